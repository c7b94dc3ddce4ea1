"""The pipeline's stages and run against what the operators' brute force gives, and the registered queries."""

import importlib.util
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.functions import store
from tidelog.llm import catalog, decontam, langid, mixing, simhash
from tidelog.llm.common import kept_table

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = kept_table(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_work_on_what_is_left(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _, _ in stages] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "token-ID output"]
    assert all(after.columns == columns for _, _, after in stages[:-1])
    (_, d0, a0), (_, d1, a1), (_, d2, a2), (_, d3, a3), (_, d4, a4) = stages
    told = langid.identify(d0.select("doc_id", "text"), langid.train(d0.where(~langid.held_out())))
    assert ids(a0) == ids(told.where("lang_pred != 'und' AND known >= 0.2"))
    linked = simhash.near_dedup(d1)
    assert ids(linked) == sorted({r["component_id"] for r in simhash.simhash_components(d1).collect()})
    assert ids(a1) == ids(simhash.similar_dedup(linked)) and set(ids(a1)) <= set(ids(linked))
    marked = decontam.decontaminate(d2, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(a2) == ids(marked.where("size(hits) = 0")) and a2.count() < d2.count()
    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(d3).collect()}
    assert ids(a3) == sorted(d for d, n in copies.items() for _ in range(n))
    assert ids(a4) == ids(d4)


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(k)) for k in range(files.size()) if "/shuffle_" in str(files.apply(k)) and str(files.apply(k)).endswith(".data")}


def test_near_copies_leave_little_on_disk(spark):
    """Of the tables between, the keys of the rows that stay; shuffle files go with the write that needed them."""
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), {*store._made}
    corpus_pipeline.near_copies(spark, docs, SF)
    made = {*store._made} - before
    assert len(made) == 1 and spark.read.parquet(*made).columns == ["a", "b"]
    there = shuffled(spark)
    store.stored(docs.repartition(3, "doc_id"), "dealt")
    ends = time.monotonic() + 20
    while shuffled(spark) - there and time.monotonic() < ends:
        time.sleep(0.1)
    assert not shuffled(spark) - there


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1][2])


def test_run_on_odd_rows(spark, odd, nothing, tmp_path):
    """Nulls in every column, empty and very long texts, ties, rows that repeat, names of ours; an empty table; a folder that is told and stays."""
    from tidelog.functions import store

    for k, docs in enumerate((odd.withColumn("_key", F.lit("mine")).withColumn("cuts", F.lit(1)), nothing)):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([(1, "other text with the same id and so on to ten words"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        spark.conf.set(corpus_pipeline.TOKENS, f"file://{tmp_path}/tokens{k}")
        before = {*store._made}
        try:
            rows = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        finally:
            spark.conf.unset(corpus_pipeline.TOKENS)
        assert {r["doc_id"] for r in rows} <= {4, 6, 7, 8, 9} and bool(rows) == (k == 0)
        assert (tmp_path / f"tokens{k}" / "manifest").is_dir()
        assert not [p for p in store._made if p not in before and ("-language-" in p or "-simhash-" in p or "-prints-" in p)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, told = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(told.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[told.columns.index(c)] for c in order) for r in told.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_answer_every_row(spark, name):
    table = "pages" if name.startswith("op10_") else "documents"
    assert catalog.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_entry_has_them_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {f"{n.split('_')[0]}_" for n in names} and "pipeline" in names
    assert importlib.util.find_spec("tidelog.plans")
