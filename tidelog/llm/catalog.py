"""The queries of this folder and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, exact_dedup, html_extract, langid, line_template, mixing, quality, simhash, suffix_dedup, token_output
from tidelog.llm.common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at the contract's weights."""
    return mixing.pareto_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text repeats elsewhere, and a digest of what is left."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of near copies."""
    marked = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of which benchmark items."""
    return decontam.digest(decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_line_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document recur, and a digest of what is left."""
    left = line_template.drop_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every text."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of token ids hold, read back; they are for this report only and go with the driver."""
    return token_output.token_output(spark, _table(spark, sf_dir, "documents"), token_output.tokenizer_path(), folder=fresh_path(spark, "tokens"))[0]


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_pareto_mix, op2_language_id, op3_suffix_dedup, op4_simhash, op5_decontaminate, op6_line_template, op7_quality, op8_exact_dedup, op9_token_output, op10_html_extract)}

ORACLES = {
    "op5_decontaminate": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM iw WHERE len(w) > 0)),
        widths AS (SELECT DISTINCT n FROM windows),
        spots AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, widths WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, k, n FROM spots JOIN windows USING (n, win)),
        counts AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN counts USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_line_template": r"""
        WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        raw AS (SELECT doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        marks AS (SELECT doc_id, pos, line, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ')] AS t FROM raw),
        placed AS (SELECT *, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS masked FROM marks WHERE t != ['']),
        seen AS (SELECT leaf, masked, any_value(t) AS t, count(DISTINCT doc_id) AS n_docs FROM placed GROUP BY leaf, masked),
        tokens AS (SELECT leaf, masked, n_docs, unnest(t) AS token, unnest(range(len(t))) AS k FROM seen),
        fixed AS (SELECT leaf, k, token FROM tokens GROUP BY leaf, k, token HAVING sum(n_docs) >= 5),
        kept AS (SELECT t.leaf, t.masked, t.k, t.token, t.token != '<*>' AND (t.k < 3 OR f.token IS NOT NULL) AS keeps FROM tokens t LEFT JOIN fixed f ON t.leaf = f.leaf AND t.k = f.k AND t.token = f.token),
        formed AS (SELECT leaf, masked, string_agg(CASE WHEN keeps THEN token ELSE '<*>' END, ' ' ORDER BY k) AS template, avg(keeps::INT) AS share FROM kept GROUP BY leaf, masked),
        recurring AS (SELECT f.leaf, f.template FROM formed f JOIN placed p USING (leaf, masked) WHERE share >= 0.6 GROUP BY f.leaf, f.template HAVING count(DISTINCT p.doc_id) >= 5),
        gone AS (SELECT leaf, masked FROM formed JOIN recurring USING (leaf, template) WHERE share >= 0.6),
        marked AS (SELECT l.doc_id, l.pos, l.line, g.masked IS NOT NULL AS gone_line FROM marks l LEFT JOIN placed p USING (doc_id, pos) LEFT JOIN gone g ON p.leaf = g.leaf AND p.masked = g.masked)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone_line) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone_line), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
}
