"""Mixing sources to target weights by Pareto order sampling.

Within a source, a document's expected copies grow with its length: by the power BY_LENGTH of its length class (the power of two below its number of words), as far as MOST allows, so that all expected words sum up to the source's target. The whole part of the expected copies is taken for certain. The fraction p that is left is the document's own inclusion probability: documents are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), and the first ones are taken. The sample's size is fixed in words, the measure of the targets: it is cut at the words that the whole copies leave of the target. After that cut, further documents are taken in the same order where they still fit, so that a long document at the cut leaves no gap. u is a hash of the document, so reruns agree.

No source is sorted as a whole. A rank's place in (0, 1) falls into slices, whose words are summed first; in the slice of a source's cut the words of each place are summed, and only rows that tie at the place of the cut are ranked one by one, a file block of them at most. Each cut is a bound of the rank, and what follows it, of documents that still fit, is cut in the same way until a share of NEAR is left of the target or nothing fits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import kept_table, words_pattern

#: Weights of the sources in code point order, null last, repeating (fixed by the contract), and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: The power of a document's length class that its expected copies follow.
BY_LENGTH = 0.25
#: Documents of a slice, at least.
SLICE = 128
#: The share of a target that may be missing of the words taken.
NEAR = 0.001
#: Shares of a copy below this are rounding.
_LEAST = 1e-9


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with nth, their place in code point order, null last: dealt by ranges, of which the driver only learns the sizes."""
    order = F.col("source").asc_nulls_last()
    table = kept_table(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_place", 33).cast("int")
    before, upto = [], 0
    for r in table.groupBy(part.alias("part")).count().orderBy("part").collect():
        before += [F.lit(r["part"]), F.lit(upto)]
        upto += r["count"]
    first = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return table.withColumn("nth", first + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, target from (source, source_size): shares by weight of share times all sizes, none above most times its source, the excess shared again by weight.

    With a level l, targets are least(most * size, l * weight); l is where they sum up. It is found from below: what the sources at their bound leave, by weight among the others, until no further source reaches its bound.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = _numbered(sources).withColumn("weight", w).withColumn("bound", F.col("source_size") * float(most))
    full, level = -1, 0.0
    while True:
        stopped = F.col("bound") <= F.lit(level) * F.col("weight")
        told = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(stopped, F.col("bound"))).alias("stopped"), F.sum(F.when(~stopped, F.col("weight"))).alias("open"), F.count(F.when(stopped, 1)).alias("n")).first()
        if told["n"] == full or not told["open"]:
            level = level if told["open"] else float("inf")
            break
        full, level = told["n"], (told["all"] * share - (told["stopped"] or 0.0)) / told["open"]
    met = F.least(F.col("bound"), F.lit(level) * F.col("weight")) if level < float("inf") else F.col("bound")
    return ranked.select("source", "source_size", met.alias("target"))


def _measures(doc_id: str, text: str, source: str, seed: int) -> list[Column]:
    """size in words, class of length (-1 without words), and u in (0, 1) of a row."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(words_pattern())), F.lit(0)).cast("long")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(source), F.col(text)), 12)
    length = F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(F.lit(-1))
    return [size.alias("size"), length.cast("int").alias("length"), ((bits + 0.5) / float(1 << 52)).alias("u")]


def measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """A row number, doc_id, source, the size in words, the class of length and a number u in (0, 1) for each row."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *_measures(doc_id, text, source, seed))


def _same(a: DataFrame, b: DataFrame, how: str = "inner", *also: str) -> DataFrame:
    """a joined with b, a row for each of b's sources (and other columns of the same name in both); null is a source."""
    keys = ["source", *also]
    other = b.withColumnsRenamed({c: f"_{c}" for c in keys})
    on = reduce(lambda x, y: x & y, (a[c].eqNullSafe(other[f"_{c}"]) for c in keys))
    return a.join(other, on, how).drop(*(f"_{c}" for c in keys))


def inclusion(classes: DataFrame, most: float = MOST, by_length: float = BY_LENGTH) -> DataFrame:
    """classes (source, length, words, target, and what else they have), a row for each class of length of a source, with certain and p: whole copies, and the share of one more."""
    g = F.pow(F.lit(2.0), F.lit(float(by_length)) * F.greatest("length", F.lit(0)))
    known = classes.withColumn("g", g).withColumn("weight", F.col("g") * F.col("words")).withColumn("bound", F.col("words") * float(most))
    by_room = Window.partitionBy("source").orderBy(F.desc("g"), "length")  # a class each: 64 at most
    every = Window.partitionBy("source")
    before = F.coalesce(F.sum("bound").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    tried = known.withColumn("level", F.when(after > 0, (F.col("target") - before) / after))
    fits = F.col("level") * F.col("g") <= float(most) + _LEAST
    found = tried.withColumn("level", F.min(F.when(fits & (F.col("words") > 0), F.struct(-F.col("g"), "level"))).over(every)["level"])
    copies = F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("g"), F.lit(float(most))))).otherwise(F.lit(0.0))
    certain = F.floor(copies + _LEAST)
    p = F.greatest(copies - certain, F.lit(0.0))
    return found.select(*classes.columns, certain.alias("certain"), F.when(p < _LEAST, F.lit(0.0)).otherwise(p).alias("p"))


def _ranked(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """rows with source_size, target, certain and v, the place in (0, 1) of their random odds over their inclusion odds; null for documents that have all copies they may."""
    p = F.greatest("p", F.lit(_LEAST))
    odds = F.col("u") * (1 - p)
    v = F.when(F.col("certain") < most, odds / (odds + (1 - F.col("u")) * p))
    return _same(rows, plan, "left", "length").withColumn("v", v).drop("p")


def _cuts(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """source, slice, low, high, most, gap, target, ends and tied from (source, low, most, gap, target): up to which place, in the order of places after low, documents of at most `most` words fill the gap, and the gap that is then left; ends where all of them fit. Where several rows of a file block share the place of the cut they are tied, and high stands before them."""
    open_ = (F.col("size") > 0) & (F.col("size") <= F.col("most")) & (F.struct("v", "_row") > F.col("low"))
    fields = ["low", "most", "gap", "target"]
    carried = [F.first(c).alias(c) for c in fields]
    by_slice = _same(ranked, state).where(open_).groupBy("source", "slice").agg(F.sum("size").alias("words"), *carried)
    walked = by_slice.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("slice")))
    first = F.min(F.when(F.col("upto") > F.col("gap"), F.struct("slice", (F.col("gap") - F.col("upto") + F.col("words")).alias("left"))))
    cut = kept_table(walked.groupBy("source").agg(*carried, first.alias("cut"), F.sum("words").alias("words")), "cuts")
    end = F.struct(F.lit(2.0).alias("v"), F.lit(0).cast("long").alias("_row"))
    ended = cut.where("cut IS NULL").select("source", F.lit(None).cast("long").alias("slice"), "low", end.alias("high"), "most", (F.col("gap") - F.col("words")).alias("gap"), "target", F.lit(True).alias("ends"), F.lit(False).alias("tied"))
    at = cut.where("cut IS NOT NULL").select("source", F.col("cut.slice").alias("slice"), F.col("cut.left").alias("left"), *fields)
    inside = _same(ranked, at, "inner", "slice").where(open_)
    by_place = inside.groupBy("source", "v", F.shiftright("_row", 33).alias("part")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("_row").alias("_row"), *(F.first(c).alias(c) for c in ("slice", "left")), *carried)
    walked = by_place.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("v", "part")))
    here = F.struct("v", "_row", "n", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))
    spot = F.min(F.when(F.col("upto") > F.col("left"), here))
    found = walked.groupBy("source").agg(F.first("slice").alias("slice"), *carried, spot.alias("spot"))
    high = F.struct(F.col("spot.v").alias("v"), (F.col("spot._row") - 1).alias("_row"))
    return found.select("source", "slice", "low", high.alias("high"), "most", F.col("spot.left").alias("gap"), "target", F.lit(False).alias("ends"), (F.col("spot.n") > 1).alias("tied")).unionByName(ended)


def _untied(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts in which the tied rows after high are taken one by one as long as they fit."""
    at = cuts.where("tied").select("source", "slice", "high", "most", "gap")
    may = (F.col("size") > 0) & (F.col("size") <= F.col("most"))
    after = (F.col("v") == F.col("high.v")) & (F.col("_row") > F.col("high._row")) & (F.shiftright("_row", 33) == F.shiftright(F.col("high._row") + 1, 33))
    ties = _same(ranked, at, "inner", "slice").where(may & after)
    walked = ties.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)))
    last = walked.where(F.col("upto") <= F.col("gap")).groupBy("source").agg(F.max("_row").alias("last"), F.sum("size").alias("taken"))
    high = F.struct(F.col("high.v").alias("v"), F.coalesce("last", "high._row").alias("_row"))
    return _same(cuts, last, "left").select("source", "slice", "low", high.alias("high"), "most", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"), "target", "ends", F.lit(False).alias("tied"))


def _draw(docs: DataFrame, doc_id: str, text: str, source: str, weights: Sequence[float], most: float, share: float, seed: int, by_length: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The measured rows, the plan (a row for each class of length of a source) and the cuts (a row for each source): all that decides how often a document is taken."""
    rows = kept_table(measured(docs, doc_id, text, source, seed), "sizes")
    classes = kept_table(rows.groupBy("source", "length").agg(F.sum("size").alias("words")), "classes")
    sources = kept_table(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most, share), "targets")
    plan = kept_table(inclusion(_same(classes, sources), most, by_length).select("source", "length", "words", "source_size", "target", "certain", "p"), "plan")
    n = rows.count()
    slices = max(1, n // max(SLICE, int(n**0.5)))
    slim = plan.select("source", "length", "certain", "p")
    ranked = kept_table(_ranked(rows, slim, most).where("v IS NOT NULL").select("source", "v", "_row", "size", F.floor(F.col("v") * slices).alias("slice")), "ranked")
    start = F.struct(F.lit(-1.0).alias("v"), F.lit(0).cast("long").alias("_row"))
    gap = F.first("target") - F.sum(F.col("certain") * F.col("words"))
    state = kept_table(plan.groupBy("source").agg(gap.alias("gap"), F.first("target").alias("target")).where(F.col("gap") > _LEAST).select("source", start.alias("low"), F.lit(1 << 62).alias("most"), "gap", "target"), "gaps")
    found = []
    while not state.isEmpty():
        cuts = kept_table(_cuts(ranked, state), "cuts")
        if not cuts.where("tied").isEmpty():
            cuts = kept_table(_untied(ranked, cuts), "cuts")
        found.append(cuts.select("source", F.struct("low", "high", "most").alias("cut")))
        state = cuts.where(~F.col("ends") & (F.col("gap") >= 1) & (F.col("gap") > NEAR * F.col("target"))).select("source", F.col("high").alias("low"), F.floor("gap").alias("most"), "gap", "target")
    every = reduce(DataFrame.unionByName, found, plan.where("false").select("source", F.struct(start.alias("low"), start.alias("high"), F.lit(1 << 62).alias("most")).alias("cut")))
    return rows, plan.drop("words"), kept_table(every.groupBy("source").agg(F.collect_list("cut").alias("cuts")), "all-cuts")


def _copied(rows: DataFrame, plan: DataFrame, cuts: DataFrame, most: float) -> DataFrame:
    """rows with source_size, target and copies."""
    ranked = _same(_ranked(rows, plan, most), cuts, "left")
    place = F.struct("v", "_row")
    drawn = F.exists(F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)), lambda c: (place > c["low"]) & (place <= c["high"]) & (F.col("size") <= c["most"]))
    return ranked.withColumn("copies", (F.col("certain") + F.coalesce((F.col("v").isNotNull() & drawn).cast("long"), F.lit(0))).cast("long"))


def pareto_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = 42, by_length: float = BY_LENGTH) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of docs, rows with no copy too.

    A size is the number of words; null and empty texts have 0, take no words, and are drawn like documents of one word. Documents with a null source form a source of their own, the last. Rows that repeat are drawn each on its own; rows that tie in every column share their rank, and a cut falls between them. A source of size 0 has target 0 and no copies. Other columns of docs play no part, whatever their names. An empty table gives no rows.
    """
    out = _copied(*_draw(docs, doc_id, text, source, weights, most, share, seed, by_length), most)
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = 42, by_length: float = BY_LENGTH) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix copies it.

    What decides is small and joined to the rows, which are read once more and not shuffled. Nulls, empty texts and ties as in pareto_mix(); rows that repeat are each copied, a row of a name of ours is no row number; an empty table gives no rows.
    """
    _, plan, cuts = _draw(docs, doc_id, text, source, weights, most, share, seed, by_length)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    rows = docs.select(whole, F.monotonically_increasing_id().alias("_row"), F.col(source).alias("source"), *_measures(doc_id, text, source, seed))
    copied = _copied(rows, plan, cuts, most).where("copies > 0")
    return copied.select("_all", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_all.*")
