"""What could not be explained: unrecognised lines by shape, with samples, and the health of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.fold import UNRECOGNISED
from tidelog.sources.profiles import Profile

SAMPLES, SAMPLE_BYTES = 5, 240

#: Shapes of an unrecognised line: label and meaning.
SHAPES = {
    "Empty": ("Empty line", "Nothing stands on the line."),
    "NearEntry": ("Almost an entry", "It starts like an entry, but the rest does not fit the format's pattern."),
    "Blank": ("Blank line", "Only spaces and tabs stand on the line."),
    "NearContinuation": ("Indented line", "It is indented, but not as the format continues an entry, or no entry was open."),
    "Other": ("Anything else", "Nothing in the format explains it."),
}


def shape(text: Column, profile: Profile) -> Column:
    near = profile.opens.column(text) if profile.opens else F.lit(False)
    return F.when(text == "", "Empty").when(near, "NearEntry").when(text.rlike(r"\A[ \t\r]*\z"), "Blank").when(text.rlike(r"\A[ \t]"), "NearContinuation").otherwise("Other")


def unrecognised(classified: DataFrame, profile: Profile) -> DataFrame:
    return classified.where(F.col("kind") == UNRECOGNISED).withColumn("shape", shape(F.col("text"), profile))


def shape_counts(found: DataFrame) -> DataFrame:
    """shape and n, the most frequent first; shapes without a line are not listed."""
    return found.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape")


def shape_samples(found: DataFrame, samples: int = SAMPLES, size: int = SAMPLE_BYTES) -> DataFrame:
    """The first lines of each shape, in file order: shape, file, line_no, sample (its first bytes). Spark limits the ranks before it shuffles."""
    cut = F.make_valid_utf8(F.substring(F.col("text").cast("binary"), 1, size).cast("string"))
    by_shape = Window.partitionBy("shape").orderBy("file_id", "line_no")
    return found.withColumn("_nth", F.row_number().over(by_shape)).where(F.col("_nth") <= samples).select("shape", "file_id", "file", "line_no", cut.alias("sample"))


def report(counts: list[tuple[str, int]], samples: list[tuple[str, str, int, str]]) -> str:
    """The report in words: a paragraph for each shape, its samples as file:line."""
    out = []
    for name, n in counts:
        label, meaning = SHAPES[name]
        out.append(f"{label}: {n}. {meaning}")
        out += [f"  {file}:{line}  {text}" for s, file, line, text in samples if s == name]
    return "\n".join(out)
