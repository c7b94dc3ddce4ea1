"""A source of log files: opened, detected, folded, merged, queried."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.store import drop, numbered, stored
from tidelog.functions.timestamps import local_zone
from tidelog.operators import diagnostics, facets, fold, merge, results
from tidelog.plans.compiler import CompiledQuery, Facet, Shape, compile_query
from tidelog.sources import adapters
from tidelog.sources.lines import File, _escaped, lines, raw_lines
from tidelog.sources.profiles import Profile, Registry

Progress = Callable[[str, int, int], None]
PHASES = ("Converting", "Detecting", "Indexing", "Merging")


class NoMatchingProfile(ValueError):
    """No format explains the file; says which were tried."""

    def __init__(self, file: str, tried: Sequence[str]) -> None:
        super().__init__(f"'{file}' is written in none of the formats that were tried ({', '.join(tried)}); a profile in the user folder can describe another")


@dataclass(frozen=True)
class Match:
    profile: Profile
    score: float
    entries: int
    filename_agrees: bool


def _listed(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, int]]:
    """Path to name and size of the files that the paths name."""
    out: dict[str, tuple[str, int]] = {}
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        status = store.getFileStatus(where)
        found = sorted(store.listStatus(where), key=lambda s: s.getPath().getName()) if status.isDirectory() else [status]
        for s in found:
            name, full = s.getPath().getName(), s.getPath().toString()
            if s.isFile() and (not status.isDirectory() or (s.getLen() > 0 and not name.startswith("."))):
                out.setdefault(full.replace("file:/", "/", 1) if full.startswith("file:/") else full, (name, s.getLen()))
    return out


def expand(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(name, path) of the files that the paths name: of a folder the files in it by name, without empty and hidden ones."""
    return [(name, path) for path, (name, _) in _listed(spark, paths).items()]


#: Bytes of a file that its sample is taken from, at most, and those that are read at once.
SAMPLED, AT_ONCE = 16 << 20, 1 << 16


def heads(spark: SparkSession, files: Sequence[File], n: int) -> DataFrame:
    """file_id, adapter (the format of the container that claims the file, if any), line_no (from 1) and text of the first lines of each file: one job for all files.

    A file has one row at least. line_no is null where a store can't be read from Python; then the driver reads the head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    data = b""
                    with store.open_input_stream(where) as source:
                        while len(data) < SAMPLED and data.count(b"\n") < n and (piece := source.read(AT_ONCE)):
                            data += piece
                    adapter = adapters.claiming(adapters.sniffed(data))
                    rows = [x.decode("utf-8", "replace").removesuffix("\r") for x in data.split(b"\n")[: n if data.count(b"\n") >= n else None]]
                    rows = rows[:-1] if rows[-1] == "" and len(rows) > 1 else rows
                    places = list(range(1, len(rows) + 1))
                except (OSError, ValueError, pa.ArrowException):
                    adapter, rows, places = None, [""], [None]
                size = len(rows)
                yield pa.RecordBatch.from_pydict({"file_id": pa.array([file_id] * size, pa.int32()), "adapter": pa.array([adapter.profile if adapter else None] * size, pa.string()), "line_no": pa.array(places, pa.int32()), "text": pa.array(rows, pa.string())})

    listed = spark.createDataFrame([(f.file_id, f.path) for f in files], "file_id int, path string")
    parts = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    return listed.repartition(max(1, parts)).mapInArrow(run, "file_id int, adapter string, line_no int, text string")


def head(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a file."""
    name = path.rsplit("/", 1)[-1]
    if name.startswith(("_", ".")):
        rows = raw_lines(spark, [File(0, name, path)]).orderBy("block", "at").limit(n).collect()
        return [r["raw"].removesuffix("\r") for r in rows]
    return [r["value"].removesuffix("\r") for r in spark.read.option("lineSep", "\n").text(_escaped(path)).head(n)]


def scores(sample: DataFrame, profiles: Sequence[Profile]) -> dict[tuple[int, str], tuple[float, int]]:
    """(file, profile) to the share of the file's sample (file_id, line_no, text) that the profile accounts for and the entries it opens there: one job for all."""
    if not profiles:
        return {}
    aggs = []
    for k, p in enumerate(profiles):
        inside = F.col("line_no") <= p.sample
        aggs += [F.avg(F.when(inside, p.accounts(F.col("text")).cast("double"))).alias(f"s{k}"), F.count(F.when(inside & p.parses(F.col("text")), 1)).alias(f"e{k}")]
    out = {}
    for r in sample.groupBy("file_id").agg(*aggs).collect():  # a row for each file
        for k, p in enumerate(profiles):
            out[r["file_id"], p.name] = (r[f"s{k}"] or 0.0, r[f"e{k}"])
    return out


def detect(spark: SparkSession, path: str, registry: Registry) -> list[Match]:
    """The profiles that explain enough of a file, the best first: by score, then by priority, then as registered."""
    sample = head(spark, path, max((p.sample for p in registry.profiles), default=0))
    found = scores(spark.createDataFrame([(0, k + 1, x) for k, x in enumerate(sample)], "file_id int, line_no int, text string"), registry.profiles)
    name = path.rsplit("/", 1)[-1]
    matches = [Match(p, *found.get((0, p.name), (0.0, 0)), _names(p, name)) for p in registry.profiles]
    return sorted((m for m in matches if m.score >= m.profile.min_match), key=lambda m: (-m.score, -m.profile.priority))


def _names(profile: Profile, name: str) -> bool:
    import re

    return bool(profile.filename and re.fullmatch(profile.filename, name))


@dataclass
class Results:
    """What a query selects: ordered matches with their places, and the counts around them."""

    query: CompiledQuery
    df: DataFrame
    source: Source
    _count: int | None = None

    @property
    def problems(self) -> list[str]:
        return self.query.problems

    @property
    def count(self) -> int:
        if self._count is None:
            self._count = self.df.count()
        return self._count

    @property
    def window(self) -> tuple[int | None, int | None]:
        return self.query.since, self.query.until

    def is_stale(self, current: str) -> bool:
        return current != self.query.query

    def page(self, first: int, size: int) -> DataFrame:
        return results.page(self.df, first, size)

    def position_of(self, entry_id: int) -> int:
        return results.position_of(self.df, entry_id)

    def counts(self, buckets: int = results.BUCKETS) -> DataFrame:
        return facets.sidebar(self.source.entries, self.query, self.source.facets, *self.source.bounds, buckets)

    def top(self, facet: str, **how) -> tuple[DataFrame, int]:
        mode = next(f.mode for f in self.source.facets if f.name == facet)
        return facets.top_values(self.source.dictionary(facet), facets.facet_counts(self.source.entries, self.query, facet), mode=mode, **how)

    def copy(self, selection: results.Selection, cap: int = results.COPY_CAP) -> tuple[str, str | None]:
        return results.copy(self.df, selection, cap)

    def export(self, path: str, progress: Callable[[int], None] | None = None, single: bool = False) -> int:
        return results.export(self.df, path, progress, single)

    def days(self) -> DataFrame:
        return results.day_changes(self.df, self.source.zone)


@dataclass
class Source:
    """An opened set of files."""

    spark: SparkSession
    paths: list[str]
    profile: Profile
    detection: Match
    files: list[File]
    entries: DataFrame
    lines: DataFrame
    zone: str
    skipped: list[tuple[str, str]] = field(default_factory=list)
    converted: dict[str, str] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)
    elapsed: float = 0.0
    _tables: list[str] = field(default_factory=list)
    _registry: Registry | None = None
    _stats: dict | None = None

    @property
    def facets(self) -> list[Facet]:
        return [*self.profile.facets, *([Facet("file", "File")] if len(self.files) > 1 else [])]

    @property
    def stats(self) -> dict:
        """Counts of lines by kind, of entries by level, and the time span; asked once."""
        if self._stats is None:
            kinds = {r["kind"]: r["n"] for r in fold.counters(self.lines).collect()}
            levels = {r["level_ord"]: r["n"] for r in self.entries.groupBy("level_ord").agg(F.count(F.lit(1)).alias("n")).collect()}
            span = self.entries.agg(F.coalesce(F.min("ts_ms"), F.lit(0)).alias("a"), F.coalesce(F.max("ts_ms"), F.lit(0)).alias("b")).first()
            total = sum(kinds.values())
            self._stats = {"lines": total, "entries": sum(levels.values()), "first_ms": span["a"], "last_ms": span["b"], "levels": levels, "kinds": kinds, "recognised": fold.recognised_ratio(total, kinds.get(fold.UNRECOGNISED, 0))}
        return self._stats

    @property
    def bounds(self) -> tuple[int, int]:
        return self.stats["first_ms"], self.stats["last_ms"]

    @property
    def shape(self) -> Shape:
        asked = Shape.of(self.entries, self.facets, self.profile.levels or None, self.zone)
        return Shape(asked.facets, asked.levels, asked.zone, lambda: self.bounds, asked.found)

    def compile(self, query: str) -> CompiledQuery:
        return compile_query(query, self.shape)

    def query(self, text: str) -> Results:
        compiled = self.compile(text)
        return Results(compiled, results.with_positions(compiled.select(self.entries)), self)

    def context(self, entry_id: int, radius: int = results.CONTEXT) -> DataFrame:
        return results.neighbourhood(self.entries, entry_id, radius)

    def render(self, entry_id: int) -> tuple[str, list[str]]:
        """The message and the lines after it."""
        row = self.entries.where(F.col("entry_id") == entry_id).select("message", "continuations").first()
        return row["message"], row["continuations"]

    def detail(self, entry_id: int) -> dict[str, str]:
        row = self.entries.where(F.col("entry_id") == entry_id).first().asDict()
        out = {"Time": str(row["ts"]), "Level": self.profile.level_labels.get(row["level"], row["level"]) or "?"}
        return out | {f.label: "none" if row[f.name] is None else row[f.name] for f in self.facets} | {"File": row["file"]}

    def dictionary(self, facet: str) -> DataFrame:
        return facets.dictionary(self.entries, facet, ["entry_id"])

    def timeline(self, buckets: int = results.BUCKETS) -> DataFrame:
        return facets.histogram(self.entries, *self.bounds, buckets)

    def unrecognised(self) -> tuple[DataFrame, DataFrame]:
        found = diagnostics.unrecognised(self.lines, self.profile)
        return diagnostics.shape_counts(found), diagnostics.shape_samples(found)

    def report(self) -> str:
        counts, samples = self.unrecognised()
        return diagnostics.report([(r["shape"], r["n"]) for r in counts.collect()], [(r["shape"], r["file"], r["line_no"], r["sample"]) for r in samples.orderBy("shape", "file_id", "line_no").collect()])

    def health(self) -> dict:
        s = self.stats
        return {"lines": s["lines"], "recognised": s["lines"] - s["kinds"].get(fold.UNRECOGNISED, 0), "folded": s["kinds"].get(fold.CONTINUATION, 0), "ms": round(self.elapsed * 1000), "problems": self.problems}

    def summary(self) -> dict:
        return {"files": [f.name for f in self.files], "entries": self.stats["entries"], "ms": round(self.elapsed * 1000), "skipped": self.skipped, "profile": self.profile.name, "score": f"{int(self.detection.score * 100)} %", "converted": self.converted}

    def footprint(self) -> dict:
        """Bytes of the stored entries, all and for each entry."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._tables[-1])
        size = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        return {"bytes": size, "bytes_per_entry": size / max(1, self.stats["entries"])}

    def add(self, paths: Sequence[str]) -> Source:
        """A source of these files too; a path that is there already counts once."""
        return open_source(self.spark, list(dict.fromkeys([*self.paths, *paths])), self._registry, self.zone)

    def close(self) -> None:
        """Deletes the source's tables."""
        for path in self._tables:
            drop(self.spark, path)
        self._tables.clear()


def open_source(spark: SparkSession, paths: Sequence[str], registry: Registry | None = None, zone: str | None = None, now: datetime | None = None, progress: Progress | None = None) -> Source:
    """Opens files and folders as one source.

    The largest file decides the format; files that it doesn't explain are skipped and told. zone is what the files' local times mean.
    """
    began, zone = time.time(), zone or local_zone()
    registry = registry or Registry.bundled_plus_user(zone=zone, now=now)
    tell = progress or (lambda phase, done, total: None)
    listed = _listed(spark, paths)
    if not listed:
        raise FileNotFoundError(f"no file to read in {', '.join(paths)}")
    own = {a.profile for a in adapters.ADAPTERS}
    files = [File(k, name, path) for k, (path, (name, _)) in enumerate(listed.items())]
    most = max(p.sample for p in registry.profiles)
    tell("Converting", 0, len(files))
    sample, first = stored(heads(spark, files, most), "heads")
    claimed = {r["file_id"]: r["adapter"] for r in sample.where("line_no = 1 AND adapter IS NOT NULL").select("file_id", "adapter").collect()}
    sample = sample.where("adapter IS NULL AND line_no IS NOT NULL").select("file_id", "line_no", "text")
    texts, pinned, converted, made_at = {}, {}, {}, []
    for r in spark.read.parquet(first).where("line_no IS NULL").select("file_id").collect():  # of a store that only Spark reads
        file = files[r["file_id"]]
        if adapter := adapters.claiming(adapters.first_line(spark, file.path)):
            claimed[file.file_id] = adapter.profile
        else:
            sample = sample.unionByName(spark.createDataFrame([(file.file_id, k + 1, x) for k, x in enumerate(head(spark, file.path, most))], "file_id int, line_no int, text string"))
    for done, (k, name) in enumerate(claimed.items()):
        tell("Converting", done, len(claimed))
        made = next(a for a in adapters.ADAPTERS if a.profile == name).convert(spark, files[k], zone)
        texts[k], pinned[k], converted[files[k].name] = made.lines, name, made.note
        made_at += [made.path] if made.path else []
        sample = sample.unionByName(made.lines.where(F.col("line_no") <= most).select("file_id", F.col("line_no").cast("int").alias("line_no"), "text"))
    tell("Converting", len(claimed), len(claimed))
    tell("Detecting", 0, len(files))
    size = {f.file_id: listed[f.path][1] for f in files}
    largest = max(files, key=lambda f: (size[f.file_id], -f.file_id))
    found = scores(sample, registry.profiles)
    drop(spark, first)
    tell("Detecting", len(files), len(files))
    if largest.file_id in pinned:
        profile = registry.named(pinned[largest.file_id])
        score = found.get((largest.file_id, profile.name), (0.0, 0)) if profile else (0.0, 0)
        if profile is None or score[0] < profile.min_match:
            raise NoMatchingProfile(largest.name, [pinned[largest.file_id]])
        best = Match(profile, *score, _names(profile, largest.name))
    else:
        open_to = registry.excluding(own)
        matches = [Match(p, *found.get((largest.file_id, p.name), (0.0, 0)), _names(p, largest.name)) for p in open_to.profiles]
        good = sorted((m for m in matches if m.score >= m.profile.min_match), key=lambda m: (-m.score, -m.profile.priority))
        if not good:
            raise NoMatchingProfile(largest.name, [p.name for p in open_to.profiles])
        best = good[0]
    profile = best.profile
    fits = lambda f: f is largest or found.get((f.file_id, profile.name), (0.0, 0))[0] >= profile.min_match
    skipped = [(f.name, f"not recognised by {profile.name}") for f in files if not fits(f)]
    accepted = sorted((f for f in files if fits(f)), key=lambda f: f.name)
    if len({f.name for f in accepted}) < len(accepted):  # the file facet tells files apart by name
        accepted = [File(f.file_id, f.path if sum(g.name == f.name for g in accepted) > 1 else f.name, f.path) for f in accepted]
    tell("Indexing", 0, len(accepted))
    order = {f.file_id: k for k, f in enumerate(accepted)}
    parts = [lines(spark, [File(order[f.file_id], f.name, f.path) for f in accepted if f.file_id not in texts])] if any(f.file_id not in texts for f in accepted) else []
    parts += [texts[f.file_id].withColumn("file_id", F.lit(order[f.file_id])).withColumn("file", F.lit(f.name)) for f in accepted if f.file_id in texts]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    read, at = stored(fold.parsed(every, profile), "lines")
    for path in made_at:
        drop(spark, path)
    classified = fold.classify_parsed(read, profile)
    tell("Indexing", len(accepted), len(accepted))
    tell("Merging", 0, len(accepted))
    entries, where = _merged(read, fold.fold(classified, profile))
    tell("Merging", len(accepted), len(accepted))
    return Source(spark, list(listed), profile, best, [File(order[f.file_id], f.name, f.path) for f in accepted], entries, classified, zone, skipped, converted, [*registry.problems], time.time() - began, [at, where], registry)


def _merged(read: DataFrame, folded: DataFrame) -> tuple[DataFrame, str]:
    """Entries with entry_id, their place in the merged stream, on a table, and its path. Files that follow one another in time need no merge: a file's entries stand behind those of the files before."""
    spark = read.sparkSession
    spans = read.groupBy("file_id").agg(F.count("_ms").alias("n"), F.min("_ms").alias("low"), F.max("_ms").alias("high")).where("n > 0").orderBy("low", "file_id").collect()  # a row for each file
    if all(a["high"] < b["low"] or (a["high"] == b["low"] and a["file_id"] < b["file_id"]) for a, b in zip(spans, spans[1:], strict=False)):
        starts, upto = [], 0
        for r in spans:
            starts.append((r["file_id"], upto))
            upto += r["n"]
        known = spark.createDataFrame(starts, "file_id int, _start long")
        placed = folded.join(known, "file_id").withColumn("entry_id", F.col("_start") + F.col("seq") - 1).drop("_start")
        return stored(placed, "entries")
    once, path = stored(folded, "folded")
    entries, where = numbered(merge.merge_time(once), merge.MERGE_KEYS, "entries", cheap=True)
    drop(spark, path)
    return entries.drop("merge_ms"), where
