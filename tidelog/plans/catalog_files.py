"""Registered queries over files: tables written as logs, opened, queried, exported; and the parts that need no table."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import text as texts
from tidelog.functions.store import fresh_path
from tidelog.functions.timestamps import TimestampFormat
from tidelog.operators import facets, results
from tidelog.plans import edits
from tidelog.plans.catalog import _E, EVENT_FACETS, EVENT_LEVELS, _event_lines, _table, events, registered
from tidelog.plans.compiler import Shape, compile_query
from tidelog.plans.engine import Source, open_source
from tidelog.sources.canonical import INDENT
from tidelog.sources.profiles import Registry, bundled_names, copy_template
from tidelog.sources.tables import epoch_millis


def _file(lines: DataFrame, order: list[str], folder: str, name: str) -> str:
    """The column raw as one text file, and its path."""
    spark = lines.sparkSession
    lines.repartition(1).sortWithinPartitions(*order).select("raw").write.text(f"{folder}/{name}.made")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in store.listStatus(path(f"{folder}/{name}.made")) if s.getPath().getName().startswith("part-"))
    store.rename(part, path(f"{folder}/{name}"))
    store.delete(path(f"{folder}/{name}.made"), True)
    return f"{folder}/{name}"


def _days(spark: SparkSession, sf: str, several: bool = True) -> Source:
    """Events as three files that interleave in time, beside one that no format explains; or all in one file."""
    folder = fresh_path(spark, "files")
    lines = _event_lines(spark, sf)
    if not several:
        return open_source(spark, [_file(lines, ["at"], folder, "all")], Registry.bundled("UTC"), "UTC")
    for k in range(3):
        _file(lines.where(F.col("at") % 3 == k), ["at"], folder, f"file{k}")
    _file(spark.createDataFrame([("nothing of a log",), ("is in here",)], "raw string"), ["raw"], folder, "notes.txt")
    return open_source(spark, [folder], Registry.bundled("UTC"), "UTC")


_FILES = "WITH f AS (SELECT event_id, 'file' || event_id % 3 AS file, epoch_us(ts) // 1000 AS ts_ms, event_type, user_id, props, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line_no, (list_position(['view','click','signup','purchase','error'], event_type) - 1)::BIGINT AS level_ord FROM events), m AS (SELECT *, max(ts_ms) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS merge_ms FROM f), e AS (SELECT *, row_number() OVER (ORDER BY merge_ms, file, event_id) - 1 AS entry_id FROM m) "


@registered(_FILES + "SELECT entry_id, file, line_no, ts_ms, level_ord, 'u' || user_id AS tag, props AS message FROM e")
def opened_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of three files, opened and merged."""
    return _days(spark, sf).entries.select("entry_id", "file", "line_no", "ts_ms", F.col("level_ord").cast("long").alias("level_ord"), "tag", "message")


@registered(_FILES + "SELECT row_number() OVER (ORDER BY entry_id) - 1 AS pos, entry_id, file, props AS message FROM e WHERE level_ord >= 2 AND file IN ('file0', 'file2') AND user_id % 2 = 0 AND regexp_matches(props, ': [0-4][0-9]') ")
def opened_query(spark: SparkSession, sf: str) -> DataFrame:
    """A query over merged files, with the facet that merging adds."""
    source = _days(spark, sf)
    even = source.query("level>=I file:file0,FILE2 /: [0-4][0-9]/")
    return results.with_positions(even.query.select(source.entries).where(F.substring("tag", 2, 20).cast("long") % 2 == 0)).select("pos", "entry_id", "file", "message")


@registered(
    "SELECT 'profile' AS what, 'withings-healthmate' AS value UNION ALL SELECT 'score', '100 %' UNION ALL SELECT 'files', 'file0 file1 file2' UNION ALL SELECT 'skipped', 'notes.txt' "
    "UNION ALL SELECT 'entries', count(*)::VARCHAR FROM events UNION ALL SELECT 'lines', count(*)::VARCHAR FROM events UNION ALL SELECT 'recognised', count(*)::VARCHAR FROM events "
    "UNION ALL SELECT 'first', (min(epoch_us(ts)) // 1000)::VARCHAR FROM events UNION ALL SELECT 'last', (max(epoch_us(ts)) // 1000)::VARCHAR FROM events "
    "UNION ALL SELECT 'facets', 'category tag file' UNION ALL SELECT 'users', count(DISTINCT user_id)::VARCHAR FROM events"
)
def opened_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What opening found: format, files, counters summed over files, time span, facets."""
    source = _days(spark, sf)
    told, health = source.summary(), source.health()
    rows = {"profile": told["profile"], "score": told["score"], "files": " ".join(told["files"]), "skipped": " ".join(n for n, _ in told["skipped"]), "entries": told["entries"], "lines": health["lines"], "recognised": health["recognised"], "first": source.bounds[0], "last": source.bounds[1], "facets": " ".join(f.name for f in source.facets), "users": source.dictionary("tag").count()}
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "what string, value string")


@registered(_FILES + "SELECT row_number() OVER (ORDER BY entry_id) - 1 AS at, props FROM e WHERE level_ord = 4")
def exported_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The text that an export has written, part after part."""
    path = fresh_path(spark, "export")
    _days(spark, sf).query("level:E").export(path)
    in_file = F.struct("_metadata.file_name", F.monotonically_increasing_id())
    read = spark.read.text(path).select(in_file.alias("order"), F.substring_index("value", " -> ", -1).alias("props"))
    return read.select((F.row_number().over(Window.orderBy("order")) - 1).alias("at"), "props")  # of a report's lines


@registered(_FILES + ", r AS (SELECT props, row_number() OVER (ORDER BY entry_id) - 1 AS pos FROM e WHERE level_ord = 3) SELECT string_agg(props, '|' ORDER BY pos) AS messages, 'Copied 3 of 8 entries' AS notice FROM r WHERE pos BETWEEN 2 AND 4")
def copied_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What a copy of eight selected entries gives when three are its cap."""
    text, notice = _days(spark, sf).query("level:W").copy(results.Selection(9, 2), cap=3)
    return spark.createDataFrame([("|".join(x.split(" -> ", 1)[1] for x in text.split("\n")), notice)], "messages string, notice string")


@registered(
    "WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at, event_type, user_id, props FROM events WHERE event_id = 4) "
    "SELECT 'File' AS what, 'all' AS value FROM e UNION ALL SELECT 'Tag', 'u' || user_id FROM e UNION ALL SELECT 'Category', '' FROM e UNION ALL SELECT 'message', props FROM e UNION ALL SELECT 'position', '4' FROM e"
)
def entry_detail(spark: SparkSession, sf: str) -> DataFrame:
    """One entry as a reader sees it: its fields, its text, its place in a result."""
    source = _days(spark, sf, several=False)
    told = source.detail(4)
    message, _ = source.render(4)
    rows = [("File", told["File"]), ("Tag", told["Tag"]), ("Category", told["Category"]), ("message", message), ("position", str(source.query("").position_of(4)))]
    return spark.createDataFrame(rows, "what string, value string")


@registered(
    "SELECT event_id AS entry_id, epoch_us(ts) // 1000 AS ts_ms, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'TRACE' ELSE 'INFO' END AS level, 'shop.' || event_type AS context, props AS message, 'user=' || user_id || ' ok=' || (event_id % 2 = 0)::VARCHAR AS extras FROM events"
)
def opened_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """NDJSON with times of an offset, in UTC or in epoch seconds, levels by other names, extra keys and nested ones."""
    table = _table(spark, sf, "events")
    ms = epoch_millis(F.col("ts"), table.schema["ts"].dataType)
    utc = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    east = F.date_format(F.timestamp_millis(ms + 7_200_000), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    time = F.when(F.col("event_id") % 3 == 0, F.concat(utc, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(east, F.lit("+02:00"))).otherwise(ms.cast("string"))
    words = F.create_map(*(F.lit(x) for pair in {"error": "Severe", "click": "warning", "view": "verbose", "signup": "informational", "purchase": "odd"}.items() for x in pair))
    record = F.to_json(F.struct(time.alias("@timestamp"), words[F.col("event_type")].alias("severity"), F.col("props").alias("body"), F.concat(F.lit("shop."), "event_type").alias("logger"), F.col("user_id").alias("user"), (F.col("event_id") % 2 == 0).alias("ok"), F.struct("value").alias("nested")))
    path = _file(table.select(record.alias("raw"), F.col("event_id").alias("at")), ["at"], fresh_path(spark, "files"), "events.json")
    entries = open_source(spark, [path], Registry.bundled("UTC"), "UTC").entries
    return entries.select("entry_id", "ts_ms", "level", "context", "message", F.trim(F.element_at("continuations", -1)).alias("extras"))


@registered("SELECT event_id AS entry_id, epoch_us(ts) // 1000 AS ts_ms, CASE event_type WHEN 'error' THEN 'E' WHEN 'click' THEN 'W' WHEN 'view' THEN 'V' ELSE 'I' END AS level, user_id::VARCHAR AS pid, 'tag [' || event_type || ']' AS tag, CASE WHEN event_id % 2 = 0 THEN 'com.shop' ELSE 'com.shop:ui' END AS process, props AS message FROM events")
def opened_logcat(spark: SparkSession, sf: str) -> DataFrame:
    """A logcat export of one document, converted and opened."""
    table = _table(spark, sf, "events")
    ms = epoch_millis(F.col("ts"), table.schema["ts"].dataType)
    words = F.create_map(*(F.lit(x) for pair in {"error": "ERROR", "click": "WARN", "view": "VERBOSE"}.items() for x in pair))
    header = F.struct(F.coalesce(words[F.col("event_type")], F.lit("SOMETHING")).alias("logLevel"), F.col("user_id").alias("pid"), F.lit(7).alias("tid"), F.when(F.col("event_id") % 2 == 0, F.lit("com.shop")).otherwise(F.lit("")).alias("applicationId"), F.lit("com.shop:ui").alias("processName"), F.concat(F.lit("tag ["), "event_type", F.lit("]")).alias("tag"), F.struct(F.floor(ms / 1000).alias("seconds"), (ms % 1000 * 1_000_000 + 517).alias("nanos")).alias("timestamp"))
    record = F.concat(F.when(F.col("event_id") == 0, F.lit("")).otherwise(F.lit(",")), F.to_json(F.struct(header.alias("header"), F.col("props").alias("message"))))
    parts = table.select(record.alias("raw"), F.col("event_id").alias("at")).unionByName(spark.createDataFrame([("{", -2), ('"metadata":{},"logcatMessages":[', -1), ("]}", 1 << 60)], "raw string, at long"))
    path = _file(parts, ["at"], fresh_path(spark, "files"), "export.logcat")
    return open_source(spark, [path], Registry.bundled("UTC"), "UTC").entries.select("entry_id", "ts_ms", "level", "pid", "tag", "process", "message")


@registered("SELECT event_id AS key, epoch_ms(CASE WHEN clock < TIMESTAMP '2026-03-29 03:00:00' THEN clock - INTERVAL 1 HOUR ELSE clock - INTERVAL 2 HOUR END) AS ms FROM (SELECT event_id, TIMESTAMP '2026-03-28 12:00:00' + to_seconds(event_id * 37 % 100000) AS clock FROM events)")
def local_times(spark: SparkSession, sf: str) -> DataFrame:
    """Local times around the hour that summer time skips: those in it move forward."""
    at = F.timestamp_millis(F.lit(1_774_699_200_000) + F.col("event_id") * 37 % 100_000 * 1000)  # 2026-03-28 12:00
    made = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    return _table(spark, sf, "events").select(F.col("event_id").alias("key"), TimestampFormat.compile("yyyy-MM-dd HH:mm:ss", "Europe/Paris").millis(made).alias("ms"))


@registered(_E + "SELECT max(n) AS peak, count(*) - 8 AS hidden FROM (SELECT user_id, count(*) FILTER (WHERE level_ord >= 1) AS n FROM e GROUP BY 1 HAVING n > 0)")
def facet_peak(spark: SparkSession, sf: str) -> DataFrame:
    """The largest count of a facet, which scales its bars, and how many values are not listed."""
    entries = events(spark, sf)
    counts = facets.facet_counts(entries, compile_query("level>=click", Shape.of(entries, EVENT_FACETS, EVENT_LEVELS)), "user_id")
    hidden = facets.top_values(facets.dictionary(entries, "user_id", ["entry_id"]), counts)[1]
    return facets.facet_peak(counts).withColumn("hidden", F.lit(hidden).cast("long"))


@registered("SELECT event_id AS key, strftime(ts, '%H:%M') AS minute, strftime(ts, '%m-%d %H:%M') AS day_minute, strftime(ts, '%H:%M:%S.%g') AS millisecond, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%m-%d') AS month_day, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS \"full\", strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS query FROM events")
def time_displays(spark: SparkSession, sf: str) -> DataFrame:
    """Every way to show a time."""
    at = F.timestamp_millis(epoch_millis(F.col("ts"), _table(spark, sf, "events").schema["ts"].dataType))
    return _table(spark, sf, "events").select(F.col("event_id").alias("key"), *(texts.displayed(at, how).alias(how) for how in texts.DISPLAYS))


@registered("SELECT doc_id, replace(text, chr(10), chr(10) || repeat(' ', 23)) AS message, replace(text, chr(10), ' ') AS field, CASE WHEN length(lang) < 5 THEN lpad(lang, 5, ' ') ELSE lang END AS padded FROM documents")
def written_values(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as the message and as a field of a canonical line: folded, flattened, padded."""
    table = _table(spark, sf, "documents")
    return table.select("doc_id", texts.folded(F.col("text"), INDENT).alias("message"), texts.flattened(F.col("text")).alias("field"), texts.padded(F.col("lang"), 5).alias("padded"))


def _values(rows: list[tuple[str, str]]) -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t(what, value)"


@registered(
    _values(
        [
            ("add", "category:Mail,Home"), ("take", "category:Home"), ("last", ""), ("level up", "level>=W"), ("level down", "level:W"), ("kept", "-category:Door category:Mail"),
            ("clear", "a b"), ("window", "x since:10:00"), ("no window", "x"), ("selected", "E W"), ("brushed", "1250 1750"), ("too narrow", "None"), ("lines", "2"), ("instant", "2026-07-22T12:00:00.123"),
            ("days", "True"), ("moved", "4 4"), ("extended", "1 0"), ("fitted", "1 1"), ("all", "0 6"), ("count", "1,234,567"), ("stale", "True"), ("profiles", "6"), ("copies", "-copy -copy-2"),
        ]
    )
)
def controls(spark: SparkSession, sf: str) -> DataFrame:
    """What needs no data: edits of a query, brushes, gridlines, selections, templates."""
    scale, day = list("VDIWE"), 86_400_000
    spot = lambda s: f"{s.anchor} {s.focus}"
    entries = events(spark, sf)
    asked = compile_query("level>=click", Shape.of(entries, EVENT_FACETS, EVENT_LEVELS))
    with tempfile.TemporaryDirectory() as folder:
        name = bundled_names()[0]
        stem = name.split(".")[0]
        copies = " ".join(copy_template(name, Path(folder)).name.removeprefix(stem).split(".")[0] for _ in range(2))
    rows = {
        "add": edits.toggle("category:Mail", "category", "Home"), "take": edits.toggle("category:Mail,Home", "category", "mail"), "last": edits.toggle("category:Mail", "category", "Mail"),
        "level up": edits.toggle("level:W", "level", "E", scale), "level down": edits.toggle("level>=W", "level", "E", scale), "kept": edits.toggle("-category:Door", "category", "Mail"),
        "clear": edits.clear("a level:W b", "level"), "window": edits.set_window("x", "10:00", None), "no window": edits.set_window("since:1 until:2 x", None, None),
        "selected": " ".join(sorted(edits.selected("level>=W", "level", scale))), "brushed": "{} {}".format(*results.brushed(1000, 2000, 75, 25, 100)), "too narrow": results.brushed(1000, 2000, 10, 12, 100),
        "lines": len(results.gridlines(0, 2 * day, "UTC")), "instant": texts.query_instant(1_784_714_400_123, "Europe/Paris"), "days": texts.spans_days(0, day, "UTC"),
        "moved": spot(results.Selection(1, 3).moved(5, 5)), "extended": spot(results.Selection(1, 3).moved(-9, 5, extend=True)), "fitted": spot(results.Selection(3, 4).within(2)), "all": spot(results.Selection.everything(7)),
        "count": texts.count_text(1_234_567), "stale": asked.query != "level>=signup", "profiles": len(Registry.bundled("UTC").profiles), "copies": copies,
    }
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "what string, value string")


@registered(
    _values([("0", "colour: no such field here; there are level, since, until, user_id, event_type"), ("1", "event_type: no entry has 'clik'"), ("2", "event_type: no entry has a value with 'zzz' in it"), ("3", "level: 'Nope' is none of view, click, signup, purchase, error"), ("4", "user_id: nothing to look for after the sign"), ("5", "level: nothing to look for after the sign")])
    + " UNION ALL SELECT 'n', count(*)::VARCHAR FROM events WHERE event_type = 'error'"
)
def query_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that can't be used are told, and the others filter."""
    entries = events(spark, sf)
    found = compile_query("colour:red event_type:clik,error event_type:~zzz level:Nope user_id: level:", Shape.of(entries, EVENT_FACETS, EVENT_LEVELS))
    rows = [(str(k), x) for k, x in enumerate(found.problems)]
    return spark.createDataFrame([*rows, ("n", str(found.select(entries).count()))], "what string, value string")
