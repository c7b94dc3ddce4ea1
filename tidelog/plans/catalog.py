"""The registered queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text as texts
from tidelog.functions.timestamps import TimestampFormat
from tidelog.operators import diagnostics, facets, fold, merge, results
from tidelog.plans.compiler import Facet, Shape, compile_query
from tidelog.sources.adapters import JSON_LAYOUT, LOGCAT_LAYOUT, LOGCAT_LEVELS
from tidelog.sources.canonical import INDENT
from tidelog.sources.lines import lines_of, placed
from tidelog.sources.profiles import BUNDLED, SUFFIX, Profile, Registry, compile_profile
from tidelog.sources.tables import entries_of, epoch_millis

EVENT_LEVELS = ["view", "click", "signup", "purchase", "error"]
EVENT_FACETS = [Facet("user_id", "User"), Facet("event_type", "Type")]
ORDER_LEVELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
ORDER_FACETS = [Facet("status", "Status"), Facet("priority", "Priority")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    """Adds the query under its function's name, with its SQL."""

    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return entries_of(_table(spark, sf, "events"), "event_id", "ts", "event_type", EVENT_LEVELS, {"user_id": "user_id", "event_type": "event_type"}, "props")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh order has no priority facet."""
    table = _table(spark, sf, "orders").withColumn("_priority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return entries_of(table, "o_orderkey", "o_orderdate", "o_orderpriority", ORDER_LEVELS, {"status": "o_orderstatus", "priority": "_priority"}, "o_orderstatus")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), F.lit(0).alias("ts_ms"), F.lit(-1).alias("level_ord"), "source", F.col("text").alias("raw_text"))


def _selected(entries: DataFrame, fields: list[Facet], levels: list[str] | None, query: str, *columns: str) -> DataFrame:
    compiled = compile_query(query, Shape.of(entries, fields, levels))
    if compiled.problems:
        raise ValueError("; ".join(compiled.problems))
    return compiled.select(entries).select("entry_id", *columns)


def _profile(name: str) -> Profile:
    return compile_profile((BUNDLED / f"{name}{SUFFIX}").read_text("utf-8"), "UTC")


_E = "WITH e AS (SELECT event_id AS entry_id, epoch_us(ts) // 1000 AS ts_ms, (list_position(['view','click','signup','purchase','error'], event_type) - 1)::BIGINT AS level_ord, user_id::VARCHAR AS user_id, event_type, props FROM events) "
_O = "WITH o AS (SELECT o_orderkey AS entry_id, epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderstatus AS status, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders) "


def _event_query(name: str, query: str, condition: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _selected(events(spark, sf), EVENT_FACETS, EVENT_LEVELS, query, "event_type", "ts_ms")

    run.__name__, run.__doc__ = name, f"Events that {query!r} selects."
    registered(_E + f"SELECT entry_id, event_type, ts_ms FROM e WHERE {condition}")(run)


def _order_query(name: str, query: str, condition: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _selected(orders(spark, sf), ORDER_FACETS, ORDER_LEVELS, query, "status", "priority")

    run.__name__, run.__doc__ = name, f"Orders that {query!r} selects."
    registered(_O + f"SELECT entry_id, status, priority FROM o WHERE {condition}")(run)


def _document_query(name: str, query: str, condition: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _selected(documents(spark, sf), [Facet("source", "Source")], None, query, "source")

    run.__name__, run.__doc__ = name, f"Documents that {query!r} selects."
    registered(f"SELECT doc_id AS entry_id, source FROM documents WHERE {condition}")(run)


_ASCII = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_event_query("level_at_least", "level>=purchase", "level_ord >= 3")
_event_query("level_above", "level>signup", "level_ord > 2")
_event_query("level_below", "level<click", "level_ord < 1")
_event_query("level_at_most", "level<=click", "level_ord <= 1")
_event_query("level_set", "level:view,error", "level_ord IN (0, 4)")
_event_query("level_negated", "-level:VIEW", "level_ord <> 0")
_event_query("level_intersect", "level>=click level<=signup", "level_ord BETWEEN 1 AND 2")
_event_query("facet_contains", "event_type:~I", "contains(lower(event_type), 'i')")
_event_query("facet_intersect", "event_type:~i event_type:click,purchase", "event_type = 'click'")
_event_query("facet_empty_intersection", "event_type:click event_type:view", "false")
_event_query("facet_by_label", "type:signup", "event_type = 'signup'")
_event_query("since_until", "since:2024-01-05T06:30 until:2024-01-10T12:00:30.250", "ts_ms BETWEEN 1704436200000 AND 1704888030250")
_event_query("since_relative", "since:-2d", "ts_ms >= (SELECT max(ts_ms) FROM e) - 172800000")
_event_query("since_time_of_day", "until:14:30", "ts_ms <= (SELECT min(ts_ms) // 86400000 * 86400000 FROM e) + 52200000")
_event_query("since_date", "since:2024-01-20", "ts_ms >= 1705708800000")
_event_query("phrase_in_message", "'\"k\": 4'", "contains(lower(props), '\"k\": 4')")
_event_query("composite_query", "level>=click -event_type:error since:-9d until:-1d /: [1-4]\\d/", "level_ord >= 1 AND event_type <> 'error' AND ts_ms >= (SELECT max(ts_ms) FROM e) - 777600000 AND ts_ms <= (SELECT max(ts_ms) FROM e) - 86400000 AND regexp_matches(props, ': [1-4][0-9]')")
_order_query("facet_eq_ci", "status:f", "status = 'F'")
_order_query("facet_or", "status:F,o", "status IN ('F', 'O')")
_order_query("facet_negated_keeps_null", "-priority:1-urgent,5-low", "priority IS NULL OR priority NOT IN ('1-URGENT', '5-LOW')")
_order_query("facet_negated_twice", "-priority:~urgent priority:~i", "priority LIKE '%I%'")
_document_query("phrase_ascii_ci", "THE IT", f"contains({_ASCII}, 'the it')")
_document_query("phrase_non_ascii", '"LES éè"', f"contains({_ASCII}, 'les éè')")
_document_query("phrase_upper_accent_is_lost", "É", f"contains({_ASCII}, 'é')")
_document_query("regex_ci", r"/\bERTH[a-z]+ing\b/", r"regexp_matches(text, '(?i)\berth[a-z]+ing\b')")
_document_query("facet_and_phrase", "source:src1,src2 license", f"source IN ('src1', 'src2') AND contains({_ASCII}, 'license')")

_LIFT = "level>=click event_type:~i since:2024-01-08"
_LEVEL, _TYPE, _TIME = "level_ord >= 1", "contains(event_type, 'i')", "ts_ms >= 1704672000000"


def _lifted(spark: SparkSession, sf: str):
    entries = events(spark, sf)
    shape = Shape.of(entries, EVENT_FACETS, EVENT_LEVELS)
    return entries, compile_query(_LIFT, shape), shape.bounds()


@registered(_E + f"SELECT event_type AS value, count(*) AS n FROM e WHERE {_LEVEL} AND {_TIME} GROUP BY 1")
def facet_counts_lifted(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a facet, its own constraint lifted."""
    entries, query, _ = _lifted(spark, sf)
    return facets.facet_counts(entries, query, "event_type")


@registered(_E + f"SELECT level_ord, count(*) AS n FROM e WHERE {_TYPE} AND {_TIME} GROUP BY 1")
def level_counts_lifted(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the levels, the level constraint lifted."""
    entries, query, _ = _lifted(spark, sf)
    return facets.level_counts(entries, query).withColumn("level_ord", F.col("level_ord").cast("long"))


_B = ", b AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM e), t AS (SELECT e.*, least(((ts_ms - lo) * {n}) // (hi - lo), {m}) AS bucket FROM e, b) "


@registered(_E + _B.format(n=200, m=199) + f"SELECT level_ord, bucket, count(*) AS n FROM t WHERE {_LEVEL} AND {_TYPE} GROUP BY ALL")
def timeline_lifted(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline of a query, its time window lifted."""
    entries, query, bounds = _lifted(spark, sf)
    return facets.timeline(entries, query, *bounds, 200).withColumn("level_ord", F.col("level_ord").cast("long"))


@registered(_E + _B.format(n=900, m=899) + "SELECT level_ord, bucket, count(*) AS n FROM t GROUP BY ALL")
def timeline_full(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline of all entries."""
    entries, _, bounds = _lifted(spark, sf)
    return facets.histogram(entries, *bounds, 900).withColumn("level_ord", F.col("level_ord").cast("long"))


@registered(
    _E + _B.format(n=60, m=59) + f"SELECT 'level' AS control, level_ord::VARCHAR AS value, -1::BIGINT AS bucket, count(*) AS n FROM t WHERE {_TYPE} AND {_TIME} GROUP BY ALL "
    f"UNION ALL SELECT 'timeline', level_ord::VARCHAR, bucket, count(*) FROM t WHERE {_LEVEL} AND {_TYPE} GROUP BY ALL "
    f"UNION ALL SELECT 'facet:event_type', event_type, -1, count(*) FROM t WHERE {_LEVEL} AND {_TIME} GROUP BY ALL "
    f"UNION ALL SELECT 'facet:user_id', user_id, -1, count(*) FROM t WHERE {_LEVEL} AND {_TYPE} AND {_TIME} GROUP BY ALL"
)
def sidebar_all(spark: SparkSession, sf: str) -> DataFrame:
    """All controls in one scan."""
    entries, query, bounds = _lifted(spark, sf)
    return facets.sidebar(entries, query, EVENT_FACETS, *bounds, 60).withColumn("bucket", F.coalesce("bucket", F.lit(-1)))


_L = "WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS entry_id, epoch_us(l_shipdate) // 1000 AS ts_ms, (list_position(['N','A','R'], l_returnflag) - 1)::BIGINT AS level_ord, l_linestatus AS status FROM lineitem) "


@registered(
    _L + _B.format(n=100, m=99) + "SELECT 'level' AS control, level_ord::VARCHAR AS value, -1::BIGINT AS bucket, count(*) AS n FROM t WHERE status = 'O' GROUP BY ALL "
    "UNION ALL SELECT 'timeline', level_ord::VARCHAR, bucket, count(*) FROM t WHERE level_ord >= 1 AND status = 'O' GROUP BY ALL "
    "UNION ALL SELECT 'facet:status', status, -1, count(*) FROM t WHERE level_ord >= 1 GROUP BY ALL"
)
def lineitem_sidebar(spark: SparkSession, sf: str) -> DataFrame:
    """All controls over the largest table."""
    table = _table(spark, sf, "lineitem").withColumn("_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    entries = entries_of(table, "_id", "l_shipdate", "l_returnflag", ["N", "A", "R"], {"status": "l_linestatus"})
    fields = [Facet("status", "Status")]
    shape = Shape.of(entries, fields, ["N", "A", "R"])
    return facets.sidebar(entries, compile_query("level>=A status:o", shape), fields, *shape.bounds(), 100).withColumn("bucket", F.coalesce("bucket", F.lit(-1)))


@registered(_O + "SELECT priority AS value, count(*) AS total, min(entry_id) AS first FROM o WHERE priority IS NOT NULL GROUP BY 1")
def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a facet with their totals and first entries."""
    return facets.dictionary(orders(spark, sf), "priority", ["entry_id"]).select("value", "total", F.col("first.entry_id").alias("first"))


@registered(_E + "SELECT user_id AS value, count(*) AS total, count(*) FILTER (WHERE level_ord >= 3) AS n FROM e GROUP BY 1 HAVING n > 0 ORDER BY total DESC, min(entry_id) LIMIT 8")
def facet_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """What the sidebar shows of a facet with many values: eight, by total."""
    entries = events(spark, sf)
    query = compile_query("level>=purchase", Shape.of(entries, EVENT_FACETS, EVENT_LEVELS))
    totals = facets.dictionary(entries, "user_id", ["entry_id"])
    return facets.top_values(totals, facets.facet_counts(entries, query, "user_id"))[0].select("value", "total", "n")


@registered(_E + _B.format(n=300, m=299) + "SELECT max(n) AS peak FROM (SELECT bucket, count(*) AS n FROM t GROUP BY 1)")
def timeline_peak(spark: SparkSession, sf: str) -> DataFrame:
    """The fullest bucket."""
    entries, _, bounds = _lifted(spark, sf)
    return facets.peak(facets.histogram(entries, *bounds, 300))


@registered(_E + "SELECT level_ord, count(*) AS n, CASE WHEN level_ord = 4 THEN 'error' WHEN level_ord = 3 THEN 'warning' ELSE 'plain' END AS severity FROM e GROUP BY ALL")
def level_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of each level, and how severe it is."""
    counts = events(spark, sf).groupBy("level_ord").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("level_ord").cast("long").alias("level_ord"), "n", texts.severity(F.col("level_ord"), len(EVENT_LEVELS)).alias("severity"))


@registered(_E + "SELECT count(*) AS entries, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM e")
def corpus_shape(spark: SparkSession, sf: str) -> DataFrame:
    """The size of a source: entries, distinct values, time span."""
    return events(spark, sf).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def _order_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as three files whose entries are not in time order: the file is the customer modulo 3, the line the order."""
    table = _table(spark, sf, "orders")
    return table.select((F.col("o_custkey") % 3).cast("int").alias("file_id"), F.concat(F.lit("file"), F.col("o_custkey") % 3).alias("file"), F.floor(F.col("o_orderkey") / 1000).alias("block"), F.col("o_orderkey").alias("seq"), epoch_millis(F.col("o_orderdate"), table.schema["o_orderdate"].dataType).alias("ts_ms"))


_M = "WITH f AS (SELECT (o_custkey % 3)::INT AS file_id, 'file' || (o_custkey % 3) AS file, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS ts_ms FROM orders), m AS (SELECT *, max(ts_ms) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS merge_ms FROM f) "


@registered(_M + "SELECT row_number() OVER (ORDER BY merge_ms, file_id, seq) - 1 AS entry_id, file_id, seq, ts_ms FROM m")
def kway_merge_order(spark: SparkSession, sf: str) -> DataFrame:
    """Three files as one stream, with every entry's place in it."""
    from tidelog.functions.store import numbered

    return numbered(merge.merge_time(_order_files(spark, sf)), merge.MERGE_KEYS, "merged", cheap=True)[0].select("entry_id", "file_id", "seq", "ts_ms")


@registered(_M + "SELECT file AS value, count(*) AS n FROM f WHERE ts_ms >= 852076800000 GROUP BY 1")
def file_facet(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the facet that merging adds, under a time window."""
    entries = _order_files(spark, sf).withColumn("level_ord", F.lit(-1)).withColumn("raw_text", F.lit(""))
    fields = [Facet("file", "File")]
    return facets.facet_counts(entries, compile_query("file:file1 since:1997-01-01", Shape.of(entries, fields, None)), "file")


@registered(_E + "SELECT entry_id, event_type, ts_ms FROM e WHERE entry_id BETWEEN 480 AND 520")
def context_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """The entries around one."""
    return results.neighbourhood(events(spark, sf), 500).select("entry_id", "event_type", "ts_ms")


@registered(_E + "SELECT entry_id, ts_ms, (date '1970-01-01' + (ts_ms // 86400000)::INT)::VARCHAR AS day, coalesce(lag(ts_ms // 86400000) OVER (ORDER BY entry_id) <> ts_ms // 86400000, true) AS opens_day FROM e WHERE level_ord >= 3")
def day_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Results with the rows that open another day than the row before."""
    entries = events(spark, sf)
    found = compile_query("level>=purchase", Shape.of(entries, EVENT_FACETS, EVENT_LEVELS)).select(entries)
    return results.day_changes(found).select("entry_id", "ts_ms", F.col("day").cast("string").alias("day"), "opens_day")


_POS = ", r AS (SELECT *, row_number() OVER (ORDER BY entry_id) - 1 AS pos FROM e WHERE event_type = 'click') "


@registered(_E + _POS + "SELECT pos, entry_id, props FROM r WHERE pos BETWEEN 300 AND 349")
def page_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty rows of a result, from place 300."""
    return results.page(_positions(spark, sf), 300, 50).select("pos", "entry_id", F.col("raw_text").alias("props"))


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    entries = events(spark, sf)
    return results.with_positions(compile_query("event_type:click", Shape.of(entries, EVENT_FACETS, EVENT_LEVELS)).select(entries))


@registered(_E + _POS + "SELECT pos, props AS raw_text FROM r")
def export_text(spark: SparkSession, sf: str) -> DataFrame:
    """What an export writes, with the place of each entry."""
    return _positions(spark, sf).select("pos", "raw_text")


@registered("SELECT max(pos) AS last_pos, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_type = 'click')")
def select_all(spark: SparkSession, sf: str) -> DataFrame:
    """The extent of a selection of everything."""
    return _positions(spark, sf).agg(F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


def _event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of a day file: every third without a category, some with an empty one."""
    table = _table(spark, sf, "events")
    ms = epoch_millis(F.col("ts"), table.schema["ts"].dataType)
    time = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")
    level = F.upper(F.element_at(F.array(*map(F.lit, "VDIWE")), F.array_position(F.array(*map(F.lit, EVENT_LEVELS)), F.col("event_type")).cast("int")))
    category = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit("[] ")).otherwise(F.concat(F.lit("["), F.col("event_type"), F.lit("] ")))
    line = F.concat(time, F.lit(" ["), level, F.lit("] "), category, F.lit("[u"), F.col("user_id"), F.lit("] -> "), F.col("props"))
    return table.select(F.lit(0).alias("file_id"), F.lit("events").alias("file"), F.floor(F.col("event_id") / 1000).alias("block"), F.col("event_id").alias("at"), line.alias("raw"))


@registered("SELECT event_id + 1 AS line_no, epoch_us(ts) // 1000 AS ts_ms, (list_position(['view','click','signup','purchase','error'], event_type) - 1)::BIGINT AS level_ord, 'u' || user_id AS tag, props AS message FROM events")
def parse_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered lines parsed back: time, level, tag, message."""
    entries = _parsed(_event_lines(spark, sf), _profile("withings-healthmate"))
    return entries.select("line_no", "ts_ms", F.col("level_ord").cast("long").alias("level_ord"), "tag", "message")


def _parsed(raw: DataFrame, profile: Profile) -> DataFrame:
    return fold.fold(fold.classify(placed(raw), profile), profile)


@registered("SELECT event_id + 1 AS line_no, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS category FROM events")
def optional_group_null(spark: SparkSession, sf: str) -> DataFrame:
    """A group that takes no part is null, an empty one is not."""
    return _parsed(_event_lines(spark, sf), _profile("withings-healthmate")).select("line_no", "category")


@registered("SELECT o_orderkey AS key, epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 AS spaced, epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 AS quoted, epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 + 250 AS hundredths, epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 AS named, epoch_ms(make_date(2026, month(o_orderdate), least(day(o_orderdate), 28))) AS yearless FROM orders")
def timestamp_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Times written in several patterns and read back."""
    table = _table(spark, sf, "orders")
    ms = epoch_millis(F.col("o_orderdate"), table.schema["o_orderdate"].dataType) + (F.col("o_orderkey") % 86400) * 1000
    at = F.timestamp_millis(ms)
    made = {
        "spaced": ("yyyy-MM-dd HH:mm:ss.SSS", F.date_format(at, "yyyy-MM-dd HH:mm:ss")),
        "quoted": ("yyyy-MM-dd'T'HH:mm:ss", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")),
        "hundredths": ("yyyyMMdd HHmmss.SS", F.concat(F.date_format(at, "yyyyMMdd HHmmss"), F.lit(".25"))),
        "named": ("d MMM yyyy HH:mm:ss", F.date_format(at, "d MMM yyyy HH:mm:ss")),
        "yearless": ("MMM ppd HH:mm:ss", F.concat(F.date_format(at, "MMM "), F.lpad(F.least(F.dayofmonth(at), F.lit(28)).cast("string"), 2, " "), F.lit(" 00:00:00"))),
    }
    read = [TimestampFormat.compile(p, "utc", assume_year=2026).millis(text).alias(name) for name, (p, text) in made.items()]
    return table.select(F.col("o_orderkey").alias("key"), *read)


def _document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: of three lines one opens an entry, one continues it and one is as it stands."""
    table = _table(spark, sf, "documents")
    opening = lambda i: F.concat(F.lit("2026-07-22 10:00:00.00"), (i % 10).cast("string"), F.lit(" [D] ["), F.col("source"), F.lit("] [doc] -> "))
    made = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 0, F.concat(opening(i), x)).when(i % 3 == 1, F.concat(F.lit(INDENT), x)).otherwise(x))
    return lines_of(table.withColumn("_made", F.array_join(made, "\n")), "_made", "doc_id", "doc_id", "doc_id")


_D = (
    "WITH split AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), raw AS (SELECT doc_id, source, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM split), "
    "made AS (SELECT doc_id, i + 1 AS line_no, CASE i % 3 WHEN 0 THEN '2026-07-22 10:00:00.00' || (i % 10) || ' [D] [' || source || '] [doc] -> ' || part WHEN 1 THEN repeat(' ', 23) || part ELSE part END AS line FROM raw), "
    "tested AS (SELECT *, regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:.]{12} \\[[VDIWE]\\] .*\\] -> ') AS opens, starts_with(line, repeat(' ', 23)) AS continues FROM made), "
    "kinds AS (SELECT *, CASE WHEN coalesce(max(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND continues THEN 'continuation' WHEN opens THEN 'entry' ELSE 'unrecognised' END AS kind FROM tested), "
    "numbered AS (SELECT *, count(*) FILTER (WHERE kind = 'entry') OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seq FROM kinds), "
    "ends AS (SELECT doc_id, seq, max(line_no) FILTER (WHERE kind <> 'unrecognised') AS last_line_no FROM numbered WHERE seq > 0 GROUP BY ALL) "
)


@registered(_D + "SELECT n.doc_id::INT AS file_id, n.seq, min(line_no) AS line_no, any_value(last_line_no) AS last_line_no, string_agg(line, chr(10) ORDER BY line_no) AS raw_text FROM numbered n JOIN ends e USING (doc_id, seq) WHERE line_no <= last_line_no GROUP BY n.doc_id, n.seq")
def fold_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of several lines, folded."""
    profile = _profile("withings-healthmate")
    return fold.fold(fold.classify(_document_lines(spark, sf), profile), profile).select("file_id", "seq", "line_no", "last_line_no", "raw_text")


@registered(_D + "SELECT kind, count(*) AS n FROM kinds GROUP BY 1")
def classify_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each kind."""
    return fold.counters(fold.classify(_document_lines(spark, sf), _profile("withings-healthmate")))


@registered(_D + "SELECT count(*) AS lines, count(*) FILTER (WHERE kind = 'continuation') AS folded, count(*) FILTER (WHERE kind <> 'unrecognised') / count(*) AS recognised FROM kinds")
def health(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a source the format explains."""
    kinds = fold.classify(_document_lines(spark, sf), _profile("withings-healthmate"))
    known = F.count(F.when(F.col("kind") != fold.UNRECOGNISED, 1))
    return kinds.agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("kind") == fold.CONTINUATION, 1)).alias("folded"), (known / F.count(F.lit(1))).alias("recognised"))


_SHAPE = "CASE WHEN line = '' THEN 'Empty' WHEN regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\\.[0-9]{3} \\[') THEN 'NearEntry' WHEN regexp_full_match(line, '[ \\t\\r]*') THEN 'Blank' WHEN regexp_matches(line, '^[ \\t]') THEN 'NearContinuation' ELSE 'Other' END"


def _unexplained(spark: SparkSession, sf: str) -> DataFrame:
    profile = _profile("withings-healthmate")
    return diagnostics.unrecognised(fold.classify(_document_lines(spark, sf), profile), profile)


@registered(_D + f"SELECT {_SHAPE} AS shape, count(*) AS n FROM kinds WHERE kind = 'unrecognised' GROUP BY 1")
def unrecognised_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Unexplained lines by shape."""
    return diagnostics.shape_counts(_unexplained(spark, sf))


@registered(_D + f", s AS (SELECT {_SHAPE} AS shape, doc_id::INT AS file_id, line_no, line FROM kinds WHERE kind = 'unrecognised') SELECT shape, file_id, line_no, octet_length(encode(line)) <= 240 AS whole FROM s QUALIFY row_number() OVER (PARTITION BY shape ORDER BY file_id, line_no) <= 5")
def unrecognised_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first unexplained lines of each shape, and whether the sample holds all of one."""
    found = diagnostics.shape_samples(_unexplained(spark, sf).withColumn("_whole", F.octet_length("text") <= 240))
    whole = F.octet_length("sample") < 238
    return found.select("shape", "file_id", "line_no", whole.alias("whole"))


@registered("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(*) AS lines, count(*) FILTER (WHERE line = '' OR regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:') OR regexp_matches(line, '^\\s')) AS generic, count(*) FILTER (WHERE line = '' OR starts_with(line, repeat(' ', 23)) OR regexp_matches(line, '^=== .+ ===$')) AS dayfile FROM l")
def detect_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of the documents two formats account for."""
    lines = _table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("text"))
    count = lambda name: F.count(F.when(_profile(name).accounts(F.col("text")), 1))
    return lines.agg(F.count(F.lit(1)).alias("lines"), count("generic-timestamped").alias("generic"), count("withings-healthmate").alias("dayfile"))


@registered("SELECT event_id + 1 AS line_no, epoch_us(ts) // 1000 AS ts_ms, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level, user_id::VARCHAR AS context, props AS message FROM events")
def canonical_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Records rendered as the lines of NDJSON and read back by the paired format."""
    table = _table(spark, sf, "events")
    ms = epoch_millis(F.col("ts"), table.schema["ts"].dataType)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "DEBUG").otherwise("INFO")
    line = JSON_LAYOUT.rendered(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS"), {"level": level, "context": F.col("user_id").cast("string")}, F.col("props"))
    raw = table.select(F.lit(0).alias("file_id"), F.lit("events").alias("file"), F.floor(F.col("event_id") / 1000).alias("block"), F.col("event_id").alias("at"), line.alias("raw"))
    return _parsed(raw, _profile("json-lines")).select("line_no", "ts_ms", "level", "context", "message")


@registered("SELECT event_id AS at, epoch_us(ts) // 1000 AS ts_ms, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' ELSE 'INFO' END AS level, props AS message, event_type = 'view' AS guessed FROM events")
def jsonl_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON objects, read by the adapter's decoder and its paired format."""
    from tidelog.sources.adapters import _each_line

    table = _table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "view", "odd").otherwise("info")
    record = F.to_json(F.struct(epoch_millis(F.col("ts"), table.schema["ts"].dataType).alias("ts"), level.alias("lvl"), F.col("props").alias("msg"), F.col("user_id").alias("user"), F.struct("value").alias("nested")))
    chosen = {"time": "ts", "message": "msg", "level": "lvl", "context": None}
    found = table.select(F.lit(0).cast("long").alias("block"), F.col("event_id").alias("at"), record.alias("raw")).mapInArrow(_each_line(chosen, "UTC", JSON_LAYOUT), "block long, at long, body string, guessed boolean, bad string")
    profile = _profile("json-lines")
    read = fold.parsed(found.withColumn("text", F.substring_index("body", "\n", 1)), profile)
    return read.select(F.shiftright("at", 10).alias("at"), F.col("_ms").alias("ts_ms"), F.col("_fields.level").alias("level"), F.col("_fields.message").alias("message"), "guessed")


@registered("SELECT event_id + 1 AS line_no, epoch_us(ts) // 1000 AS ts_ms, CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'D' WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'W' ELSE 'I' END AS level, user_id::VARCHAR AS pid, 't[' || event_type || ']' AS tag, 'com.app' AS process, props AS message FROM events")
def logcat_export_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Logcat records rendered as lines and read back by the paired format, tags with brackets included."""
    table = _table(spark, sf, "events")
    ms = epoch_millis(F.col("ts"), table.schema["ts"].dataType)
    words = F.create_map(*(F.lit(x) for pair in {"view": "VERBOSE", "click": "DEBUG", "error": "ERROR", "purchase": "WARN"}.items() for x in pair))
    letters = F.create_map(*(F.lit(x) for pair in LOGCAT_LEVELS.items() for x in pair))
    values = {"pid": F.col("user_id").cast("string"), "tid": F.lit("7"), "level": F.coalesce(letters[words[F.col("event_type")]], F.lit("I")), "tag": F.concat(F.lit("t["), F.col("event_type"), F.lit("]")), "process": F.lit("com.app")}
    line = LOGCAT_LAYOUT.rendered(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS"), values, F.col("props"))
    raw = table.select(F.lit(0).alias("file_id"), F.lit("events").alias("file"), F.floor(F.col("event_id") / 1000).alias("block"), F.col("event_id").alias("at"), line.alias("raw"))
    return _parsed(raw, _profile("android-studio-logcat")).select("line_no", "ts_ms", "level", "pid", "tag", "process", "message")


@registered("WITH c AS (SELECT conv_id, turn, role, text, unnest(string_split(text, chr(10))) AS line FROM conversations) SELECT conv_id::INT AS file_id, count(*) AS n, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes FROM c GROUP BY 1")
def conversation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as files of lines: the number of lines of each, and the bytes up to the end of the last."""
    lines = lines_of(_table(spark, sf, "conversations"), "text", "conv_id", "conv_id", "turn")
    return lines.groupBy("file_id").agg(F.max("line_no").alias("n"), F.max(F.col("byte_offset") + F.octet_length("raw") + 1).alias("bytes"))


@registered()
def detection(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every bundled format on rendered event lines."""
    raw = _event_lines(spark, sf).select(F.col("raw").alias("text"))
    scores = [F.avg(p.accounts(F.col("text")).cast("double")).alias(p.name.replace("-", "_")) for p in Registry.bundled("UTC").profiles]
    return raw.agg(*scores)


# registers the queries over files, which build on these
from tidelog.plans import catalog_files  # noqa: E402, F401
