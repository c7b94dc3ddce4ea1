import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import IN, NOW, ZONE, messages, opened
from tidelog.operators import fold
from tidelog.plans.engine import NoMatchingProfile, detect
from tidelog.sources.adapters import ADAPTERS, ContainerError, claiming, instant_of
from tidelog.sources.generator import generate
from tidelog.sources.lines import File, lines
from tidelog.sources.profiles import ProfileError, Registry, bundled_names, compile_profile, copy_template

W = "withings-healthmate"


def profile(name):
    return Registry.bundled(ZONE, NOW).named(name)


def classified(spark, tmp_path, text, name=W):
    path = tmp_path / "x.log"
    path.write_bytes(text.encode())
    return fold.classify(lines(spark, [File(0, "x.log", str(path))]), profile(name)), profile(name)


def test_fold_and_parse(spark, tmp_path):
    text = (
        "=== day one ===\n--- older lines dropped (3) ---\n"
        "2026-07-22 10:00:00.000 [D] [Mail] [tag] -> a -> b\n" + IN + "more\r\n" + IN + "  deeper\n"
        "2026-07-22 10:00:01.000 [D] [ou1] -> [bracket] message\n"
        "2026-07-22 10:00:02.000 [E] [] [Résumé] -> \n"
        "junk\n" + IN + "late\n"
        "2026-07-22 10:00:03.000 [X] [a] -> no such level\n\n"
    )
    c, p = classified(spark, tmp_path, text)
    kinds = [r["kind"] for r in c.orderBy("line_no").collect()]
    assert kinds == ["section", "notice", "entry", "continuation", "continuation", "entry", "entry", "unrecognised", "continuation", "unrecognised", "unrecognised"]
    rows = fold.fold(c, p).orderBy("seq").collect()
    assert [r["message"] for r in rows] == ["a -> b", "[bracket] message", ""]
    assert [r["category"] for r in rows] == ["Mail", None, ""]
    assert [r["tag"] for r in rows] == ["tag", "ou1", "Résumé"]
    assert rows[0]["continuations"] == ["more\r", "deeper"]
    assert rows[0]["raw_text"] == text.split("2026-07-22 10:00:00.000")[1].join(["2026-07-22 10:00:00.000", ""])[: len(rows[0]["raw_text"])]
    assert rows[2]["raw_text"].split("\n")[1:] == ["junk", IN + "late"]
    raw = text.encode()
    for r in rows:
        assert raw[r["byte_offset"] : r["byte_offset"] + r["byte_length"]].decode() == r["raw_text"]


def test_lines_across_splits(spark, tmp_path):
    text = "\n".join(f"line {i} " + "x" * (i % 97) for i in range(20_000))
    (tmp_path / "big.log").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = lines(spark, [File(0, "big.log", str(tmp_path / "big.log"))]).orderBy("line_no").select("line_no", "byte_offset", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in rows] == text.split("\n")
    assert [r["line_no"] for r in rows] == list(range(1, 20_001))
    raw = text.encode()
    assert all(raw[r["byte_offset"] :].startswith(r["text"].encode()) for r in rows[::997])


def test_odd_file_names(spark, tmp_path):
    for name in ("_hidden.log", "a[1].log", "b c.log", ".dot"):
        (tmp_path / name).write_text(f"{name}\r\nsecond")
    files = [File(k, n, str(tmp_path / n)) for k, n in enumerate(("_hidden.log", "a[1].log", "b c.log", ".dot"))]
    rows = lines(spark, files).orderBy("file_id", "line_no").select("file", "line_no", "text").collect()
    assert [tuple(r) for r in rows] == [x for f in files for x in ((f.name, 1, f.name), (f.name, 2, "second"))]


def test_unrecognised_shapes(spark, tmp_path):
    s = opened(spark, tmp_path, {"d.log": "2026-07-22 10:00:00.000 [D] [t] -> a\n\n    four\n2026-07-22 10:00:00.000 [nope\n" + "é" * 480 + "\n" + "".join(f"2026-07-22 10:00:0{i}.000 [D] [t] -> a\n" for i in range(9)) * 3}, registry=Registry([profile(W)]))
    counts, samples = s.unrecognised()
    assert {r["shape"]: r["n"] for r in counts.collect()} == {"Empty": 1, "NearContinuation": 1, "NearEntry": 1, "Other": 1}
    other = samples.where("shape = 'Other'").first()
    assert other["line_no"] == 5 and other["sample"] == "é" * 120
    assert "d.log:4" in s.report()
    assert s.stats["recognised"] == pytest.approx(28 / 32)
    assert s.health()["recognised"] == 28


def test_merge_is_a_k_way_merge(spark, tmp_path):
    def line(t, m, c="Mail"):
        return f"2026-07-22 {t}.000 [D] [{c}] [t] -> {m}\n"

    s = opened(spark, tmp_path, {"a": line("10:00:00", "a1") + line("12:00:00", "a2") + line("11:00:00", "a3") + line("13:00:00", "a4"), "b": line("11:30:00", "b1") + line("11:00:00", "b2", "Home") + line("12:30:00", "b3") + IN + "cont\n", "notes.txt": "hello\nthere\nall\n"})
    # the heap takes the file whose next entry is earliest: an entry behind a later one waits for it
    heads, want = {"a": [(10, "a1"), (12, "a2"), (11, "a3"), (13, "a4")], "b": [(11.5, "b1"), (11, "b2"), (12.5, "b3")]}, []
    while any(heads.values()):
        f = min((f for f in heads if heads[f]), key=lambda f: (heads[f][0][0], f))
        want.append(heads[f].pop(0)[1])
    assert messages(s.entries) == want
    assert s.skipped == [("notes.txt", f"not recognised by {W}")]
    assert [f.name for f in s.facets] == ["category", "tag", "file"]
    assert messages(s.query("file:b").df) == ["b1", "b2", "b3"]
    assert {r["value"]: r["total"] for r in s.dictionary("category").collect()} == {"Mail": 6, "Home": 1}


def test_no_profile(spark, tmp_path):
    with pytest.raises(NoMatchingProfile, match="tried"):
        opened(spark, tmp_path, {"x": "hello\nthere\n"})


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("2026-07-22 10:00:00.000 [D] [Mail] [tag] -> hi\n" * 3, W),
        ("2026-07-22 10:00:00.000 INFO hi\n2026-07-22T10:00:00Z WARN x\n2026-07-22 10:00:00 y\n", "generic-timestamped"),
        ("07-22 10:00:00.000  123  456 D Tag : hi\n--------- beginning of main\n", "android-logcat"),
        ("Oct  1 10:00:00 host app[12]: hi\nOct 11 10:00:00 host kernel: there\n", "syslog-rfc3164"),
    ],
)
def test_detection(spark, tmp_path, text, name):
    (tmp_path / "f").write_text(text)
    best = detect(spark, str(tmp_path / "f"), Registry.bundled(ZONE, NOW).excluding(["json-lines", "android-studio-logcat"]))
    assert best[0].profile.name == name and best[0].score == 1.0


def test_times(spark, tmp_path):
    s = opened(spark, tmp_path, {"f": "Oct  1 10:00:00 host app[12]: hi\nOct 11 10:00:00 host kernel: there\n"})
    assert [r["ts_ms"] for r in s.entries.orderBy("entry_id").collect()] == [1790841600000, 1791705600000]
    p = profile("generic-timestamped")
    rows = spark.createDataFrame([("2026-03-29 01:30:00.250",), ("2026-03-29 03:30:00",), ("2026-03-29 02:30:00.000",), ("2026-13-01 00:00:00",)], "t string").select(p.time.millis(F.col("t")).alias("ms")).collect()
    base = 1774744200000
    assert [r["ms"] for r in rows] == [base + 250, base + 3_600_000, base + 3_600_000, None]


def test_json_lines(spark, tmp_path):
    records = [
        {"timestamp": "2026-07-22T15:21:15.293Z", "level": "warn", "message": "a/b \"c\"\nsecond", "category": "Net", "userId": 42, "durationMs": 1180, "nested": {"x": 1}},
        {"timestamp": 1784726475293, "level": "SEVERE", "message": "ms", "category": "Net", "ratio": 1e3},
        {"timestamp": "1784726475", "level": "weird", "message": "s"},
        {"timestamp": "2026-07-22T17:21:15.293+02:00", "message": "offset", "flag": True, "none": None},
    ]
    text = "\n".join(json.dumps(r) for r in records).replace("1000.0", "1e3")
    s = opened(spark, tmp_path, {"log.json": text + "\n"})
    rows = s.entries.orderBy("entry_id").collect()
    by = {r["message"]: r for r in rows}
    assert by['a/b "c"']["raw_text"] == "2026-07-22 17:21:15.293 [WARN] [Net] a/b \"c\"\n" + IN + "second\n" + IN + "userId=42 durationMs=1180"
    assert by["ms"]["level"] == "ERROR" and by["ms"]["raw_text"].endswith("ratio=1e3")
    assert by["s"]["level"] == "INFO" and by["s"]["context"] == "" and by["s"]["ts_ms"] == 1784726475000
    assert by["offset"]["ts_ms"] == by['a/b "c"']["ts_ms"] == 1784733675293 and "flag=true none=null" in by["offset"]["raw_text"]
    assert "1 with a level of no known name" in s.converted["log.json"]
    pretty = "{}\n" + json.dumps(records[0], indent=1) + json.dumps(records[1])
    (tmp_path / "p").mkdir()
    assert opened(spark, tmp_path / "p", {"log.json": '{"a":1,\n"timestamp":"2026-07-22T10:00:00","message":"m"}\n' + pretty[3:]}).stats["entries"] == 3


def test_json_objects_that_span_lines(spark, tmp_path):
    """Braces, quotes and line feeds in strings; the first object far from the file's begin; files in several blocks."""
    told = ['{ "a": "}{" }', "a \\ end \\\\", '"quoted" [', "plain", "two\nlines } {", "é"]
    records = [{"time": f"2026-07-22T10:00:{k % 60:02d}", "level": "info", "message": told[k % len(told)], "more": {"deep": ["]", {"x": k}]}, "k": k} for k in range(3000)]
    text = '{"skipped": {}, "time":\n\n"2026-07-22T09:00:00", "level": "info", "message": "first"}' + "\n" * 1500
    text += "".join(json.dumps(r, indent=k % 3 or None) + ("\n" if k % 5 else " ") for k, r in enumerate(records)).replace("two\\nlines", "two\nlines")
    (tmp_path / "x.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        s = opened(spark, tmp_path, {})
        rows = s.entries.orderBy("entry_id").select("message", "continuations").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3001 and rows[0]["message"] == "first"
    assert [r["message"] for r in rows[1:]] == [x["message"].split("\n")[0] for x in records]
    assert [r["continuations"][-1].strip() for r in rows[1:]] == [f"k={k}" for k in range(3000)]
    (tmp_path / "late").mkdir()
    late = opened(spark, tmp_path / "late", {"late.json": '{}\n' + "\n" * 1200 + '{"ts": "2026-07-22T10:00:00", "msg": "m"}\n'})
    assert late.stats["entries"] == 1


def test_many_files_open_in_few_jobs(spark, tmp_path):
    """A thousand small files: the driver's jobs do not follow their number, and files one after the other need no merge."""
    for k in range(1000):
        (tmp_path / f"part-{k:04d}.log").write_text("".join(f"2026-07-22 {k // 60:02d}:{k % 60:02d}:0{i}.000 [D] [t{k % 3}] -> {k} {i}\n" for i in range(3)))
    (tmp_path / "readme").write_text("nothing\nof a log\nis here\n")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many", "many files")
    s = opened(spark, tmp_path, {})
    assert len(jobs.getJobIdsForGroup("many")) < 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert s.skipped == [("readme", f"not recognised by {W}")] and s.stats["entries"] == 3000
    assert messages(s.entries) == [f"{k} {i}" for k in range(1000) for i in range(3)]
    assert s.query("tag:t1 file:part-0001.log").count == 3


def test_lines_behind_the_last_continuation_are_not_held(spark, tmp_path):
    """An entry before many unrecognised lines is small; with a continuation behind them they are all its own."""
    text = "2026-07-22 10:00:00.000 [D] [t] -> a\n" + "junk\n" * 3000 + IN + "end\n" + "other\n" * 50_000 + "2026-07-22 10:00:01.000 [D] [t] -> b\n" + "tail\n" * 3000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        c, p = classified(spark, tmp_path, text)
        held = fold.fold(c, p)
        rows = held.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line_no"], r["last_line_no"], len(r["continuations"])) for r in rows] == [(1, 3002, 3001), (53003, 53003, 0)]


def test_json_failures(spark, tmp_path):
    with pytest.raises(ContainerError, match="no key of its objects names the time"):
        opened(spark, tmp_path, {"a.json": '{"message":"x"}\n'})
    (tmp_path / "b").mkdir()
    with pytest.raises(ContainerError, match="is no time"):
        opened(spark, tmp_path / "b", {"a.json": '{"ts":"2026-07-22T10:00:00Z","msg":"x"}\n{"ts":"soon","msg":"x"}\n'})
    assert instant_of("nope", ZONE) is None


def test_logcat_export(spark, tmp_path):
    def m(level, tag, text, seconds=1786963735, **more):
        return {"header": {"logLevel": level, "pid": 4194304, "tid": 12, "applicationId": "com.x", "processName": "com.x.p", "tag": tag, "timestamp": {"seconds": seconds, "nanos": 620829517}} | more, "message": text}

    doc = {"metadata": {"device": {}}, "logcatMessages": [m("DEBUG", "a [b]", "one"), m("ERROR", "T", "boom\n\tat x\n\tat y"), m("FANCY", "T", "odd", applicationId="")]}
    s = opened(spark, tmp_path, {"x.logcat": json.dumps(doc, indent=1)})
    rows = s.entries.orderBy("entry_id").collect()
    assert [(r["tag"], r["level"], r["process"], r["pid"], r["ts_ms"]) for r in rows] == [("a [b]", "D", "com.x", "4194304", 1786963735620), ("T", "E", "com.x", "4194304", 1786963735620), ("T", "I", "com.x.p", "4194304", 1786963735620)]
    assert len(rows[1]["continuations"]) == 2
    (tmp_path / "b").mkdir()
    with pytest.raises(ContainerError, match="logcatMessages"):
        opened(spark, tmp_path / "b", {"x.logcat": "{\n}"})
    assert claiming("{").name == "Android Studio logcat" and claiming('{"a":1}').name == "JSON lines" and claiming("x") is None


def logcat_of(n):
    return [{"header": {"logLevel": "WARN", "pid": k, "tid": 1, "applicationId": "a", "processName": "p", "tag": "t", "timestamp": {"seconds": 1786963735 + k, "nanos": 0}}, "message": f"m{k} " + ['}],[{ "q\\" \\', 'plain', "\\" * (k % 5), "é}\n{"][k % 4]} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", ["300", "10m"])
def test_logcat_export_in_many_blocks(spark, tmp_path, indent, size):
    """No row holds the document, with lines or without; braces in texts, other arrays and cut records change nothing."""
    messages = logcat_of(40)
    doc = {"before": [{"message": "no"}, 1, []], "a}b": "}]", "metadata": {"x": [{"logcatMessages": [{}]}]}, "logcatMessages": messages, "after": [{"message": "no"}], "s": "logcatMessages", "z": {"y": 1}}
    path = tmp_path / "x.logcat"
    path.write_text("{\n" + json.dumps(doc, indent=indent, ensure_ascii=False)[1:] + "\n" * (indent or 0))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found, where = ADAPTERS[1]._messages(spark, File(0, "x.logcat", str(path)))
        got = [json.loads(r["text"]) for r in found.orderBy("block", "at").collect()]
        assert got == messages
        rows = spark.read.parquet(where)
        assert rows.agg(F.max(F.octet_length("text"))).first()[0] < 1000 and (rows.where("kind = 4").count() > 10) == (size == "300")
        for text in ("{\n" + json.dumps(doc)[1:-1], "{\n" + json.dumps(doc)[1:] + "}", '{\n"logcatMessages":[{"a":]}'):
            path.write_text(text)
            with pytest.raises(ContainerError):
                ADAPTERS[1]._messages(spark, File(0, "x.logcat", str(path)))
        path.write_text('{\n"logcatMessages":[{"header" 1}]}')
        with pytest.raises(ContainerError, match="no JSON objects"):
            ADAPTERS[1].convert(spark, File(0, "x.logcat", str(path)), ZONE)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_profiles(spark, tmp_path):
    assert len(bundled_names()) == 6 and not Registry.bundled(ZONE, NOW).problems
    with pytest.raises(ProfileError) as error:
        compile_profile('name="x"\nfoo=1\n[parse]\nregex="(?<a>x)(?<b>y)"\n[fields.c]\nrole="facet"\n[fields.a]\nrole="level"\norder=["V","V"]\n')
    assert len(error.value.problems) == 5
    path = copy_template(bundled_names()[0], tmp_path)
    again = copy_template(bundled_names()[0], tmp_path)
    assert path.name == "android-logcat-copy.logprofile.toml" and again.name == "android-logcat-copy-2.logprofile.toml"
    (tmp_path / "bad.logprofile.toml").write_text("name = 3 3")
    found = Registry.bundled_plus_user(tmp_path, ZONE, NOW)
    assert len(found.profiles) == 8 and len(found.problems) == 1
    from tidelog.sources import adapters

    for a in adapters.ADAPTERS:
        p = found.named(a.profile)
        assert p.groups.source == a.layout.parse_pattern()
        assert p.continues.literal == IN


def test_generator_round_trip(spark, tmp_path):
    rows = [r["text"] for r in generate(spark, 2000).orderBy("id").collect()]
    assert rows == [r["text"] for r in generate(spark, 2000).orderBy("id").collect()]
    s = opened(spark, tmp_path, {"2026-06-02": "\n".join(rows) + "\n"})
    assert s.profile.name == W and s.stats["entries"] == 2000
    assert 0 < s.footprint()["bytes_per_entry"] < 500
    assert s.add([str(tmp_path / "2026-06-02")]).stats["entries"] == 2000
    s.close()


def test_stream(spark, tmp_path):
    from tidelog.streaming.tail import level_windows, tail

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("2026-07-22 10:00:00.000 [D] [t] -> a\njunk\n2026-07-22 10:00:30.000 [D] [t] -> b\n2026-07-22 10:01:30.000 [W] [t] -> c\n")
    counted = level_windows(tail(spark, str(tmp_path / "in"), profile(W)))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("tail_counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r["level"], r["n"]) for r in spark.sql("select * from tail_counts").collect()) == [("D", 2), ("W", 1)]
