"""Readers and streams against hand-checked files."""

import pytest
from pyspark.sql import functions as F

from lodestar.sources import captures, config, engine_log
from lodestar.sources import text as X
from lodestar.streaming import live


def texts(spark, text):
    return spark.createDataFrame([("f", text)], "path string, text string")


def summary(spark, text):
    return engine_log.summaries(engine_log.entries(X.lines(texts(spark, text)))).first()


@pytest.mark.parametrize(("content", "encoding", "text"), [(b"a\xc3\xa9", "utf-8", "aé"), (b"\xef\xbb\xbfa", "utf-8-sig", "a"), ("Привет".encode("cp1251"), "cp1251", "Привет"), (b"\x98", "latin-1", "\x98"), (b"", "utf-8", "")])
def test_encodings(content, encoding, text):
    assert X.decode(content) == (encoding, text)


def test_read_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.lua").write_bytes("Привет\r\nx\n".encode("cp1251"))
    (tmp_path / "y.txt").write_bytes(b"no")
    got = X.read_texts(spark, str(tmp_path), "*.lua")
    assert [(r.encoding, r.text) for r in got.collect()] == [("cp1251", "Привет\r\nx\n")]
    assert [(r.line_no, r.raw) for r in X.lines(got).collect()] == [(0, "Привет"), (1, "x")]
    assert X.newest(spark, str(tmp_path), "*.lua").first().path.endswith("a/x.lua")


HARBOUR = """[00:00:01] # build 4711, Jan 2020
[00:00:03] * Loading level [north_harbour]
- phase time: 350 ms
- phase time: 90 ms
~ lamp_07: no light map
! cannot open config 'boats'
! sound error 4
* A-Life: boats: 31; crews = 8, boats : 33
* Level load time: 4210 ms
[00:00:09] * Game evening save is successfully loaded
* texture load time: 9 s

"""


def test_engine_log(spark):
    got = summary(spark, HARBOUR)
    assert got.levels == ["north_harbour"] and got.phase_times_ms == [350, 90] and got.warnings == 3 and got.errors == ["sound error 4"] and not got.crashed
    assert got.load_time_s == pytest.approx(4.21) and got.alife == {"boats": 33.0, "crews": 8.0} and got.lines == 11 and got.world_loads == ["evening save"] and got.build.startswith("build 4711")
    assert summary(spark, HARBOUR.replace("* Level load time: 4210 ms\n", "")).load_time_s == pytest.approx(0.44)


CRASH = "[ 7.25] * deck\nFatal error\n[where] pump : 3\n[why] valve\nStack trace:\n  pump_on\n\tvalve_open\nharbour.exe main\nall quiet\n  not a frame\n! late error\n"


def test_crashed_log(spark):
    got = summary(spark, CRASH)
    assert got.crashed and got.errors == ["Fatal error", "[where] pump : 3", "[why] valve", "late error"] and got.stack_trace == ["pump_on", "valve_open", "harbour.exe main"]
    rows = engine_log.entries(X.lines(texts(spark, "[ 7.25] * [pump]: on\n[02:00:05] ! off\n[x] y"))).orderBy("index").collect()
    assert [(r.t_s, r.sigil, r.tag, r.text) for r in rows] == [(7.25, "*", "pump", "on"), (7205.0, "!", "", "off"), (None, "", "", "[x] y")]


CONFIG = 'top = 1\n; note\n[a]:b, c ; why\nx = 1 ; one\nflag\n#include "o.ltx"\n\n[d]\nx = 3\nx = 4'


def test_sectioned_config(spark):
    rows = config.sectioned(texts(spark, CONFIG)).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["entry", "comment", "section", "entry", "bare", "include", "blank", "section", "entry", "entry"]
    assert (rows[2].section, rows[2].parent, rows[2].comment) == ("a", "b, c", "; why")
    assert (rows[3].section, rows[3].key, rows[3].value, rows[3].comment) == ("a", "x", "1", "; one") and rows[5].value == "o.ltx" and rows[0].section is None
    got = {(r.section, r.key): r.value for r in config.items(config.sectioned(texts(spark, CONFIG))).collect()}
    assert got == {(None, "top"): "1", ("a", "x"): "1", ("a", "flag"): "", ("d", "x"): "4"}


def test_config_difference(spark):
    read = lambda t: config.items(config.commands(texts(spark, t)))
    got = config.difference(read("fov 70\nbind jump kSPACE\nbind use kF\nold 1 ; x"), read("fov 80\nbind jump kSPACE\nbind use kG\nnew 2"))
    assert {r.key: (r.old, r.new) for r in got.collect()} == {"fov": ("70", "80"), "bind use": ("kF", "kG"), "old": ("1", None), "new": (None, "2")}


@pytest.mark.parametrize(("text", "flat"), [("a 1\nb 2\nc = 3", True), ("a = 1\nb 2", False), ("[s]\na\nb", False), ("", False)])
def test_dialect(spark, text, flat):
    assert config.is_command_list(texts(spark, text)).first().flat is flat


def test_mod_list(spark):
    rows = config.mod_list(texts(spark, "# head\r\n+Top\r\n-Off\r\n*Sep\r\n\r\n+X_separator\r\nbare")).orderBy("rank").collect()
    assert [(r.rank, r.prefix, r.name, r.separator) for r in rows] == [(0, "+", "Top", False), (1, "-", "Off", False), (2, "*", "Sep", True), (3, "+", "X_separator", True), (4, "+", "bare", False)]


def test_captures(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Application,TimeInSeconds,msBetweenPresents\na.exe,100.0,16.7\na.exe,100.0167,16.6\na.exe,,33.0\na.exe,101,NA\n")
    got = captures.read_captures(spark, str(tmp_path / "c.csv")).orderBy("t_s").collect()
    assert [r.t_s for r in got] == pytest.approx([0, 0.0167, 0.0497, 1.0]) and got[0].fps == pytest.approx(1000 / 16.7) and got[3].frametime_ms is None and got[3].fps is None
    rows = spark.createDataFrame([("r", i, "20") for i in range(3)], "run string, i int, FrameTime string")
    assert [r.t_s for r in captures.samples(rows, "run", ["i"]).orderBy("i").collect()] == pytest.approx([0, 0.02, 0.04])
    captures.write_samples(spark.createDataFrame([(0.5, None, 60.0)], "t_s double, frametime_ms double, fps double"), str(tmp_path / "o"))
    assert {r.value for r in spark.read.text(str(tmp_path / "o")).collect()} == {"t_s,frametime_ms,fps", "0.5000,,60.00"}


PROFILE = """x PROF|1|hdr|timer=os
noise
PROF|1|win|seq=1|frames=40|total_units=10.5|span_ms=nil
PROF|1|cb|seq=1|name=f|calls=3|units=9
PROF|1|cb|seq=1|name=f|calls=4|units=8
PROF|1|eow|seq=1
PROF|1|win|seq=2|frames=50
PROF|1|frm|n=1|ms=20.5|top=a~1,b~c~2,d~x,e
PROF|1|hit|seq=2|name=f|max=7|b=1,2,
PROF|1|err|broken"""


def test_profile(spark):
    records = captures.profile_records(X.lines(texts(spark, PROFILE)), "PROF")
    assert [r.kind for r in records.orderBy("line_no").collect()] == ["hdr", "win", "cb", "cb", "eow", "win", "frm", "hit", "err"]
    windows = captures.profile_windows(records).collect()
    assert [(w.seq, w.frames, w.total_units, w.span_ms) for w in windows] == [(1, 40, 10.5, None)] and captures.profile_windows(records, 41).count() == 0
    assert [(c.name, c.calls, c.units) for c in captures.profile_calls(records).collect()] == [("f", 4, 8.0)]
    assert [tuple(x) for x in captures.slow_frames(records).first().top] == [("a", 1.0), ("b~c", 2.0)]
    assert captures.hitches(records).first().buckets == [1, 2]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("! bad\n* fine\n~ hm\n")
    lines = live.follow_lines(spark, str(tmp_path / "in"), ["error", "warning"])
    lines.writeStream.format("memory").queryName("followed").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.line for r in spark.table("followed").collect()) == ["! bad", "~ hm"]
    events = spark.createDataFrame([(1.0, "a", 2.0), (2.0, "a", 3.0), (31.0, "a", 5.0), (500.0, "b", 1.0)], "t double, name string, v double").select(F.timestamp_seconds("t").alias("ts"), "name", "v")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    for name, mode, rows in (("totals", "append", live.windowed_totals(stream, "ts", "name", "v")), ("running", "complete", live.running_totals(stream, "name", "v"))):
        rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.name, r.calls, r.units) for r in spark.table("totals").collect()) == [("a", 1, 5.0), ("a", 2, 5.0)]
    assert {r.name: (r.calls, r.units, r.highest) for r in spark.table("running").collect()} == {"a": (3, 10.0, 5.0), "b": (1, 1.0, 1.0)}


def test_after_marker(spark):
    rows = spark.createDataFrame([("r", 1.0, False), ("r", 2.0, True), ("r", 3.0, False), ("s", 9.0, False)], "run string, t double, up boolean")
    assert [r.t for r in engine_log.after_marker(rows, "run", "t", "up", 1.0).collect()] == [3.0]
