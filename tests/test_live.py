"""The source that follows logs, scripts written back, ranks, bags, layers and samples."""

import math
import os
import statistics

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import kv_bag
from lodestar.operators import tallies as T
from lodestar.operators.documents import merged_layers
from lodestar.operators.metrics import frame_metrics
from lodestar.operators.ranks import ranked_values, top
from lodestar.sinks import reports as K
from lodestar.sinks.scripts import write_back
from lodestar.streaming.tail import LogTail, backlog, logs, ranges, whole


def put(path, text, at=None, mode="a"):
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)
    if at is not None:
        os.utime(path, (at, at))


def test_places_in_logs(tmp_path):
    p = str(tmp_path / "a.log")
    put(p, "one\ntwo\r\nthr")
    assert whole(p) == 9 and backlog(p, 1) == 4 and backlog(p, 2) == 0 and backlog(p, 9) == 0
    assert [(r.start, r.end) for r in ranges(p, 0, 9)] == [(0, 9)]
    put(p, "ee")
    assert whole(p) == 9
    put(str(tmp_path / "none.log"), "")
    assert whole(str(tmp_path / "none.log")) == 0 and backlog(str(tmp_path / "none.log"), 3) == 0
    put(p, "\n" + "x" * 200_000 + "\nend\n")
    assert backlog(p, 1) == whole(p) - 4 and backlog(p, 2) == whole(p) - 4 - 200_001


def test_log_tail_grows_rotates_and_starts_again(spark: SparkSession, tmp_path):
    folder, out, marks = tmp_path / "logs", tmp_path / "out", tmp_path / "marks"
    folder.mkdir()
    a, b, c = (str(folder / f"{x}.log") for x in "abc")
    put(a, "".join(f"old {i}\n" for i in range(9)), 100)
    put(str(folder / "other.txt"), "no\n", 900)
    spark.dataSource.register(LogTail)

    def drained():
        rows = spark.readStream.format("log_tail").option("folder", str(folder)).option("lines", "2").load()
        q = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(marks)).trigger(once=True).start()
        q.awaitTermination(120)
        got = spark.read.parquet(str(out)).collect() if any(out.glob("*.parquet")) else []
        return [r.line for r in sorted(got, key=lambda r: (r.path, r.at))]

    first = drained()
    put(a, "new 1\nhalf", 100)
    second = drained()
    put(a, " done\n", 100)
    put(b, "b 1\nb 2\n", 200)
    put(c, "c 1\nc half", 300)
    third = drained()
    put(c, "\nc 3\n", 300)
    last = drained()
    assert set(first) <= {"old 7", "old 8"} and set(second) <= {"old 7", "old 8", "new 1"}
    assert last == ["old 7", "old 8", "new 1", "half done", "b 1", "b 2", "c 1", "c half", "c 3"] and len(third) < len(last)
    assert logs(str(folder), "*.log") == [a, b, c]


def test_write_back(spark, tmp_path):
    files = {"a": ("cp1251", "Жук = 1\r\n"), "b": ("utf-8-sig", "x"), "c": ("latin-1", "Жук"), "d": ("utf-8", "same")}
    for name in files:
        (tmp_path / name).write_bytes(b"before")
    rows = [(str(tmp_path / n), e, t, int(n != "d")) for n, (e, t) in files.items()] + [(str(tmp_path / "none"), "utf-8", "x", 1)]
    df = spark.createDataFrame(rows, "path string, encoding string, text string, applied int")
    status = {os.path.basename(r.path): r.status for r in write_back(df).collect()}
    assert status == {"a": "written", "b": "written", "c": "unencodable", "d": "unchanged", "none": "missing"}
    assert (tmp_path / "a").read_bytes() == "Жук = 1\r\n".encode("cp1251") and (tmp_path / "a.orig").read_bytes() == b"before" and (tmp_path / "b").read_bytes() == b"\xef\xbb\xbfx"
    assert (tmp_path / "c").read_bytes() == b"before" and not (tmp_path / "d.orig").exists()
    more = df.withColumn("text", F.concat("text", F.lit("2"))).filter(F.col("path").endswith("b"))
    assert write_back(more).first().status == "written" and (tmp_path / "b.orig").read_bytes() == b"before"  # the first original stays


def test_bags_in_any_session(spark):
    for policy in ("EXCEPTION", "LAST_WIN"):
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
        lines = [("a=1| b = 2 |a= 3 |x|=e|c=d=e|\tq\t=\n",), ("",), (None,), ("a=|a=",)]
        got = [r.m for r in spark.createDataFrame(lines, "line string").select(kv_bag(F.col("line")).alias("m")).collect()]
        assert got == [{"b": "2", "a": "3", "": "e", "c": "d=e", "q": ""}, {}, None, {"a": ""}]
    spark.conf.unset("spark.sql.mapKeyDedupPolicy")


def test_ranked_values_end(spark):
    values = [3.0, -1.0, math.inf, -math.inf, math.nan, None, 0.0, -0.0, 1e-300, 1e300, 3.0, 3.0]
    rows = spark.createDataFrame([("k", v) for v in values] + [("one", 5.0)], "r string, lo double")
    ranks = spark.createDataFrame([(k, i) for k in ("k", "one", "none") for i in range(-1, 12)], "r string, __rank long")
    got = {(x[0], x[1]): x[2] for x in ranked_values(rows, ["r"], "lo", ranks).collect()}
    ordered = sorted(v for v in values if v is not None and v == v)
    assert got == {**{("k", i): v for i, v in enumerate(ordered)}, ("one", 0): 5.0}
    assert ranked_values(rows.limit(0), ["r"], "lo", ranks).count() == 0


def test_frame_metrics_of_odd_samples(spark):
    some = [10.0, 20.0, 30.0, 40.0, 16.5]
    rows = spark.createDataFrame([("a", v) for v in [*some, 0.0, -3.0, None, math.nan, math.inf]] + [("b", math.nan), (None, 7.0)], "frames string, lo double")
    got = frame_metrics(rows, "frames", "lo").toPandas()
    assert len(got) == 1 and got.iloc[0]["median_ms"] == statistics.median(some) and got.iloc[0]["max_ms"] == 40.0 and round(got.iloc[0]["fps_1pct_low"], 6) == 25.0


def test_top_of_several_keys(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), F.col("id").alias("v"))
    got = top(rows, ["a", "b"], [F.col("v").desc()], 2, F.xxhash64("v")).groupBy("a", "b").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 6 and all(r.n == 2 for r in got) and max(r.s for r in got) == 999 + 993


def test_layers(spark):
    rows = [(1, 0, '{"a":{"b":1,"c":{"d":[1,2],"e":"x"}},"f":1}'), (1, 1, '{"a":{"c":{"d":[3]},"b":{"n":null}}}'), (1, 2, '{"f":{"g":"1"},"a":{"b":{"m":{}}}}'), (2, 0, "nope"), (2, 1, "[1]"), (3, 0, "{}"), (3, 1, '{"x":{}}')]
    rows += [(4, 0, '{"p":{"q":{"r":1}}}'), (4, 1, '{"p":5}'), (4, 2, '{"p":{"z":true}}'), (5, 0, None), (None, 0, '{"k":1}')]
    got = {(r.k, ".".join(r.path)): r.value for r in merged_layers(spark.createDataFrame(rows, "k int, l int, doc string"), "k", "l", "doc").collect()}
    assert got == {(1, "a.b.m"): "{}", (1, "a.b.n"): "null", (1, "a.c.d"): "[3]", (1, "a.c.e"): '"x"', (1, "f.g"): '"1"', (3, "x"): "{}", (4, "p.z"): "true", (None, "k"): "1"}


def test_sample_until_is_one_order(spark):
    rows = spark.range(2000).withColumn("hit", F.when(F.col("id") % 7 == 0, True))
    samples = [sorted(r.id for r in T.sample_until(rows.repartition(n), "id", F.col("hit"), 20).collect()) for n in (1, 7)]
    assert samples[0] == samples[1] and sum(i % 7 == 0 for i in samples[0]) == 20 and len(samples[0]) < 600
    assert T.sample_until(rows, "id", F.col("hit"), 10_000).count() == 2000 and T.sample_until(rows, "id", F.col("hit"), 0).count() == 0


def test_examples_and_tables(spark):
    rows = spark.createDataFrame([("a", "z"), ("a", "y"), ("a", "y"), ("a", None), ("b", None), (None, "q")], "k string, e string")
    got = {r.k: (r.n, r.examples) for r in T.with_examples(rows, "k", "e", 1).collect()}
    assert got == {"a": (4, ["y"]), "b": (1, []), None: (1, ["q"])}


def test_whole_report(spark, tmp_path):
    found = spark.createDataFrame([("m", "f", "p", "RED", 1), ("m", "g", "q", "GREEN", 2), ("n", "h", "p", "RED", 3)], "mod string, path string, pattern string, severity string, line long")
    failures, edits = spark.createDataFrame([("x", "parse")], "path string, what string"), spark.createDataFrame([("f", 2, 1), ("g", 0, 0)], "path string, applied int, dropped int")
    K.write_report(found, failures, edits, str(tmp_path), spark.createDataFrame([("p", "high")], "pattern string, impact string"))
    s = spark.read.json(str(tmp_path / "summary")).first()
    assert (s.findings, s.by_severity.RED, s.failures, s.applied, s.dropped, s.modified) == (3, 2, 1, 2, 1, 1)
    assert {r.mod: (r.files, r.by_impact.high) for r in spark.read.json(str(tmp_path / "mods")).collect()} == {"m": (2, 1), "n": (1, 1)}
    assert spark.read.json(str(tmp_path / "files")).count() == 3 and K.summary(found.limit(0), failures.limit(0), edits.limit(0)).first().findings == 0


def test_documents_and_overlays(spark, tmp_path):
    from lodestar.sinks import runs as D

    rows = spark.createDataFrame([("r1", 1.5, None), ("r2", 2.0, "x"), ("r2", 2.0, "x"), (None, 1.0, "y")], "run string, fps double, notes string")
    done = D.write_documents(D.documents(rows, "run", "metrics.json"), str(tmp_path / "runs")).collect()
    assert sorted((r.path, r.status) for r in done) == [("r1/metrics.json", "written"), ("r2/metrics.json", "written")]
    assert (tmp_path / "runs/r1/metrics.json").read_text() == '{"fps":1.5}' and (tmp_path / "runs/r2/metrics.json").read_text() == '{"fps":2.0,"notes":"x"}'
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a").write_bytes(b"\x00one")
    winners = spark.createDataFrame([("scripts/a", str(tmp_path / "m/a"), "m"), ("scripts/b", str(tmp_path / "m/b"), "m")], "rel string, source string, mod string")
    assert sorted((r.path, r.status, r.bytes) for r in D.overlay(winners, str(tmp_path / "out")).collect()) == [("scripts/a", "copied", 4), ("scripts/b", "missing", 0)]
    assert (tmp_path / "out/scripts/a").read_bytes() == b"\x00one"
    D.write_manifest(winners, str(tmp_path / "manifest"))
    assert [r.rel for r in spark.read.json(str(tmp_path / "manifest")).orderBy("rel").collect()] == ["scripts/a", "scripts/b"]
    old, new = (spark.createDataFrame(x, "rel string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {r.rel: r.change for r in D.added_only(old, new).collect()} == {"b": "changed", "c": "removed", "d": "added"}
