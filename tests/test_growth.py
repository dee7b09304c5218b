"""What must not grow: expressions repeated in plans, texts parsed again, tasks that hold all; and results at ties."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar import scratch
from lodestar.operators import census, joins, sequences, tallies
from lodestar.plans.catalog import QUERIES
from lodestar.scripts import edits, facts
from lodestar.sources import captures, engine_log

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["profile_windows", "profile_calls", "kv_parse"])
def test_lines_are_taken_apart_once(spark, name):
    assert plan(QUERIES[name](spark, SMALL)).count("map_from_entries") == 1


def test_profile_pairs_of_equal_keys(spark):
    lines = [("f", 0, "~ PROF|1|win|seq=1| seq = 2 |frames=3|x|frames=|y=a=b"), ("f", 1, "PROF|1|err|a=b"), ("f", 2, "PROF|1|eow")]
    got = captures.profile_records(spark.createDataFrame(lines, "path string, line_no int, raw string"), "PROF").orderBy("line_no").collect()
    assert [(r.kind, r.kv) for r in got] == [("win", {"seq": "2", "frames": "", "y": "a=b"}), ("err", None), ("eow", {})]


def test_innermost_of_equal_spans(spark):
    points = spark.createDataFrame([(1, "u", 5)], "p int, u string, at int")
    for order in ([3, 1, 2], [2, 3, 1], [1, 2, 3]):
        spans = spark.createDataFrame([(s, "u", 0, 9) for s in order], "s int, u string, lo int, hi int")
        assert joins.innermost(points, "at", spans, "lo", "hi", ["u"], "p", 4, "s").first().s == 1


def test_head_of_a_log_line(spark):
    assert "translate(" not in plan(QUERIES["log_times"](spark, SMALL))
    raws = [" [ 1:02:03 ]  *  [tag]:  text ", "[] x", "[:] x", "!!", "  [a]: b", "[a]: b", "[1][b]: c", "[1]b] d", "~[x]y", "[7"]
    rows = engine_log.entries(spark.createDataFrame([("f", i, r) for i, r in enumerate(raws)], "path string, line_no int, raw string")).orderBy("index").collect()
    assert [(r.timestamp, r.sigil, r.tag, r.text) for r in rows] == [
        ("1:02:03", "*", "tag", "text"), (None, "", "", "[] x"), (None, "", "", "[:] x"), (None, "!", "", "!"), (None, "", "", "[a]: b"),
        (None, "", "a", "b"), ("1", "", "b", "c"), ("1", "", "", "b] d"), (None, "~", "", "[x]y"), (None, "", "", "[7")]


def test_metric_document_ties_and_rates_of_zero(spark):
    rows = spark.createDataFrame([("r", float(i), None, f, 1.0, None) for i, f in enumerate((50.0, 0.0))], "run string, t_s double, frametime_ms double, fps double, cpu_pct double, rss_mb double")
    assert (census.metric_document(rows, "run").first().frames, census.metric_document(rows, "run").first().fps_min) == (1, 50.0)
    still = census.metric_document(rows, "run", still=True).first()
    assert (still.frames, still.fps_avg, still.fps_min, still.p99_ms) == (2, 0.0, 0.0, math.inf)
    lo, hi, d = 0.1, 0.7, 0.61
    got = spark.createDataFrame([(lo, hi, d)], "lo double, hi double, d double").select(census._between(F.col("lo"), F.col("hi"), F.col("d"))).first()[0]
    assert got == math.fma(lo, 1 - d, hi * d)


def test_equal_scripts_are_parsed_once_a_task(spark, tmp_path):
    seen = tmp_path / "seen"

    def read(text):
        with open(seen, "a") as f:
            f.write("x")
        return [(text, 1)] * len(text)

    files = spark.createDataFrame([("a", "ab"), ("b", "ab"), ("c", None), ("d", "abc")], "path string, text string").coalesce(1)
    schema = pa.schema([("path", pa.string()), ("t", pa.string()), ("n", pa.int32())])
    rows = facts.parsed(files, read, schema, "path string, t string, n int").collect()
    assert sorted((r.path, r.t) for r in rows) == [("a", "ab")] * 2 + [("b", "ab")] * 2 + [("d", "abc")] * 3 and seen.read_text() == "xxx"


def test_scripts_are_dealt_before_they_are_rewritten(spark):
    files = spark.createDataFrame([("a", "xy"), ("b", None), ("c", "z")], "path string, text string").coalesce(1)
    made = spark.createDataFrame([("a", 0, 1, "X", 0, None, False, False), ("a", 1, 1, "-", 0, None, False, False)], "path string, start int, end int, text string, priority int, grp string, enabler boolean, atomic boolean")
    out = edits.rewrite(files, made)
    assert "RepartitionByExpression [path" in plan(out)
    got = {r.path: (r.text, r.applied, r.dropped, [tuple(p) for p in r.pieces]) for r in out.collect()}
    assert got == {"a": ("X-y", 2, 0, [(0, 1, 0, 1), (1, 1, 1, 2)]), "b": ("", 0, 0, []), "c": ("z", 0, 0, [])}


def test_reads_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 50)
    rows = [(None if i % 31 == 0 else i % 97, None if i % 7 == 0 else i % 5, None if i % 3 == 0 else i % 2 == 0) for i in range(1000)]
    reads, reachable = spark.createDataFrame(rows, "body long, key long, loop boolean"), spark.createDataFrame([(b,) for b in (*range(0, 97, 2), 4, 4, None)], "body long")
    out = tallies.reachable_reads(reads, "body", reachable, "key", F.col("loop"))
    assert "RepartitionByExpression [body" in plan(out) and ", 20" in plan(out) and "count(distinct" not in plan(out)
    kept = [r for r in rows if r[0] is not None and r[0] % 2 == 0]
    want = {k: (len(of), len({r[0] for r in of}), sum(r[2] is True for r in of)) for k in {r[1] for r in kept} for of in [[r for r in kept if r[1] == k]]}
    assert {r.key: (r.sites, r.bodies, r.in_loop) for r in out.collect()} == want
    assert tallies.reachable_reads(reads.limit(0), "body", reachable, "key", F.col("loop")).count() == 0


def worst(chains: list, depth: int = 0) -> int:
    forks = {}
    for c in chains:
        if len(c) > depth:
            forks.setdefault(c[depth][0], {}).setdefault(c[depth][1], []).append(c)
    return sum(len(c) <= depth for c in chains) + sum(max(worst(b, depth + 1) for b in branches.values()) for branches in forks.values())


def test_paths_are_dealt_by_their_number_and_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 50)
    draw = random.Random(7)
    step = lambda: (draw.choice([0, 1, None]), draw.choice([-1, 0, 1, None]))
    rows = [(draw.choice(["a", "b", None]), i % 20, None if i % 50 == 0 else [step() for _ in range(draw.randrange(5))]) for i in range(1000)]
    out = sequences.max_path(spark.createDataFrame(rows, "k string, j int, chain array<struct<fork:int,branch:int>>"), ["k", "j"], "chain")
    assert out.rdd.getNumPartitions() == 20
    physical = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert physical.count("Sort [") == 1 and physical.count("Exchange") == 1
    want = {}
    for k, j, c in rows:
        want.setdefault((k, j), []).append(c or [])
    assert {(r.k, r.j): (r.worst, r.flat) for r in out.collect()} == {k: (worst(c), len(c)) for k, c in want.items()}


def test_crowded_keys_are_counted_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 300)
    rows = [(0 if i % 2 else None if i % 5 == 0 else i, i % 4, [] if i % 3 == 0 else [(i % 3, i % 7)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "body long, key long, chain array<struct<fork:int,branch:int>>")
    out = sequences.max_path(df, ["body"], "chain")
    assert "Union" in plan(out) and plan(out).count("Aggregate") == 2
    want = {}
    for b, _, c in rows:
        want.setdefault(b, []).append(c)
    assert {r.body: (r.worst, r.flat) for r in out.collect()} == {b: (worst(c), len(c)) for b, c in want.items()}
    read = tallies.reachable_reads(df, "body", df.select("body").filter("body IS NULL OR body % 3 = 0"), "key", F.size("chain") > 0)
    assert "Union" in plan(read)
    kept = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    of = {k: [r for r in kept if r[1] == k] for k in range(4)}
    assert {r.key: (r.sites, r.bodies, r.in_loop) for r in read.collect()} == {k: (len(v), len({r[0] for r in v}), sum(bool(r[2]) for r in v)) for k, v in of.items() if v}
