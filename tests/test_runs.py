"""Runs, ranks, graphs, mods and reports: hits, near misses, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import graphs as G
from lodestar.operators import joins as J
from lodestar.operators import profile as P
from lodestar.operators import ranks
from lodestar.operators import runs as R
from lodestar.operators import sequences as S
from lodestar.sinks import reports as K
from lodestar.sources import mods as D


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_ranked_values(spark):
    rows = [("a", float(v)) for v in [5, 5, 5, 1, 9, 9, 1e9, -3]] + [("b", 2.0), ("b", None), ("c", None)]
    wanted = [("a", r) for r in (0, 1, 2, 4, 6, 7, 8)] + [("b", 0), ("b", 1), ("c", 0)]
    got = ranks.ranked_values(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", spark.createDataFrame(wanted, "k string, r long"), "r", "v").collect()
    assert {(r.k, r.r): r.v for r in got} == {("a", 0): -3.0, ("a", 1): 1.0, ("a", 2): 5.0, ("a", 4): 5.0, ("a", 6): 9.0, ("a", 7): 1e9, ("b", 0): 2.0}


def test_numbered_and_top(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    assert ranks.numbered(rows, "k", ["t"], "i").filter("i != floor(t / 3)").isEmpty()
    got = ranks.top(rows, "k", [F.col("t").desc()], 2, F.xxhash64("t")).collect()
    assert {(r.k, r.t, r.place) for r in got} == {(0, 999, 1), (0, 996, 2), (1, 997, 1), (1, 994, 2), (2, 998, 1), (2, 995, 2)}


def test_started_keys(spark):
    got = one(spark, *[R.started_key(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("x", None, "20240102-030405-n"), ("y", "2020", "20240102-030405"), ("z", "", "2024-run"))])
    assert tuple(got) == ("2024-01-02T03:04:05", "2020", "")


@pytest.mark.parametrize(("notes", "idea", "is_base"), [(None, None, True), ("", "i", False), (" Baseline x", "i", True), ("[baseline] x", "i", True), ("x baseline=true", "i", True), ("baseline variant", None, False), ("against the baseline", "i", False), (None, "baseline", True)])
def test_baselines(spark, notes, idea, is_base):
    assert one(spark, R.is_baseline(F.lit(notes).cast("string"), F.lit(idea).cast("string")))[0] is is_base


def test_a_best_run_is_not_its_own_baseline(spark):
    rows = [("r1", None, 50.0, "1", "", False), ("r2", "i", 60.0, "2", "", False), ("r3", "i", 90.0, "3", "", True), ("r4", "j", 70.0, "4", "baseline", False), ("r5", "i", None, "5", "", False)]
    got = R.best_against_baseline(spark.createDataFrame(rows, "run_id string, idea string, fps double, started string, notes string, crashed boolean")).collect()
    assert [tuple(r) for r in got] == [("i", "r2", "r4", -10.0, -14.29)]


def test_bucket_specs(spark):
    got = one(spark, R.buckets_of(F.lit("3-10?:15, 68:3 5-2 0 x 7")))[0]
    assert [b and tuple(b) for b in got] == [(3, 10, 15, True), (68, 68, 3, False), None, None, None, (7, 7, None, False)]


def test_gate_needs_every_mode(spark):
    rows = spark.createDataFrame([("a", "on", 1.2), ("a", "off", 1.3), ("b", "on", 1.2), ("c", "on", 1.2), ("c", "off", 0.5)], "c string, mode string, speedup double")
    assert {r.c: r.passed for r in R.gate(rows, ["c"], "mode", ["on", "off"], 1.15, 0.98).collect()} == {"a": True, "b": None, "c": False}


def test_all_capped_runs_count(spark):
    rows = spark.createDataFrame([("a", 10.0, True), ("a", 20.0, False), ("b", 10.0, True), ("b", 30.0, True)], "arm string, fps double, capped boolean")
    assert {r.arm: (r.n, r.n_all, r.fps, r.capped) for r in R.arm_means(rows, "arm", ["fps"], "capped").collect()} == {"a": (1, 2, 20.0, 1), "b": (2, 2, 20.0, 2)}


def test_run_documents(spark):
    m = spark.createDataFrame([(1, '{"run_id": "1", "corpus": "c"}'), (2, "broken"), (3, "{}")], "run_id long, document string")
    r = spark.createDataFrame([(1, '{"findings_by_pattern": {"a": 2}, "findings_by_severity": {"G": 1}, "timeouts": ["f"]}'), (3, '{"crashes": [{"file": "f"}, "g"]')], "run_id long, document string")
    got = {x.run_id: x for x in R.run_rows(m, r).collect()}
    assert got[1].health == "warn" and got[1].findings == 2 and not got[1].sums_agree and got[2].corpus is None and got[3].health == "unknown" and got[3].crashes == 0


def test_tail_brackets(spark):
    rows = spark.createDataFrame([("a", [5, 0, 1], 2.0, 6, 10), ("b", [1, 0, 0], 2.0, 1, 1000), ("c", [0, 0], 2.0, 0, 0)], "k string, b array<int>, f double, above int, calls int")
    assert {r.k: (r.p_lo, r.p_hi) for r in P.tail_bracket(rows, ["k"], "b", "f", "above", "calls", 0.5).collect()} == {"a": (2.0, 4.0), "b": (0.0, 2.0), "c": (0.0, 2.0)}


def test_warm_up(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 6.0), ("b", 2.0), ("b", 3.0)], "run string, t double")
    assert sorted((r.run, r.t) for r in P.trimmed(rows, "run", "t", 4.0).collect()) == [("a", 0.0), ("a", 1.0), ("b", 0.0)]


def test_max_path(spark):
    step = lambda *xs: [{"fork": a, "branch": b} for a, b in xs]
    rows = [step(), step((0, 0)), step((0, 0), (1, 0)), step((0, 0), (1, 0)), step((0, 0), (1, -1)), step((0, 1)), step((2, 0))]
    got = S.max_path(spark.createDataFrame([("f", r) for r in rows], "k string, chain array<struct<fork:int,branch:int>>"), ["k"], "chain").first()
    assert (got.worst, got.flat) == (1 + (1 + 2) + 1, 7)
    assert S.max_path(spark.createDataFrame([], "k string, chain array<struct<fork:int,branch:int>>"), ["k"], "chain").count() == 0


def test_reach_kinds_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "a", "x"), ("b", "d", "z"), ("a", "b", "y")], "src string, dst string, kind string")
    got = G.reach(spark.createDataFrame([("a",)], "node string"), edges, 5, ["x", "y"]).collect()
    assert {r.node: (r.hop, r.via) for r in got} == {"a": (0, None), "b": (1, "x"), "c": (2, "y")}


def test_ancestors_and_includes(spark):
    parents = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, 12)]], "node int, parent int")
    assert G.ancestors(parents).filter("node = 11").count() == 12 and G.ancestors(parents).filter("node - ancestor != depth").isEmpty()
    lines = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "file string, included string")
    assert {(r.root, r.file, r.depth) for r in G.includes(lines, spark.createDataFrame([("a",)], "file string")).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2)}


def test_overlaps(spark):
    rows = spark.createDataFrame([("k", 1, 0, 100), ("k", 2, 50, 60), ("k", 3, 100, 120), ("k", 4, 55, 101), ("j", 5, 0, 9), ("k", 6, 7, 7)], "k string, id int, lo int, hi int")
    got = J.overlaps(rows, "k", "id", "lo", "hi", 16).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 4), (2, 4), (3, 4)]


@pytest.mark.parametrize(("raw", "name"), [(b"caf\xa9 \xb1", "latin-1"), ("Привет".encode("cp1251"), "cp1251"), (b"\xef\xbb\xbfx", "utf-8-sig"), ("é".encode(), "utf-8"), (b"\x98", "latin-1"), (b"", "utf-8")])
def test_encodings_need_letters(raw, name):
    assert D.encoding_of(raw) == name


def test_bench_faults(spark):
    good = "-- @pattern p\n-- @title t\n-- @original\na\n-- @rewrite\nb\n-- @sink\nc"
    rows = [("a", good), ("b", good.replace("@title", "@tilte")), ("c", good.replace("-- @sink\n", "")), ("d", ""), ("e", good + "\n-- @title u"), ("f", good + "\n-- @notes x\n-- @notes y")]
    got = {r.path: r for r in D.bench_cases(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a"].fault is None and got["a"].sections == {"original": "a", "rewrite": "b", "sink": "c"} and got["b"].fault == "unknown directive @tilte" and got["c"].fault == "missing section sink" and got["d"].fault.startswith("missing section") and got["e"].fault == "directive given twice @title" and got["f"].fault is None and got["f"].meta["notes"] == "x y"


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("m", "f", "p", "RED", 1), ("m", "f", "p", "RED", 2), ("m", "g", "q", "ODD", 1)], "mod string, path string, pattern string, severity string, line long")
    assert K.markdown(K.pattern_counts(rows).select("pattern", "n")) == "| pattern | n |\n|---|---|\n| p | 2 |\n| q | 1 |"
    assert [r.severity for r in K.severity_counts(rows, ["RED"]).orderBy("place").collect()] == ["RED", "ODD"]
    K.write_json(rows, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).filter("path = 'f'").first().findings[1].line == 2
    assert "<td>p</td>" in K.html(K.pattern_counts(rows), "a < b") and "a &lt; b" in K.html(K.pattern_counts(rows), "a < b") and K.plain_text(rows.limit(0)).startswith("mod")


def test_texts(spark):
    row = one(spark, *[T.typed_number(F.lit(x).cast("string")).alias(n) for n, x in (("a", "7"), ("b", "7.0"), ("c", "nil"), ("d", None), ("e", "1e3"))])
    assert [tuple(x) for x in row] == [(7, None), (None, 7.0), (None, None), (None, None), (1000, None)]
    masked = T.masked_scripts(spark.createDataFrame([('a = "x--y" -- z\nb = [==[ ]] ]==] c',)], "text string"), "text").first().text
    assert masked == "a = " + " " * 6 + " " + " " * 4 + "\nb = " + " " * 12 + " c"
    assert one(spark, T.patched_once(F.lit("aXbX"), "X", "Y").alias("t")).t is None and one(spark, T.patched_once(F.lit("a.b"), ".", "Y").alias("t")).t == "aYb"
    assert [r.size for r in spark.createDataFrame([(1023,), (2048,), (3 << 20,)], "n long").select(T.human_size(F.col("n")).alias("size")).collect()] == ["1023 B", "2.0 KB", "3.0 MB"]
