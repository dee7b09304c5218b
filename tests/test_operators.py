"""Hand-computed vectors for the operators, hits and near misses."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import metrics as M


def test_harmonic_mean_not_arithmetic(spark):
    rows = spark.createDataFrame([("r", 10.0)] * 100 + [("r", 50.0)] * 100 + [("r", 0.0)], "run string, ft double")
    got = M.frame_metrics(rows, "run", "ft").first()
    assert got.fps_avg == pytest.approx(33.333333) and got.frames == 200


def test_one_percent_low(spark):
    rows = spark.createDataFrame([("r", 1000 / 60)] * 99 + [("r", 200.0)], "run string, ft double")
    got = M.frame_metrics(rows, "run", "ft").first()
    assert got.fps_1pct_low == pytest.approx(5.0) and got.fps_avg < 60


@pytest.mark.parametrize(("fps", "capped"), [([144.0] * 10, True), ([215.0, 211.0, 211.0, 212.0], False), ([207.0] * 10, False), ([144.0] * 2, False)])
def test_caps(spark, fps, capped):
    rows = spark.createDataFrame([("r", v) for v in fps], "run string, fps double")
    assert M.cap_detection(rows, "run", [60.0, 120.0, 144.0], 1.0).first().capped is capped


def test_kv_bag(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    got = spark.range(1).select(T.kv_bag(F.lit("P|1|hdr|a=1|b=x=y|a=2")).alias("m")).first().m
    assert got == {"a": "2", "b": "x=y"}


def test_number_and_slug(spark):
    got = spark.createDataFrame([("nil", "  Hello, World!  "), ("1.5", "???"), ("x", None)], "n string, s string").select(T.number(F.col("n")).alias("n"), T.slug(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(None, "hello-world"), (1.5, "run"), (None, "run")]


def test_spread_of_constants(spark):
    rows = spark.createDataFrame([("r", 2.0)] * 3 + [("one", 5.0)], "run string, v double")
    got = {r.run: r for r in M.spread(rows, ["run"], "v").collect()}
    assert got["r"].stdev == 0 and got["r"].cv_pct == 0 and got["one"].stdev == 0
