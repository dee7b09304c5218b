"""Queries of the run catalogue, profiler, graphs and mods, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.time import micros
from ..operators import graphs as G
from ..operators import profile as P
from ..operators import runs as R
from ..sinks import reports as K
from ..sources import mods as D
from .catalog import query

# ---- catalogue: a run a customer


def _documents(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests of all runs and results of most: those of one nation have none, every fifth is a broken text."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    manifest = F.to_json(F.struct(k.cast("string").alias("run_id"), F.concat(F.lit("abcdef01234"), k).alias("commit"), F.col("c_mktsegment").alias("corpus"), F.lit("done").alias("status"), F.array(F.lit("--fix")).alias("flags")))
    some = lambda m, text: F.when(k % m == 0, F.lit(text)).otherwise("")
    whole = F.concat(
        F.lit('{"analyze_s": 1.5, "findings_by_pattern": {"a": '), n, F.lit(', "b": 2}, "findings_by_severity": {"GREEN": '), n + 2 + (k % 4 == 0).cast("int"), F.lit('}, "parse_failures": ['),
        some(3, '{"file": "f1", "error": "x"}, "f2", {"error": "y"}, 7'), F.lit('], "crashes": ['), some(11, '"c"'), F.lit("]}"),
    )
    results = customers.filter(n != 7).select(k.alias("run_id"), F.when(k % 5 == 0, F.lit('{"analyze_s": 1')).otherwise(whole).alias("document"))
    return customers.select(k.alias("run_id"), manifest.alias("document")), results


_READ = "c_nationkey <> 7 AND c_custkey % 5 <> 0"


@query(f"""SELECT c_custkey AS run_id, c_mktsegment AS corpus, 'abcdef01' AS commit_short, CASE WHEN {_READ} THEN c_nationkey + 2 ELSE 0 END::BIGINT AS findings,
    CASE WHEN {_READ} AND c_custkey % 3 = 0 THEN 4 ELSE 0 END AS parse_failures, CASE WHEN {_READ} AND c_custkey % 11 = 0 THEN 1 ELSE 0 END AS crashes,
    CASE WHEN NOT ({_READ}) THEN 'unknown' WHEN c_custkey % 11 = 0 THEN 'fail' WHEN c_custkey % 3 = 0 THEN 'warn' ELSE 'ok' END AS health,
    ({_READ}) AS has_results, CASE WHEN {_READ} THEN c_custkey % 4 <> 0 ELSE true END AS sums_agree FROM customer""")
def run_catalogue(t):
    found = R.run_rows(*_documents(t("customer")))
    return found.select("run_id", "corpus", "commit_short", "findings", "parse_failures", "crashes", "health", "has_results", "sums_agree")


@query(f"""SELECT corpus, health, count(*) AS runs FROM (SELECT c_mktsegment AS corpus, CASE WHEN NOT ({_READ}) THEN 'unknown' WHEN c_custkey % 11 = 0 THEN 'fail' WHEN c_custkey % 3 = 0 THEN 'warn' ELSE 'ok' END AS health FROM customer) GROUP BY 1, 2""")
def health_histogram(t):
    return R.run_rows(*_documents(t("customer"))).groupBy("corpus", "health").agg(F.count(F.lit(1)).alias("runs"))


@query(f"SELECT c_custkey AS run_id, unnest(['f1', 'f2']) AS file FROM customer WHERE {_READ} AND c_custkey % 3 = 0")
def failure_entries(t):
    _, results = _documents(t("customer"))
    r = results.filter(F.try_parse_json("document").isNotNull()).select("run_id", F.from_json("document", R.RESULTS).alias("r"))
    return r.select("run_id", F.explode(R.failure_files(F.col("r.parse_failures"))).alias("file"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-01T00:00:00' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:11:12' ELSE '' END AS started,
    row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-01T00:00:00' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:11:12' ELSE '' END DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100""")
def newest_runs(t):
    o = t("orders")
    run_id = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-101112-name"))).otherwise("unnamed")
    keyed = o.select("o_orderkey", R.started_key(F.when(F.col("o_orderkey") % 3 == 0, F.lit("2024-01-01T00:00:00")), run_id).alias("started"))
    top = keyed.orderBy(F.col("started").desc(), "o_orderkey").limit(100)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("started").desc(), "o_orderkey")).cast("long"))  # 100 rows


_RUNS = """(SELECT c_custkey AS run_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment || c_nationkey END AS idea, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS fps,
    lpad((c_custkey * 7919 % 1000)::VARCHAR, 4, '0') AS started, CASE WHEN c_custkey % 31 = 0 THEN 'Baseline of old' WHEN c_custkey % 20 = 0 THEN 'variant, not the baseline' ELSE '' END AS notes, c_custkey % 13 = 0 AS crashed FROM customer)"""


def _runs(t) -> DataFrame:
    k = F.col("c_custkey")
    idea = F.when(k % 10 != 0, F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    notes = F.when(k % 31 == 0, "Baseline of old").when(k % 20 == 0, "variant, not the baseline").otherwise("")
    return t("customer").select(k.alias("run_id"), idea.alias("idea"), F.when(k % 17 != 0, F.col("c_acctbal")).alias("fps"), F.lpad((k * 7919 % 1000).cast("string"), 4, "0").alias("started"), notes.alias("notes"), (k % 13 == 0).alias("crashed"))


@query(f"""WITH s AS (SELECT * FROM {_RUNS} WHERE fps IS NOT NULL AND NOT crashed), v AS (SELECT idea, arg_min(run_id, (-fps, run_id)) AS run_id, max(fps) AS fps FROM s WHERE idea IS NOT NULL GROUP BY 1),
    b AS (SELECT * FROM s WHERE NOT contains(lower(notes), 'variant') AND (lower(notes) LIKE 'baseline%' OR idea IS NULL)),
    o AS (SELECT idea, min(run_id) AS run_id, arg_min(fps, run_id) AS fps FROM b WHERE idea IS NOT NULL GROUP BY 1), g AS (SELECT arg_max(run_id, (started, run_id)) AS run_id, arg_max(fps, (started, run_id)) AS fps FROM b),
    m AS (SELECT v.idea, v.run_id AS variant, coalesce(o.run_id, g.run_id) AS base, v.fps AS x, coalesce(o.fps, g.fps) AS y FROM v LEFT JOIN o USING (idea), g)
    SELECT idea, variant, base, round_even(x - y, 3) AS delta, CASE WHEN y <> 0 THEN round_even(100 * (x - y) / y, 2) END AS pct FROM m WHERE variant <> base""")
def best_vs_baseline(t):
    return R.best_against_baseline(_runs(t))


@query(f"SELECT crashed, (fps IS NULL) AS unscored, count(*) AS runs, max(fps) AS best FROM {_RUNS} GROUP BY 1, 2")
def run_status(t):
    return _runs(t).groupBy("crashed", F.col("fps").isNull().alias("unscored")).agg(F.count(F.lit(1)).alias("runs"), F.max("fps").alias("best"))


@query("""WITH r AS (SELECT c_mktsegment AS arm, c_acctbal AS fps, (c_nationkey = 3 OR c_mktsegment = 'BUILDING') AS capped FROM customer)
    SELECT arm, CASE WHEN count(*) FILTER (NOT capped) > 0 THEN count(*) FILTER (NOT capped) ELSE count(*) END AS n, count(*) AS n_all,
    round(coalesce(avg(fps) FILTER (NOT capped), avg(fps))) AS fps, count(*) FILTER (capped) AS capped FROM r GROUP BY 1""")
def arm_means(t):
    runs = t("customer").select(F.col("c_mktsegment").alias("arm"), F.col("c_acctbal").alias("fps"), ((F.col("c_nationkey") == 3) | (F.col("c_mktsegment") == "BUILDING")).alias("capped"))
    return R.arm_means(runs, "arm", ["fps"], "capped").withColumn("fps", F.round("fps"))


@query("""WITH r AS (SELECT c_mktsegment AS arm, avg(c_acctbal) AS fps FROM customer GROUP BY 1), b AS (SELECT fps AS base FROM r WHERE arm = 'BUILDING')
    SELECT arm, round(fps - base, 1) AS fps_delta, round(100 * (fps - base) / base, 1) AS fps_pct FROM r, b WHERE arm <> 'BUILDING'""")
def arms_against_base(t):
    means = t("customer").groupBy(F.col("c_mktsegment").alias("arm")).agg(F.avg("c_acctbal").alias("fps"))
    return R.arms_compared(means, "arm", ["fps"], "BUILDING").select("arm", F.round("fps_delta", 1).alias("fps_delta"), F.round("fps_pct", 1).alias("fps_pct"))


@query("""SELECT o_custkey, max(v) FILTER (p = 1) AS latest, max(v) FILTER (p = 2) AS before, max(v) FILTER (p = 1) - max(v) FILTER (p = 2) AS change, string_agg(v, ',' ORDER BY p DESC) AS trend
    FROM (SELECT o_custkey, o_orderkey % 100 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p <= 5 GROUP BY 1""")
def latest_and_trends(t):
    rows = t("orders").withColumn("v", F.col("o_orderkey") % 100)
    return R.latest_and_trend(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "v").withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ","))


_TIMES = """(SELECT l_suppkey, l_linestatus AS mode, min(l_extendedprice) FILTER (l_returnflag = 'A') AS ba, median(l_extendedprice) FILTER (l_returnflag = 'A') AS ma,
    min(l_extendedprice) FILTER (l_returnflag = 'R') AS br, median(l_extendedprice) FILTER (l_returnflag = 'R') AS mr FROM lineitem GROUP BY 1, 2)"""


def _timings(t) -> DataFrame:
    arm = F.when(F.col("l_returnflag") == "A", "original").when(F.col("l_returnflag") == "R", "rewrite")
    return R.speedups(t("lineitem").withColumn("arm", arm).withColumnRenamed("l_linestatus", "mode"), ["l_suppkey", "mode"], "arm", "l_extendedprice")


@query(f"SELECT l_suppkey, mode, round(ba / br, 6) AS speedup, round(ma / mr, 6) AS speedup_median, round(greatest(ma / ba, mr / br), 6) AS jitter FROM {_TIMES}")
def bench_speedups(t):
    return _timings(t).select("l_suppkey", "mode", *[F.round(c, 6).alias(c) for c in ("speedup", "speedup_median", "jitter")])


@query(f"""SELECT l_suppkey, CASE WHEN count(*) FILTER (mode IN ('F', 'O') AND ba / br IS NOT NULL) = 2 THEN bool_and(ba / br >= 1.0) END AS passed FROM {_TIMES} WHERE mode = 'F' OR ba > 1000 GROUP BY 1""")
def bench_gate(t):
    return R.gate(_timings(t).filter("mode = 'F' OR best_original > 1000"), ["l_suppkey"], "mode", ["F", "O"], 1.0, 0.98)


_SPEC = "1-5?:15 10:3 20-40:7, 90:2 7-3:1 x"
_BUCKETS = "(VALUES (1, 5, 15, true), (10, 10, 3, false), (20, 40, 7, false), (90, 90, 2, false)) b(lo, hi, sites, estimated)"


@query(f"SELECT p_brand, lo::INT AS lo, hi::INT AS hi, sites::INT AS sites, estimated FROM (SELECT DISTINCT p_brand FROM part), {_BUCKETS}")
def bucket_specs(t):
    brands = t("part").select("p_brand").distinct()
    return brands.select("p_brand", F.explode(R.buckets_of(F.lit(_SPEC))).alias("b")).filter("b IS NOT NULL").select("p_brand", "b.*")


_POINTS = "(SELECT p_brand, p_size AS k, avg(p_retailprice) >= 1400 AS ok FROM part GROUP BY 1, 2)"
_VERDICTS = f"(SELECT p_brand, lo, hi, sites, estimated, CASE WHEN bool_and(ok) THEN 'pass' WHEN NOT bool_or(ok) THEN 'fail' ELSE 'mixed' END AS verdict, count(*) AS points FROM {_POINTS}, {_BUCKETS} WHERE k BETWEEN lo AND hi GROUP BY ALL)"


def _verdicts(t) -> DataFrame:
    points = t("part").groupBy("p_brand", F.col("p_size").alias("k")).agg((F.avg("p_retailprice") >= 1400).alias("ok"))
    return R.bucket_verdicts(bucket_specs(t), points, "p_brand")


@query(f"SELECT p_brand, lo::INT AS lo, hi::INT AS hi, verdict, points FROM {_VERDICTS}")
def site_buckets(t):
    return _verdicts(t).select("p_brand", "lo", "hi", "verdict", "points")


@query(f"""SELECT p_brand, coalesce(sum(sites) FILTER (verdict = 'pass'), 0)::BIGINT AS pass_sites, coalesce(sum(sites) FILTER (verdict = 'fail'), 0)::BIGINT AS fail_sites,
    coalesce(sum(sites) FILTER (verdict = 'mixed'), 0)::BIGINT AS mixed_sites, sum(sites)::BIGINT AS sites, coalesce(sum(sites) FILTER (estimated), 0)::BIGINT AS estimated_sites FROM {_VERDICTS} GROUP BY 1""")
def weighted_verdicts(t):
    return R.weighted_verdict(_verdicts(t), "p_brand")


@query("""SELECT coalesce(c_custkey, o_custkey) AS key, CASE WHEN n IS NULL THEN c_name ELSE 'changed' END AS name, coalesce(n, c_acctbal) AS value
    FROM customer FULL JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def merge_by_key(t):
    old = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    new = t("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.lit("changed").alias("name"), F.max("o_totalprice").alias("value"))
    return R.merged(old, new, "key")


@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM orders) WHERE place <= 5""")
def rolling_history(t):
    return R.recent(t("orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5).select("o_custkey", "o_orderkey", "place")


@query("""SELECT name, old, new FROM (SELECT 'c' || x AS name, CASE WHEN c_acctbal > 0 THEN 'enabled' WHEN c_acctbal IS NOT NULL THEN 'disabled' END AS old,
    CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN x % 2 = 0 THEN 'enabled' ELSE 'disabled' END AS new FROM (SELECT o_orderkey AS x FROM orders) LEFT JOIN customer ON c_custkey = x) WHERE old IS DISTINCT FROM new""")
def toggle_diff(t):
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("name")
    return R.toggled(t("customer").select(name("c_custkey"), (F.col("c_acctbal") > 0).alias("enabled")), t("orders").select(name("o_orderkey"), (F.col("o_orderkey") % 2 == 0).alias("want")), "name")


# ---- profiler: an arm an event type, a run a day


def _windows(t) -> DataFrame:
    us = micros("ts")
    return t("events").groupBy(F.col("event_type").alias("arm"), F.floor(us / 86_400_000_000).alias("run"), F.floor(us / 3_600_000_000).alias("w")).agg(F.avg("value").alias("ms"))


_MEANS = "(SELECT event_type AS arm, run, avg(ms) AS m, row_number() OVER (PARTITION BY event_type ORDER BY run) AS p FROM (SELECT event_type, epoch_us(ts) // 86400000000 AS run, epoch_us(ts) // 3600000000 AS w, avg(value) AS ms FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query(f"SELECT arm, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m) / avg(m) * 100, 6) AS cv_pct, round((max(m) - min(m)) / avg(m) * 100, 6) AS range_pct FROM {_MEANS} GROUP BY 1")
def run_spread(t):
    return P.run_spread(_windows(t), "arm", "run", "ms").select("arm", "n", "mean", "cv_pct", "range_pct")


@query(f"""WITH a AS (SELECT arm, count(*) AS runs, round(avg(m), 6) AS cold, round(avg(m) FILTER (p > 1), 6) AS warm FROM {_MEANS} GROUP BY 1), b AS (SELECT arg_min(cold, arm) AS c, arg_min(warm, arm) AS w FROM a)
    SELECT arm, runs, cold, warm, round_even(100 * (cold - c) / c, 2) AS cold_pct, round_even(100 * (warm - w) / w, 2) AS warm_pct FROM a, b""")
def arm_cold_warm(t):
    return P.cold_and_warm(_windows(t), "arm", "run", "ms")


@query("""WITH f AS (SELECT user_id, count(*) AS frames FROM events GROUP BY 1), r AS (SELECT user_id, event_type, sum(value) / any_value(frames) AS rate FROM events JOIN f USING (user_id) GROUP BY 1, 2)
    SELECT event_type, count(*) AS runs, round(avg(rate), 6) AS per_frame, round(stddev_samp(rate) / avg(rate) * 100, 6) AS cv_pct FROM r GROUP BY 1""")
def ranking_over_runs(t):
    frames = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))
    return P.ranking_over_runs(t("events"), "user_id", "event_type", "value", frames)


@query("SELECT o_custkey, round((sum(o_orderkey % 7 + o_orderkey % 3) * 200.0 / nullif(sum(o_orderkey % 5), 0)) / 1e6, 9) AS overhead_ms FROM orders GROUP BY 1")
def overhead_estimate(t):
    k = F.col("o_orderkey")
    w = t("orders").select("o_custkey", (k % 7).alias("calls"), (k % 3).alias("nested"), (k % 5).alias("frames"))
    return P.overhead(w, "o_custkey", "calls", "nested", "frames", F.lit(200.0)).withColumn("overhead_ms", F.round("overhead_ms", 9))


@query("""SELECT user_id, count(*) AS n, max(value) AS worst_ms, median(value) AS median_ms, round(median((props::JSON ->> 'k')::BIGINT / value), 6) AS median_share, count(*) FILTER (-(props::JSON ->> 'k')::BIGINT < -64) AS gc_frames
    FROM events WHERE value >= 20 AND event_type <> 'error' GROUP BY 1""")
def slow_frame_summary(t):
    k = F.get_json_object("props", "$.k").cast("long")
    slow = P.slow_frames(t("events"), "value", 20.0, F.col("event_type") == "error").withColumn("share", k / F.col("value")).withColumn("gc", -k)
    return P.frame_summary(slow, "user_id", "value", "share", "gc").withColumn("median_share", F.round("median_share", 6))


@query("""SELECT o_custkey, label, n, ms, max_ms, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ms DESC, label)::INT AS place FROM (
    SELECT o_custkey, 'p' || (l_partkey % 10) AS label, count(*) AS n, sum(l_quantity) AS ms, max(l_quantity) AS max_ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 10 <> 0 GROUP BY 1, 2)) WHERE place <= 3""")
def top_scopes(t):
    label = F.when(F.col("l_partkey") % 10 == 0, "-").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 10).cast("string")))
    tops = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(label.alias("label"), F.col("l_quantity").alias("ms"))).alias("top"))
    frames = tops.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return P.top_scopes(frames, "o_custkey", "top", 3)


@query("""WITH s AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000) % 100000 AS sec FROM events), e AS (SELECT user_id, max(sec) AS last, min(sec) FILTER (sec >= 90000) AS first FROM s GROUP BY 1)
    SELECT event_id, sec - coalesce(first, last) AS sec FROM s JOIN e USING (user_id) WHERE sec >= coalesce(first, last)""")
def warm_up_trim(t):
    s = t("events").select("user_id", "event_id", (F.floor(micros("ts") / 1_000_000) % 100_000).alias("sec"))
    return P.trimmed(s, "user_id", "sec", 90_000).select("event_id", "sec")


@query("""WITH h AS (SELECT p_partkey, p_size % 3 AS a, p_size % 5 AS b, p_size % 7 AS c, greatest(p_size * 4, p_size % 3 + p_size % 5 + p_size % 7) AS total FROM part)
    SELECT p_partkey, CASE WHEN total > 0 AND c >= total * 0.1 THEN 8.0 WHEN total > 0 AND b + c >= total * 0.1 THEN 4.0 WHEN total > 0 AND a + b + c >= total * 0.1 THEN 2.0 ELSE 0.0 END::DOUBLE AS p_lo,
    CASE WHEN total > 0 AND c >= total * 0.1 THEN NULL WHEN total > 0 AND b + c >= total * 0.1 THEN 8.0 WHEN total > 0 AND a + b + c >= total * 0.1 THEN 4.0 ELSE 2.0 END::DOUBLE AS p_hi FROM h""")
def tail_brackets(t):
    s = F.col("p_size")
    parts = [s % 3, s % 5, s % 7]
    hits = t("part").select("p_partkey", F.array(*parts).alias("buckets"), F.lit(2.0).alias("floor"), (parts[0] + parts[1] + parts[2]).alias("above"), (s * 4).alias("calls"))
    return P.tail_bracket(hits, ["p_partkey"], "buckets", "floor", "above", "calls", 0.9)


@query("""SELECT p_brand, sum(p_size)::BIGINT AS calls, max(p_retailprice) AS max_ms, min(p_partkey) AS first_frame, max(p_size)::INT AS p_lo, max(p_size)::INT * 2 AS p_hi FROM part GROUP BY 1""")
def hitches_over_runs(t):
    p = t("part").select("p_brand", F.col("p_size").alias("calls"), F.col("p_retailprice").alias("max_ms"), F.col("p_partkey").alias("first_frame"), F.col("p_size").alias("p_lo"), (F.col("p_size") * 2).alias("p_hi"))
    return P.merged_hitches(p, ["p_brand"])


@query("""SELECT l_suppkey, count(*) FILTER (l_partkey > l_orderkey) AS grew, round(avg(l_quantity) FILTER (l_partkey > l_orderkey), 6) AS grew_mean, round(avg(l_quantity) FILTER (l_partkey <= l_orderkey), 6) AS flat_mean FROM lineitem GROUP BY 1""")
def growth_split(t):
    return P.growth_split(t("lineitem"), "l_suppkey", "l_orderkey", "l_partkey", "l_quantity").select("l_suppkey", "grew", F.round("grew_mean", 6).alias("grew_mean"), F.round("flat_mean", 6).alias("flat_mean"))


@query(f"""SELECT event_id, {" OR ".join(f"coalesce(epoch_us(ts) - lag(epoch_us(ts), {i}) OVER w BETWEEN 3600000000 AND 7200000000, false)" for i in range(1, 7))} AS in_train FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts))""")
def frame_trains(t):
    return P.trains(t("events").select("event_id", "user_id", micros("ts").alias("us")), "user_id", "us", 3_600_000_000, 7_200_000_000, 6).select("event_id", "in_train")


# ---- graphs: suppliers and parts of line items


def _edges(t) -> DataFrame:
    return t("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("s"), ((F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 997).cast("string")).alias("dst"), F.col("l_returnflag").alias("kind"))


_EDGES = "(SELECT 's' || l_suppkey AS src, 's' || ((l_suppkey * 3 + l_linenumber) % 997) AS dst, min(l_returnflag) AS kind FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)"
_REACH = f"""WITH RECURSIVE r(node, hop, via) AS (SELECT 's' || s_suppkey, 0, NULL::VARCHAR FROM supplier WHERE s_nationkey = 3 UNION SELECT dst, hop + 1, kind FROM r JOIN {_EDGES} e ON src = node WHERE hop < 3),
    m AS (SELECT node, min(hop) AS hop FROM r GROUP BY 1), f AS (SELECT node, hop, min(via) AS via FROM r JOIN m USING (node, hop) GROUP BY 1, 2)"""


def _reached(t) -> DataFrame:
    start = t("supplier").filter("s_nationkey = 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.reach(start, _edges(t), 3, ["A", "R"])


@query(_REACH + " SELECT node, hop::INT AS hop, via FROM f")
def closure_bfs(t):
    return _reached(t)


@query(_REACH + " SELECT hop::INT AS hop, n AS nodes, sum(n) OVER (ORDER BY hop)::BIGINT AS upto FROM (SELECT hop, count(*) AS n FROM f GROUP BY 1)")
def hop_summary(t):
    return G.hop_summary(_reached(t))


@query("""SELECT node, origin FROM (SELECT 's' || s_suppkey AS node, 'name' AS origin FROM supplier WHERE s_acctbal < 0 UNION SELECT 's' || s_suppkey, 'registration' FROM supplier WHERE s_nationkey < 5 AND s_acctbal >= 0)""")
def entry_seeds(t):
    s = t("supplier").withColumn("node", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return G.seeds(s.filter("s_acctbal < 0"), s.filter("s_nationkey < 5"))


@query("""WITH RECURSIVE c(node, ancestor, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT node, (ancestor - 1) // 3, depth + 1 FROM c WHERE ancestor > 0) SELECT node, ancestor, depth::INT AS depth FROM c""")
def scope_ancestors(t):
    k = F.col("c_custkey")
    return G.ancestors(t("customer").select(k.alias("node"), F.when(k > 0, F.floor((k - 1) / 3)).alias("parent")))


@query("""WITH RECURSIVE c(node, ancestor, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT node, (ancestor - 1) // 3, depth + 1 FROM c WHERE ancestor > 0)
    SELECT node, arg_min(ancestor, depth) AS ancestor, arg_min(c_mktsegment, depth) AS kind FROM c JOIN customer ON c_custkey = ancestor WHERE c_nationkey < 8 GROUP BY 1""")
def nearest_ancestor(t):
    marked = t("customer").filter("c_nationkey < 8").select(F.col("c_custkey").alias("ancestor"), F.col("c_mktsegment").alias("kind"))
    return G.nearest(scope_ancestors(t), marked)


@query("""WITH l AS (SELECT l_suppkey AS file, 'p' || l_partkey AS name, min(l_orderkey) AS target FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), x AS (SELECT 'p' || p_partkey AS name, p_partkey AS target FROM part WHERE p_size < 10),
    c AS (SELECT DISTINCT l_suppkey AS file, CASE WHEN l_linenumber = 7 THEN 'o:' ELSE '' END || 'p' || l_partkey AS name FROM lineitem)
    SELECT c.file, c.name, coalesce(l.target, x.target) AS target, CASE WHEN l.target IS NOT NULL THEN 'local' WHEN x.target IS NOT NULL THEN 'exported' WHEN contains(c.name, ':') THEN 'method' ELSE 'unresolved' END AS kind
    FROM c LEFT JOIN l ON l.file = c.file AND l.name = c.name LEFT JOIN x ON x.name = c.name""")
def call_resolution(t):
    l = t("lineitem").withColumn("file", F.col("l_suppkey")).withColumn("name", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))  # noqa: E741
    calls = l.select("file", F.when(F.col("l_linenumber") == 7, F.concat(F.lit("o:"), "name")).otherwise(F.col("name")).alias("name")).distinct()
    exported = t("part").filter("p_size < 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("target"))
    return G.resolved(calls, l.filter("l_linenumber = 1").select("file", "name", F.col("l_orderkey").alias("target")), exported).drop("ambiguous")


@query("""SELECT kind, count(*) AS calls, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (WITH l AS (SELECT DISTINCT l_suppkey AS file, 'p' || l_partkey AS name FROM lineitem WHERE l_linenumber = 1),
    x AS (SELECT 'p' || p_partkey AS name FROM part WHERE p_size < 10), c AS (SELECT DISTINCT l_suppkey AS file, CASE WHEN l_linenumber = 7 THEN 'o:' ELSE '' END || 'p' || l_partkey AS name FROM lineitem)
    SELECT CASE WHEN l.name IS NOT NULL THEN 'local' WHEN x.name IS NOT NULL THEN 'exported' WHEN contains(c.name, ':') THEN 'method' ELSE 'unresolved' END AS kind
    FROM c LEFT JOIN l ON l.file = c.file AND l.name = c.name LEFT JOIN x ON x.name = c.name) GROUP BY 1""")
def resolution_breakdown(t):
    by = call_resolution(t).groupBy("kind").agg(F.count(F.lit(1)).alias("calls"))
    return by.join(F.broadcast(by.agg(F.sum("calls").alias("all")))).select("kind", "calls", F.round(100 * F.col("calls") / F.col("all"), 6).alias("pct"))  # a row a kind


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS file, c_custkey // 3 AS included FROM customer UNION SELECT c_custkey, (c_custkey + 1) // 2 FROM customer), r(root, file, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_nationkey = 1
    UNION SELECT root, included, depth + 1 FROM r JOIN e USING (file) WHERE depth < 40) SELECT root, file, min(depth)::INT AS depth FROM r GROUP BY 1, 2""")
def include_closure(t):
    k = F.col("c_custkey")
    lines = t("customer").select(k.alias("file"), F.explode(F.array(F.floor(k / 3), F.floor((k + 1) / 2))).alias("included"))
    return G.includes(lines, t("customer").filter("c_nationkey = 1").select(k.alias("file")))


@query("SELECT c_custkey || '.' || i AS id, c_custkey::VARCHAR AS parent, c_nationkey + 1 AS generation FROM customer, range(1, 4) x(i) WHERE c_acctbal > 9000")
def offspring(t):
    kept = t("customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("generation"))
    return G.offspring(kept, "id", "generation", 3)


@query("""WITH s AS (SELECT o_custkey AS user_id, o_orderkey, o_orderkey % 1000 AS lo, o_orderkey % 1000 + 20 AS hi FROM orders) SELECT event_id, o_orderkey FROM events e JOIN s USING (user_id) WHERE lo < event_id % 1100 AND event_id % 1100 < hi""")
def insertions_inside(t):
    spans = t("orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", (F.col("o_orderkey") % 1000).alias("lo"), (F.col("o_orderkey") % 1000 + 20).alias("hi"))
    return G.inside(t("events").select("event_id", "user_id"), F.col("event_id") % 1100, spans, ["user_id"], 32).select("event_id", "o_orderkey")


# ---- mods and benches


def _paths(t) -> DataFrame:
    k, brand = F.col("p_partkey").cast("string"), F.col("p_brand")
    shapes = [
        F.concat(F.lit("/g/mods/"), brand, F.lit("/gamedata/scripts/sub/"), k, F.lit(".script")), F.concat(F.lit("/g/mods/"), brand, F.lit("/gamedata/scripts/"), k, F.lit(".txt")),
        F.concat(F.lit("/g/mods/pack/"), brand, F.lit("/gamedata/scripts/"), k, F.lit(".lua")), F.concat(F.lit("/g/mods/backup/gamedata/scripts/"), k, F.lit(".lua")),
        F.concat(F.lit("/g/mods/gamedata/scripts/"), k, F.lit(".lua")), F.concat(F.lit("/g/mods/.git/gamedata/scripts/"), k, F.lit(".lua")),
        F.concat(F.lit("/g/mods/"), brand, F.lit("/inner/gamedata/scripts/"), k, F.lit(".lua")),
    ]
    return t("part").select(F.element_at(F.array(*shapes), (F.col("p_partkey") % 7).cast("int") + 1).alias("path"))


@query("""SELECT mod, path FROM (SELECT CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 2 THEN 'pack/' || p_brand WHEN 4 THEN 'mods' WHEN 6 THEN CASE WHEN p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 7 = 0) THEN p_brand || '/inner' END END AS mod,
    CASE p_partkey % 7 WHEN 0 THEN '/g/mods/' || p_brand || '/gamedata/scripts/sub/' || p_partkey || '.script' WHEN 2 THEN '/g/mods/pack/' || p_brand || '/gamedata/scripts/' || p_partkey || '.lua' WHEN 6 THEN '/g/mods/' || p_brand || '/inner/gamedata/scripts/' || p_partkey || '.lua' ELSE '/g/mods/gamedata/scripts/' || p_partkey || '.lua' END AS path
    FROM part) WHERE mod IS NOT NULL""")
def discover_mods(t):
    return D.discovered(_paths(t), "/g/mods")


@query("SELECT '(direct)' AS mod, count(*) AS files FROM part WHERE p_partkey % 7 <> 1")
def discover_direct(t):
    return D.direct(_paths(t)).groupBy("mod").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT 'm' || s_suppkey AS mod, CASE WHEN s_nationkey < 8 THEN 'Title ' || s_suppkey WHEN s_acctbal > 0 THEN s_name ELSE 'm' || s_suppkey END AS name, CASE WHEN s_acctbal > 0 THEN '1.' || s_nationkey END AS version, NULL::VARCHAR AS author FROM supplier""")
def mod_metadata(t):
    k = F.col("s_suppkey")
    mod = F.concat(F.lit("m"), k.cast("string")).alias("mod")
    meta = t("supplier").filter("s_acctbal > 0").select(mod, F.lit("meta.ini").alias("file"), F.concat(F.lit("[General]\nname="), "s_name", F.lit("\r\nversion=1."), "s_nationkey", F.lit("\nauthor=\n")).alias("text"))
    info = t("supplier").filter("s_nationkey < 8").select(mod, F.lit("modinfo.txt").alias("file"), F.concat(F.lit(" Title "), k, F.lit("\nmore")).alias("text"))
    other = t("supplier").select(mod, F.lit("readme.txt").alias("file"), F.lit("name=no").alias("text"))
    return D.mod_info(meta.unionByName(info).unionByName(other))


def _encoded(t) -> DataFrame:
    kinds = [F.concat(F.unhex(F.lit("EFBBBF")), F.encode("p_name", "UTF-8")), F.encode(F.concat("p_name", F.lit("é")), "UTF-8"), F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("CFF0E8"))), F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("A920B1")))]
    return t("part").select("p_partkey", F.element_at(F.array(*kinds), (F.col("p_partkey") % 4).cast("int") + 1).alias("content"))


@query("""SELECT p_partkey, ['utf-8-sig', 'utf-8', 'cp1251', 'latin-1'][p_partkey % 4 + 1] AS encoding, p_name || ['', 'é', 'При', '© ±'][p_partkey % 4 + 1] AS text FROM part""")
def decoded_files(t):
    return D.decoded(_encoded(t))


@query("""SELECT ['utf-8-sig', 'utf-8', 'cp1251', 'latin-1'][p_partkey % 4 + 1] AS encoding, count(*) AS files, sum(length(p_name) + [3, 2, 3, 3][p_partkey % 4 + 1])::BIGINT AS bytes FROM part GROUP BY 1""")
def encoding_histogram(t):
    e = _encoded(t)
    sized = D.decoded(e.withColumn("bytes", F.octet_length("content")))
    return sized.groupBy("encoding").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query("""SELECT 'b' || s_suppkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'unknown directive @colour' WHEN 1 THEN 'missing section rewrite' WHEN 2 THEN 'missing @title' END AS fault, CASE WHEN s_suppkey % 4 <> 1 THEN 'b = 2' END AS rewrite,
    CASE WHEN s_suppkey % 4 = 3 THEN 'one two' END AS notes FROM supplier""")
def bench_files(t):
    k = F.col("s_suppkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % 4).cast("int") + 1)
    text = F.concat_ws("\n", F.lit("-- @pattern p"), pick("-- @title x", "-- @title x", "-- plain", "-- @title x"), pick("-- @colour red", "", "", "-- @notes one"), F.lit("-- @setup"), F.lit("local a"), F.lit("-- @original a = 1"), F.lit("a = 1"), pick("-- @rewrite", "", "--@rewrite", "-- @rewrite"), F.lit("b = 2"), F.lit("-- @sink"), F.lit("return a"), pick("", "", "", "-- @notes two"))
    found = D.bench_cases(t("supplier").select(F.concat(F.lit("b"), k.cast("string")).alias("path"), text.alias("text")))
    return found.select("path", "fault", F.col("sections")["rewrite"].alias("rewrite"), F.col("meta")["notes"].alias("notes"))


@query("SELECT s_suppkey::INT AS row, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'a=b' ELSE '' END AS arguments FROM supplier")
def keyed_settings(t):
    k = F.col("s_suppkey").cast("string")
    lines = F.array(F.concat(k, F.lit("\\title="), "s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(k, F.lit("\\arguments=a=b"))).otherwise("size=2"), F.lit("x\\title=no"))
    return D.keyed_rows(t("supplier").select(F.explode(lines).alias("line")), ["title", "arguments"])


@query("SELECT p_partkey, p_size::BIGINT AS files, CASE WHEN p_size % 2 = 0 THEN 7 END::BIGINT AS errors FROM part")
def scraped_counters(t):
    text = F.concat(F.lit("done\nFiles: "), "p_size", F.when(F.col("p_size") % 2 == 0, "\n  errors:7").otherwise(""), F.lit("\nfiles per second: 3"))
    bag = D.counters(text, ["files", "errors"])
    return t("part").select("p_partkey", bag["files"].alias("files"), bag["errors"].alias("errors"))


@query("""WITH p AS (SELECT p_brand, sha256(p_partkey::VARCHAR)[1:3] AS part, sha256(string_agg(p_partkey || ' ' || sha256(p_name), chr(10) ORDER BY p_partkey::VARCHAR)) AS digest, count(*) AS files FROM part GROUP BY 1, 2)
    SELECT p_brand, sha256(string_agg(part || ' ' || digest, chr(10) ORDER BY part)) AS digest, sum(files)::BIGINT AS files FROM p GROUP BY 1""")
def tree_digests(t):
    return D.tree_digest(t("part").select("p_brand", F.col("p_partkey").cast("string").alias("path"), F.sha2("p_name", 256).alias("sha256")), ["p_brand"])


# ---- reports


def _findings(t) -> DataFrame:
    l = t("lineitem")  # noqa: E741
    severity = F.element_at(F.array(*map(F.lit, ("GREEN", "YELLOW", "RED", "DEBUG"))), (F.col("l_linenumber") % 4) + 1)
    return l.select(F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")).alias("mod"), F.col("l_suppkey").cast("string").alias("path"), F.concat(F.lit("p"), (F.col("l_partkey") % 12).cast("string")).alias("pattern"), severity.alias("severity"), F.col("l_orderkey").alias("line"))


_FINDINGS = "(SELECT 'm' || (l_suppkey % 10) AS mod, l_suppkey::VARCHAR AS path, 'p' || (l_partkey % 12) AS pattern, ['GREEN', 'YELLOW', 'RED', 'DEBUG'][l_linenumber % 4 + 1] AS severity, l_orderkey AS line FROM lineitem)"


@query(f"SELECT pattern, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, pattern)::INT AS place FROM {_FINDINGS} GROUP BY 1")
def pattern_counts(t):
    return K.pattern_counts(_findings(t))


@query(f"SELECT severity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, CASE severity WHEN 'RED' THEN 1 WHEN 'YELLOW' THEN 2 WHEN 'GREEN' THEN 3 ELSE 1000 END::INT AS place FROM {_FINDINGS} GROUP BY 1")
def severity_counts(t):
    return K.severity_counts(_findings(t), ["RED", "YELLOW", "GREEN"])


@query(f"SELECT mod, count(DISTINCT path) AS files, count(*) AS findings, count(*) FILTER (severity = 'RED') AS red FROM {_FINDINGS} GROUP BY 1")
def nested_rollup(t):
    red = F.size(F.filter("findings", lambda x: x["severity"] == "RED")).cast("long")
    return K.nested(_findings(t)).groupBy("mod").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("findings").cast("long")).alias("findings"), F.sum(red).alias("red"))


@query(f"""SELECT mod, count(DISTINCT path) AS files, count(*) AS findings, count(*) FILTER (severity = 'RED') AS red, count(*) FILTER (pattern = 'p1') AS high, count(*) FILTER (pattern <> 'p1') AS low FROM {_FINDINGS} GROUP BY 1""")
def mod_rollup(t):
    """Totals of each mod with those of each impact."""
    impacts = t("region").sparkSession.createDataFrame([("p1", "high")], "pattern string, impact string")
    rows = K.rollup(_findings(t), impacts, "low")
    bag = lambda c, k: F.coalesce(F.col(c)[k], F.lit(0))
    return rows.select("mod", "files", "findings", bag("by_severity", "RED").alias("red"), bag("by_impact", "high").alias("high"), bag("by_impact", "low").alias("low"))


@query(f"""SELECT (SELECT count(*) FROM {_FINDINGS}) AS findings, (SELECT count(*) FROM {_FINDINGS} WHERE severity = 'RED') AS red, (SELECT count(*) FROM {_FINDINGS} WHERE pattern = 'p1') AS p1,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failures, (SELECT sum(o_orderkey % 5)::BIGINT FROM orders) AS applied, (SELECT count(*) FROM orders WHERE o_orderkey % 5 > 0) AS modified""")
def report_summary(t):
    """What a whole report says first."""
    failures = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("path"), F.lit("parse").alias("what"))
    rewritten = t("orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 5).alias("applied"), F.lit(0).alias("dropped"))
    s = K.summary(_findings(t), failures, rewritten)
    return s.select("findings", F.col("by_severity")["RED"].alias("red"), F.col("by_pattern")["p1"].alias("p1"), "failures", "applied", "modified")


@query(f"SELECT mod, sha256('{{\"mod\":\"' || mod || '\",\"total\":' || count(*) || ',\"by_severity\":{{\"DEBUG\":' || count(*) FILTER (severity = 'DEBUG') || ',\"GREEN\":' || count(*) FILTER (severity = 'GREEN') || ',\"RED\":' || count(*) FILTER (severity = 'RED') || ',\"YELLOW\":' || count(*) FILTER (severity = 'YELLOW') || '}}}}') AS digest FROM {_FINDINGS} GROUP BY 1")
def json_reports(t):
    return K.json_documents(_findings(t)).select("mod", F.sha2("document", 256).alias("digest"))


@query(f"""SELECT string_agg(line, chr(10) ORDER BY place) AS text FROM (SELECT 0 AS place, '| pattern | n |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL
    SELECT 2 + row_number() OVER (ORDER BY n DESC, pattern), '| ' || pattern || ' | ' || n || ' |' FROM (SELECT pattern, count(*) AS n FROM {_FINDINGS} GROUP BY 1))""")
def markdown_report(t):
    rows = K.pattern_counts(_findings(t)).orderBy("place").select("pattern", "n")
    return t("region").sparkSession.createDataFrame([(K.markdown(rows),)], "text string")


@query(f"SELECT path, severity, line FROM (SELECT *, row_number() OVER (PARTITION BY path, severity ORDER BY line, pattern) AS r FROM (SELECT DISTINCT path, severity, line, pattern FROM {_FINDINGS})) WHERE r <= 8")
def capped_examples(t):
    return K.examples(_findings(t).distinct(), ["path", "severity"], ["line", "pattern"], 8).select("path", "severity", "line")


@query(f"""WITH g AS (SELECT DISTINCT path, line, pattern, severity FROM {_FINDINGS} WHERE severity IN ('GREEN', 'YELLOW')), o AS (SELECT DISTINCT path, line, pattern FROM {_FINDINGS} WHERE pattern IN ('p1', 'p2') AND severity = 'DEBUG')
    SELECT path, line, pattern FROM g UNION ALL SELECT path, line, pattern FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.path = o.path AND g.line = o.line)""")
def fixable_findings(t):
    return K.fixable(_findings(t).select("path", "line", "pattern", "severity").distinct(), ["GREEN", "YELLOW"], F.col("pattern").isin("p1", "p2") & (F.col("severity") == "DEBUG")).select("path", "line", "pattern")


@query(f"SELECT mod, count(*) AS n FROM {_FINDINGS} WHERE mod NOT IN (SELECT 'm' || r_regionkey FROM region) GROUP BY 1")
def excluded_mods(t):
    excluded = t("region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("mod"))
    return K.without(_findings(t), excluded, "mod").groupBy("mod").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT pattern, count(*) AS n, any_value(CASE WHEN pattern = 'p1' THEN 'high' WHEN pattern LIKE 'p1%' THEN 'medium' ELSE 'low' END) AS impact FROM {_FINDINGS} GROUP BY 1""")
def impacts(t):
    table = t("region").sparkSession.createDataFrame([("p1", "high")], "pattern string, impact string")
    return K.with_impact(K.pattern_counts(_findings(t)), table, [("p1", "medium")], "low").select("pattern", "n", "impact")


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '@@ -1,3 +1,3 @@' END AS head, CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END::INT AS changed FROM customer""")
def unified_diffs(t):
    old = F.concat(F.lit("a\n"), "c_name", F.lit("\nz"))
    new = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("a\nnew "), "c_name", F.lit("\nz"))).otherwise(old)
    d = K.unified_diff(t("customer").select("c_custkey", old.alias("old"), new.alias("new")), ["c_custkey"])
    lines = F.split("diff", "\n")
    marks = F.size(F.filter(lines, lambda x: x.rlike(r"^[-+](?![-+]{2})")))
    return d.select("c_custkey", F.nullif(F.regexp_extract("diff", r"(?m)^(@@ .* @@)$", 1), F.lit("")).alias("head"), F.when(F.col("diff") != "", marks).otherwise(0).alias("changed"))


@query("SELECT chunk::INT AS chunk, count(*) AS mods, min(p_brand) AS first FROM (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1) // 7 AS chunk FROM (SELECT DISTINCT p_brand FROM part)) GROUP BY 1")
def archive_chunks(t):
    return K.chunks(t("part").select("p_brand").distinct(), "p_brand", 7).groupBy("chunk").agg(F.count(F.lit(1)).alias("mods"), F.min("p_brand").alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN (p_size * 37) || ' B' WHEN p_size < 30 THEN printf('%.1f KB', p_size * 4096 / 1024.0) ELSE printf('%.1f MB', p_size * 1048576 * 3 / 1048576.0) END AS size FROM part")
def human_sizes(t):
    s = F.col("p_size").cast("long")
    return t("part").select("p_partkey", T.human_size(F.when(s < 10, s * 37).when(s < 30, s * 4096).otherwise(s * 1048576 * 3)).alias("size"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 3) THEN p_size END::BIGINT AS whole, CASE WHEN p_size % 4 = 1 THEN p_size + 0.5 WHEN p_size % 4 = 3 THEN NULL ELSE NULL END::DOUBLE AS real FROM part")
def typed_numbers(t):
    s = F.col("p_size")
    text = F.when(s % 4 == 0, s.cast("string")).when(s % 4 == 1, F.concat(s.cast("string"), F.lit(".5"))).when(s % 4 == 2, "nil").otherwise(F.concat(F.lit(" "), s.cast("string")))
    n = T.typed_number(text)
    return t("part").select("p_partkey", n["whole"].alias("whole"), n["real"].alias("real"))


@query("""SELECT doc_id, length(text) AS n, length(text) - length(replace(replace(text, '.', ''), ',', '')) AS marks FROM documents WHERE text IS NOT NULL""")
def masked_texts(t):
    """Offsets stay: a masked text is as long as before, and what isn't in a comment or literal is still there."""
    masked = T.masked_scripts(t("documents").filter("text IS NOT NULL").select("doc_id", F.concat(F.regexp_replace("text", "[^.,]", "x"), F.lit("--.,")).alias("text")), "text")
    return masked.select("doc_id", (F.length("text") - 4).cast("long").alias("n"), F.length(F.regexp_replace("text", "[^.,]", "")).cast("long").alias("marks"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN chr(9) ELSE repeat(' ', (c_custkey % 3 * 2)::INT) END AS unit FROM customer")
def indent_units(t):
    k = F.col("c_custkey")
    unit = F.when(k % 3 == 0, "\t").otherwise(F.repeat(F.lit(" "), (k % 3 * 2).cast("int")))
    text = F.concat(F.lit("a\n"), unit, F.lit("b\n"), unit, unit, F.lit("c\n"), unit, F.lit("d"))
    return T.indent_unit(t("customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 AND value <> 0 THEN round(1000 / value, 9) END AS ft, CASE WHEN event_id % 3 = 0 AND value <> 0 THEN round(1000 / value, 9) WHEN event_id % 3 = 1 THEN value END AS fps FROM events""")
def derived_rates(t):
    k, v = F.col("event_id") % 3, F.col("value")
    ft, fps = T.rates(F.when(k == 0, v), F.when(k == 1, v))
    return t("events").select("event_id", F.when(k == 0, ft).otherwise(F.round(ft, 9)).alias("ft"), F.when(k == 1, fps).otherwise(F.round(fps, 9)).alias("fps"))


@query("""SELECT c_custkey, c_nationkey, place FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN v ~ '^[0-9]+$' THEN 0 ELSE 1 END, CASE WHEN v ~ '^[0-9]+$' THEN v::BIGINT END, v NULLS LAST, c_custkey)::INT AS place FROM
    (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE c_nationkey::VARCHAR END AS v FROM customer)) WHERE place <= 200""")
def natural_order(t):
    k = F.col("c_custkey")
    v = F.when(k % 50 == 0, F.lit(None)).when(k % 7 == 0, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string"))
    top = t("customer").withColumn("v", v).orderBy(*K.natural("v"), "c_custkey").limit(200)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(*K.natural("v"), "c_custkey"))).select("c_custkey", "c_nationkey", "place")  # 200 rows


@query("""SELECT user_id, event_id, (event_type IN ('error') AND before IS NULL) AS fresh, before FROM (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)::BIGINT AS before FROM events)""")
def preceding_context(t):
    before = K.seen_before(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 5, "before")
    return before.select("user_id", "event_id", ((F.col("event_type") == "error") & F.col("before").isNull()).alias("fresh"), "before")


@query("""SELECT o_custkey, CASE WHEN max(b) < 0 THEN 'never' WHEN bool_and(b >= 0) AND arg_max(b, o_orderkey) = 0 THEN 'closed' WHEN bool_or(b < 0) THEN 'broken' ELSE 'open' END AS outcome FROM (
    SELECT o_custkey, o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN -1 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) GROUP BY 1""")
def bracket_balance(t):
    delta = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return K.balance(t("orders"), "o_custkey", "o_orderkey", delta)


@query("""SELECT p_partkey, p_name || ' patched' AS text FROM part WHERE p_name NOT LIKE '%o%o%' AND p_name LIKE '%o%' UNION ALL SELECT p_partkey, NULL FROM part WHERE p_name LIKE '%o%o%' OR p_name NOT LIKE '%o%'""")
def exact_once_patch(t):
    return t("part").select("p_partkey", T.patched_once(F.concat("p_name", F.lit(" patched")), "o", "o").alias("text"))
