"""The registry of queries over the test tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.time import micros
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import ranks
from ..operators import sequences as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CAPS = [30.0, 60.0, 72.0, 75.0, 120.0, 144.0, 165.0, 240.0]
KNOTS = [(0.0, 0.0), (10.0, 4.0), (25.0, 20.0), (50.0, 30.0)]


def query(sql: str | None = None):
    """Register a function of a table reader under its name, with the SQL of its rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


METRICS = """SELECT event_type, count(*) AS frames, round(1000 / avg(value), 6) AS fps_avg, round(quantile_cont(value, 0.5), 6) AS median_ms,
    round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms,
    round(avg(1000 / value) FILTER (r <= greatest(1, floor(n * 0.01))), 6) AS fps_1pct_low, min(value) AS min_ms, max(value) AS max_ms
    FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS r FROM events WHERE value > 0) GROUP BY event_type"""


@query(METRICS)
def frame_metrics_by_type(t):
    return M.frame_metrics(t("events"), "event_type", "value")


WINDOWS = """SELECT e.event_type, (epoch_us(ts) - first) // 86400000000 AS window, count(*) AS frames, round(1000 / avg(value), 6) AS fps
    FROM events e JOIN (SELECT event_type, min(epoch_us(ts)) AS first FROM events WHERE value > 0 GROUP BY 1) f USING (event_type) WHERE value > 0 GROUP BY 1, 2"""


@query(WINDOWS.replace("AS window", 'AS "window"'))
def tumbling_harmonic(t):
    return M.anchored_windows(t("events"), "event_type", "ts", "value", 86400)


@query(f"""WITH w AS ({WINDOWS.replace("AS window", 'AS "window"')}), s AS (SELECT event_type, count(*) AS windows, min(fps) AS lo, max(fps) AS hi FROM w GROUP BY 1),
    c AS (SELECT *, windows >= 3 AND hi - lo <= 40 AS steady, list_min(list_filter({CAPS}::DOUBLE[], lambda x: abs(x - (lo + hi) / 2) <= 20)) AS near FROM s)
    SELECT event_type, windows, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(steady AND near IS NOT NULL, false) AS capped, CASE WHEN steady THEN near END AS cap_fps FROM c""")
def cap_detect(t):
    return M.cap_detection(M.anchored_windows(t("events"), "event_type", "ts", "value", 86400), "event_type", CAPS, 20.0)


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    b AS (SELECT *, CASE WHEN n <= 50 THEN i ELSE ((i + 1) * 50 - 1) // n END AS bucket FROM p)
    SELECT event_type, bucket, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, bucket ORDER BY value DESC, i) AS r FROM b) WHERE r = 1""")
def downsample_worst(t):
    return M.downsample(t("events"), "event_type", "event_id", "value", 50)


@query("""SELECT user_id, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev,
    round(coalesce(stddev_samp(value), 0) / nullif(avg(value), 0) * 100, 6) AS cv_pct, min(value) AS min, max(value) AS max,
    round((max(value) - min(value)) / nullif(avg(value), 0) * 100, 6) AS range_pct FROM events GROUP BY 1, 2""")
def spread_cv(t):
    return M.spread(t("events"), ["user_id", "event_type"], "value")


@query("""WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS c, count(*) AS calls FROM lineitem GROUP BY 1)
    SELECT l_suppkey, calls, round(c, 2) AS cost, round(c / sum(c) OVER () * 100, 6) AS share_pct FROM s ORDER BY round(c, 2) DESC, l_suppkey LIMIT 20""")
def ranking_share_topk(t):
    return M.ranking(t("lineitem"), "l_suppkey", "l_extendedprice", 20)


@query("""WITH s AS (SELECT l_returnflag, l_suppkey, sum(l_extendedprice) AS c, count(*) AS calls FROM lineitem GROUP BY 1, 2),
    r AS (SELECT l_returnflag, l_suppkey, calls, round(c, 2) AS cost, round(c / sum(c) OVER (PARTITION BY l_returnflag) * 100, 6) AS share_pct,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY round(c, 2) DESC, l_suppkey) AS place FROM s) SELECT * FROM r WHERE place <= 10""")
def axis_ranking(t):
    return M.ranking(t("lineitem"), "l_suppkey", "l_extendedprice", 10, axis="l_returnflag").withColumn("place", F.col("place").cast("long"))


BUCKET = " + ".join(f"(value >= {4.0 * 2**i})::INT" for i in range(7))


@query(f"""WITH h AS (SELECT event_type, {BUCKET} AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket DESC) AS above, sum(n) OVER (PARTITION BY event_type) AS total FROM h),
    m AS (SELECT event_type, max(total)::BIGINT AS total, max(bucket) AS bucket FROM c WHERE above >= greatest(1.0, total * (1 - 0.95)) GROUP BY 1)
    SELECT event_type, total, bucket, CASE WHEN bucket = 0 THEN 0.0 ELSE 4.0 * pow(2, bucket - 1) END::DOUBLE AS p_lo, CASE WHEN bucket < 7 THEN 4.0 * pow(2, bucket) END::DOUBLE AS p_hi FROM m""")
def hitch_percentile_bracket(t):
    return M.percentile_bracket(t("events"), "event_type", "value", 4.0, 8, 0.95)


@query("""SELECT user_id, count(*) AS calls, max(value) AS max_value, arg_min(event_type, event_id) AS first_type, min(event_id) AS first_event, arg_max(event_id, (value, -event_id)) AS worst_event FROM events GROUP BY 1""")
def hitch_merge(t):
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.max("value").alias("max_value"), F.min_by("event_type", "event_id").alias("first_type"), F.min("event_id").alias("first_event"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("worst_event"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def severity_pivot(t):
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT p_brand, count(*) AS n, arg_min(p_type, p_partkey) AS first_type, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'high' ELSE 'low' END AS impact
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""")
def top_issues(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    impact = F.when(F.col("p_brand").startswith("Brand#1"), "high").otherwise("low")
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min_by("p_type", "p_partkey").alias("first_type")).withColumn("impact", impact).orderBy(F.col("n").desc(), "p_brand").limit(10)


@query("""SELECT o_orderpriority, o_orderstatus, year(o_orderdate)::INT AS y, count(*) AS n, grouping(o_orderpriority, o_orderstatus, year(o_orderdate))::BIGINT AS level
    FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus), (year(o_orderdate)))""")
def rollup_report(t):
    y = t("orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y"))
    c = [F.col(x) for x in ("o_orderpriority", "o_orderstatus", "y")]
    return y.groupingSets([[], [c[0]], [c[1]], [c[2]]], *c).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("""WITH a AS (SELECT o_orderpriority, count(*) AS a FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT o_orderpriority, count(*) AS b FROM orders WHERE year(o_orderdate) = 1995 AND o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT o_orderpriority, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(a, 0) - coalesce(b, 0) AS delta, b IS NULL AS is_new, a IS NULL AS is_gone FROM a FULL JOIN b USING (o_orderpriority)""")
def compare_full_outer(t):
    o = t("orders").withColumn("y", F.year("o_orderdate"))
    count = lambda d: d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return J.full_compare(count(o.filter("y = 1996 AND o_orderstatus = 'F'")), count(o.filter("y = 1995 AND o_orderpriority <> '5-LOW'")), "o_orderpriority", "n")


WINNER = "row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber, l_extendedprice)"


@query(f"SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, {WINNER} AS r FROM lineitem) WHERE r = 1")
def winner_resolution(t):
    return J.winners(t("lineitem"), "l_partkey", [F.col(c) for c in ("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query(f"SELECT l_partkey, l_orderkey, l_linenumber, r::INT AS place, CASE WHEN r = 1 THEN 'LIVE' ELSE 'shadowed' END AS tag FROM (SELECT *, {WINNER} AS r FROM lineitem)")
def live_copies(t):
    placed = J.winners(t("lineitem"), "l_partkey", [F.col(c) for c in ("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")], keep_losers=True)
    return placed.select("l_partkey", "l_orderkey", "l_linenumber", "place", F.when(F.col("place") == 1, "LIVE").otherwise("shadowed").alias("tag"))


@query("""WITH s AS (SELECT o_custkey AS user_id, o_orderkey, o_orderkey % 1000 AS lo, o_orderkey % 1000 + 50 + o_orderkey % 97 AS hi FROM orders),
    p AS (SELECT event_id, user_id, event_id % 1100 AS pos FROM events)
    SELECT event_id, o_orderkey FROM (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, lo DESC, o_orderkey) AS r FROM p JOIN s USING (user_id) WHERE pos BETWEEN lo AND hi) WHERE r = 1""")
def innermost_interval(t):
    spans = t("orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", (F.col("o_orderkey") % 1000).alias("lo"), (F.col("o_orderkey") % 1000 + 50 + F.col("o_orderkey") % 97).alias("hi"))
    return J.innermost(t("events").select("event_id", "user_id", (F.col("event_id") % 1100).alias("pos")), "pos", spans, "lo", "hi", ["user_id"], "event_id", 64, "o_orderkey").select("event_id", "o_orderkey")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS lo, epoch_us(o_orderdate) // 86400000000 + 30 AS hi FROM orders)
    SELECT a.o_custkey, a.o_orderkey AS first, b.o_orderkey AS second FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.lo < b.hi AND b.lo < a.hi""")
def overlap_pairs(t):
    day = F.floor(micros("o_orderdate") / 86_400_000_000)
    o = t("orders").select("o_custkey", "o_orderkey", day.alias("lo"), (day + 30).alias("hi"))
    return J.overlaps(o, "o_custkey", "o_orderkey", "lo", "hi", 30).select("a.o_custkey", F.col("a.o_orderkey").alias("first"), F.col("b.o_orderkey").alias("second"))


@query("""SELECT event_id, last_view FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events) WHERE event_type = 'purchase'""")
def asof_last_before(t):
    return J.last_before(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view", "event_id", "last_view").filter("event_type = 'purchase'").select("event_id", "last_view")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND 3600000000 PRECEDING) AS earlier FROM events""")
def train_band_join(t):
    e = t("events").withColumn("us", micros("ts"))
    return J.preceded_within(e, "user_id", "us", 3_600_000_000, 7_200_000_000, "earlier").select("event_id", "earlier")


@query("""SELECT c_custkey, coalesce(s.s_name, r.r_name, 'unresolved') AS target, CASE WHEN s.s_name IS NOT NULL THEN 'same' WHEN r.r_name IS NOT NULL THEN 'region' ELSE 'none' END AS kind
    FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey LEFT JOIN region r ON r_regionkey = c_nationkey""")
def resolve_chain(t):
    c = t("customer").join(t("supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("c_nationkey"), "left")
    kind = F.when(F.col("s_name").isNotNull(), "same").when(F.col("r_name").isNotNull(), "region").otherwise("none")
    return c.select("c_custkey", F.coalesce("s_name", "r_name", F.lit("unresolved")).alias("target"), kind.alias("kind"))


@query("SELECT r_name, n_name, i::INT AS round FROM region, nation, range(3) x(i)")
def arms_cross(t):
    # Arms, corpora and rounds: a handful of rows each by definition.
    return t("region").select("r_name").join(t("nation").select("n_name")).select("r_name", "n_name", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("round"))


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN p_size * 0.4 WHEN p_size <= 25 THEN 4 + (p_size - 10) * (16 / 15) WHEN p_size <= 50 THEN 20 + (p_size - 25) * (10 / 25) ELSE 30 END, 6)::DOUBLE AS predicted FROM part""")
def interp_band(t):
    return t("part").select("p_partkey", F.round(J.interpolated(F.col("p_size").cast("double"), KNOTS), 6).alias("predicted"))


@query("""WITH k AS (SELECT p_brand, p_size, avg(p_retailprice) >= 1400 AS ok FROM part GROUP BY 1, 2), h AS (SELECT *, min(ok::INT) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS held FROM k),
    g AS (SELECT p_brand, bool_and(ok) AS a, bool_or(ok) AS o, min(p_size) FILTER (held = 1) AS f FROM h GROUP BY 1)
    SELECT p_brand, CASE WHEN a THEN 'pass' WHEN NOT o THEN 'fail' WHEN f IS NOT NULL THEN 'from' ELSE 'mixed' END AS verdict, CASE WHEN NOT a THEN f END AS from_k FROM g""")
def bucket_verdict(t):
    k = t("part").groupBy("p_brand", "p_size").agg((F.avg("p_retailprice") >= 1400).alias("ok"))
    return S.sweep_verdict(k, "p_brand", "p_size", "ok")


@query("""SELECT event_type, d, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS r FROM (SELECT event_type, epoch_us(ts) // 86400000000 AS d, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r > 1 AND n >= 3""")
def drop_first_windows(t):
    days = t("events").groupBy("event_type", F.floor(micros("ts") / 86_400_000_000).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return S.drop_first(days, "event_type", ["d"], 1).filter("n >= 3")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS gap FROM events), s AS (SELECT user_id, list_sort(list(gap)) AS l FROM g WHERE gap IS NOT NULL GROUP BY 1)
    SELECT user_id, len(l)::INT AS gaps, l[len(l) // 2 + 1] AS median_gap FROM s""")
def gaps_median(t):
    return S.gaps(t("events").select("user_id", micros("ts").alias("us")), "user_id", "us")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def fill_forward(t):
    return S.fill_forward(t("events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "section").select("event_id", "section")


@query("""SELECT p_brand, p_partkey, place, CASE WHEN s IS NULL THEN 'open' WHEN place <= 5 AND s >= 1000 THEN 'kept' ELSE 'pruned' END AS status FROM (
    SELECT p_brand, p_partkey, s, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC NULLS LAST, p_partkey)::INT AS place FROM (SELECT *, CASE WHEN p_size > 5 THEN p_retailprice END AS s FROM part))""")
def beam_survivors(t):
    scored = t("part").withColumn("score", F.when(F.col("p_size") > 5, F.col("p_retailprice")))
    return S.survivors(scored, "p_brand", "score", "p_partkey", 5, 1000.0).select("p_brand", "p_partkey", "place", "status")


@query("""SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS previous FROM orders""")
def latest_vs_previous(t):
    from pyspark.sql import Window

    newest = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return t("orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(newest).alias("previous"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_docs_hash(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def html_strip(t):
    return t("pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_chars"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN true WHEN event_type = 'view' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS in_fatal FROM events""")
def state_machine(t):
    return S.inside(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view", "in_fatal").select("event_id", "in_fatal")


@query("SELECT l_orderkey, l_linenumber, l_partkey, bool_and(l_quantity < 45) OVER (PARTITION BY l_orderkey) AS applied FROM lineitem")
def group_rollback(t):
    return S.rollback(t("lineitem"), "l_orderkey", F.col("l_quantity") < 45).select("l_orderkey", "l_linenumber", "l_partkey", "applied")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) AS claimed FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def queue_claim_order(t):
    return t("orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("claimed"))


@query("""SELECT y, m, n, sum(n) OVER (ORDER BY y, m)::BIGINT AS running FROM (SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY 1, 2)""")
def cumulative_trend(t):
    from pyspark.sql import Window

    months = t("orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return months.withColumn("running", F.sum("n").over(Window.orderBy("y", "m")))  # a row a month


@query("""SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug, greatest(0, floor((p_size - 3) / 2) + 1)::BIGINT AS trips FROM part""")
def slug_and_trips(t):
    return t("part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.trip_count(F.lit(3), F.col("p_size"), 2).cast("long").alias("trips"))


@query("SELECT user_id, count(DISTINCT event_type) AS callers, round(avg((event_type = 'click')::INT), 6) AS agreement, count(*) FILTER (value < 100) AS cheap FROM events GROUP BY 1")
def distinct_callers(t):
    return t("events").groupBy("user_id").agg(F.countDistinct("event_type").alias("callers"), F.round(F.avg((F.col("event_type") == "click").cast("int")), 6).alias("agreement"), F.count_if(F.col("value") < 100).alias("cheap"))


@query("""WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS p FROM events)
    SELECT event_type, sum(value) FILTER (p <= 3) AS shown, count(*) FILTER (p > 3) AS hidden, round(sum(value) FILTER (p > 3), 2) AS hidden_value FROM r GROUP BY 1""".replace("sum(value) FILTER (p <= 3)", "round(sum(value) FILTER (p <= 3), 2)"))
def limit_with_remainder(t):
    e = t("events")
    shown = ranks.top(e, "event_type", [F.col("value").desc(), F.col("event_id")], 3, F.xxhash64("event_id")).groupBy("event_type").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"))
    every = e.groupBy("event_type").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    rest = F.when(F.col("n") > F.col("k"), F.round(F.col("total") - F.col("s"), 2))
    return every.join(shown, "event_type").select("event_type", F.round("s", 2).alias("shown"), (F.col("n") - F.col("k")).alias("hidden"), rest.alias("hidden_value"))


@query("""WITH a AS (SELECT c_custkey, c_acctbal AS old FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS new FROM customer WHERE c_nationkey <> 3)
    SELECT c_custkey, old, new FROM a FULL JOIN b USING (c_custkey) WHERE old IS DISTINCT FROM new""")
def config_diff(t):
    c = t("customer")
    new = c.filter("c_nationkey <> 3").withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal")))
    return J.changed(c.filter("c_mktsegment <> 'BUILDING'"), new, "c_custkey", "c_acctbal")


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount >= 0.1)
    SELECT 'added' AS kind, l_partkey FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'removed', l_partkey FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'unchanged', l_partkey FROM (FROM a INTERSECT FROM b)""")
def failure_setdiff(t):
    l = t("lineitem")  # noqa: E741
    a, b = l.filter("l_quantity > 48").select("l_partkey"), l.filter("l_discount >= 0.1").select("l_partkey")
    tag = lambda d, k: d.select(F.lit(k).alias("kind"), "l_partkey")
    return tag(a.subtract(b), "added").union(tag(b.subtract(a), "removed")).union(tag(a.intersect(b), "unchanged"))


@query("""SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount >= 0.1) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)""")
def unused_symbols_anti(t):
    l = t("lineitem").withColumnRenamed("l_partkey", "p_partkey")  # noqa: E741
    return J.unused(t("part"), "p_partkey", l.filter("l_quantity > 49"), l.filter("l_returnflag = 'R' AND l_discount >= 0.1"), t("supplier").withColumnRenamed("s_suppkey", "p_partkey")).select("p_partkey", "p_name")


@query("SELECT event_id, event_type AS kind, CASE WHEN event_id % 4 <> 0 THEN value END AS ms FROM events")
def kv_parse(t):
    """Lines with a part that is no pair, a pair with a second `=`, a key that comes twice, and `nil`."""
    ms = F.when(F.col("event_id") % 4 == 0, "nil").otherwise(F.col("value").cast("string"))
    line = F.concat_ws("|", F.lit("PROF"), F.concat(F.lit("kind="), "event_type"), F.lit("ms=1"), F.lit("x=a=b"), F.concat(F.lit("ms="), ms))
    bag = t("events").select("event_id", F.explode(F.array(T.kv_bag(line))).alias("m"))
    return bag.filter(F.col("m")["x"] == "a=b").select("event_id", F.col("m")["kind"].alias("kind"), T.number(F.col("m")["ms"]).alias("ms"))


@query("""SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (line LIKE '%!!%') AS errors, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def log_lines_classify(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_lines"), F.count_if(F.col("line").contains("!!")).alias("errors"), F.max(F.length("line")).cast("long").alias("longest"))


@query("""WITH a AS (SELECT l_orderkey, l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2, 3), b AS (SELECT l_orderkey, f, max(n) AS n FROM a GROUP BY 1, 2),
    c AS (SELECT l_orderkey, l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2), d AS (SELECT l_orderkey, f, sum(n) AS n FROM (FROM b UNION ALL FROM c) GROUP BY 1, 2),
    e AS (SELECT l_orderkey, max(n) AS n FROM d GROUP BY 1), g AS (SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS direct, count(*) AS flat FROM lineitem GROUP BY 1)
    SELECT l_orderkey, (direct + coalesce(n, 0))::BIGINT AS worst, flat FROM g LEFT JOIN e USING (l_orderkey)""")
def branch_aware_max(t):
    """Rows of an order as calls: some on every path, some under the return flag, some under the line status below that."""
    flag, status = F.ascii("l_returnflag"), F.ascii("l_linestatus")
    step = lambda fork, branch: F.struct(fork.cast("int").alias("fork"), branch.cast("int").alias("branch"))
    outer = step(F.lit(0), flag)
    none = F.array().cast("array<struct<fork:int,branch:int>>")
    chain = F.when(F.col("l_linenumber") == 1, none).when(F.col("l_linenumber") == 2, F.array(outer)).otherwise(F.array(outer, step(flag, status)))
    return S.max_path(t("lineitem").select("l_orderkey", chain.alias("chain")), ["l_orderkey"], "chain")
