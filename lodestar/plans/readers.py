"""Queries of the file readers: their lines are written from the tables' columns, with the oddities that the formats have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import micros
from ..operators import tallies as T
from ..scripts import censuses as S
from ..scripts.bindings import stored_bindings
from ..scripts.facts import stored_facts
from ..operators import profile
from ..sinks import reports as R
from ..sinks import runs as O
from ..sources import captures as C
from ..sources import config as K
from ..sources import engine_log as E
from ..sources import mods
from ..sources import text as X
from .catalog import query


def _str(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _texts(rows: DataFrame, key: str, name: str, lines: list[Column]) -> DataFrame:
    """path, text: a file a row, its lines joined; null lines are left out."""
    return rows.select(F.concat(F.lit(name + "_"), _str(key)).alias("path"), F.array_join(F.array(*lines), "\n").alias("text"))


@query("""SELECT user_id, count(*) AS frames, round(max(t_s), 6) AS seconds, count(frametime_ms) AS timed, round(sum(fps), 4) AS fps FROM (
    SELECT user_id, event_id, (epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS t_s, CASE WHEN event_id % 7 <> 0 THEN value END AS frametime_ms, CASE WHEN event_id % 7 <> 0 AND value > 0 THEN 1000 / value END AS fps FROM events)
    GROUP BY user_id""")
def capture_samples(t):
    """Captures whose time is in milliseconds under another name, with cells that are no numbers."""
    rows = t("events").select("user_id", "event_id", _str(micros("ts") / 1000).alias("TimeInMs"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(_str("value")).alias("msBetweenPresents"))
    out = C.samples(rows, "user_id", ["event_id"])
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.max("t_s"), 6).alias("seconds"), F.count("frametime_ms").alias("timed"), F.round(F.sum("fps"), 4).alias("fps"))


def _log(t) -> DataFrame:
    k = F.col("c_custkey")
    crash = k % 3 == 0
    none = F.lit(None).cast("string")
    return _texts(t("customer"), "c_custkey", "log", [
        F.concat(F.lit("* [x-ray]: Loading level [l"), _str(F.col("c_nationkey")), F.lit("]")), F.concat(F.lit("* phase time: "), _str(k % 50 + 1), F.lit(" ms")), F.lit(""),
        F.concat(F.lit("[00:01:"), F.lpad(_str(k % 60), 2, "0"), F.lit("] ! Can't find texture 'x'")), F.lit("~ sound: no such resource"),
        F.concat(F.lit("* [ALife] simulation: objects : "), _str(k), F.lit(", online : "), _str(k % 9)), F.when(k % 2 == 0, F.lit("* Level loading time: 12.5 sec")).otherwise(none),
        F.when(crash, F.lit("FATAL ERROR")).otherwise(none), F.when(crash, F.lit("[error]Expression    : x")).otherwise(none), F.when(crash, F.lit("stack trace:")).otherwise(none),
        F.when(crash, F.lit("  engine.dll at 0x1")).otherwise(none), F.when(crash, F.lit("xrGame.exe main")).otherwise(none), F.lit("# end")])


@query("""SELECT 'log_' || c_custkey AS path, c_custkey % 3 = 0 AS crashed, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS stack, 2::BIGINT AS warnings, 'l' || c_nationkey AS level,
    CASE WHEN c_custkey % 2 = 0 THEN 12.5 ELSE (c_custkey % 50 + 1) / 1000 END AS load_time_s, c_custkey::DOUBLE AS objects, (c_custkey % 9)::DOUBLE AS online FROM customer""")
def engine_logs(t):
    """Summaries of engine logs, a third of them with a crash and its stack."""
    found = E.summaries(E.entries(X.lines(_log(t))))
    return found.select("path", "crashed", F.size("stack_trace").alias("stack"), "warnings", F.col("levels")[0].alias("level"), "load_time_s", F.col("alife")["objects"].alias("objects"), F.col("alife")["online"].alias("online"))


@query("SELECT 'log_' || c_custkey AS path, (60 + c_custkey % 60)::DOUBLE AS t_s, '!' AS sigil FROM customer")
def log_times(t):
    """Lines with a time before them, as seconds."""
    return E.entries(X.lines(_log(t))).filter("t_s IS NOT NULL").select("path", "t_s", "sigil")


def _config(t) -> DataFrame:
    return _texts(t("supplier"), "s_suppkey", "conf", [
        F.lit("; head"), F.concat(F.lit('#include "base_'), _str("s_nationkey"), F.lit('.ltx"')), F.concat(F.lit("[actor_"), _str("s_suppkey"), F.lit("]:base, other ; note")), F.concat(F.lit("  speed = "), _str("s_acctbal"), F.lit(" ; m/s")),
        F.lit("speed = 1=2"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("flag")).otherwise(F.lit("")), F.lit("[empty]"), F.lit("// done"), F.lit("name =")])


@query("""WITH s AS (SELECT 'conf_' || s_suppkey AS path, 'actor_' || s_suppkey AS a, s_suppkey, s_nationkey FROM supplier)
    SELECT path, NULL AS section, 'include' AS kind, '#include' AS key, 'base_' || s_nationkey || '.ltx' AS value FROM s UNION ALL SELECT path, a, 'section', '', '' FROM s UNION ALL SELECT path, a, 'entry', 'speed', s_acctbal::VARCHAR FROM s JOIN supplier USING (s_suppkey)
    UNION ALL SELECT path, a, 'entry', 'speed', '1=2' FROM s UNION ALL SELECT path, a, 'bare', 'flag', '' FROM s WHERE s_suppkey % 2 = 0 UNION ALL SELECT path, 'empty', 'section', '', '' FROM s UNION ALL SELECT path, 'empty', 'entry', 'name', '' FROM s""")
def config_sections(t):
    """Sectioned files: an include, inheritance with a remark, a key that comes twice, a bare name, an empty value."""
    return K.sectioned(_config(t)).filter("kind NOT IN ('blank', 'comment')").select("path", "section", "kind", "key", "value")


@query("""SELECT 'conf_' || s_suppkey AS path, 'actor_' || s_suppkey AS section, 'speed' AS key, '1=2' AS value FROM supplier UNION ALL SELECT 'conf_' || s_suppkey, 'actor_' || s_suppkey, 'flag', '' FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'conf_' || s_suppkey, 'empty', 'name', '' FROM supplier""")
def config_items(t):
    """Of equal keys the last."""
    return K.items(K.sectioned(_config(t)))


def _commands(t) -> DataFrame:
    return _texts(t("supplier"), "s_suppkey", "user", [
        F.lit("; saved"), F.concat(F.lit("vid_mode "), _str("s_suppkey"), F.lit("x100")), F.lit("bind forward kW"), F.concat(F.lit("bind back k"), _str("s_nationkey"), F.lit(" ; remapped")), F.lit("rs_stats off"), F.lit("vid_mode 1x1")])


@query("""SELECT 'user_' || s_suppkey AS path, unnest(['vid_mode', 'bind forward', 'bind back', 'rs_stats']) AS key, unnest(['1x1', 'kW', 'k' || s_nationkey, 'off']) AS value, true AS flat FROM supplier""")
def command_lists(t):
    """Flat command files: told from sectioned ones, bindings by what they bind, of equal names the last."""
    texts = _commands(t)
    flat = K.is_command_list(texts.unionByName(_config(t)))
    return K.items(K.commands(texts)).join(flat, "path").select("path", "key", "value", "flat")


@query("""SELECT 'list_' || s_suppkey AS path, unnest([0, 1, 2, 3])::INT AS rank, unnest([CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END, '+', '-', '*']) AS prefix, unnest([s_name, 'plain', 'Weapons_separator', 'unmanaged']) AS name,
    unnest([s_suppkey % 2 <> 0, true, false, false]) AS enabled, unnest([false, false, true, true]) AS separator FROM supplier""")
def mod_lists(t):
    """Mod lists with switched-off entries, separators, remarks and an entry without a sign."""
    sign = F.when(F.col("s_suppkey") % 2 == 0, "-").otherwise("+")
    return K.mod_list(_texts(t("supplier"), "s_suppkey", "list", [F.lit("# managed"), F.concat(sign, "s_name"), F.lit("plain"), F.lit(""), F.lit("-Weapons_separator"), F.lit("*unmanaged")]))


def _profile(t) -> DataFrame:
    """path, line_no, raw: three windows an order, the last cut off, with a slow frame and lines of others between."""
    o = F.col("o_orderkey")
    num = lambda k, v: F.concat(F.lit(f"{k}="), _str(v))
    line = lambda *parts: F.concat_ws("|", F.lit("~ script PROF"), F.lit("3"), *parts)
    lines = F.array(
        line(F.lit("win"), F.lit("seq=1"), num("frames", o % 90), F.lit("t0=0"), F.lit("t1= 30 "), F.lit("calls=5")), line(F.lit("cb"), F.lit("seq=1"), F.lit("name=update"), num("units", o), F.lit("calls=2")), line(F.lit("cb"), F.lit("seq=1"), F.lit("name=update"), num("units", o + 1), F.lit("calls=3")),
        F.lit("* other"), line(F.lit("eow"), F.lit("seq=1")), line(F.lit("frm"), F.lit("n=1"), num("ms", o % 40), F.concat(F.lit("top=a~b~"), _str(o % 7), F.lit(",x~2,bad,y~z"))), line(F.lit("win"), F.lit("seq=2"), F.lit("frames=99")), line(F.lit("err"), F.lit("a=b| c")))
    return t("orders").select(F.concat(F.lit("run_"), _str("o_orderkey")).alias("path"), F.posexplode(lines).alias("line_no", "raw"))


@query("SELECT 'run_' || o_orderkey AS path, 1::BIGINT AS seq, 30.0::DOUBLE AS t1, (o_orderkey % 90)::BIGINT AS frames, 5::BIGINT AS calls FROM orders WHERE o_orderkey % 90 >= 30")
def profile_windows(t):
    """Windows with an end and frames enough; the one that was cut off is left out."""
    return C.profile_windows(C.profile_records(_profile(t), "PROF"), 30).select("path", "seq", "t1", "frames", "calls")


@query("SELECT 'run_' || o_orderkey AS path, 'update' AS name, 3::BIGINT AS calls, (o_orderkey + 1)::DOUBLE AS units FROM orders")
def profile_calls(t):
    """Of equal names in a window the last line."""
    return C.profile_calls(C.profile_records(_profile(t), "PROF")).select("path", "name", "calls", "units")


def _instrument(t) -> DataFrame:
    o = F.col("o_orderkey")
    line = lambda *parts: F.concat_ws("|", F.lit("~ PROF"), F.lit("4"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    num = lambda k, v: F.concat(F.lit(f"{k}="), _str(v))
    lines = F.array(
        line("hdr", "timer=qpc", "units_per_ms=1", "make_callback=false"), line("hdr", "timer= rdtsc ", num("units_per_ms", o % 9), "overhead_ns=nil", "make_callback=true", "hitch_buckets=12"),
        line("wdr", "walkout=on", "pending=2", num("ver", o % 3)), line("bnx", "target=a", num("wrapped", o % 2)), line("bnx", "target=b", "wrapped=0", "why=no method"),
        line("nst", "n=1", num("units", o), "scope=actor", "top=0", F.concat(F.lit("in=x~y~"), _str(o % 5), F.lit(",bad,z~1.5"))), line("trace", "n=1", "name=go", num("units", o), F.concat(F.lit("pre=hp="), _str(o % 4), F.lit(", hp = 7,mode=a=b")), "post="), line("err", " out of | room "))
    return t("orders").select(F.concat(F.lit("run_"), _str("o_orderkey")).alias("path"), F.posexplode(lines).alias("line_no", "raw"))


@query("""SELECT 'run_' || o_orderkey AS path, 'rdtsc' AS timer, (o_orderkey % 9)::DOUBLE AS units_per_ms, NULL::DOUBLE AS overhead_ns, true AS make_callback, 'off' AS binders, 12 AS hitch_buckets,
    'on' AS walkout, (o_orderkey % 3)::DOUBLE AS ver, 2::BIGINT AS pending, 2::BIGINT AS probes, (o_orderkey % 2)::BIGINT AS wrapped FROM orders""")
def profile_headers(t):
    """Of several headers the last; the second header with what came of its probes."""
    r = C.profile_records(_instrument(t), "PROF")
    return C.headers(r).join(C.walkout_headers(r), "path").select("path", "timer", "units_per_ms", "overhead_ns", "make_callback", "binders", "hitch_buckets", "walkout", "ver", "pending", "probes", "wrapped")


@query("""SELECT 'run_' || o_orderkey AS path, 'nested' AS kind, 'actor' AS name, o_orderkey::DOUBLE AS units, 'x~y:' || (o_orderkey % 5) || '.0 z:1.5' AS inner FROM orders
    UNION ALL SELECT 'run_' || o_orderkey, 'trace', 'go', o_orderkey::DOUBLE, 'hp:7 mode:a=b' FROM orders UNION ALL SELECT 'run_' || o_orderkey, 'error', 'out of | room', NULL, NULL FROM orders""")
def profile_details(t):
    """Slow calls taken apart, traced calls with their state before, and complaints."""
    r = C.profile_records(_instrument(t), "PROF")
    pairs = F.array_join(F.transform("inside", lambda x: F.concat_ws(":", x["label"], x["units"].cast("string"))), " ")
    nested = C.nested_calls(r).filter("NOT top").select("path", F.lit("nested").alias("kind"), F.col("scope").alias("name"), "units", pairs.alias("inner"))
    state = F.array_join(F.transform(F.array_sort(F.map_entries("pre")), lambda x: F.concat_ws(":", x["key"], x["value"])), " ")
    traced = C.trace_calls(r).filter(F.size("post") == 0).select("path", F.lit("trace").alias("kind"), "name", "units", state.alias("inner"))
    errors = C.profile_errors(r).select("path", F.lit("error").alias("kind"), F.col("message").alias("name"), F.lit(None).cast("double").alias("units"), F.lit(None).cast("string").alias("inner"))
    return nested.unionByName(traced).unionByName(errors)


@query("""SELECT user_id, count(*) AS samples, round(sum(CASE WHEN event_id % 3 = 0 THEN value WHEN value <> 0 THEN 1000 / value END), 4) AS frame_ms, max(p)::DOUBLE AS last
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events) GROUP BY 1""")
def tolerant_samples(t):
    """Samples without a time, some with a frame time and some with a rate only, blanks between."""
    some = F.col("event_id") % 3 == 0
    rows = t("events").select("user_id", "event_id", F.when(some, _str("value")).otherwise("").alias("FrameTime_ms"), F.when(~some, _str("value")).alias(" fps "), F.lit("n/a").alias("cpu_pct"))
    out = C.tolerant_samples(rows, ["user_id", "event_id"])
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("frametime_ms"), 4).alias("frame_ms"), F.max("t_s").alias("last"))


@query("SELECT 'run_' || o_orderkey AS path, (o_orderkey % 40)::DOUBLE AS ms, unnest(['a~b', 'x']) AS label, unnest([(o_orderkey % 7)::DOUBLE, 2.0]) AS units FROM orders")
def slow_frame_labels(t):
    """Pairs of a label (which may hold the sign itself) and a number; parts that are none are left out."""
    frames = C.slow_frames(C.profile_records(_profile(t), "PROF"))
    return frames.select("path", "ms", F.explode("top").alias("x")).select("path", "ms", "x.label", "x.units")


@query("""SELECT user_id, count(*) AS samples FROM (SELECT user_id, epoch_us(ts) / 1e6 AS s, min(CASE WHEN event_type = 'signup' THEN epoch_us(ts) / 1e6 END) OVER (PARTITION BY user_id) + 3600 AS since FROM events) WHERE s >= since GROUP BY user_id""")
def samples_after_marker(t):
    """Samples from an hour after a user's first sign-up on."""
    rows = t("events").select("user_id", (micros("ts") / 1e6).alias("s"), (F.col("event_type") == "signup").alias("loaded"))
    return E.after_marker(rows, "user_id", "s", "loaded", 3600.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'utf-8-sig' WHEN s_suppkey % 4 = 1 THEN 'cp1251' WHEN s_suppkey % 4 = 2 THEN 'latin-1' ELSE 'utf-8' END AS encoding, CASE WHEN s_suppkey % 4 = 1 THEN 'Жук' WHEN s_suppkey % 4 = 2 THEN chr(176) || 'C' ELSE s_name END AS text FROM supplier""")
def decoded_texts(t):
    """Bytes with a mark, Cyrillic letters in one byte, other single bytes, and plain ones."""
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("s_name", "UTF-8"))).when(k == 1, F.unhex(F.lit("C6F3EA"))).when(k == 2, F.unhex(F.lit("B043"))).otherwise(F.encode("s_name", "UTF-8"))
    out = X.decoded(t("supplier").select(_str("s_suppkey").alias("path"), raw.alias("content")))
    return out.select(F.col("path").cast("long").alias("s_suppkey"), "encoding", "text")


@query("""SELECT least(25, count(*))::BIGINT AS hits, true AS ends_with_hit FROM events WHERE event_type = 'signup'""")
def sampled_until_hits(t):
    """A shuffled sample that ends with its 25th hit."""
    hit = F.col("event_type") == "signup"
    rows = T.sample_until(t("events"), "event_id", hit, 25)
    return rows.agg(F.count_if(hit).alias("hits"), F.max_by(hit, F.struct("place_hash", _str("event_id"))).alias("ends_with_hit"))


def _listeners(t) -> DataFrame:
    k = F.col("s_suppkey")
    event = F.concat(F.lit('"on_'), _str("s_nationkey"), F.lit('"'))
    lines = [
        F.lit("function hear()"), F.when(k % 3 == 0, F.concat(F.lit("  UnregisterScriptCallback("), event, F.lit(", hear)"))).when(k % 3 == 1, F.lit('  RegisterScriptCallback("other", hear)')).otherwise(F.lit("  go()")),
        F.lit('  printf("x %s", name())'), F.lit("  if alife() then alife() alife() end"), F.lit("end"),
        F.lit("function start()"), F.concat(F.lit("  RegisterScriptCallback("), event, F.lit(", hear)")), F.concat(F.lit("  RegisterScriptCallback("), event, F.lit(", function() go() end)")), F.lit('  RegisterScriptCallback("gone", missing)'),
        F.when(k % 2 == 0, F.lit('  if DEV then printf("only") end')).otherwise(F.lit('  if DEV then printf("a" .. 1) go() end')), F.lit("end")]
    return _texts(t("supplier"), "s_suppkey", "script", lines)


@query("SELECT 'script_' || s_suppkey AS path, 'on_' || s_nationkey AS event, 'hear' AS listener, 2 AS line, 'unregister' AS op FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'script_' || s_suppkey, 'other', 'hear', 2, 'register' FROM supplier WHERE s_suppkey % 3 = 1")
def churning_listeners(t):
    """Listeners that take themselves off their event, or put themselves on it again when it comes."""
    s = _listeners(t)
    return S.self_churn(stored_facts(s), stored_bindings(s))


@query("SELECT 3 * count(*) + count(*) FILTER (s_suppkey % 3 = 1) AS registrations, count(*) AS inline, count(*) AS unresolved FROM supplier")
def churn_blind_spots(t):
    s = _listeners(t)
    return S.churn_blind_spots(stored_facts(s), stored_bindings(s))


@query("SELECT 'alife' AS name, 'interpreted' AS mode, 3 * count(*) AS sites, count(*) AS bodies, count(*) AS often, 0::BIGINT AS per_frame FROM supplier")
def repeat_census(t):
    return S.repeat_census(stored_facts(_listeners(t))).withColumn("sites", F.col("sites").cast("long"))


@query("""SELECT 'script_' || s_suppkey AS path, 3 AS line, 'name' AS effects, false AS sole FROM supplier UNION ALL SELECT 'script_' || s_suppkey, 10, NULL, s_suppkey % 2 = 0 FROM supplier""")
def debug_risks(t):
    """What the removal of a debug call would take with it: a call among its arguments, a branch's only statement."""
    return S.debug_risks(stored_facts(_listeners(t))).select("path", "line", "effects", "sole")


@query("""SELECT what, value, sum(n)::BIGINT AS n FROM (SELECT unnest(['function', 'function', 'shape', 'shape', 'place', 'place', 'body', 'body']) AS what,
    unnest(['printf', 'printf', 'call', CASE WHEN s_suppkey % 2 = 0 THEN 'literal' ELSE 'join' END, 'statement', 'statement', 'other', 'other']) AS value, 1 AS n FROM supplier) GROUP BY 1, 2""")
def debug_census(t):
    return S.debug_census(stored_facts(_listeners(t)))


@query("""SELECT 'm' || p_size || '/' || p_partkey AS rel, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 5 = 1 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 5 IN (0, 1, 2)""")
def overlay_changes(t):
    """Two trees of files by their digests: what the later one adds, takes away and changes."""
    rel = F.concat(F.lit("m"), _str("p_size"), F.lit("/"), _str("p_partkey"))
    k = F.col("p_partkey") % 5
    before = t("part").filter(k != 0).select(rel.alias("rel"), F.sha2("p_name", 256).alias("sha256"))
    after = t("part").filter(k != 1).select(rel.alias("rel"), F.sha2(F.concat("p_name", F.when(k == 2, "!").otherwise("")), 256).alias("sha256"))
    return O.added_only(before, after)


@query("SELECT 'run_' || c_custkey || '/metrics.json' AS path, '{\"fps_avg\":' || c_custkey || ',\"crashed\":' || (c_custkey % 2 = 0)::VARCHAR || '}' AS document FROM customer")
def run_documents(t):
    """A run's metrics as the document that is written for it."""
    rows = t("customer").select(F.concat(F.lit("run_"), _str("c_custkey")).alias("run"), F.col("c_custkey").alias("fps_avg"), (F.col("c_custkey") % 2 == 0).alias("crashed"), F.lit(None).cast("string").alias("notes"))
    return O.documents(rows, "run", "metrics.json")


@query("""SELECT c_nationkey, string_agg(v, ' ' ORDER BY a, n, z) AS ordered FROM (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'Mod ' ELSE 'arm' END || CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '' END || c_custkey AS v,
    CASE WHEN c_custkey % 2 = 0 THEN 'mod ' ELSE 'arm' END AS a, c_custkey AS n, c_custkey % 3 = 0 AS z FROM customer) GROUP BY 1""")
def natural_names(t):
    """Names with numbers in them in the order people read them."""
    k = F.col("c_custkey")
    v = F.concat(F.when(k % 2 == 0, "Mod ").otherwise("arm"), F.when(k % 3 == 0, "0").otherwise(""), _str(k))
    rows = t("customer").select("c_nationkey", v.alias("v"), R.natural_key(v).alias("key"))
    return rows.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda x: x["v"]), " ").alias("ordered"))


@query("""SELECT user_id, count(*) AS slow, max(value) AS worst, round(sum(value - 12), 6) AS lost_ms FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS s FROM events) WHERE value >= 12 AND s <= 900000 GROUP BY 1""")
def slow_starts(t):
    """Slow frames of a run's beginning."""
    e = t("events").withColumn("__us", micros("ts"))
    first = e.groupBy("user_id").agg(F.min("__us").alias("__from"))
    rows = e.join(first, "user_id").withColumn("s", (F.col("__us") - F.col("__from")) / 1e6)
    return profile.slow_start(rows, "user_id", "s", "value", 12.0, 900_000.0)


@query("""SELECT 'p' || p_size AS path, kind, taken FROM (SELECT p_size, ['script', 'config', 'other'][p_partkey % 3 + 1] AS kind, p_partkey AS taken, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS r FROM part WHERE p_partkey % 3 < 2) WHERE r = 1""")
def restored_entries(t):
    """What of a snapshot is brought back: the newest entry of each path among two kinds."""
    kind = F.element_at(F.array(*map(F.lit, ("script", "config", "other"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    manifest = t("part").select(F.concat(F.lit("p"), _str("p_size")).alias("path"), kind.alias("kind"), F.col("p_partkey").alias("taken"))
    return mods.restored(manifest, ["script", "config"])


@query("SELECT p_partkey::VARCHAR AS path, length(p_name)::BIGINT AS bytes, sha256(p_name) AS sha256 FROM part")
def snapshots(t):
    """Size and digest of each file's bytes."""
    return mods.snapshot(t("part").select(_str("p_partkey").alias("path"), F.col("p_name").cast("binary").alias("content")))
