"""Queries of ingest, decoding, discovery, store and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.rules import RULES, by_name
from seqloom.functions.text import plain_user
from seqloom.operators.canonical import CATEGORIES, canonical
from seqloom.operators.compare import capture_summary, compare_captures, share_ranks, summary_vector
from seqloom.operators.discover import name_counts, propose_rules, similar_pairs
from seqloom.operators.events import usable_events
from seqloom.operators.store import CaptureStore
from seqloom.operators.sequence import segments
from seqloom.plans.analytics import BASE, PANELS
from seqloom.plans.problems import EVENTS_SQL
from seqloom.session import scratch_path
from seqloom.sources.ndjson import canonical_blobs, ordered_events, parsed, quarantine, source_repeats
from seqloom.sources.tables import table
from seqloom.streaming.live import live_sessions

SALT = "seqloom"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relay_lines", "line_id", "capture_id", "line")


def relay_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of each line."""
    return parsed(_lines(spark, d)).groupBy("capture_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def relay_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return quarantine(_lines(spark, d)).select("line_id", "outcome")


def relay_events(spark: SparkSession, d: str) -> DataFrame:
    """The lines as ordered, deduplicated canonical events."""
    ev = ordered_events(canonical_blobs(_lines(spark, d), SALT))
    return ev.select("capture_id", "seq", "line_id", "ts_us", "req", "route", "friendly", "url_path", "rev", "ccg", "user_hash", "latency_ms", "kind")


def relay_decoded(spark: SparkSession, d: str) -> DataFrame:
    """(category, rule_id, n) of the lines' events."""
    ev = canonical_blobs(_lines(spark, d), SALT)
    return ev.groupBy("category", F.coalesce("rule_id", F.lit(-9)).alias("rule_id"), "decoded").agg(F.count(F.lit(1)).alias("n"))


def relay_segments(spark: SparkSession, d: str) -> DataFrame:
    ev = ordered_events(canonical_blobs(_lines(spark, d), SALT)).select("capture_id", F.col("seq").alias("pos"), "ts_us", F.nullif("user_hash", F.lit("")).alias("user"))
    return segments(ev).groupBy("capture_id").agg((F.max("segment_id") + 1).alias("n_segments"), F.count(F.lit(1)).alias("n_events"))


def relay_source_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Requests as the producer would have sent them: without those that repeat the last one at once."""
    ev = canonical_blobs(_lines(spark, d), SALT).select("capture_id", "line_id", "ts_us", "route", "friendly")
    return source_repeats(ev).select("capture_id", "line_id")


def event_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Of the events with the same user, request number and second the first."""
    return ordered_events(canonical_blobs(_lines(spark, d), SALT)).select("capture_id", "line_id")


def decoder_suffix_fallback(spark: SparkSession, d: str) -> DataFrame:
    """(category, rule_id, n): the distinct stored names that no rule matches, by what their ending tells."""
    names = table(spark, d, "capture_events", "friendly").where("friendly <> ''").distinct().withColumn("r", by_name("friendly")).where("r.rule_id < 0")
    return names.groupBy(F.col("r.category").alias("category"), F.col("r.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


def session_window_user(spark: SparkSession, d: str) -> DataFrame:
    """The live side's sessions over the stored events: windows of at most ten minutes between a user's neighbours."""
    ev = usable_events(table(spark, d, "capture_events"), "user_hash").select(F.coalesce(plain_user("user_hash"), F.lit("")).alias("user_hash"), F.timestamp_micros("ts_us").alias("ts"))
    s = live_sessions(ev)
    return s.select("user_hash", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return canonical_blobs(_lines(spark, d), SALT).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def decode_names(spark: SparkSession, d: str) -> DataFrame:
    """(category, rule_id, n): the listed operations under the rule table."""
    ops = table(spark, d, "dim_operation", "operation").withColumn("r", by_name("operation"))
    return ops.groupBy(F.col("r.category").alias("category"), F.col("r.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


def _undecoded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_events", "friendly", "decoded").where(~F.coalesce("decoded", F.lit(False)))


def discover_counts(spark: SparkSession, d: str) -> DataFrame:
    return name_counts(_undecoded(spark, d))


def trigram_pairs_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "dim_operation").select(F.col("operation").alias("name")))


def cluster_regex_proposals(spark: SparkSession, d: str) -> DataFrame:
    return propose_rules(_undecoded(spark, d))


def _largest(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in table(spark, d, "captures", "capture_id", "n_events").orderBy(F.desc_nulls_last("n_events"), "capture_id").limit(2).collect()]


def capture_diff_hook_lift(spark: SparkSession, d: str) -> DataFrame:
    """The two captures with the most events according to the capture table."""
    a, b = _largest(spark, d)
    return compare_captures(canonical(spark, d), a, b)


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Two ingests of the same captures, then the store's list: one row per capture all the same."""
    store = CaptureStore(spark, scratch_path(spark, "store"))
    ev = canonical(spark, d).select("capture_id", "pos", "seq", "ts_us", "category")
    store.ingest(ev.where("category <> 'nav'"))
    store.ingest(ev)
    return store.captures().drop("source_path")


def store_point_read(spark: SparkSession, d: str) -> DataFrame:
    """The events of one stored capture in order."""
    store = CaptureStore(spark, scratch_path(spark, "store"))
    store.ingest(canonical(spark, d).select("capture_id", "pos", "seq", "ts_us", "category"))
    return store.events(_largest(spark, d)[0]).select("capture_id", "pos", "seq", "ts_us", "category")


def _panel(f):
    return lambda spark, d: f(canonical(spark, d))


QUERIES = {f.__name__: f for f in (relay_outcomes, relay_quarantine, relay_events, relay_decoded, relay_segments, relay_source_repeats, event_dedup_keep_first, decoder_suffix_fallback, session_window_user, kind_counts, decode_names, discover_counts, trigram_pairs_jaccard, cluster_regex_proposals, capture_diff_hook_lift, store_roundtrip, store_point_read)}
QUERIES |= {"capture_summary": _panel(capture_summary), "summary_vector": _panel(summary_vector), "category_ranks": _panel(share_ranks)}

_LINES = """j AS (SELECT line_id, capture_id, trim(coalesce(line, ''), ' \t\r\n') = '' AS blank, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN line END AS o FROM relay_lines),
f AS (SELECT line_id, capture_id, blank, o, coalesce(o->>'$.__kind', 'request') AS kind, o->>'$.__type' AS tp, o->>'$.__crn' AS crn, o->>'$.__spin_t' AS st, o->>'$.__ts_wall' AS tw, trim(o->>'$.__req') AS rq, coalesce(substr(o->>'$.fb_api_req_friendly_name', 1, 300), '') AS nm,
 coalesce(substr(o->>'$.__url_path', 1, 300), '') AS url_path, nullif(o->>'$.__rev', '') AS rev, coalesce(nullif(o->>'$.__ccg', ''), 'GOOD') AS ccg, coalesce(o->>'$.__user', '') AS usr, o->>'$.__latency_ms' AS lat FROM j),
t AS (SELECT *, try_cast(trim(CASE WHEN coalesce(st, '') <> '' THEN st WHEN kind <> 'request' THEN tw END) AS DOUBLE) AS tm FROM f),
p AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN o IS NULL THEN 'broken' WHEN tp IS NOT DISTINCT FROM 'hello' THEN 'hello' WHEN tm IS NOT NULL AND (kind <> 'request' OR coalesce(crn, '') <> '') THEN 'event' ELSE 'rejected' END AS outcome FROM t),
b AS (SELECT capture_id, line_id, round(tm * 1e6)::BIGINT AS ts_us, CASE WHEN kind = 'request' AND regexp_full_match(rq, '[0-9A-Za-z]{1,12}') THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(rq), ''), lambda c: (position(c IN '0123456789abcdefghijklmnopqrstuvwxyz') - 1)::BIGINT)), lambda x, y: x * 36 + y) ELSE 0 END AS req,
 coalesce(substr(crn, 1, 300), '') AS route, CASE WHEN kind = 'request' THEN nm ELSE '' END AS friendly, url_path, rev, ccg, CASE WHEN usr = '' THEN '' ELSE substr(sha256('seqloom' || usr), 1, 12) END AS user_hash, CASE WHEN kind = 'request' THEN coalesce(try_cast(lat AS DOUBLE), 0.0) ELSE 0.0 END AS latency_ms, kind FROM p WHERE outcome = 'event')"""
_ORDERED = _LINES + """,
k AS (SELECT *, row_number() OVER (PARTITION BY capture_id, user_hash, req, ts_us // 1000000 ORDER BY ts_us, req, line_id) AS rn FROM b),
d AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY capture_id ORDER BY ts_us, req, line_id) - 1 AS seq FROM k WHERE rn = 1 OR req = 0)"""


def _sql_rule(pattern: str, x: str) -> str:
    """A rule's test for an engine without lookahead: what may not follow is taken out of the name first."""
    import re

    tests = []
    for alt in re.split(r"\|(?![^(]*\))", pattern.lower()):
        m = re.fullmatch(r"(.*)\(\?!(.*)\)", alt)
        tests.append(f"regexp_matches(regexp_replace({x}, '{m[1]}({m[2]})', '#', 'g'), '{m[1]}')" if m else f"regexp_matches({x}, '{alt}')")
    return " OR ".join(tests)


def _sql_decode(name: str) -> str:
    """(CASE of the rule number, CASE of the category)."""
    x = f"lower({name})"
    number = " ".join(f"WHEN {_sql_rule(p, x)} THEN {i}" for i, (p, _) in enumerate(RULES))
    return f"CASE {number} WHEN suffix({name}, 'Mutation') THEN -2 WHEN suffix({name}, 'Query') THEN -3 ELSE -1 END"


_CATEGORY_OF = "CASE " + " ".join(f"WHEN rule_id IN ({', '.join(str(i) for i, (_, c) in enumerate(RULES) if c == cat)}) THEN '{cat}'" for cat in CATEGORIES) + " WHEN rule_id = -2 THEN 'act' WHEN rule_id IN (-3, -5) THEN 'view' WHEN rule_id = -1 THEN 'nav' END"
_PATH = "CASE WHEN contains(url_path, 'route-definition') OR contains(url_path, 'bulk-route') THEN 'nav' WHEN contains(url_path, 'unified_cvc') THEN 'presence' WHEN contains(url_path, 'webstorage') OR contains(url_path, 'navigation') OR contains(url_path, 'gating') OR contains(url_path, 'user_preferences') OR contains(url_path, 'graphql') THEN 'nav' END"
_TRIGRAMS = """s AS (SELECT DISTINCT operation AS name, '^^' || lower(operation) || '$$' AS p FROM dim_operation), t AS (SELECT DISTINCT name, substr(p, i, 3) AS g FROM (SELECT name, p, unnest(range(1, length(p) - 1)) AS i FROM s)), z AS (SELECT name, count(*) AS size FROM t GROUP BY name)"""
_LIFT = """s0 AS (SELECT capture_id, category, row_number() OVER (PARTITION BY capture_id ORDER BY ts_us, seq) - 1 AS pos FROM ev WHERE category IN ('view', 'act', 'msg', 'compose', 'search', 'hover', 'react', 'ad') AND capture_id IN (SELECT capture_id FROM top)),
s AS (SELECT * FROM s0 WHERE capture_id IN (SELECT capture_id FROM s0 GROUP BY capture_id HAVING count(*) >= 20 AND count(*) FILTER (category IN ('act', 'compose', 'msg', 'react')) >= 3)),
a AS (SELECT capture_id, pos AS ap, unnest(range(-5, 0)) AS o FROM s WHERE category IN ('act', 'compose', 'msg', 'react')), b AS (SELECT a.capture_id, s.category, count(*) AS n_before FROM a JOIN s ON s.capture_id = a.capture_id AND s.pos = ap + o GROUP BY ALL),
t AS (SELECT capture_id, category, count(*) AS n_base FROM s GROUP BY ALL), q AS (SELECT capture_id, category, coalesce(n_before, 0) / greatest(sum(n_before) OVER w, 1) AS pb, n_base / sum(n_base) OVER w AS p0 FROM t LEFT JOIN b USING (capture_id, category) WINDOW w AS (PARTITION BY capture_id)),
l AS (SELECT capture_id, category, round(CASE WHEN p0 > 0.005 THEN pb / p0 ELSE 1.0 END, 6) + 0.0 AS lift FROM q)"""

ORACLE = {
    "relay_outcomes": f"WITH {_LINES} SELECT capture_id, outcome, count(*) AS n FROM p GROUP BY ALL",
    "relay_quarantine": f"WITH {_LINES} SELECT line_id, outcome FROM p WHERE outcome IN ('broken', 'rejected')",
    "relay_events": f"WITH {_ORDERED} SELECT capture_id, seq, line_id, ts_us, req, route, friendly, url_path, rev, ccg, user_hash, latency_ms, kind FROM d",
    "relay_decoded": f"WITH {_LINES}, x AS (SELECT kind, url_path, CASE WHEN kind <> 'request' THEN -9 WHEN friendly <> '' THEN {_sql_decode('friendly')} WHEN {_PATH} IS NOT NULL THEN -4 ELSE -5 END AS rule_id FROM b) SELECT CASE WHEN rule_id = -9 THEN 'presence' WHEN rule_id = -4 THEN {_PATH} ELSE {_CATEGORY_OF} END AS category, rule_id::INT AS rule_id, rule_id >= 0 AS decoded, count(*) AS n FROM x GROUP BY ALL",
    "relay_segments": f"WITH {_ORDERED}, u AS (SELECT *, nullif(user_hash, '') AS u FROM d), g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 600000000 OR u <> lag(u) OVER w THEN 1 ELSE 0 END AS new FROM u WINDOW w AS (PARTITION BY capture_id ORDER BY seq)) SELECT capture_id, (sum(new) + 1)::BIGINT AS n_segments, count(*) AS n_events FROM g GROUP BY capture_id",
    "kind_counts": f"WITH {_LINES} SELECT kind, count(*) AS n FROM b GROUP BY kind",
    "decode_names": f"WITH x AS (SELECT ({_sql_decode('operation')})::INT AS rule_id FROM dim_operation) SELECT {_CATEGORY_OF} AS category, rule_id, count(*) AS n FROM x GROUP BY ALL",
    "discover_counts": "SELECT friendly AS name, count(*) AS n FROM capture_events WHERE NOT coalesce(decoded, false) AND trim(friendly) <> '' GROUP BY friendly HAVING count(*) >= 2",
    "trigram_pairs_jaccard": f"WITH {_TRIGRAMS}, c AS (SELECT a.name AS a, b.name AS b, count(*) AS common FROM t a JOIN t b ON a.g = b.g AND a.name < b.name GROUP BY ALL) SELECT a, b, common, x.size + y.size - common AS either FROM c JOIN z x ON x.name = a JOIN z y ON y.name = b WHERE common / (x.size + y.size - common) > 0.45",
    "capture_summary": f"{BASE}, n AS (SELECT capture_id, count(*) AS n, max(ts_us) - min(ts_us) AS span_us FROM ev GROUP BY capture_id), c AS (SELECT capture_id, category, count(*) AS c FROM ev GROUP BY ALL), s AS (SELECT *, unnest({CATEGORIES}) AS category FROM n) SELECT s.capture_id, n, span_us, round(n / greatest(1.0, span_us / 1e6) * 60, 6) + 0.0 AS rate_per_min, s.category, round(coalesce(c, 0) / n, 6) + 0.0 AS share FROM s LEFT JOIN c ON c.capture_id = s.capture_id AND c.category = s.category",
    "category_ranks": f"{BASE}, n AS (SELECT capture_id, category, count(*) AS n FROM ev GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, category) AS rank FROM n",
    "capture_diff_hook_lift": f"{BASE}, top AS (SELECT capture_id, row_number() OVER (ORDER BY n_events DESC NULLS LAST, capture_id) AS r FROM captures QUALIFY r <= 2), {_LIFT}, x AS (SELECT category, lift AS la FROM l JOIN top USING (capture_id) WHERE r = 1), y AS (SELECT category, lift AS lb FROM l JOIN top USING (capture_id) WHERE r = 2) SELECT category, coalesce(la, 1.0) AS lift_a, coalesce(lb, 1.0) AS lift_b, round(coalesce(lb, 1.0) - coalesce(la, 1.0), 6) + 0.0 AS delta FROM x FULL JOIN y USING (category)",
    "store_roundtrip": f"{BASE} SELECT capture_id, count(*) AS n_events, min(ts_us) AS t_min_us, max(ts_us) AS t_max_us FROM ev GROUP BY capture_id",
    "store_point_read": f"{BASE} SELECT capture_id, pos, seq, ts_us, category FROM ev WHERE capture_id = (SELECT capture_id FROM captures ORDER BY n_events DESC NULLS LAST, capture_id LIMIT 1)",
}
_panel_sql = lambda name: PANELS[name][2]
ORACLE["summary_vector"] = f"""SELECT b.capture_id, b.n, coalesce(p.seconds / 60, 0) AS dominant_period_min, coalesce(u.n_bursts, 0) AS n_bursts, coalesce(h.lift, 0) AS hover_lift, coalesce(c.cv, 0) AS cv_route_mean
FROM (SELECT capture_id, n_events AS n FROM ({_panel_sql('header_stats')})) b LEFT JOIN ({_panel_sql('dominant_period')}) p USING (capture_id)
LEFT JOIN (SELECT capture_id, count(*) AS n_bursts FROM ({_panel_sql('burst_buckets_mad')}) GROUP BY capture_id) u USING (capture_id)
LEFT JOIN (SELECT capture_id, round((n_converted / n_hovers) / (n_base_converted / n_base), 6) + 0.0 AS lift FROM ({_panel_sql('hover_conversion_exact')}) WHERE n_base_converted > 0) h USING (capture_id)
LEFT JOIN (SELECT capture_id, round(avg(n_right / n), 6) + 0.0 AS cv FROM ({_panel_sql('markov_cv')}) GROUP BY capture_id) c USING (capture_id)"""
ORACLE["relay_source_repeats"] = f"""WITH RECURSIVE {_LINES},
n AS (SELECT capture_id, line_id, ts_us, route, friendly, row_number() OVER (PARTITION BY capture_id ORDER BY line_id) AS p FROM b),
st AS (SELECT capture_id, line_id, p, ts_us AS sent, route, friendly, true AS keep FROM n WHERE p = 1
 UNION ALL SELECT n.capture_id, n.line_id, n.p, CASE WHEN n.route = st.route AND n.friendly = st.friendly AND n.ts_us - st.sent < 500000 THEN st.sent ELSE n.ts_us END, n.route, n.friendly, NOT (n.route = st.route AND n.friendly = st.friendly AND n.ts_us - st.sent < 500000)
 FROM st JOIN n ON n.capture_id = st.capture_id AND n.p = st.p + 1)
SELECT capture_id, line_id FROM st WHERE keep"""
ORACLE["event_dedup_keep_first"] = f"WITH {_ORDERED} SELECT capture_id, line_id FROM d"
ORACLE["decoder_suffix_fallback"] = f"WITH n AS (SELECT DISTINCT friendly FROM capture_events WHERE friendly <> ''), x AS (SELECT ({_sql_decode('friendly')})::INT AS rule_id FROM n) SELECT {_CATEGORY_OF} AS category, rule_id, count(*) AS n FROM x WHERE rule_id < 0 GROUP BY ALL"
ORACLE["session_window_user"] = f"""WITH {EVENTS_SQL}, u AS (SELECT lower(trim(user_hash)) AS user_hash, ts_us FROM e WHERE trim(user_hash) <> ''),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_hash ORDER BY ts_us) <= 600000000 THEN 0 ELSE 1 END AS b FROM u), s AS (SELECT *, sum(b) OVER (PARTITION BY user_hash ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_hash, min(ts_us) AS start_us, max(ts_us) + 600000000 AS end_us, count(*) AS n FROM s GROUP BY user_hash, sid"""
