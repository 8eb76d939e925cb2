"""Queries of the panels over the stored events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import findings as G
from seqloom.operators import panels as P
from seqloom.operators.canonical import canonical
from seqloom.operators.sequence import segments
from seqloom.plans.problems import EVENTS_SQL

_ACT, _BEH, _ADS, _SYS = "('act', 'compose', 'msg', 'react')", "('view', 'act', 'msg', 'compose', 'search', 'hover', 'react')", "('view', 'act', 'msg', 'compose', 'search', 'hover', 'react', 'ad')", "('nav', 'ad', 'presence', 'notif_seen', 'self_surv')"
_SHOWN = "('view', 'hover', 'search', 'act', 'msg', 'ad')"
BASE = f"""WITH {EVENTS_SQL},
ev AS (SELECT e.capture_id, e.seq, e.ts_us, coalesce(d.family, 'nav') AS category, trim(regexp_replace(trim(e.route), '[?#].*$', '')) AS route, r.surface, e.rev, nullif(lower(trim(e.user_hash)), '') AS usr,
 e.latency_ms, e.friendly, e.label, e.decoded, e.kind, row_number() OVER (PARTITION BY e.capture_id ORDER BY e.ts_us, e.seq) - 1 AS pos
 FROM e LEFT JOIN dim_category d ON regexp_replace(lower(trim(e.category)), '[./:-]', '.') = d.category LEFT JOIN dim_route r ON trim(regexp_replace(trim(e.route), '[?#].*$', '')) = r.route)"""


def _sub(keep: str, name: str = "s", src: str = "ev") -> str:
    return f"{name} AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY capture_id ORDER BY ts_us, seq) - 1 AS pos FROM {src} WHERE {keep})"


def _least(src: str, name: str, *having: str) -> str:
    return f"{name} AS (SELECT * FROM {src} WHERE capture_id IN (SELECT capture_id FROM {src} GROUP BY capture_id HAVING {' AND '.join(having)}))"


def _buckets(seconds: int) -> str:
    us = seconds * 1_000_000
    return f"""g AS (SELECT capture_id, min(ts_us) AS t0, greatest(10, greatest(1000000, max(ts_us) - min(ts_us)) // {us} + 1) AS nb, count(*) FILTER (category IN {_BEH}) AS beh FROM ev GROUP BY capture_id HAVING count(*) >= 10),
k AS (SELECT ev.capture_id, category, least((ts_us - t0) // {us}, nb - 1) AS bucket, beh < 10 AS all_count, category IN {_BEH} OR beh < 10 AS counts FROM ev JOIN g USING (capture_id)),
sp AS (SELECT capture_id, unnest(range(nb)) AS bucket FROM g),
bk AS (SELECT sp.capture_id, sp.bucket, count(k.bucket) AS n FROM sp LEFT JOIN k ON k.capture_id = sp.capture_id AND k.bucket = sp.bucket AND k.counts GROUP BY sp.capture_id, sp.bucket)"""


_TREND = """tr AS (SELECT capture_id, count(*) AS n_buckets, regr_slope(n, bucket) AS slope, regr_intercept(n, bucket) AS intercept FROM bk GROUP BY capture_id),
dt AS (SELECT bk.capture_id, bucket, n_buckets, n - (slope * bucket + intercept) AS x FROM bk JOIN tr USING (capture_id))"""
_HOOKS = f"{_sub(f'category IN {_ADS}', 's0')}, {_least('s0', 's', 'count(*) >= 20', f'count(*) FILTER (category IN {_ACT}) >= 3')}"
_HOVER = f"{_sub(f'category IN {_ADS}', 's0')}, {_least('s0', 's', 'count(*) >= 30', '''count(*) FILTER (category = 'hover') >= 5''')}"
_NEAR = f"nr AS (SELECT *, min(CASE WHEN category IN {_ACT} THEN pos END) OVER (PARTITION BY capture_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) - pos AS delay FROM s)"
_SURV = f"""{_least('ev', 'l', 'count(*) >= 30')}, {_sub(f'category IN {_BEH}', 's', 'l')},
nx AS (SELECT *, last_value(CASE WHEN category IN {_ACT} THEN ts_us END IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS na, max(ts_us) OVER (PARTITION BY capture_id) AS te FROM s),
du AS (SELECT capture_id, coalesce(na, te) - ts_us AS d, na IS NOT NULL AS obs FROM nx WHERE category NOT IN {_ACT} AND CASE WHEN na IS NOT NULL THEN na - ts_us <= 480000000 ELSE te - ts_us > 0 END),
cu AS (SELECT capture_id, d AS t_us, count(*) AS n, count(*) FILTER (obs) AS n_observed, sum(count(*)) OVER (PARTITION BY capture_id ORDER BY d DESC)::BIGINT AS at_risk FROM du GROUP BY capture_id, d),
ks AS (SELECT *, product(1 - n_observed / at_risk) OVER (PARTITION BY capture_id ORDER BY t_us) AS s FROM cu WHERE t_us <= 120000000)"""


def _predictable(state: str) -> str:
    return f"""{_least('ev', 'l0', 'count(*) >= 50')}, l AS (SELECT *, count(*) FILTER (category IN {_ADS}) OVER (PARTITION BY capture_id) AS wa FROM l0),
{_sub(f'category IN {_ADS} OR wa < 50', 's1', 'l')}, s AS (SELECT capture_id, pos, coalesce({state}, '') AS state, count(*) OVER (PARTITION BY capture_id) AS nn FROM s1)"""


_MARKOV = """pr AS (SELECT *, lead(state) OVER (PARTITION BY capture_id ORDER BY pos) AS nxt FROM s),
ct AS (SELECT capture_id, state AS from_state, nxt AS to_state, count(*) AS n FROM pr WHERE nxt IS NOT NULL GROUP BY ALL),
vo AS (SELECT DISTINCT capture_id, state FROM s), vn AS (SELECT capture_id, count(*) AS v FROM vo GROUP BY capture_id),
mk AS (SELECT f.capture_id, f.from_state, vo.state AS to_state, coalesce(ct.n, 0) AS n, v FROM (SELECT DISTINCT capture_id, from_state FROM ct) f JOIN vo USING (capture_id) JOIN vn USING (capture_id) LEFT JOIN ct ON ct.capture_id = f.capture_id AND ct.from_state = f.from_state AND ct.to_state = vo.state),
mp AS (SELECT *, sum(n) OVER (PARTITION BY capture_id, from_state) AS tot FROM mk)"""


def _steps(n: int) -> str:
    """The chain's distribution after each step (v), and that of the paths without an action (u)."""
    one = lambda x, i, keep: f"""{x}{i} AS (SELECT x.capture_id, t.to_state AS state, sum(x.w * t.p) AS w FROM {x}{i - 1} x JOIN tm t ON t.capture_id = x.capture_id AND t.from_state = x.state {keep} GROUP BY ALL)"""
    chains = ", ".join(one("v", i, "") + ", " + one("u", i, f"WHERE t.to_state NOT IN {_ACT}") for i in range(1, n + 1))
    shares = ", ".join(f"q{i} AS (SELECT capture_id, coalesce(sum(w) FILTER (state IN {_ACT}), 0) AS a FROM v{i} GROUP BY capture_id)" for i in range(1, n + 1))
    stay = " * ".join(f"(1 - q{i}.a)" for i in range(1, n + 1))
    joins = " ".join(f"JOIN q{i} USING (capture_id)" for i in range(2, n + 1))
    return f"""tm AS (SELECT a.capture_id, a.state AS from_state, b.state AS to_state, (coalesce(c.n, 0) + 0.5::DOUBLE) / (coalesce(sum(c.n) OVER (PARTITION BY a.capture_id, a.state), 0) + 0.5::DOUBLE * v) AS p FROM vo a JOIN vo b USING (capture_id) JOIN vn USING (capture_id) LEFT JOIN ct c ON c.capture_id = a.capture_id AND c.from_state = a.state AND c.to_state = b.state),
v0 AS (SELECT capture_id, arg_max(state, pos) AS state, 1.0::DOUBLE AS w FROM s GROUP BY capture_id), u0 AS (SELECT * FROM v0), {chains}, {shares}, fp AS (SELECT capture_id, sum(w) AS u FROM u{n} GROUP BY capture_id)
SELECT capture_id, {_R.format(f'1 - {stay}')} AS p_marginal, {_R.format('1 - coalesce(u, 0)')} AS p_first_passage FROM q1 {joins} LEFT JOIN fp USING (capture_id)"""


def _score(train: str, test: str, fold: str = "") -> str:
    """Rank 1 and top 3 of the training counts, completed by the states in order."""
    k = f"capture_id{fold}"
    return f"""pr AS (SELECT *, lead(state) OVER (PARTITION BY {k} ORDER BY pos) AS nxt FROM sf),
ct AS (SELECT {k}, state, nxt, count(*) AS n FROM pr WHERE nxt IS NOT NULL AND {train} GROUP BY ALL),
vo AS (SELECT DISTINCT {k}, state AS nxt FROM sf), te AS (SELECT * FROM pr WHERE nxt IS NOT NULL AND {test}),
src AS (SELECT DISTINCT {k}, state FROM te),
rk AS (SELECT *, row_number() OVER (PARTITION BY {k}, state ORDER BY n DESC, nxt) AS rank FROM (SELECT {', '.join('src.' + c for c in k.split(', '))}, src.state, vo.nxt, coalesce(ct.n, 0) AS n FROM src JOIN vo USING ({k}) LEFT JOIN ct ON {' AND '.join(f'ct.{c} = src.{c}' for c in k.split(', '))} AND ct.state = src.state AND ct.nxt = vo.nxt)),
mo AS (SELECT {k}, arg_min(state, (-n, state)) AS mode FROM (SELECT {k}, state, count(*) AS n FROM sf GROUP BY ALL) GROUP BY {k}),
sc AS (SELECT {', '.join('te.' + c for c in k.split(', '))}, te.nxt, rk.rank, mo.mode FROM te JOIN rk ON {' AND '.join(f'rk.{c} = te.{c}' for c in k.split(', '))} AND rk.state = te.state AND rk.nxt = te.nxt JOIN mo ON {' AND '.join(f'mo.{c} = te.{c}' for c in k.split(', '))})"""


_R = "round({}, 6) + 0.0"
_WELCH = f"""x AS (SELECT *, least(64, n_buckets) AS len, greatest(least(64, n_buckets) // 2, 1) AS step FROM dt),
sg AS (SELECT DISTINCT capture_id, len, step, unnest(range((n_buckets - len) // step + 1)) AS seg FROM x), y AS (SELECT x.capture_id, sg.seg, x.len, x.bucket - sg.seg * x.step AS i, x.x - avg(x.x) OVER (PARTITION BY x.capture_id, sg.seg) AS z FROM x JOIN sg ON sg.capture_id = x.capture_id AND x.bucket >= sg.seg * x.step AND x.bucket < sg.seg * x.step + x.len),
h AS (SELECT *, z * 0.5 * (1 - cos(2 * pi() * i / (len - 1))) AS w FROM y), f AS (SELECT capture_id, seg, len, k, (power(sum(w * cos(2 * pi() * k * i / len)), 2) + power(sum(w * sin(2 * pi() * k * i / len)), 2)) / len AS pw FROM (SELECT *, unnest(range(1, len // 2 + 1)) AS k FROM h) GROUP BY capture_id, seg, len, k),
wp AS (SELECT capture_id, k, {_R.format('len / k')} AS period, avg(pw) AS power FROM f GROUP BY capture_id, len, k HAVING len / k >= 2)"""
_POWERS = "SELECT capture_id, k, period, round(power, 4) + 0.0 AS power FROM wp"
_DOMINANT = """wr AS (SELECT capture_id, k, period, round(power, 6) AS power FROM wp), wm AS (SELECT capture_id, list_sort(list(power))[count(*) // 2 + 1] AS floor FROM wr GROUP BY capture_id)
SELECT capture_id, arg_min(period * 60, (-power, k)) AS seconds FROM wr JOIN wm USING (capture_id) WHERE period > 2 AND power > 2 * floor GROUP BY capture_id"""


def _segment_summary(ev: DataFrame) -> DataFrame:
    return segments(ev).groupBy("capture_id", "segment_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def _gap_only(ev: DataFrame) -> DataFrame:
    return segments(ev, by_user=False).select("capture_id", "pos", "segment_id")


#: name -> (panel over the canonical sequence, extra columns it needs, SQL)
PANELS: dict[str, tuple] = {
    "header_stats": (P.header_stats, (), f"""{BASE} SELECT capture_id, count(*) AS n_events, count(*) FILTER (category IN {_ACT}) AS n_actions, count(*) FILTER (category = 'hover') AS n_hovers, count(*) FILTER (category = 'ad') AS n_ads, count(DISTINCT route) AS n_routes, max(ts_us) - min(ts_us) AS span_us FROM ev GROUP BY capture_id"""),
    "panel_status": (P.panel_status, (), f"""{BASE}, c AS (SELECT capture_id, count(*) n, count(*) FILTER (category IN ('act', 'compose', 'msg')) resp, count(*) FILTER (category IN {_ACT}) actions, count(*) FILTER (category IN {_BEH}) beh, count(*) FILTER (category IN {_ADS}) wads, count(*) FILTER (category = 'hover') hovers, count(*) FILTER (category = 'ad') ads, count(*) FILTER (category IN ('self_surv', 'presence')) tele, count(DISTINCT CASE WHEN surface IS NOT NULL THEN route END) known FROM ev GROUP BY capture_id)
SELECT capture_id, unnest(['response', 'transitions', 'rhythm', 'hooks', 'diurnal', 'predictions', 'hover', 'ads', 'revisions', 'survival', 'telemetry', 'anomalies', 'coverage']) AS panel, unnest([resp >= 3, known >= 2, n >= 10, wads >= 20 AND actions >= 3, n >= 1, n >= 50, wads >= 30 AND hovers >= 5, wads >= 50 AND ads >= 3, n >= 30, n >= 30, tele >= 1, n >= 50 AND beh >= 50, n >= 1]) AS available FROM c"""),
    "diurnal_hour_category": (P.diurnal, (), f"""{BASE} SELECT capture_id, ts_us % 86400000000 // 3600000000 AS hour, category, count(*) AS n FROM ev GROUP BY ALL"""),
    "diurnal_peak_hour": (P.peak_hour, (), f"""{BASE}, h AS (SELECT capture_id, ts_us % 86400000000 // 3600000000 AS hour, count(*) AS n FROM ev GROUP BY ALL) SELECT capture_id, arg_min(hour, (-n, hour)) AS peak_hour, max(n) AS n FROM h GROUP BY capture_id"""),
    "segment_gap": (_gap_only, (), f"""{BASE}, b AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 600000000 THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY capture_id ORDER BY pos)) SELECT capture_id, pos, sum(b) OVER (PARTITION BY capture_id ORDER BY pos)::BIGINT AS segment_id FROM b"""),
    "segment_gap_or_user": (lambda ev: segments(ev).select("capture_id", "pos", "segment_id"), (), f"""{BASE}, b AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 600000000 OR usr <> lag(usr) OVER w THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY capture_id ORDER BY pos)) SELECT capture_id, pos, sum(b) OVER (PARTITION BY capture_id ORDER BY pos)::BIGINT AS segment_id FROM b"""),
    "segment_summary": (_segment_summary, (), f"""{BASE}, b AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 600000000 OR usr <> lag(usr) OVER w THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY capture_id ORDER BY pos)), s AS (SELECT *, sum(b) OVER (PARTITION BY capture_id ORDER BY pos)::BIGINT AS segment_id FROM b) SELECT capture_id, segment_id, count(*) AS n_events, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s GROUP BY capture_id, segment_id"""),
    "action_response_envelope": (P.action_response, (), f"""{BASE}, {_least('ev', 'l', "count(*) FILTER (category IN ('act', 'compose', 'msg')) >= 3")}, a AS (SELECT capture_id, pos AS ap, unnest(range(-30, 31)) AS "offset" FROM l WHERE category IN ('act', 'compose', 'msg')),
j AS (SELECT a.capture_id, a."offset", l.category, count(*) AS n FROM a JOIN l ON l.capture_id = a.capture_id AND l.pos = a.ap + a."offset" GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY capture_id, "offset")::BIGINT AS n_all FROM j) SELECT * FROM t WHERE category IN {_SHOWN}"""),
    "route_transitions": (P.transitions, (), f"""{BASE}, p AS (SELECT capture_id, route, surface, lead(route) OVER w AS r2, lead(surface) OVER w AS s2 FROM ev WINDOW w AS (PARTITION BY capture_id ORDER BY pos)), c AS (SELECT capture_id, route, r2, count(*) AS n FROM p WHERE surface IS NOT NULL AND s2 IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT capture_id, route FROM ev WHERE surface IS NOT NULL), f AS (SELECT a.capture_id, a.route AS from_route, b.route AS to_route, coalesce(c.n, 0) AS n FROM k a JOIN k b USING (capture_id) LEFT JOIN c ON c.capture_id = a.capture_id AND c.route = a.route AND c.r2 = b.route WHERE a.capture_id IN (SELECT capture_id FROM k GROUP BY capture_id HAVING count(*) >= 2))
SELECT *, sum(n) OVER (PARTITION BY capture_id, from_route)::BIGINT AS n_from FROM f"""),
    "transition_coverage": (P.transition_coverage, (), f"""{BASE}, p AS (SELECT capture_id, surface, lead(surface) OVER w AS s2, lead(pos) OVER w AS p2 FROM ev WINDOW w AS (PARTITION BY capture_id ORDER BY pos)) SELECT capture_id, count(*) FILTER (surface IS NOT NULL AND s2 IS NOT NULL) AS n_counted, count(*) FILTER (surface IS NULL OR s2 IS NULL) AS n_excluded FROM p WHERE p2 IS NOT NULL GROUP BY capture_id"""),
    "route_visits": (P.route_visits, (), f"""{BASE} SELECT capture_id, surface, count(*) AS n FROM ev WHERE surface IS NOT NULL GROUP BY ALL"""),
    "hook_lift": (P.hook_lift, (), f"""{BASE}, {_HOOKS}, a AS (SELECT capture_id, pos AS ap, unnest(range(-5, 0)) AS o FROM s WHERE category IN {_ACT}), b AS (SELECT a.capture_id, s.category, count(*) AS n_before FROM a JOIN s ON s.capture_id = a.capture_id AND s.pos = ap + o GROUP BY ALL),
t AS (SELECT capture_id, category, count(*) AS n_base FROM s GROUP BY ALL), j AS (SELECT capture_id, category, coalesce(n_before, 0) AS n_before, n_base FROM t LEFT JOIN b USING (capture_id, category)), q AS (SELECT *, n_before / greatest(sum(n_before) OVER w, 1) AS pb, n_base / sum(n_base) OVER w AS p0 FROM j WINDOW w AS (PARTITION BY capture_id))
SELECT capture_id, category, n_before, n_base, {_R.format('CASE WHEN p0 > 0.005 THEN pb / p0 ELSE 1.0 END::DOUBLE')} AS lift FROM q"""),
    "hook_permutation_p": (P.hook_permutation, (), f"""{BASE}, {_HOOKS}, l AS (SELECT capture_id, pos, category, category IN {_ACT} AS act, {', '.join(f"count(*) FILTER (category = '{c}') OVER w AS c_{c}" for c in P.HOOKS)}, least(pos, 5) AS d FROM s WINDOW w AS (PARTITION BY capture_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
o AS (SELECT capture_id, count(*) AS n, count(*) FILTER (act) AS a, sum(d) FILTER (act) AS od, {', '.join(f"sum(c_{c}) FILTER (act) AS o_{c}, count(*) FILTER (category = '{c}') AS b_{c}" for c in P.HOOKS)} FROM l GROUP BY capture_id), r AS (SELECT *, unnest(range(500)) AS r FROM l WHERE pos >= 1), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id, r ORDER BY md5(r || ':' || pos), pos) AS k FROM r),
t AS (SELECT capture_id, r, sum(d) AS rd, {', '.join(f'sum(c_{c}) AS r_{c}' for c in P.HOOKS)} FROM k JOIN o USING (capture_id) WHERE k <= a GROUP BY ALL),
x AS ({' UNION ALL '.join(f"SELECT capture_id, '{c}' AS category, n, b_{c} AS b, o_{c} AS oc, od, count(*) FILTER (r_{c} * greatest(od, 1) >= o_{c} * greatest(rd, 1)) AS n_ge FROM t JOIN o USING (capture_id) GROUP BY ALL" for c in P.HOOKS)})
SELECT capture_id, category, n_ge, {_R.format('((n_ge + 1) / 501.0)::DOUBLE')} AS p FROM x WHERE b >= 5 AND b * 200 > n AND oc * n > b * greatest(od, 1)"""),
    "rhythm_buckets": (P.rhythm_buckets, (), f"{BASE}, {_buckets(60)} SELECT capture_id, bucket, n FROM bk"),
    "rhythm_buckets_900s": (lambda ev: P.rhythm_buckets(ev, 900), (), f"{BASE}, {_buckets(900)} SELECT capture_id, bucket, n FROM bk"),
    "rhythm_bucket_category": (P.rhythm_by_category, (), f"""{BASE}, {_buckets(60)} SELECT capture_id, bucket, category, sum(CASE WHEN counts THEN 1 ELSE 0 END + CASE WHEN category IN {_SYS} THEN 1 ELSE 0 END)::BIGINT AS n FROM k GROUP BY ALL"""),
    "burst_buckets_mad": (P.bursts, (), f"""{BASE}, {_buckets(60)}, m AS (SELECT capture_id, median(n) AS median, stddev_samp(n) AS sd FROM bk GROUP BY capture_id HAVING count(*) FILTER (n > 0) >= 5), d AS (SELECT capture_id, median(abs(n - m.median)) AS mad FROM bk JOIN m USING (capture_id) GROUP BY capture_id),
t AS (SELECT capture_id, bucket, n, median, mad, median + (3.5 / 0.6745)::DOUBLE * CASE WHEN mad = 0 THEN sd / 1.4826 ELSE mad END AS threshold FROM bk JOIN m USING (capture_id) JOIN d USING (capture_id)) SELECT capture_id, bucket, n, median, mad, {_R.format('threshold')} AS threshold FROM t WHERE n > threshold AND n > 0"""),
    "bucket_trend": (P.bucket_trend, (), f"{BASE}, {_buckets(60)}, {_TREND} SELECT capture_id, n_buckets, round(slope, 9) + 0.0 AS slope, {_R.format('intercept')} AS intercept FROM tr"),
    "bucket_autocorr": (P.autocorrelation, (), f"""{BASE}, {_buckets(60)}, {_TREND}, v AS (SELECT capture_id, sum(x * x) AS ss FROM dt GROUP BY capture_id), lg AS (SELECT dt.*, unnest(range(least(60, n_buckets // 2))) AS lag FROM dt),
c AS (SELECT lg.capture_id, lg.lag, sum(lg.x * b.x) AS s FROM lg JOIN dt b ON b.capture_id = lg.capture_id AND b.bucket = lg.bucket + lg.lag GROUP BY ALL) SELECT capture_id, lag, {_R.format('s / CASE WHEN ss = 0 THEN 1.0 ELSE ss END')} AS r FROM c JOIN v USING (capture_id)"""),
    "welch_periodogram": (lambda ev: P.periodogram(ev).withColumn("power", P.rounded("power", 4)), (), f"{BASE}, {_buckets(60)}, {_TREND}, {_WELCH} {_POWERS}"),
    "welch_periodogram_900s": (lambda ev: P.periodogram(ev, 900).withColumn("power", P.rounded("power", 4)), (), f"{BASE}, {_buckets(900)}, {_TREND}, {_WELCH} {_POWERS}"),
    "dominant_period": (P.dominant_period, (), f"{BASE}, {_buckets(60)}, {_TREND}, {_WELCH}, {_DOMINANT}"),
    "hover_conversion_exact": (P.hover_conversion, (), f"""{BASE}, {_HOVER}, {_NEAR} SELECT capture_id, count(*) FILTER (category = 'hover') AS n_hovers, count(*) FILTER (category = 'hover' AND delay IS NOT NULL) AS n_converted, count(*) AS n_base, count(delay) AS n_base_converted, median(CASE WHEN category = 'hover' THEN delay END) AS median_delay FROM nr GROUP BY capture_id"""),
    "hover_conversion_sampled": (lambda ev: P.hover_conversion(ev, samples=True), (), f"""{BASE}, {_HOVER}, {_NEAR}, p AS (SELECT capture_id, count(*) FILTER (category = 'hover') AS n_hovers, count(*) FILTER (category = 'hover' AND delay IS NOT NULL) AS n_converted, count(*) AS n, median(CASE WHEN category = 'hover' THEN delay END) AS median_delay FROM nr GROUP BY capture_id),
i AS (SELECT capture_id, n, unnest(range(1, least(20 * n_hovers, n - 1) + 1)) AS i FROM p), dr AS (SELECT capture_id, ('0x' || substr(md5(i::VARCHAR), 1, 8))::BIGINT % n AS pos FROM i), b AS (SELECT dr.capture_id, count(*) AS n_base, count(nr.delay) AS n_base_converted FROM dr JOIN nr ON nr.capture_id = dr.capture_id AND nr.pos = dr.pos GROUP BY ALL)
SELECT capture_id, n_hovers, n_converted, n_base, n_base_converted, median_delay FROM p JOIN b USING (capture_id)"""),
    "ad_dose_response": (P.ad_dose_response, (), f"""{BASE}, {_sub(f'category IN {_ADS}', 's0')}, {_least('s0', 's', 'count(*) >= 50', "count(*) FILTER (category = 'ad') >= 3")}, a AS (SELECT capture_id, pos, category = 'ad' AS ad, unnest(range(1, 31)) AS k FROM s),
j AS (SELECT a.capture_id, a.k, count(*) FILTER (ad) AS n, count(*) FILTER (ad AND s.category IN {_ACT}) AS n_action, count(*) AS base_n, count(*) FILTER (s.category IN {_ACT}) AS base_action FROM a JOIN s ON s.capture_id = a.capture_id AND s.pos = a.pos + a.k GROUP BY ALL)
SELECT capture_id, k, n, n_action, round(1 - product(1 - CASE WHEN n > 0 THEN n_action / n ELSE 0.0 END) OVER (PARTITION BY capture_id ORDER BY k), 9) + 0.0 AS cumulative, base_n, base_action FROM j"""),
    "rev_boundary_delta": (P.revision_boundaries, (), f"""{BASE}, {_least('ev', 'l', 'count(*) >= 30')}, o AS (SELECT capture_id, pos, category, ts_us, nullif(rev, '') AS rev, last_value(nullif(rev, '') IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM l),
b AS (SELECT * FROM o WHERE rev IS NOT NULL AND pos > 0 AND rev IS DISTINCT FROM old), j AS (SELECT b.capture_id, b.pos, coalesce(b.old, '') AS old_rev, b.rev AS new_rev, l.category, l.ts_us, l.pos < b.pos AS bef FROM b JOIN l ON l.capture_id = b.capture_id AND l.pos >= b.pos - 50 AND l.pos < b.pos + 50),
t AS (SELECT capture_id, pos, old_rev, new_rev, count(*) FILTER (bef AND category IN {_BEH}) AS all_before, count(*) FILTER (NOT bef AND category IN {_BEH}) AS all_after, count(*) FILTER (bef) AS nb, count(*) FILTER (NOT bef) AS na, max(ts_us) FILTER (bef) - min(ts_us) FILTER (bef) AS tb, max(ts_us) FILTER (NOT bef) - min(ts_us) FILTER (NOT bef) AS ta, list(category) FILTER (bef) AS cb, list(category) FILTER (NOT bef) AS ca FROM j GROUP BY ALL),
u AS (SELECT *, unnest(['view', 'act', 'msg', 'compose', 'search', 'hover', 'react']) AS category FROM t WHERE nb >= 10 AND na >= 10)
SELECT capture_id, pos, old_rev, new_rev, category, len(list_filter(cb, lambda c: c = category)) AS n_before, all_before, len(list_filter(ca, lambda c: c = category)) AS n_after, all_after, {_R.format('nb / greatest(1.0, tb / 1e6)')} AS rate_before, {_R.format('na / greatest(1.0, ta / 1e6)')} AS rate_after FROM u"""),
    "survival_curve": (P.survival_curve, (), f"{BASE}, {_SURV} SELECT capture_id, t_us, at_risk, n_observed, {_R.format('s')} AS survival FROM ks"),
    "survival_summary": (P.survival_summary, (), f"""{BASE}, {_SURV}, h AS (SELECT capture_id, min(t_us) AS m FROM ks WHERE round(s, 6) <= 0.5 GROUP BY capture_id), t AS (SELECT capture_id, count(*) AS n, count(*) FILTER (obs) AS n_observed, sum(d) FILTER (obs) AS sd FROM du GROUP BY capture_id)
SELECT capture_id, n, n_observed, {_R.format('sd / n_observed / 1e6')} AS mean_dwell_s, coalesce(m, -1) AS median_t_us FROM t LEFT JOIN h USING (capture_id) WHERE n_observed > 0"""),
    "telemetry_intervals": (P.telemetry_intervals, (), f"""{BASE}, g AS (SELECT capture_id, category, ts_us - lag(ts_us) OVER (PARTITION BY capture_id, category ORDER BY pos) AS gap FROM ev WHERE category IN ('self_surv', 'presence', 'notif_seen')) SELECT capture_id, category, count(*) AS n, {_R.format('coalesce(median(CASE WHEN gap > 0 THEN gap END), -1e6) / 1e6')} AS median_interval_s FROM g GROUP BY ALL"""),
    "telemetry_behaviour_30s": (P.telemetry_behaviour, (), f"""{BASE}, c AS (SELECT capture_id, pos, category, count(*) FILTER (category IN {_BEH}) OVER (PARTITION BY capture_id ORDER BY ts_us RANGE BETWEEN 30000000 PRECEDING AND 1 PRECEDING) AS n_before FROM ev) SELECT capture_id, pos, n_before FROM c WHERE category = 'self_surv'"""),
    "markov_route_probs": (P.markov_routes, (), f"{BASE}, {_predictable('route')}, {_MARKOV} SELECT capture_id, from_state, to_state, n, {_R.format('((n + 0.5) / (tot + 0.5 * v))::DOUBLE')} AS p, {_R.format('(0.5 / (tot + 0.5 * v))::DOUBLE')} AS p_unseen FROM mp WHERE n > 0"),
    "markov_category_probs": (P.markov_categories, (), f"{BASE}, {_predictable('category')}, {_MARKOV} SELECT capture_id, from_state, to_state, n, {_R.format('((n + 0.5) / (tot + 0.5 * v))::DOUBLE')} AS p, {_R.format('(0.5 / (tot + 0.5 * v))::DOUBLE')} AS p_unseen FROM mp WHERE n > 0"),
    "markov_holdout_accuracy": (P.markov_holdout, (), f"{BASE}, {_predictable('route')}, sf AS (SELECT *, floor(nn * 0.8::DOUBLE)::BIGINT AS split FROM s), {_score('pos + 1 < split', 'pos >= split')} SELECT capture_id, count(*) AS n, count(*) FILTER (rank = 1) AS n_right, count(*) FILTER (rank <= 3) AS n_top3, count(*) FILTER (mode = nxt) AS n_mode FROM sc GROUP BY capture_id"),
    "markov_cv": (P.markov_cross_validation, (), f"{BASE}, {_predictable('route')}, sf AS (SELECT *, nn // 6 AS ch, unnest(range(1, 6)) AS fold FROM s WHERE nn // 6 >= 10), {_score('pos + 1 < ch * fold', 'pos >= ch * fold AND pos + 1 < ch * fold + ch', ', fold')} SELECT capture_id, fold, count(*) AS n, count(*) FILTER (rank = 1) AS n_right, count(*) FILTER (mode = nxt) AS n_mode FROM sc GROUP BY capture_id, fold"),
    "next_route_topk": (P.next_routes, (), f"{BASE}, {_predictable('route')}, {_MARKOV}, la AS (SELECT capture_id, arg_max(state, pos) AS from_state FROM s GROUP BY capture_id), q AS (SELECT capture_id, to_state, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, to_state) AS rank, {_R.format('((n + 0.5) / (tot + 0.5 * v))::DOUBLE')} AS p FROM mp JOIN la USING (capture_id, from_state)) SELECT capture_id, rank, to_state, p FROM q WHERE rank <= 5"),
    "action_prob_next5": (P.action_probability, (), f"{BASE}, {_predictable('category')}, {_MARKOV}, {_steps(5)}"),
    "route_streaks": (P.longest_streaks, (), f"""{BASE}, {_sub(f'category IN {_BEH}')}, b AS (SELECT *, CASE WHEN pos > 0 AND route IS NOT DISTINCT FROM lag(route) OVER (PARTITION BY capture_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY pos) AS isl FROM b), z AS (SELECT capture_id, isl, count(*) AS n FROM i GROUP BY ALL) SELECT capture_id, max(n) AS longest, count(*) AS n_streaks FROM z GROUP BY capture_id"""),
    "anomaly_topk": (P.anomalies, ("label", "friendly"), f"""{BASE}, {_least('ev', 'l', 'count(*) >= 50')}, {_sub(f'category IN {_BEH}', 's0', 'l')}, {_least('s0', 's1', 'count(*) >= 50')}, s AS (SELECT capture_id, pos, category AS state FROM s1), {_MARKOV}, pp AS (SELECT capture_id, from_state, to_state, (n + 1) / (tot + v) AS p FROM mp),
b AS (SELECT s1.*, lag(category) OVER w AS prev, (ts_us - lag(ts_us) OVER w) / 1e6 AS gap, CASE WHEN pos > 0 AND route IS NOT DISTINCT FROM lag(route) OVER w THEN 0 ELSE 1 END AS new FROM s1 WINDOW w AS (PARTITION BY capture_id ORDER BY pos)), i AS (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY pos) AS isl FROM b), z AS (SELECT *, row_number() OVER (PARTITION BY capture_id, isl ORDER BY pos) AS streak FROM i),
c AS (SELECT z.capture_id, pos, seq, coalesce(route, '') AS route, coalesce(label, '') AS label, coalesce(friendly, '') AS friendly, {_R.format('''CASE WHEN gap > 0 THEN ln(1 + gap) * 0.4 ELSE 0 END + CASE WHEN prev IS NOT NULL THEN -ln(greatest(coalesce(p, 1e-6), 1e-6)) ELSE 0 END + CASE WHEN streak >= 20 THEN (streak - 20) * 0.05 ELSE 0 END + CASE WHEN latency_ms > 1000 THEN ln(latency_ms / 1000) * 0.6 ELSE 0 END''')} AS score FROM z LEFT JOIN pp ON pp.capture_id = z.capture_id AND pp.from_state = z.prev AND pp.to_state = z.category),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, pos) AS rank FROM c) SELECT capture_id, rank, seq, score, route, label, friendly FROM r WHERE rank <= 10"""),
    "decoder_coverage": (P.coverage, ("friendly", "decoded"), f"""{BASE} SELECT capture_id, count(*) FILTER (trim(friendly) <> '') AS n_named, count(*) FILTER (trim(friendly) <> '' AND decoded) AS n_decoded, count(*) FILTER (coalesce(trim(friendly), '') = '') AS n_nameless, count(DISTINCT CASE WHEN trim(friendly) <> '' AND NOT coalesce(decoded, false) THEN friendly END) AS n_unmatched_names FROM ev GROUP BY capture_id"""),
    "unmatched_topk": (P.unmatched, ("friendly", "decoded"), f"""{BASE} SELECT friendly, count(*) AS n, CASE WHEN friendly LIKE '%Mutation' THEN 'MUT' WHEN friendly LIKE '%Query' THEN 'QRY' ELSE '?' END AS tag FROM ev WHERE NOT coalesce(decoded, false) AND trim(friendly) <> '' GROUP BY friendly ORDER BY n DESC, friendly LIMIT 50"""),
    "finding_view_change": (G.view_change, (), f"""{BASE}, {_least('ev', 'l', "count(*) FILTER (category IN ('act', 'compose', 'msg')) >= 3")}, a AS (SELECT capture_id, pos AS ap, unnest(range(-10, 11)) AS o FROM l WHERE category IN ('act', 'compose', 'msg')),
j AS (SELECT a.capture_id, a.o, count(*) FILTER (l.category = 'view') / count(*) AS s, count(*) FILTER (l.category = 'view') AS nv FROM a JOIN l ON l.capture_id = a.capture_id AND l.pos = a.ap + a.o WHERE a.o <> 0 GROUP BY ALL),
m AS (SELECT capture_id, coalesce(sum(s) FILTER (o < 0), 0) / 10 AS b, coalesce(sum(s) FILTER (o > 0), 0) / 10 AS f FROM j GROUP BY capture_id HAVING sum(nv) > 0), p AS (SELECT capture_id, b, f, round(CASE WHEN b > 0 THEN (f - b) / b * 100 ELSE 0.0 END, 4) + 0.0 AS change_pct FROM m)
SELECT capture_id, {_R.format('b')} AS before, {_R.format('f')} AS after, change_pct, CASE WHEN change_pct > 5 THEN 'up' WHEN change_pct < -5 THEN 'down' ELSE 'flat' END AS direction FROM p"""),
    "finding_strongest_pull": (G.strongest_pull, (), f"""{BASE}, p AS (SELECT capture_id, route, surface, lead(route) OVER w AS r2, lead(surface) OVER w AS s2 FROM ev WINDOW w AS (PARTITION BY capture_id ORDER BY pos)), c AS (SELECT capture_id, route, r2, count(*) AS n FROM p WHERE surface IS NOT NULL AND s2 IS NOT NULL GROUP BY ALL),
k AS (SELECT capture_id FROM ev WHERE surface IS NOT NULL GROUP BY capture_id HAVING count(DISTINCT route) >= 2), q AS (SELECT *, n / sum(n) OVER (PARTITION BY capture_id, route) AS p FROM c WHERE capture_id IN (SELECT capture_id FROM k)),
b AS (SELECT *, row_number() OVER (PARTITION BY capture_id, route ORDER BY p DESC, r2) AS i FROM q), t AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY p DESC, route) AS j FROM b WHERE i = 1 AND r2 <> route AND p > 0.2) SELECT capture_id, route AS from_route, r2 AS to_route, {_R.format('p')} AS p FROM t WHERE j = 1"""),
    "finding_leading_hooks": (G.leading_hooks, (), f"""{BASE}, {_HOOKS}, a AS (SELECT capture_id, pos AS ap, unnest(range(-5, 0)) AS o FROM s WHERE category IN {_ACT}), b AS (SELECT a.capture_id, s.category, count(*) AS nb FROM a JOIN s ON s.capture_id = a.capture_id AND s.pos = ap + o GROUP BY ALL),
t AS (SELECT capture_id, category, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT capture_id, category, coalesce(nb, 0) / greatest(sum(coalesce(nb, 0)) OVER w, 1) AS pb, n / sum(n) OVER w AS p0 FROM t LEFT JOIN b USING (capture_id, category) WINDOW w AS (PARTITION BY capture_id)),
l AS (SELECT capture_id, category, {_R.format('CASE WHEN p0 > 0.005 THEN pb / p0 ELSE 1.0 END::DOUBLE')} AS lift FROM q) SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY lift DESC, category) AS rank, category, lift FROM l WHERE category NOT IN ('nav', 'self_surv', 'presence', 'notif_seen')"""),
    "finding_ad_gap": (G.ad_gap, (), f"""{BASE}, {_sub(f'category IN {_ADS}', 's0')}, {_least('s0', 's', 'count(*) >= 50', "count(*) FILTER (category = 'ad') >= 3")}, a AS (SELECT capture_id, pos, category = 'ad' AS ad, unnest(range(1, 11)) AS k FROM s),
j AS (SELECT a.capture_id, a.k, count(*) FILTER (ad) AS n, count(*) FILTER (ad AND s.category IN {_ACT}) AS n1, count(*) AS m, count(*) FILTER (s.category IN {_ACT}) AS m1 FROM a JOIN s ON s.capture_id = a.capture_id AND s.pos = a.pos + a.k GROUP BY ALL),
c AS (SELECT capture_id, {_R.format('1 - product(1 - CASE WHEN n > 0 THEN n1 / n ELSE 0.0 END)')} AS after_ad, {_R.format('1 - product(1 - m1 / m)')} AS base FROM j GROUP BY capture_id), g AS (SELECT *, {_R.format('after_ad - base')} AS gap FROM c) SELECT capture_id, after_ad, base, gap, CASE WHEN gap > 0.02 THEN 'up' WHEN gap < -0.02 THEN 'down' ELSE 'flat' END AS direction FROM g"""),
}


_HOLDOUT = """sf AS (SELECT *, floor(nn * 0.8::DOUBLE)::BIGINT AS split FROM s), {} SELECT capture_id, count(*) AS n, count(*) FILTER (rank = 1) AS n_right, count(*) FILTER (rank <= 3) AS n_top3, count(*) FILTER (mode = nxt) AS n_mode FROM sc GROUP BY capture_id""".format(_score("pos + 1 < split", "pos >= split"))
PANELS |= {
    "hook_routes": (P.hook_routes, (), f"""{BASE}, {_HOOKS}, a AS (SELECT capture_id, pos AS ap, unnest(range(-5, 0)) AS o FROM s WHERE category IN {_ACT}) SELECT a.capture_id, coalesce(s.route, '') AS route, count(*) AS n FROM a JOIN s ON s.capture_id = a.capture_id AND s.pos = ap + o GROUP BY ALL"""),
    "hook_triggered": (P.triggered, ("label",), f"""{BASE}, {_HOOKS}, x AS (SELECT capture_id, 'category' AS kind, category AS name, count(*) AS n FROM s WHERE category IN {_ACT} GROUP BY ALL UNION ALL SELECT capture_id, 'label' AS kind, coalesce(label, '') AS name, count(*) AS n FROM s WHERE category IN {_ACT} GROUP BY ALL)
SELECT * FROM x QUALIFY kind = 'category' OR row_number() OVER (PARTITION BY capture_id, kind ORDER BY n DESC, name) <= 8"""),
    "telemetry_top_labels": (P.telemetry_labels, ("label",), f"""{BASE}, x AS (SELECT capture_id, coalesce(label, '') AS name, count(*) AS n FROM ev WHERE category = 'self_surv' GROUP BY ALL) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, name) <= 6"""),
    "telemetry_median_behaviour": (P.telemetry_median_behaviour, (), f"""SELECT capture_id, median(n_before) AS median FROM ({PANELS['telemetry_behaviour_30s'][2]}) GROUP BY capture_id"""),
    "coverage_by_category": (P.coverage_by_category, (), f"{BASE} SELECT capture_id, category, count(*) AS n FROM ev GROUP BY ALL"),
    "markov_category_holdout": (lambda ev: P.markov_holdout(ev, state="category"), (), f"{BASE}, {_predictable('category')}, {_HOLDOUT}"),
    "next_category_topk": (lambda ev: P.next_routes(ev, state="category"), (), PANELS["next_route_topk"][2].replace("coalesce(route, '') AS state", "coalesce(category, '') AS state")),
}
PANELS["prediction_summary"] = (P.prediction_summary, (), f"""SELECT r.capture_id, {_R.format('r.n_right / r.n')} AS route_accuracy, {_R.format('r.n_top3 / r.n')} AS route_top3_accuracy, {_R.format('r.n_mode / r.n')} AS baseline_accuracy, {_R.format('coalesce(c.n_right / c.n, 0)')} AS category_accuracy,
 {_R.format('coalesce(f.m, 0)')} AS cv_route_mean, {_R.format('coalesce(f.sd, 0)')} AS cv_route_sd, {_R.format('coalesce(f.b, 0)')} AS cv_baseline_mean, {_R.format('CASE WHEN r.n_mode > 0 THEN (r.n_right / r.n) / (r.n_mode / r.n) ELSE 0.0 END')} AS lift_over_baseline
FROM ({PANELS['markov_holdout_accuracy'][2]}) r LEFT JOIN ({PANELS['markov_category_holdout'][2]}) c USING (capture_id)
LEFT JOIN (SELECT capture_id, avg(n_right / n) AS m, stddev_samp(n_right / n) AS sd, avg(n_mode / n) AS b FROM ({PANELS['markov_cv'][2]}) GROUP BY capture_id) f USING (capture_id)""")
PANELS["finding_revision_shift"] = (G.revision_shift, (), f"""WITH r AS ({PANELS['rev_boundary_delta'][2]}),
p AS (SELECT capture_id, pos, avg(abs(n_after / greatest(all_after, 1) - n_before / greatest(all_before, 1))) AS s, max(rate_before) AS rb, max(rate_after) AS ra FROM r GROUP BY capture_id, pos)
SELECT capture_id, count(*) AS n_boundaries, {_R.format('avg(s)')} AS mean_shift, round(avg(CASE WHEN rb > 0 THEN (ra - rb) / rb * 100 ELSE 0.0 END), 3) + 0.0 AS mean_rate_change_pct FROM p GROUP BY capture_id""")


def _query(panel, extra: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return panel(canonical(spark, d, *extra))

    return run


QUERIES = {name: _query(panel, extra) for name, (panel, extra, _) in PANELS.items()}
ORACLE = {name: sql for name, (_, _, sql) in PANELS.items() if sql}
