"""Queries of the event and message problems over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import category_key, plain_user
from seqloom.operators.dedup import messages, split_copies
from seqloom.operators.events import usable_events
from seqloom.operators.features import feature_rows, feature_table
from seqloom.operators.late import corrected_periods, replay
from seqloom.operators.sessions import sessions, with_duration
from seqloom.session import broadcast_if_small
from seqloom.sources.tables import table


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    types = [r[0] for r in table(spark, d, "dim_category", "category").orderBy("category").collect()]  # fixed list of types
    place = F.array_position(F.array(*map(F.lit, types)), F.col("category")) - 1
    index = table(spark, d, "dim_category", "category").groupBy(category_key("category").alias("_ckey")).agg(F.min(place).alias("_k"))
    ev = usable_events(table(spark, d, "capture_events"), "category", "latency_ms").withColumn("_ckey", category_key("category"))
    ev = ev.join(broadcast_if_small(index), "_ckey", "left")
    return feature_table(ev, "capture_id", "_k", len(types), "ts_us", F.col("latency_ms")), types


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wide, types = _features(spark, d)
    return feature_rows(wide, "capture_id", types, "category")


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per capture: what the 218 categories add up to, cell by cell."""
    wide, _ = _features(spark, d)
    total = lambda f: F.aggregate(F.transform("cells", lambda c: c[f]), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return wide.select("capture_id", total("n").alias("n_events"), total("total").alias("latency_sum"), F.array_max(F.transform("cells", lambda c: c["last_us"])).alias("last_us"))


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The batch that landed last is new, all earlier ones are stored."""
    lines = table(spark, d, "relay_lines", "line_id", "batch_id", "capture_id", "line")
    new = F.col("batch_id").eqNullSafe(F.lit(lines.agg(F.max("batch_id")).head()[0]))
    return split_copies(messages(lines.where(new)), messages(lines.where(~new)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[1]


def p3_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message once: the line that stays."""
    return _copies(spark, d)[0]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ev = usable_events(table(spark, d, "capture_events"), "user_hash").select(plain_user("user_hash").alias("user_hash"), "ts_us")
    return sessions(ev)


def p4_durations(spark: SparkSession, d: str) -> DataFrame:
    return with_duration(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "capture_events")
    return corrected_periods(replay(usable_events(raw), raw.select("seq")))


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every period of the corrected table."""
    raw = table(spark, d, "capture_events")
    return replay(usable_events(raw), raw.select("seq")).counts()


QUERIES = {f.__name__: f for f in (p1_found, p1_features, p3_found, p3_messages, p4_found, p4_durations, p5_found, p5_periods)}

#: Usable events, one row per (capture_id, seq).
EVENTS_SQL = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, seq ORDER BY id) AS rn FROM capture_events WHERE capture_id IS NOT NULL AND seq IS NOT NULL)
 WHERE rn = 1 AND ts_us >= 1577836800000000 AND ts_us < 1893456000000000)"""
_CAT = "regexp_replace(lower(trim({}, ' \t\n\r')), '[./:-]', '.')"
_MESSAGES_SQL = """j AS (SELECT line_id, capture_id, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN line END AS o FROM relay_lines),
f AS (SELECT line_id, coalesce(trim(capture_id), '') AS cap, coalesce(trim(o->>'$.__type'), '') AS tp, coalesce(trim(o->>'$.__kind'), '') AS kd, coalesce(trim(o->>'$.__crn'), '') AS crn,
 coalesce(trim(o->>'$.__user'), '') AS usr, coalesce(trim(o->>'$.fb_api_req_friendly_name'), '') AS nm, floor(try_cast(trim(o->>'$.__spin_t') AS DECIMAL(38, 12)))::BIGINT AS sec, lower(trim(o->>'$.__req')) AS req FROM j WHERE o IS NOT NULL),
m AS (SELECT *, CASE WHEN regexp_full_match(req, '[0-9a-z]{1,12}') AND regexp_matches(req, '[^0]') THEN ltrim(req, '0') END AS r FROM f WHERE tp <> 'hello' AND kd IN ('', 'request') AND crn <> ''),
k AS (SELECT line_id, r, min(line_id) OVER (PARTITION BY cap, usr, crn, nm, sec, r) AS kept FROM m)"""
_SESSIONS_SQL = f"""WITH {EVENTS_SQL},
u AS (SELECT lower(trim(user_hash)) AS user_hash, ts_us FROM e WHERE trim(user_hash) <> ''),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_hash ORDER BY ts_us) <= 600000000 THEN 0 ELSE 1 END AS b FROM u),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_hash ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_hash, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_events{{}} FROM s GROUP BY user_hash, sid"""
_PERIODS_SQL = f"""WITH {EVENTS_SQL},
h AS (SELECT capture_id, ts_us, ts_us - ts_us % 900000000 AS period_us, max(ts_us) OVER (PARTITION BY capture_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e),
l AS (SELECT *, coalesce(high >= period_us + 900000000, false) AS late FROM h),
c AS (SELECT capture_id, period_us, count(*) AS n_final, count(*) FILTER (late) AS n_late FROM l WHERE NOT (late AND high - ts_us > 7200000000) GROUP BY capture_id, period_us)
"""
_P1_SQL = f"""WITH {EVENTS_SQL},
x AS (SELECT e.capture_id, d.category, e.ts_us, e.latency_ms FROM e {{}} JOIN dim_category d ON {_CAT.format('e.category')} = {_CAT.format('d.category')})
"""

ORACLE = {
    "p1_found": _P1_SQL.format("") + "SELECT capture_id, category, count(*) AS n_events, max(ts_us) AS last_us, coalesce(sum(CASE WHEN latency_ms > 0 THEN latency_ms END), 0)::BIGINT AS latency_sum FROM x GROUP BY capture_id, category",
    "p1_features": _P1_SQL.format("LEFT") + "SELECT capture_id, count(category) AS n_events, coalesce(sum(CASE WHEN category IS NOT NULL AND latency_ms > 0 THEN latency_ms END), 0)::BIGINT AS latency_sum, max(CASE WHEN category IS NOT NULL THEN ts_us END) AS last_us FROM x GROUP BY capture_id",
    "p3_found": f"WITH {_MESSAGES_SQL} SELECT kept AS line_id_kept, line_id AS line_id_dropped FROM k WHERE r IS NOT NULL AND line_id <> kept",
    "p3_messages": f"WITH {_MESSAGES_SQL} SELECT line_id FROM k WHERE r IS NULL OR line_id = kept",
    "p4_found": _SESSIONS_SQL.format(""),
    "p4_durations": _SESSIONS_SQL.format(", max(ts_us) - min(ts_us) AS duration_us"),
    "p5_found": _PERIODS_SQL + "SELECT capture_id, period_us, n_final FROM c WHERE n_late > 0",
    "p5_periods": _PERIODS_SQL + "SELECT capture_id, period_us, n_final, n_late FROM c",
}
