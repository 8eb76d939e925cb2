"""The canonical sequence that the panels read, from the stored events and their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import category_key, plain_route, plain_user
from seqloom.operators.events import usable_events
from seqloom.operators.ordered import numbered
from seqloom.session import broadcast_if_small
from seqloom.sources.tables import table

#: The twelve categories in their order, and their sets.
CATEGORIES = ["view", "act", "msg", "compose", "search", "hover", "react", "nav", "ad", "presence", "notif_seen", "self_surv"]
BEHAVIOUR = ["view", "act", "msg", "compose", "search", "hover", "react"]
ACTIONS = ["act", "compose", "msg", "react"]
SYSTEM = ["nav", "ad", "presence", "notif_seen", "self_surv"]
#: What an event that can't be read counts as.
UNKNOWN = "nav"


def canonical(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """(capture_id, seq, ts_us, category, route, surface, rev, user, latency_ms, *extra, pos).

    ``category`` is the family, ``surface`` is null for unknown routes, ``pos`` numbers a capture's
    usable events by (ts_us, seq).
    """
    ev = usable_events(table(spark, d, "capture_events"), "category", "route", "rev", "user_hash", "latency_ms", *extra)
    families = table(spark, d, "dim_category").groupBy(category_key("category").alias("_ckey")).agg(F.min("family").alias("_family"))
    routes = table(spark, d, "dim_route").groupBy(plain_route("route").alias("route")).agg(F.min("surface").alias("surface"))
    ev = ev.withColumns({"_ckey": category_key("category"), "route": plain_route("route"), "user": plain_user("user_hash")})
    ev = ev.join(broadcast_if_small(families), "_ckey", "left").join(broadcast_if_small(routes), "route", "left")
    ev = ev.withColumn("category", F.coalesce("_family", F.lit(UNKNOWN)))
    return numbered(ev.select("capture_id", "seq", "ts_us", "category", "route", "surface", "rev", "user", "latency_ms", *extra), "capture_id", "ts_us", "seq")
