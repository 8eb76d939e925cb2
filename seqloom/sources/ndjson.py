"""Newline-delimited JSON of request blobs: reading, canonical events and what is set aside.

The same functions serve batch and streaming frames.  Only analytic fields are parsed; tokens are
never read, and the user id is hashed here with the caller's salt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.blobs import json_object
from seqloom.functions.labels import labelled
from seqloom.functions.rules import RULES, Rules, decoded_category
from seqloom.functions.text import base36, number, stripped
from seqloom.operators.ordered import numbered
from seqloom.operators.sequence import BLOCK, framed, keep_first
from seqloom.session import materialise

#: The fields that are read.
FIELDS = ("__type", "__kind", "__req", "__crn", "__spin_t", "__ts_wall", "__ccg", "__rev", "__user", "fb_api_req_friendly_name", "doc_id", "__url_path", "__latency_ms", "__response_size", "__relay_seq")
#: Values are cut to this many signs.
MOST_SIGNS = 300


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(capture_id, line_id, line) of text files; the file's path is the capture, ``line_id`` follows the file's order.

    A file may be read in several splits: a line's number is made of where its split begins, in MB, and
    of the row's number among those its task reads.
    """
    paths = [paths] if isinstance(paths, str) else paths
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line_id = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 20), 33).bitwiseOR(within)
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("capture_id"), line_id.alias("line_id"), F.col("value").alias("line"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files that land in a folder; the folder is the capture."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    return spark.readStream.text(path).select(folder.alias("capture_id"), F.lit(None).cast("bigint").alias("line_id"), F.col("value").alias("line"))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``m`` (null if broken) and ``outcome``: blank, broken, hello, rejected or event.

    Rejected are requests without a route or a readable time, and sensor records without a time.
    """
    m = json_object(line, FIELDS)
    df = lines.withColumn("m", m)
    kind = F.coalesce(F.col("m.__kind"), F.lit("request"))
    has = lambda f: F.coalesce(F.col(f"m.`{f}`") != "", F.lit(False))
    time = number(F.when(has("__spin_t"), F.col("m.__spin_t")).when(kind != "request", F.col("m.__ts_wall")))
    ok = time.isNotNull() & ((kind != "request") | has("__crn"))
    outcome = F.when(F.coalesce(stripped(line), F.lit("")) == "", "blank").when(F.col("m").isNull(), "broken").when(F.col("m.__type").eqNullSafe(F.lit("hello")), "hello").when(ok, "event").otherwise("rejected")
    return df.withColumns({"outcome": outcome, "_time": time, "_kind": kind})


def quarantine(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that give no event, with the reason; blank lines and hello frames aren't among them."""
    return parsed(lines, line).where(F.col("outcome").isin("broken", "rejected")).select(*lines.columns, "outcome")


def hashed(user: Column, salt: str) -> Column:
    """Twelve hex digits of the salted SHA-256; empty stays empty."""
    return F.when(F.coalesce(user, F.lit("")) == "", F.lit("")).otherwise(F.substring(F.sha2(F.concat(F.lit(salt), user), 256), 1, 12))


def canonical_blobs(lines: DataFrame, salt: str, rules: Rules = RULES, line: str = "line") -> DataFrame:
    """One canonical event per line that gives one, not yet ordered or deduplicated.

    Sensor records (``kind`` other than request) are presence events with request number 0, the kind
    as label and no name.
    """
    p = parsed(lines, line).where("outcome = 'event'")
    cut = lambda f: F.substring(F.col(f"m.`{f}`"), 1, MOST_SIGNS)
    sensor = F.col("_kind") != "request"
    name = F.when(~sensor, F.coalesce(cut("fb_api_req_friendly_name"), F.lit(""))).otherwise("")
    # names go to the decoder only where there is one, so that sensors and nameless requests stay in the JVM
    df = p.select(
        "capture_id", "line_id", F.round(F.col("_time") * 1e6).cast("bigint").alias("ts_us"), F.when(sensor, 0).otherwise(base36(F.col("m.__req"))).cast("bigint").alias("req"), F.coalesce(cut("__crn"), F.lit("")).alias("route"),
        name.alias("friendly"), F.coalesce(cut("__url_path"), F.lit("")).alias("url_path"), F.nullif(cut("__rev"), F.lit("")).alias("rev"), F.coalesce(F.nullif(cut("__ccg"), F.lit("")), F.lit("GOOD")).alias("ccg"),
        hashed(F.col("m.__user"), salt).alias("user_hash"), F.when(~sensor, F.coalesce(number(F.col("m.__latency_ms")), F.lit(0.0))).otherwise(0.0).alias("latency_ms"),
        F.when(~sensor, F.coalesce(F.col("m.__response_size").try_cast("bigint"), F.lit(0))).otherwise(0).cast("bigint").alias("response_size"), F.col("_kind").alias("kind"), F.col("m.__relay_seq").try_cast("bigint").alias("relay_seq"),
    )
    d = decoded_category(F.col("friendly"), F.col("url_path"), F.col("route"), rules)
    df = df.withColumn("_d", d)
    presence = F.col("kind") != "request"
    named = labelled(F.col("_d.rule_id"), F.col("url_path"), F.col("route"), F.col("kind"))
    df = df.withColumns({"category": F.when(presence, "presence").otherwise(F.col("_d.category")), "rule_id": F.when(~presence, F.col("_d.rule_id")), "decoded": ~presence & (F.col("_d.rule_id") >= 0), "_l": named})
    return df.withColumns({"label": F.col("_l.label"), "icon": F.col("_l.icon")}).drop("_d", "_l")


def ordered_events(events: DataFrame) -> DataFrame:
    """Deduplicated events with ``seq``: per capture by (time, request number, line).

    Of events with the same user, request number other than 0 and whole second the first stays; the
    route is no part of the key.
    """
    second = F.floor(F.col("ts_us") / 1_000_000).cast("bigint")
    kept = keep_first(events, ["capture_id", "user_hash", F.col("req"), second], ["ts_us", "req", "line_id"], F.col("req") != 0)
    return numbered(kept.withColumn("_tie", F.struct("req", "line_id")), "capture_id", "ts_us", "_tie", "seq").drop("_tie")


def _sent(time: np.ndarray, new: np.ndarray, sent: int | None, within: int) -> tuple[list[int], int | None]:
    """Which places of a block are sent, after one at time ``sent``, and when the last of them was."""
    kept = []
    for i, (t, first) in enumerate(zip(time.tolist(), new.tolist())):
        if first or sent is None or t - sent >= within:
            kept.append(i)
            sent = t
    return kept, sent


def _steps(time: np.ndarray, within: int) -> list[tuple[int, int]]:
    """When the last place of a block without a new message is sent, by what came before: (t, last), in
    rising order of t, tells it for an earlier time from the one before up to t - ``within``."""
    highest, records = None, []
    for i, t in enumerate(time.tolist()):
        if highest is None or t > highest:
            highest = t
            records.append(i)
    none = np.zeros(len(time), bool)
    out: list[tuple[int, int]] = []
    for i in records:  # the first place that is far enough from what came before is always one of these
        last = _sent(time[i:], none[i:], None, within)[1]
        if out and out[-1][1] == last:
            out[-1] = (int(time[i]), last)
        else:
            out.append((int(time[i]), last))
    return out


def source_repeats(events: DataFrame, within_us: int = 500_000) -> DataFrame:
    """The events in arrival order (``line_id``) without those that repeat the last one sent.

    A repeat has the route and name of the last event *sent* and came less than ``within_us`` after
    it.  Whether an event is sent depends on the one sent before, so blocks of places first tell how
    the time they leave behind follows from the time they are given: a block in which the message
    changes forgets it, for the others it is a short step function.  Runs of the latter, one entry
    for ``BLOCK`` places, are followed in order; then each block is settled where it lies.
    """
    pos = numbered(events, "capture_id", "line_id", "line_id")
    prev = framed(pos, 1, 0, _r=lambda w: F.lag("route").over(w), _f=lambda w: F.lag("friendly").over(w))
    new = (F.col("pos") == 0) | ~(F.col("route").eqNullSafe(F.col("_r")) & F.col("friendly").eqNullSafe(F.col("_f")))
    rows = prev.select("capture_id", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"), "pos", "ts_us", new.alias("new"))
    packed = rows.groupBy("capture_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "ts_us", "new"))).alias("r"))
    packed = packed.select("capture_id", "block", F.transform("r", lambda x: x["ts_us"]).alias("time"), F.transform("r", lambda x: x["new"]).alias("new"))
    packed = materialise(packed, "blocks")

    @F.pandas_udf("last bigint, steps array<struct<t:bigint,last:bigint>>")
    def outcome(time: pd.Series, new: pd.Series) -> pd.DataFrame:
        out = []
        for t, n in zip(time, new):
            t, n = np.asarray(t), np.asarray(n, bool)
            if n.any():
                at = int(np.flatnonzero(n)[-1])
                out.append((_sent(t[at:], n[at:], None, within_us)[1], None))
            else:
                out.append((None, [{"t": a, "last": b} for a, b in _steps(t, within_us)]))
        return pd.DataFrame(out, columns=["last", "steps"])

    @F.pandas_udf("array<int>")
    def settled(time: pd.Series, new: pd.Series, sent: pd.Series) -> pd.Series:
        return pd.Series([_sent(np.asarray(t), np.asarray(n, bool), None if pd.isna(s) else int(s), within_us)[0] for t, n, s in zip(time, new, sent)])

    told = packed.select("capture_id", "block", outcome("time", "new").alias("o")).select("capture_id", "block", "o.last", "o.steps")
    w = Window.partitionBy("capture_id").orderBy("block")
    runs = told.withColumn("run", F.sum(F.when(F.col("last").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("capture_id", "run").agg(F.sort_array(F.collect_list(F.struct("block", "last", "steps"))).alias("b"))
    after = lambda sent, steps: F.coalesce(F.get(F.filter(steps, lambda s: s["t"] >= sent + within_us), 0)["last"], sent)
    start = F.struct(F.lit(None).cast("bigint").alias("sent"), F.array().cast("array<struct<block:bigint,sent:bigint>>").alias("out"))
    step = lambda a, x: F.struct(F.coalesce(x["last"], after(a["sent"], x["steps"])).alias("sent"), F.concat(a["out"], F.array(F.struct((x["block"] + 1).alias("block"), F.coalesce(x["last"], after(a["sent"], x["steps"])).alias("sent")))).alias("out"))
    given = runs.select("capture_id", F.explode(F.aggregate("b", start, step)["out"]).alias("g")).select("capture_id", "g.block", "g.sent")
    kept = packed.join(given, ["capture_id", "block"], "left").select("capture_id", F.explode(settled("time", "new", "sent")).alias("i"), "block")
    kept = kept.select("capture_id", (F.col("block") * BLOCK + F.col("i")).alias("pos"))
    return pos.join(kept, ["capture_id", "pos"], "left_semi").drop("pos")
