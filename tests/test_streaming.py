import json

from pyspark.sql import functions as F

from seqloom.operators.late import PeriodStore
from seqloom.streaming import live

BASE = 1_600_000_000


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"__req": q, "__crn": "r", "__spin_t": BASE + t, "__user": u, **({"__kind": k} if k else {})}) for t, q, u, k in rows))


def finish(df, spark, tmp_path, name, mode="append"):
    out: list = []
    q = live.start(df, lambda b, n: out.append([tuple(r) for r in b.collect()]), str(tmp_path / f"cp-{name}"), mode)
    q.awaitTermination(120)
    assert q.exception() is None
    return [r for b in out for r in b], out


ROWS = [(0, "a", "u", None), (0, "a", "u", None), (10, "0", "u", None), (10, "0", "u", None), (700, "b", "u", None), (5, None, "", "input")]


def test_dedup_counts_sessions(spark, tmp_path):
    land(tmp_path / "in", "1.ndjson", ROWS)
    land(tmp_path / "in", "2.ndjson", [(40_000, "z", "", None)])  # moves the watermark past all sessions
    ev = live.live_events(spark, str(tmp_path / "in"), "salt")
    rows, _ = finish(live.deduplicated(ev).select("req", "kind"), spark, tmp_path, "d")
    assert sorted(rows) == [(0, "input"), (0, "request"), (0, "request"), (10, "request"), (11, "request"), (35, "request")]
    rows, batches = finish(live.kind_counts(ev), spark, tmp_path, "k", "complete")
    assert sorted(batches[-1]) == [("input", 1), ("request", 6)]
    rows, _ = finish(live.live_sessions(live.deduplicated(ev)).select("n", F.unix_seconds("start")), spark, tmp_path, "s")
    assert sorted(rows) == [(1, BASE + 700), (3, BASE)]
    rows, _ = finish(live.minute_counts(ev), spark, tmp_path, "m")
    assert sum(r[2] for r in rows) == 6


def test_period_sink_takes_each_batch_once(spark, tmp_path):
    store = PeriodStore(spark, str(tmp_path / "store"))
    take = live.period_sink(store)
    us = BASE * 1_000_000
    df = spark.createDataFrame([("c", 0, us), ("c", 1, us + 2_000_000_000), ("c", 2, us + 5)], "capture_id string, seq bigint, ts_us bigint")
    take(df.where("seq < 2"), 0)
    take(df.where("seq < 2"), 0)
    take(df.where("seq = 2"), 1)
    rows = {tuple(r) for r in store.counts().collect()}
    assert sorted((n, k) for _, _, n, k in rows) == [(1, 0), (2, 1)]


def test_late_live_events_correct_their_period(spark, tmp_path):
    """What lands goes through the stream into the period store; a late line changes its period, one beyond the cut-off doesn't."""
    store = PeriodStore(spark, str(tmp_path / "store"))
    numbers = iter(range(1, 99))

    def landed(name, times):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"__req": "a", "__crn": "r", "__spin_t": BASE + t, "__relay_seq": next(numbers)}) for t in times))
        ev = live.live_events(spark, str(tmp_path / "in"), "salt").select("capture_id", "seq", "ts_us")
        q = live.start(ev, live.period_sink(store), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None

    landed("1.ndjson", [0, 1000, 2000])
    landed("2.ndjson", [100, 9000, 200])  # 100 is late, 200 too late
    rows = {r["period_us"]: (r["n_final"], r["n_late"]) for r in store.counts().collect()}
    period = lambda t: (BASE + t) // 900 * 900 * 1_000_000
    assert rows[period(0)] == (2, 1) and sum(n for n, _ in rows.values()) == 5
    assert store.counts().select("capture_id").distinct().count() == 1
