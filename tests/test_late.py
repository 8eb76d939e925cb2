import pathlib
import random

import pytest

from seqloom.operators import late
from seqloom.operators.late import PeriodStore, corrected_periods, replay

SCHEMA = "capture_id string, block bigint, seq bigint, ts_us bigint, _local bigint, late string"
P, C = 100, 300


def brute(rows, P=P, C=C):
    counts: dict = {}
    high: dict = {}
    for cap, _, _seq, t, *_ in sorted(rows, key=lambda r: (r[0], r[2])):
        h = high.get(cap)
        period = t - t % P
        late = h is not None and h >= period + P
        if not (late and h - t > C):
            n, k = counts.get((cap, period), (0, 0))
            counts[cap, period] = (n + 1, k + late)
        high[cap] = t if h is None else max(h, t)
    return {(c, p, n) for (c, p), (n, k) in counts.items() if k}, {(c, p, n, k) for (c, p), (n, k) in counts.items()}


def make(rng, n=1500):
    return [(cap, s // 16, s, max(0, s * 10 - rng.choice([0, 0, 0, 5, 150, 290, 310, 900])), 1, "x") for cap in ("hot", "b", "c") for s in range(n if cap == "hot" else 90)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_against_brute_force(spark, batches):
    rows = make(random.Random(batches))
    df = spark.createDataFrame(rows, SCHEMA)
    store = replay(df, n_batches=batches, period_us=P, cutoff_us=C, part_us=10 * P)
    corrected, every = brute(rows)
    assert set(map(tuple, corrected_periods(store).collect())) == corrected
    assert set(map(tuple, store.counts().collect())) == every


def test_a_failed_batch_leaves_the_old_tables(spark, monkeypatch):
    rows = make(random.Random(9), 200)
    df = spark.createDataFrame(rows, SCHEMA)
    store = PeriodStore(spark, period_us=P, cutoff_us=C, part_us=10 * P)
    store.add(df.where("seq < 60"))
    before = set(map(tuple, store.counts().collect()))
    with monkeypatch.context() as m:
        m.setattr(PeriodStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.add(df.where("seq >= 60"))
    assert set(map(tuple, store.counts().collect())) == before
    store.add(df.where("seq >= 60"))
    assert set(map(tuple, store.counts().collect())) == brute(rows)[1]


def test_other_limits_from_the_retained_records(spark):
    rows = make(random.Random(4))
    store = replay(spark.createDataFrame(rows, SCHEMA), n_batches=3, period_us=P, cutoff_us=C, part_us=10 * P)
    assert brute(rows)[1] != brute(rows, P, 1000)[1]
    for period, cutoff in ((P, 1000), (P, 0), (50, C), (400, 20)):
        assert set(map(tuple, store.recount(period, cutoff).collect())) == brute(rows, period, cutoff)[1]
    assert set(map(tuple, store.counts().collect())) == brute(rows)[1]


def test_batches_open_what_they_touch(spark, monkeypatch):
    """Untouched partitions keep their tables, and raw records don't pile up in ever more places."""
    monkeypatch.setattr(late, "PIECES", 3)
    rows = [("a", 0, s, 5000 + s, 1, "x") for s in range(40)] + [("b", 0, s, s % 2 * 9000, 1, "x") for s in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    store = PeriodStore(spark, period_us=P, cutoff_us=C, part_us=10 * P)
    for b in range(5):
        store.add(df.where((df.seq >= 8 * b) & (df.seq < 8 * b + 8)))
        if b == 1:
            first = store.manifest()["parts"]["0"]
    parts = store.manifest()["parts"]
    assert parts["0"]["counts"] == first["counts"] and all(len(p["raw"]) <= 5 for p in parts.values()) and len(parts["5"]["raw"]) < 3
    assert set(map(tuple, store.counts().collect())) == brute(rows)[1] == set(map(tuple, store.recount().collect()))
    written = {int(f.name.removeprefix("batch=")) for f in pathlib.Path(store.path.removeprefix("file://"), "counts").glob("batch=*") if list(f.glob("part=5"))}
    assert len(written) <= 2  # the current one and the one before
    with pytest.raises(ValueError):
        PeriodStore(spark, period_us=7, part_us=10)


def test_empty(spark):
    store = replay(spark.createDataFrame([], SCHEMA))
    assert store.counts().count() == 0
