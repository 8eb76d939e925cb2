"""Runs of repeated neighbouring events, collapsed by adjacent agglomeration.

Every event starts as a run of its own in a linked list.  A priority queue holds the borders between
neighbouring runs, most similar first (runs of one and the same label before all others), then the
shortest wait, then in a fixed shuffled order.  The best border is taken away, the two runs become
one, and its borders with the new neighbours are weighed anew and offered again; entries that speak
of runs as they were before are skipped.  This goes on until no border meets both limits.

Two runs are as similar as their least similar labels (complete linkage), so a run doesn't drift:
any two of its events are similar.  As runs grow a border can only get worse, which is what lets a
sequence be worked on in parts, exactly: a border that fails the limits once is final, and a border
that is better than both its neighbours is taken away whatever happens elsewhere.  Only runs whose
fate hangs, from border to better border, on the unknown side of a cut must wait for it.

Rows are range partitioned by (entity, time, tie) and sorted, so an entity with a third of all rows
is scanned in many tasks.  A batch carries the waiting runs at its end into the next one; those at
either end of a partition are put together, a few per partition, and agglomerated afterwards.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialise

GAP_US, SIMILARITY = 30_000_000, 1.0
Similarity = Callable[[tuple, tuple], float]
#: What a run waits for: the unknown left or right side; and whether it holds the first or last row of its partition.
LEFT, RIGHT, FIRST, LAST = 1, 2, 4, 8
#: Label pairs whose similarity a task remembers.
REMEMBERED = 200_000


def equal_labels(a: tuple, b: tuple) -> float:
    """1 for labels that are all known and the same, else 0."""
    return float(a == b and None not in a)


class Run:
    """Neighbouring events as one: ``kinds`` are their different labels, ``flags`` as above."""

    __slots__ = ("first", "start", "end", "n", "kinds", "flags")

    def __init__(self, first: int, start: int, end: int, n: int, kinds: tuple, flags: int = 0):
        self.first, self.start, self.end, self.n, self.kinds, self.flags = first, start, end, n, kinds, flags


class Linkage:
    """How similar two runs are: as their least similar labels."""

    def __init__(self, similarity: Similarity, least: float, gap: int):
        self.similarity, self.least, self.gap = similarity, least, gap
        self.known: dict[tuple, float] = {}

    def labels(self, a: tuple, b: tuple) -> float:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[a, b] = float(self.similarity(a, b))
        return found

    def runs(self, a: Run, b: Run) -> float:
        return min(self.labels(x, y) for x in a.kinds for y in b.kinds)

    def may_merge(self, a: Run, b: Run) -> bool:
        return b.start - a.end <= self.gap and self.runs(a, b) >= self.least


def _shuffled(tie: int) -> int:
    return (tie * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def agglomerate(runs: list[Run], link: Linkage) -> list[Run]:
    """The runs that are left, in order; runs that wait for an unknown side pass the waiting on."""
    n = len(runs)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    version = [0] * n  # -1 once merged into the run before
    queue: list[tuple] = []

    def offer(i: int) -> None:
        """The border between run ``i`` and the one after it."""
        j = right[i]
        if i < 0 or j >= n:
            return
        a, b = runs[i], runs[j]
        wait = b.start - a.end
        if wait <= link.gap and (alike := link.runs(a, b)) >= link.least:
            same = len(a.kinds) == 1 and a.kinds == b.kinds
            heapq.heappush(queue, (not same, -alike, wait, _shuffled(b.first), i, version[i], version[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        other, _, _, _, i, vi, vj = heapq.heappop(queue)
        j = right[i]
        if version[i] != vi or j >= n or version[j] != vj:
            continue
        a, b = runs[i], runs[j]
        waits = (a.flags | b.flags) & (LEFT | RIGHT)
        if other and waits:  # equal labels merge whatever comes; here a better border may come
            a.flags |= waits
            b.flags |= waits
            continue
        kinds = a.kinds if a.kinds == b.kinds else tuple(dict.fromkeys((*a.kinds, *b.kinds)))
        runs[i] = Run(a.first, a.start, b.end, a.n + b.n, kinds, a.flags | b.flags)
        version[i] += 1
        version[j] = -1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [r for r, v in zip(runs, version) if v >= 0]


class _Scan:
    """Runs of sorted rows (key, time, tie, labels...); those that wait at an end of the partition are edges."""

    def __init__(self, key_type: pa.DataType, link: Linkage, names: list[str]):
        self.link, self.names = link, names
        self.types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()]
        context = TaskContext.get()
        self.base = (context.partitionId() if context else 0) << 40
        self.no = 0

    def batch(self, key, runs: list[Run]) -> pa.RecordBatch:
        """``runs`` as rows; a waiting run is an edge, and joined if the run before it is one too."""
        rows, before = [], False
        for r in runs:
            edge = bool(r.flags & (LEFT | RIGHT))
            self.no += edge
            rows.append((key, r.first, r.start, r.end, r.n, pickle.dumps(r.kinds) if edge else None, r.flags if edge else None, self.base + self.no if edge else None, edge and before))
            before = edge
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.types)], self.names)

    def singles(self, keys: pa.Array, tie: np.ndarray, time: np.ndarray) -> pa.RecordBatch:
        n = len(tie)
        at = pa.array(time)
        return pa.RecordBatch.from_arrays([keys, pa.array(tie), at, at, pa.array(np.ones(n, np.int64)), *(pa.nulls(n, t) for t in self.types[5:8]), pa.array(np.zeros(n, bool))], self.names)

    def closed(self, key, carried: list[Run]) -> pa.RecordBatch:
        for r in carried:
            r.flags &= ~RIGHT
        return self.batch(key, agglomerate(carried, self.link))


def _stretches(code: np.ndarray, time: np.ndarray, labels: list[tuple], link: Linkage) -> np.ndarray:
    """Where stretches begin: before every border that fails the limits, and so is final."""
    number: dict[tuple, int] = {}
    kind = np.fromiter((number.setdefault(v, len(number)) for v in labels), np.int64, len(labels))
    names = list(number)
    may = (code[1:] == code[:-1]) & (time[1:] - time[:-1] <= link.gap)
    at = np.flatnonzero(may)
    pairs, which = np.unique(kind[at] * len(names) + kind[at + 1], return_inverse=True)
    fits = np.array([link.labels(names[p // len(names)], names[p % len(names)]) >= link.least for p in pairs.tolist()], bool)
    may[at] = fits[which]
    return np.flatnonzero(np.concatenate([[True], ~may]))


def _collapse(batches: Iterator[pa.RecordBatch], n_labels: int, link: Linkage, names: list[str], prepare) -> Iterator[pa.RecordBatch]:
    label_of = prepare() if prepare else (lambda columns: list(zip(*columns)))
    scan: _Scan | None = None
    entity, carried = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0)
        flags = 0
        if scan is None:
            scan, flags = _Scan(keys.type, link, names), LEFT | FIRST
        code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        time, tie = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        labels = label_of([b.column(3 + i).to_pylist() for i in range(n_labels)])
        starts = _stretches(code, time, labels, link)
        ends = np.append(starts[1:], len(time))
        single = (ends - starts == 1) & (np.arange(len(starts)) > 0) & (np.arange(len(starts)) < len(starts) - 1)
        yield scan.singles(keys.take(pa.array(starts[single])), tie[starts[single]], time[starts[single]])
        for k in np.flatnonzero(~single).tolist():
            lo, hi = int(starts[k]), int(ends[k])
            key = keys[lo].as_py()
            t, s = time[lo:hi].tolist(), tie[lo:hi].tolist()
            runs = [Run(s[i], t[i], t[i], 1, (labels[lo + i],)) for i in range(hi - lo)]
            runs[0].flags = flags
            flags = 0
            if carried:
                if entity == key and link.may_merge(carried[-1], runs[0]):
                    for r in carried:
                        r.flags &= ~RIGHT
                    runs = carried + runs
                else:
                    yield scan.closed(entity, carried)
                carried = []
            if hi < len(time):
                yield scan.batch(key, agglomerate(runs, link))
                continue
            runs[-1].flags |= RIGHT
            runs = agglomerate(runs, link)
            cut = next(i for i, r in enumerate(runs) if r.flags & RIGHT)
            if cut:
                yield scan.batch(key, runs[:cut])
            entity, carried = key, runs[cut:]
    if carried:
        carried[-1].flags |= LAST
        yield scan.batch(entity, carried)


def _join_edges(batches: Iterator[pa.RecordBatch], link: Linkage, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The edges of each entity in order, agglomerated where partitions touch."""
    key, chain, scan = None, [], None
    for b in batches:
        scan = scan or (_Scan(b.column(0).type, link, names) if b.num_rows else None)
        for entity, first, start, end, n, kinds, flags, _, joined in zip(*(c.to_pylist() for c in b.columns)):
            run = Run(first, start, end, n, pickle.loads(kinds), flags)
            if chain and not (entity == key and (joined or (run.flags & FIRST and chain[-1].flags & LAST))):
                yield scan.batch(key, _settled(chain, link))
                chain = []
            key = entity
            chain.append(run)
    if chain:
        yield scan.batch(key, _settled(chain, link))


def _settled(chain: list[Run], link: Linkage) -> list[Run]:
    for r in chain:
        r.flags = 0
    return agglomerate(chain, link)


def collapse_runs(df: DataFrame, entity: str, time_us: str, tie: str, labels: list[str], gap_us: int = GAP_US, similarity: Similarity = equal_labels, least: float = SIMILARITY, prepare=None) -> DataFrame:
    """(entity, first_<tie>, start_us, end_us, n_events): one row per run, runs of one event included.

    ``similarity`` compares two label tuples (1 is most similar, symmetric); runs merge while the
    least similar labels of both reach ``least`` and at most ``gap_us`` lie between them.  ``prepare``
    may give, once per task, a function from the label columns to one label tuple per row.  Rows with
    a null entity, time or tie are in no run; a null label makes an event unlike any other for
    :func:`equal_labels`; events at the same time follow ``tie``; an empty input has no runs.
    """
    src = df.select(F.col(entity), F.col(time_us).cast("bigint").alias("_t"), F.col(tie).cast("bigint").alias("_tie"), *(F.col(c).alias(f"_l{i}") for i, c in enumerate(labels)))
    src = materialise(src.where(F.col(entity).isNotNull() & F.col("_t").isNotNull() & F.col("_tie").isNotNull()), "events")
    kind = src.schema[entity].dataType.simpleString()
    first = f"first_{tie}"
    names = [entity, first, "start_us", "end_us", "n_events", "_kinds", "_flags", "_no", "_joined"]
    schema = f"`{entity}` {kind}, `{first}` bigint, start_us bigint, end_us bigint, n_events bigint, _kinds binary, _flags int, _no bigint, _joined boolean"
    ordered = src.repartitionByRange(entity, "_t", "_tie").sortWithinPartitions(entity, "_t", "_tie")
    n, link = len(labels), Linkage(similarity, least, gap_us)
    parts = materialise(ordered.mapInArrow(lambda it: _collapse(it, n, link, names, prepare), schema), "runs")
    edges = parts.where("_no is not null").repartition(entity).sortWithinPartitions(entity, "_no")  # some per partition
    joined = edges.mapInArrow(lambda it: _join_edges(it, link, names), schema)
    cols = [entity, first, "start_us", "end_us", "n_events"]
    return parts.where("_no is null").select(*cols).unionByName(joined.select(*cols))
