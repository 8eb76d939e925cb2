"""Frequent ordered patterns with gaps, level by level.

Patterns of k + 1 steps are made by joining frequent patterns of k steps that overlap in k - 1; with
a limit on the gap between steps only the patterns without their first or last step must be frequent
too, so nothing else is pruned.  Of two steps every ordered pair of frequent steps is a candidate:
their tree is complete, so it is known by its formula and never written out.  The candidates are
broadcast as a hash tree, in blocks of a bounded size, and counted in every sequence; matches of all
candidates of a block run together: for each position the set of tree nodes that some gapped match
reaches there.

Steps, candidates and frequent patterns are tables; the driver holds one block's tree at a time.
Sequences are cut into chunks that repeat the places a match may run over, so that a capture with a
third of all rows is many small rows.  Support counts captures, not matches: captures of one chunk
are counted where they lie, captures of several chunks by distinct (pattern, capture) pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.bpe import HashTable
from seqloom.operators.ordered import numbered
from seqloom.session import broadcast_if_small, materialise

MAX_GAP, MIN_STEPS, MAX_STEPS = 4, 3, 5
MIN_SHARE, MIN_CAPTURES = 0.03, 4
#: Places of a sequence in one chunk, without the repeated ones.
CHUNK = 4096
#: Candidates in one broadcast hash tree; more of them are counted in several passes.
TREE_CANDIDATES = 500_000
#: Places that are matched together.
PLACES = 1 << 20


class Tree:
    """Candidates of ``depth`` steps: nodes and their children by step, found for whole arrays."""

    depth: int
    nodes: int

    def first(self, step: np.ndarray) -> np.ndarray:
        """The node of each first step, -1 for none."""
        raise NotImplementedError

    def child(self, node: np.ndarray, step: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def number(self, node: np.ndarray) -> np.ndarray:
        """The number of the candidate that ends at a node."""
        raise NotImplementedError

    def matches(self, steps: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, candidate) of every candidate that occurs, once per owner.

        ``steps`` holds sequences one after another, with -1 for other steps and at least ``MAX_GAP``
        of them between two sequences.
        """
        at = np.flatnonzero(steps >= 0)
        node = self.first(steps[at])
        at, node = at[node >= 0], node[node >= 0]
        for _ in range(1, self.depth):
            next_at, next_node = [], []
            for gap in range(1, MAX_GAP + 1):
                inside = at + gap < len(steps)
                to, base = at[inside] + gap, node[inside]
                some = steps[to] >= 0
                to, base = to[some], base[some]
                child = self.child(base, steps[to])
                hit = child >= 0
                next_at.append(to[hit])
                next_node.append(child[hit])
            state = np.unique(np.concatenate(next_at) * self.nodes + np.concatenate(next_node))
            at, node = state // self.nodes, state % self.nodes
        pair = np.unique(owner[at] * self.nodes + node)
        return pair // self.nodes, self.number(pair % self.nodes)


class PairTree(Tree):
    """The complete tree of two different steps; pair (a, b) has the number a * n_steps + b."""

    def __init__(self, n_steps: int):
        self.depth, self.n_steps, self.nodes = 2, n_steps, n_steps + n_steps * n_steps

    def first(self, step: np.ndarray) -> np.ndarray:
        return step

    def child(self, node: np.ndarray, step: np.ndarray) -> np.ndarray:
        return np.where(node == step, -1, self.n_steps + node * self.n_steps + step)

    def number(self, node: np.ndarray) -> np.ndarray:
        return node - self.n_steps


class HashTree(Tree):
    """Candidates of equal length as one hash map (node, step) -> node; leaves carry the candidate's number."""

    def __init__(self, candidates: np.ndarray, n_steps: int):
        self.depth, self.n_steps, self.candidates = candidates.shape[1], n_steps, candidates
        node = np.zeros(len(candidates), np.int64)
        keys, values, total = [], [], 1
        for level in range(self.depth):
            key = node * n_steps + candidates[:, level]
            found, inverse = np.unique(key, return_inverse=True)
            keys.append(found)
            values.append(np.arange(total, total + len(found)))
            node = total + inverse
            total += len(found)
        self.leaf = np.full(total, -1, np.int64)
        self.leaf[node] = np.arange(len(candidates))
        self.table, self.nodes = HashTable(np.concatenate(keys), np.concatenate(values).astype(np.int32)), total

    def first(self, step: np.ndarray) -> np.ndarray:
        return self.table.get(step).astype(np.int64)

    def child(self, node: np.ndarray, step: np.ndarray) -> np.ndarray:
        return self.table.get(node * self.n_steps + step).astype(np.int64)

    def number(self, node: np.ndarray) -> np.ndarray:
        return self.leaf[node]


def _laid_out(steps: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a batch in one array with gaps of -1 between them, and the chunk of each place."""
    offsets = steps.offsets.to_numpy()
    values = steps.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size + MAX_GAP)
    out = np.full(len(owner), -1, np.int64)
    shift = np.repeat(np.arange(len(size)) * MAX_GAP - offsets[0], size)
    out[np.arange(offsets[0], offsets[-1]) + shift] = values[offsets[0] : offsets[-1]]
    return out, owner


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of chunks in parts of about ``PLACES`` places."""
    offsets = b.column(1).offsets.to_numpy()
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PLACES, side="right")) - 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def _count(chunks: DataFrame, shared) -> DataFrame:
    """(code, n): in how many captures each candidate of the broadcast tree occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in (part for whole in batches if whole.num_rows for part in _slices(whole)):
            steps, owner = _laid_out(b.column(1))
            row, code = tree.matches(steps, owner)
            single = b.column(0).is_null().to_numpy(zero_copy_only=False)[row]
            codes, n = np.unique(code[single], return_counts=True)
            captures = b.column(0).take(pa.array(row[~single]))
            columns = [np.concatenate([codes, code[~single]]), np.concatenate([n, np.zeros(len(captures), np.int64)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.concat_arrays([pa.nulls(len(codes), captures.type), captures])], ["code", "n", "cap"])

    found = chunks.select("cap", "steps").mapInArrow(run, "code bigint, n bigint, cap string")
    # one row per (code, capture) of the captures in several chunks; the others are partial counts
    once = found.groupBy("code", "cap").agg(F.sum("n").alias("n"))
    return once.groupBy("code").agg(F.sum(F.when(F.col("cap").isNull(), F.col("n")).otherwise(1)).cast("bigint").alias("n"))


_LEVEL = "p array<int>, n bigint"


def _frequent(chunks: DataFrame, tree: Tree, need: int) -> DataFrame:
    """(p, n) of the tree's candidates that enough captures have."""
    shared = chunks.sparkSession.sparkContext.broadcast(tree)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            code = b.column(0).to_numpy()
            p = tree.candidates[code] if isinstance(tree, HashTree) else np.stack([code // tree.n_steps, code % tree.n_steps], axis=1)
            flat = pa.array(p.astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * tree.depth), flat), b.column(1)], ["p", "n"])

    found = materialise(_count(chunks, shared).where(F.col("n") >= need).mapInArrow(spell, _LEVEL), "level")
    shared.unpersist()
    return found


def _candidates(level: DataFrame, k: int) -> DataFrame:
    """(p): a frequent pattern of ``k`` steps and the last step of one that goes on where it ends, all different."""
    a = level.select(F.col("p").alias("a"), F.slice("p", 2, k - 1).alias("common"))
    b = level.select(F.element_at("p", -1).alias("last"), F.slice("p", 1, k - 1).alias("common"))
    return a.join(b, "common").where(~F.array_contains("a", F.col("last"))).select(F.concat("a", F.array("last")).alias("p"))


def _next_level(chunks: DataFrame, level: DataFrame, k: int, n_steps: int, need: int) -> DataFrame | None:
    """The frequent patterns of ``k`` + 1 steps, counted block by block."""
    candidates = materialise(_candidates(level, k), "candidates")
    n_blocks = -(-candidates.count() // TREE_CANDIDATES)
    out: DataFrame | None = None
    for block in range(n_blocks):
        rows = candidates.where(F.pmod(F.xxhash64("p"), F.lit(n_blocks)) == block).toArrow().column("p").combine_chunks()
        if len(rows):
            p = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, k + 1)
            found = _frequent(chunks, HashTree(p, n_steps), need)
            out = found if out is None else out.unionByName(found)
    return out


def frequent_subsequences(df: DataFrame, sequence: str, time_us: str, tie: str, step: str, min_share: float = MIN_SHARE, min_captures: int = MIN_CAPTURES, min_steps: int = MIN_STEPS, max_steps: int = MAX_STEPS) -> DataFrame:
    """(steps array<string>, n_captures) of the patterns had by enough sequences.

    A pattern's steps are all different and each stands at most ``MAX_GAP`` places after the one
    before.  Enough is ``min_share`` of the sequences with at least one row, rounded up, and at least
    ``min_captures``.  Rows with a null sequence, time or step are no part of it; repeated rows are
    places of their own; an empty input has no patterns.
    """
    src = df.select(F.col(sequence).alias("seqkey"), F.col(time_us).alias("t"), F.col(tie).alias("tie"), F.col(step).alias("step")).where("seqkey is not null and step is not null and t is not null")
    rows = numbered(src, "seqkey", "t", "tie").select("seqkey", "pos", "step")
    total = rows.where("pos = 0").count()
    need = max(min_captures, math.ceil(round(min_share * total, 9)))
    had = rows.groupBy("step", "seqkey").agg(F.lit(1).alias("x")).groupBy("step").count().where(F.col("count") >= need)
    number = materialise(numbered(had.select(F.lit(0).alias("all"), "step"), "all", "step", "step", "k").select("step", "k"), "steps")
    n_steps = number.count()
    levels: list[DataFrame] = []
    if n_steps:
        chunks = materialise(_chunks(rows, number, (max_steps - 1) * MAX_GAP), "chunks")
        level = _frequent(chunks, PairTree(n_steps), need)
        for k in range(2, max_steps + 1):
            if level is None:
                break
            if k >= min_steps:
                levels.append(level)
            level = _next_level(chunks, level, k, n_steps, need) if k < max_steps else None
    if not levels:
        return df.sparkSession.createDataFrame([], "steps array<string>, n_captures bigint")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    each = found.select("p", "n", F.posexplode("p").alias("i", "k")).join(broadcast_if_small(number), "k")
    named = each.groupBy("p", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "step"))), lambda x: x["step"]).alias("steps"))
    return named.select("steps", F.col("n").alias("n_captures"))


def _chunks(rows: DataFrame, number: DataFrame, overlap: int) -> DataFrame:
    """(cap, steps): chunks of ``CHUNK`` places and the ``overlap`` after them, -1 for rare steps.

    ``cap`` names the sequence where it has several chunks and is null where it has one.
    """
    coded = rows.join(broadcast_if_small(number), "step", "left").select("seqkey", "pos", F.coalesce("k", F.lit(-1)).alias("k"))
    chunk = F.floor(F.col("pos") / CHUNK).cast("bigint")
    homes = F.when((F.pmod(F.col("pos"), F.lit(CHUNK)) < overlap) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    spread = coded.select("seqkey", "pos", "k", F.explode(homes).alias("chunk"))
    packed = spread.groupBy("seqkey", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "k"))).alias("rows"), F.max("pos").alias("top"))
    last = packed.groupBy("seqkey").agg(F.max("chunk").alias("_last"))
    return packed.join(last, "seqkey").select(F.when(F.col("_last") > 0, F.col("seqkey").cast("string")).alias("cap"), F.transform("rows", lambda r: r["k"]).alias("steps"))


def spelled(patterns: DataFrame) -> DataFrame:
    """(pattern, n_captures) with the steps written one after another."""
    return patterns.select(F.array_join("steps", " > ").alias("pattern"), "n_captures")
