"""How often every distinct term occurs, and in how many records.

Each task counts its records in a burst trie: terms are routed by their first signs to small
containers, and a container that grows beyond ``BURST`` terms bursts into a node with one container
per next sign, so prefixes are as long as the terms at hand make them.  A trie that holds ``HELD``
terms is handed on and begun anew, which bounds the memory.

Tries are handed on as compact subtrees, one row per container: its prefix and its endings with
their counters.  A subtree goes to the worker of its route, the shortest prefix under which all tries
together have at most ``ROUTE_TERMS`` entries, so dense prefixes are shared out more finely; a
container that is less deep than the routes below it is cut into the parts that match them.  There
the matching subtrees of all workers are merged, container into container, and their counters add up.
A term that stands in every record is one entry per trie by then, so no term is hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialise

BURST, HELD = 512, 500_000
#: Entries of all tries together that are merged under one route.
ROUTE_TERMS = 50_000
RARE_RECORDS, COMMON_SHARE = 3, 0.05
#: The term under which tries count the records that have a text at all.
_ALL = ""

_PIECE = re.compile("[A-Z]+[a-z]*|[a-z]+")


def name_terms(text: str) -> list[str]:
    """Cut at every sign that isn't an ASCII letter and before every capital after a small letter; lower case."""
    return [p.lower() for p in _PIECE.findall(text)]


class BurstTrie:
    """Terms with two counters each; inner nodes are dicts by sign, leaves are containers by ending."""

    class Node:
        __slots__ = ("here", "next")

        def __init__(self) -> None:
            self.here: list[int] | None = None  # counters of the term that ends at this node
            self.next: dict[str, BurstTrie.Node | dict[str, list[int]]] = {}

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, self.Node(), 0

    def add(self, term: str, total: int, records: int) -> None:
        self._add(self.root, term, total, records)

    def _add(self, node: BurstTrie.Node, term: str, total: int, records: int) -> None:
        i = 0
        while i < len(term):
            child = node.next.get(term[i])
            if child is None:
                child = node.next[term[i]] = {}
            if isinstance(child, dict):
                self._into(node, term[i], [(term[i + 1 :], total, records)])
                return
            node, i = child, i + 1
        if node.here is None:
            node.here = [total, records]
            self.size += 1
        else:
            node.here[0] += total
            node.here[1] += records

    def _into(self, node: BurstTrie.Node, sign: str, entries: Iterable[tuple[str, int, int]]) -> None:
        """Add endings to the container below ``node``, which bursts if it gets too large."""
        container = node.next[sign]
        for ending, total, records in entries:
            counters = container.get(ending)
            if counters is None:
                container[ending] = [total, records]
                self.size += 1
            else:
                counters[0] += total
                counters[1] += records
        if len(container) > self.burst:
            node.next[sign] = self._burst(container)

    def merge(self, prefix: str, endings: list[str], totals: list[int], records: list[int]) -> None:
        """Merge a subtree where it belongs: into the container that holds its prefix, below the node that
        stands there, or as a container of its own."""
        node, i = self.root, 0
        while i < len(prefix):
            child = node.next.setdefault(prefix[i], {})
            if isinstance(child, dict):
                rest = prefix[i + 1 :]
                self._into(node, prefix[i], ((rest + e, n, r) for e, n, r in zip(endings, totals, records)))
                return
            node, i = child, i + 1
        for e, n, r in zip(endings, totals, records):
            self._add(node, e, n, r)

    def _burst(self, container: dict[str, list[int]]) -> BurstTrie.Node:
        node = self.Node()
        for ending, counters in container.items():
            if not ending:
                node.here = counters
            else:
                node.next.setdefault(ending[0], {})[ending[1:]] = counters
        return node

    def subtrees(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix, endings, totals, records) of each container in order; a term that ends at a node is one of its own."""
        stack: list[tuple[str, BurstTrie.Node | dict[str, list[int]]]] = [("", self.root)]
        while stack:
            prefix, tree = stack.pop()
            if isinstance(tree, dict):
                endings = sorted(tree)
                yield prefix, endings, [tree[e][0] for e in endings], [tree[e][1] for e in endings]
            else:
                if tree.here is not None:
                    yield prefix, [""], [tree.here[0]], [tree.here[1]]
                stack.extend((prefix + sign, tree.next[sign]) for sign in sorted(tree.next, reverse=True))


_SUBTREE = "prefix string, endings array<string>, totals array<bigint>, records array<bigint>"
_TYPES = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _subtree_rows(rows: list[tuple], *more: tuple[str, pa.DataType]) -> pa.RecordBatch:
    names, types = ["prefix", "endings", "totals", "records"], [*_TYPES]
    for name, kind in more:
        names, types = [*names, name], [*types, kind]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _in_batches(rows: Iterable[tuple], entries: int, *more: tuple[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if n >= entries:
            yield _subtree_rows(held, *more)
            held, n = [], 0
    if held:
        yield _subtree_rows(held, *more)


def _count(batches: Iterator[pa.RecordBatch], terms_of: Callable[[str], list[str]], burst: int, held: int) -> Iterator[pa.RecordBatch]:
    trie = BurstTrie(burst)
    for b in batches:
        counts = b.column(0).value_counts()  # a text that stands in many records is cut once a batch
        for text, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
            if text is None or not text.strip():
                continue
            trie.add(_ALL, n, n)
            for term, k in Counter(terms_of(text)).items():
                trie.add(term, k * n, n)
        if trie.size > held:
            yield from _in_batches(trie.subtrees(), 20_000)
            trie = BurstTrie(burst)
    yield from _in_batches(trie.subtrees(), 20_000)


def dense_prefixes(tries: DataFrame, most: int) -> set[str]:
    """The prefixes under which the tries together have more than ``most`` entries.

    Looked for sign by sign, below dense ones only; of each length there are fewer than entries / most.
    """
    dense: set[str] = set()
    level, n = [""], tries.agg(F.sum(F.size("endings"))).head()[0]
    if not n or n <= most:
        return dense
    while level:
        dense.update(level)
        k = len(level[0]) + 1
        below = tries.where(F.substring("prefix", 1, k - 1).isin([p for p in level]) | (F.length("prefix") < k - 1))
        deep = below.where(F.length("prefix") >= k).select(F.substring("prefix", 1, k).alias("p"), F.size("endings").cast("bigint").alias("n"))
        flat = below.where(F.length("prefix") < k).select(F.explode(F.transform("endings", lambda e: F.concat("prefix", e))).alias("term"))
        flat = flat.where(F.length("term") >= k).select(F.substring("term", 1, k).alias("p"), F.lit(1).cast("bigint").alias("n"))
        sums = deep.unionByName(flat).where(F.substring("p", 1, k - 1).isin(level)).groupBy("p").agg(F.sum("n").alias("n"))
        level = [r[0] for r in sums.where(F.col("n") > most).collect()]
    return dense


def _routed(batches: Iterator[pa.RecordBatch], dense: set[str]) -> Iterator[pa.RecordBatch]:
    """Subtrees with their route; one that several routes share is cut."""

    def route(term: str, at: int) -> str | None:
        """The shortest prefix from ``at`` signs on that isn't dense, if the term has one."""
        return next((term[:k] for k in range(at, len(term) + 1) if term[:k] not in dense), None)

    def rows() -> Iterator[tuple]:
        for b in batches:
            for prefix, endings, totals, records in zip(*(c.to_pylist() for c in b.columns)):
                whole = route(prefix, 0)
                if whole is not None:
                    yield prefix, endings, totals, records, whole
                    continue
                parts: dict[str, tuple[list, list, list]] = {}
                for e, n, r in zip(endings, totals, records):
                    term = prefix + e
                    found = route(term, len(prefix) + 1)
                    for column, v in zip(parts.setdefault(term if found is None else found, ([], [], [])), (e, n, r)):
                        column.append(v)
                for to, columns in parts.items():
                    yield prefix, *columns, to

    return _in_batches(rows(), 20_000, ("route", pa.string()))


def _merged(batches: Iterator[pa.RecordBatch], burst: int) -> Iterator[pa.RecordBatch]:
    """The terms of each route's merged subtrees, whose rows follow one another."""

    def terms(trie: BurstTrie) -> pa.RecordBatch:
        flat = [(prefix + e, n, r) for prefix, *columns in trie.subtrees() for e, n, r in zip(*columns)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.string(), pa.int64(), pa.int64()))], ["term", "n_total", "n_records"])

    trie, current = None, None
    for b in batches:
        for prefix, endings, totals, records, route in zip(*(c.to_pylist() for c in b.columns)):
            if trie is None or route != current:
                if trie is not None:
                    yield terms(trie)
                trie, current = BurstTrie(burst), route
            trie.merge(prefix, endings, totals, records)
    if trie is not None:
        yield terms(trie)


def term_counts(df: DataFrame, text: str, terms_of: Callable[[str], list[str]] = name_terms, burst: int = BURST, held: int = HELD, route_terms: int = ROUTE_TERMS) -> DataFrame:
    """(term, n_total, n_records) of every term; the row of the empty term counts the non-blank texts.

    Null and blank texts have no terms; repeated rows count each; an empty input has no rows.
    """
    tries = materialise(df.select(text).mapInArrow(lambda it: _count(it, terms_of, burst, held), _SUBTREE), "tries")
    dense = dense_prefixes(tries, route_terms)
    routed = tries.mapInArrow(lambda it: _routed(it, dense), f"{_SUBTREE}, route string")
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(lambda it: _merged(it, burst), "term string, n_total bigint, n_records bigint")


def marked_terms(df: DataFrame, text: str, rare: int = RARE_RECORDS, common: float = COMMON_SHARE, **kw) -> DataFrame:
    """(term, n_total, n_records, mark) of all terms: 'rare' up to ``rare`` records, else 'common' above
    ``common`` of the non-blank texts, else null."""
    counts = materialise(term_counts(df, text, **kw), "terms")
    everything = counts.where(F.col("term") == _ALL).agg(F.max("n_records")).head()[0] or 0
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > everything * common, "common")
    return counts.where(F.col("term") != _ALL).select("term", "n_total", "n_records", mark.alias("mark"))
