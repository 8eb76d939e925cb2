"""The operation behind a name, however the name is written."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

_NOT_LETTER = re.compile("[^A-Za-z]+")
#: Names a worker remembers.
REMEMBERED = 200_000


def letters(name: str) -> str:
    """Only the ASCII letters, in lower case."""
    return _NOT_LETTER.sub("", name).lower()


class Operations:
    """Finds the longest operation whose letters a name contains one after another.

    Names that are null or blank have none; other names without a listed operation are their own
    operation, as written.  Of two operations of equal length the first in order counts.
    """

    def __init__(self, names: list[str]):
        self.automaton = ahocorasick.Automaton()
        for name in sorted(set(names), reverse=True):
            if key := letters(name):
                self.automaton.add_word(key, (len(key), name))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known: dict[str | None, str | None] = {}

    def of(self, name: str | None) -> str | None:
        if name in self.known:
            return self.known[name]
        if name is None or not name.strip():
            found = None
        else:
            hits = [v for _, v in self.automaton.iter(letters(name))] if len(self.automaton) else []
            found = min(hits, key=lambda v: (-v[0], v[1]))[1] if hits else name
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[name] = found
        return found


def operation_names(dim_operation: DataFrame) -> list[str]:
    """The listed operations: a decoder's table of some hundred rows, the same at every scale."""
    return sorted(r[0] for r in dim_operation.select("operation").where("operation is not null").distinct().collect())
