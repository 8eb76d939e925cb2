"""Cells and outputs of notebooks that were written out as text.

``layout`` says how: ``ipynb`` (JSON), ``percent``, ``fenced`` or ``prompt``, the last three with
marker lines.  A null or unknown layout is told from the text; a text that doesn't fit its layout is
one segment.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: The marker lines of the written layouts.
PERCENT = re.compile(r"^# (?:%% (?:\[\w+\]|In\[[ \d]*\])|Out\[[ \d]*\]:)[ \t]*$", re.M)
PROMPT = re.compile(r"^(?:\[(?:md|raw|markdown) \d+\][ \t]*$|In \[[ \d]*\]:(?= |$)|Out\[[ \d]*\]:[ \t]*$)", re.M)
FENCED_CELL = re.compile(r"^<!-- cell \d+ -->[ \t]*$", re.M)
FENCE = re.compile(r"^```[^\n`]*$", re.M)
JSON_MARK = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:]', re.S)


def layout_of(text: str, layout: str | None) -> str:
    """The layout, told from the text where it isn't one of the four."""
    if layout in ("ipynb", "percent", "fenced", "prompt"):
        return layout
    head = text[:200].lstrip("\ufeff \t\r\n").replace("\r\n", "\n").replace("\r", "\n")
    for name, marker in (("percent", PERCENT), ("prompt", PROMPT), ("fenced", FENCED_CELL)):
        if marker.match(head):
            return name
    return "ipynb" if head.startswith("{") else ""


def _strings(value) -> Iterator[str]:
    """Each decoded string of an output; the parts of one list belong together."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        if all(isinstance(v, str) for v in value):
            yield "".join(value)
        else:
            for v in value:
                yield from _strings(v)
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)


def _json_segments(text: str) -> list[str] | None:
    try:
        book = json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    cells = book.get("cells") if isinstance(book, dict) else None
    if not isinstance(cells, list):
        return None
    out = []
    for cell in cells:
        if not isinstance(cell, dict):
            continue
        out.append("\n".join(_strings(cell.get("source"))))
        outputs = cell.get("outputs")
        for o in outputs if isinstance(outputs, list) else ():
            if isinstance(o, dict):
                trace = o.get("traceback")
                parts = [*_strings(o.get("text")), *_strings(o.get("data"))]
                if isinstance(trace, list):
                    parts += [t for t in trace if isinstance(t, str)]
                out.append("\n".join(parts))
    return out


def segments(text: str, layout: str | None) -> list[str]:
    """The source of each cell and each of its outputs, as text of its own."""
    kind = layout_of(text, layout)
    if kind == "ipynb":
        found = _json_segments(text)
        return [text] if found is None else found
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("﻿"):
        text = text[1:]
    if kind == "percent":
        return PERCENT.split(text)
    if kind == "prompt":
        return PROMPT.split(text)
    if kind == "fenced":
        out = []
        for cell in FENCED_CELL.split(text):
            # a cell that begins with a fence is code, its fences are source and outputs; others are prose
            out += FENCE.split(cell) if cell.lstrip().startswith("```") else [cell]
        return out
    return [text]


def _json_boundaries(text: str) -> list[int]:
    """Where each object in ``cells`` and each object in a cell's ``outputs`` begins, whatever the order of keys."""
    out: list[int] = []
    open_: list[list] = []  # bracket and latest key of each level
    string = ""
    for m in JSON_MARK.finditer(text):
        sign = text[m.start()]
        if sign == '"':
            string = m[0]
        elif sign == ":":
            if open_:
                open_[-1][1] = string
        elif sign in "}]":
            if open_:
                open_.pop()
        else:
            if sign == "{" and len(open_) in (2, 4) and open_[0][1] == '"cells"' and open_[-1][0] == "[" and (len(open_) == 2 or open_[2][1] == '"outputs"'):
                out.append(m.start())
            open_.append([sign, None])
    return out


def _fenced_boundaries(text: str) -> list[int]:
    """Where each cell begins and, after the source of a code cell, each fence that opens an output."""
    marks = list(FENCED_CELL.finditer(text))
    out: list[int] = []
    for i, m in enumerate(marks):
        out.append(m.start())
        end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        if text[m.end() : end].lstrip().startswith("```"):
            out += [f.start() for f in FENCE.finditer(text, m.end(), end)][2::2]
    return out


def boundaries(text: str, layout: str | None) -> list[int]:
    """Offsets in the text at which a cell or one of its outputs begins, in order."""
    kind = layout_of(text, layout)
    if kind == "ipynb":
        return _json_boundaries(text)
    if "\r" in text:
        text = text.replace("\r\n", " \n").replace("\r", "\n")  # same length
    if kind == "fenced":
        return _fenced_boundaries(text)
    marker = {"percent": PERCENT, "prompt": PROMPT}.get(kind)
    return [m.start() for m in marker.finditer(text)] if marker else []
