import json
import random

import pytest

from seqloom.operators import dedup
from seqloom.operators.dedup import messages, split_copies


def ident_of(cap, line):
    try:
        o = json.loads(line or "")
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    get = lambda k: "" if o.get(k) is None else str(o[k]).strip()
    if get("__type") == "hello" or get("__kind") not in ("", "request") or not get("__crn"):
        return None
    req = get("__req")
    try:
        second = str(int(float(get("__spin_t")) // 1))
    except ValueError:
        second = ""
    ok = req.isascii() and req.isalnum() and len(req) <= 12 and int(req, 36)
    return (cap or "", get("__user"), get("__crn"), get("fb_api_req_friendly_name"), second, int(req, 36)) if ok else ()


LINES = ["", None, "{bad", "[1,2]", "null", '{"__type":"hello","__crn":"x","__req":"1"}', '{"__kind":"input","__crn":"x","__req":"1"}', '{"__crn":" ","__req":"1"}', '{"__crn":"r"', '{"__crn":"r","__req":"1"} x', '{"__crn":"r","__req":"1"} {"b":2}', '{"__crn":"r","__req":"1"}}', '{"__crn":"r","__req":"1"},{"__crn":"r","__req":"1"}', "{'__crn':'r','__req':'1'}", '{"__crn":"r","__req":"1",}', '{"a":1}']


def random_lines(rng, n):
    for _ in range(n):
        o = {"__req": rng.choice(["1", " 1", "01", 1, "A", "a", "!", "", None, "0", "-3", "z" * 13]), "__crn": rng.choice(["r", "r ", "s"]), "__spin_t": rng.choice(["100", 100, 100.7, "100.9", "101", None, "x"]), "__user": rng.choice(["7", 7, "", None, " 7 "]), "fb_api_req_friendly_name": rng.choice(["N", "N ", "", None]), "__kind": rng.choice(["request", None, ""])}
        keys = list(o)
        rng.shuffle(keys)
        yield json.dumps({k: o[k] for k in keys if rng.random() < 0.95}, separators=rng.choice([(",", ":"), (", ", ": ")]))


@pytest.mark.parametrize("hot", [10_000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT_COPIES", hot)
    monkeypatch.setattr(dedup, "HOT_GROUPS", 2)
    rng = random.Random(hot)
    lines = [*LINES, *random_lines(rng, 1500), *['{"__req":"k","__crn":"hot","__spin_t":5}'] * 600]
    rows = [(i, rng.choice(["a", " a", "b", None]) if "hot" not in (x or "") else "a", x, "z") for i, x in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "line_id bigint, capture_id string, line string, ident string")
    groups: dict = {}
    alone = []
    for i, cap, line, _ in sorted(rows):
        key = ident_of((cap or "").strip(), line)
        if key is None:
            continue
        groups.setdefault(key, []).append(i) if key else alone.append(i)
    kept, dropped = split_copies(messages(df))
    assert sorted(r[0] for r in kept.collect()) == sorted(alone + [g[0] for g in groups.values()])
    assert sorted(map(tuple, dropped.collect())) == sorted((g[0], i) for g in groups.values() for i in g[1:])


def test_stored_and_new(spark):
    new = spark.createDataFrame([(10, b"a"), (11, b"b"), (12, None)], "line_id bigint, ident binary")
    stored = spark.createDataFrame([(1, b"a"), (2, None)], "line_id bigint, ident binary")
    kept, dropped = split_copies(new, stored)
    assert sorted(r[0] for r in kept.collect()) == [1, 2, 11, 12]
    assert [tuple(r) for r in dropped.collect()] == [(1, 10)]


@pytest.mark.parametrize("hot", [10_000, 2])
def test_a_row_id_that_repeats_stays_once(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT_COPIES", hot)
    rows = [(5, b"a"), (5, b"a"), (7, b"a"), (None, b"a"), (None, b"b"), (None, b"b"), (9, b"c")]
    kept, dropped = split_copies(spark.createDataFrame(rows[2:], "line_id bigint, ident binary"), spark.createDataFrame(rows[:2], "line_id bigint, ident binary"))
    assert sorted((r[0] for r in kept.collect()), key=str) == [5, 9, None]
    assert sorted(map(tuple, dropped.collect()), key=str) == sorted([(5, 5), (5, 7), (5, None), (None, None)], key=str)


def test_empty(spark):
    kept, dropped = split_copies(spark.createDataFrame([], "line_id bigint, ident binary"))
    assert kept.count() == dropped.count() == 0
