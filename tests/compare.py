"""Run a query beside its SQL: python -m tests.compare FOLDER NAME...

A query without SQL fails, unless ``BY_HAND`` names the test that checks it otherwise.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb


#: Queries that SQL can't express or is too slow for, and what checks them: brute force, hand-computed cases or round trips.
BY_HAND = {
    "cluster_regex_proposals": "tests/test_ingest.py::test_merging_in_rounds_against_one_at_a_time",
    "p8_ids": "tests/llm/test_bpe.py::test_corpus",
    "p9_found": "tests/llm/test_leakage.py::test_index_against_brute_force",
    "p9_near": "tests/llm/test_leakage.py::test_index_against_brute_force",
    "p10_found": "tests/llm/test_pieces.py::test_pieces",
    "p10_pieces": "tests/llm/test_pieces.py::test_pieces",
}


def covered(name: str) -> bool:
    """Whether the test that stands for a query without SQL is there."""
    file, _, test = BY_HAND.get(name, "").partition("::")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), file)
    if not file or not os.path.isfile(path):
        return False
    with open(path) as f:
        return f"def {test}(" in f.read()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    return str(v)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, folder: str, name: str, query, sql: str | None, con=None) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return covered(name), f"{name}: {len(got)} rows, no SQL, checked by {BY_HAND.get(name, 'nothing')}, {took:.1f} s"
    cur = (con or connect(folder)).execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {c[0]: str(c[1]).lower() for c in cur.description}
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(cols)}"
    same = got == want
    diff = "" if same else f"\n  only Spark: {[r for r in got if r not in set(want)][:3]}\n  only SQL: {[r for r in want if r not in set(got)][:3]}"
    odd = [f"{c}: {types[c]}/{duck[c]}" for c in types if {types[c], duck[c]} not in ({"bigint"}, {"double"}, {"int", "integer"}, {"string", "varchar"}, {"boolean"}, {"array<int>", "integer[]"}, {"timestamp", "timestamp with time zone"}, {"timestamp_ntz", "timestamp"})]
    return same and not odd, f"{name}: {'ok' if same else 'DIFFERENT'}, {len(got)} rows against {len(want)}, {took:.1f} s{' TYPES ' + str(odd) if odd else ''}{diff}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from seqloom.session import build_session

    session = build_session("8", 8)
    con = connect(sys.argv[1])
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in [n for n in qs if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]:
        try:
            ok, text = compare(session, sys.argv[1], n, qs[n], sqls.get(n), con)
        except Exception as e:
            ok, text = False, f"{n}: {type(e).__name__} {str(e)[:1500]}"
        bad += not ok
        print("" if ok else "FAIL ", text, flush=True)
    sys.exit(bool(bad))
