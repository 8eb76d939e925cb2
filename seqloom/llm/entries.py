"""Queries of the training-data problems over the stored tables, with their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import plain_route
from seqloom.llm.bpe import encode_corpus
from seqloom.llm.leakage import leaked
from seqloom.llm.operations import Operations, operation_names
from seqloom.llm.pieces import split_oversized
from seqloom.llm.runs import collapse_runs
from seqloom.llm.subsequences import frequent_subsequences, spelled
from seqloom.llm.vocabulary import marked_terms
from seqloom.operators.events import read_category, usable_events
from seqloom.plans.problems import EVENTS_SQL
from seqloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ev = usable_events(table(spark, d, "capture_events"), "category", "route").withColumn("route", plain_route("route")).where("route is not null")
    ev = read_category(ev, table(spark, d, "dim_category"), how="inner").withColumn("step", F.concat("category", F.lit("@"), "route"))
    return spelled(frequent_subsequences(ev, "capture_id", "ts_us", "seq", "step"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    ev = read_category(usable_events(table(spark, d, "capture_events"), "category", "friendly"), table(spark, d, "dim_category"))
    listed = operation_names(table(spark, d, "dim_operation"))

    def prepare():
        of = Operations(listed).of
        return lambda columns: [(c, of(n)) for c, n in zip(*columns)]

    return collapse_runs(ev, "capture_id", "ts_us", "seq", ["category", "friendly"], prepare=prepare)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("n_events >= 2").select("capture_id", "first_seq", "n_events", (F.col("end_us") - F.col("start_us")).alias("duration_us"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence with its runs collapsed, single events included."""
    return _runs(spark, d)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(usable_events(table(spark, d, "capture_events"), "friendly"), "friendly")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null")


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term, marked or not."""
    return _terms(spark, d).withColumn("mark", F.coalesce("mark", F.lit("")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents", "doc_id", "text", "layout"), table(spark, d, "eval_items", "item_id", "text"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Proximity matches: the words of a window in order, within four words more."""
    return leaked(table(spark, d, "documents", "doc_id", "text", "layout"), table(spark, d, "eval_items", "item_id", "text"), slack=4)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents", "doc_id", "text", "layout"), with_text=False).where("piece_no = 0").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return split_oversized(table(spark, d, "documents", "doc_id", "text", "layout"))


QUERIES = {f.__name__: f for f in (p2_found, p6_found, p6_collapsed, p7_found, p7_terms, p8_ids, p9_found, p9_near, p10_found, p10_pieces)}

_CAT = "regexp_replace(lower(trim({}, ' \t\n\r')), '[./:-]', '.')"
_OPS_SQL = """o AS (SELECT DISTINCT operation, regexp_replace(lower(operation), '[^a-z]', '', 'g') AS k FROM dim_operation),
n AS (SELECT DISTINCT friendly, regexp_replace(lower(friendly), '[^a-z]', '', 'g') AS k FROM e WHERE trim(friendly) <> ''),
w AS (SELECT n.friendly, coalesce(arg_min(o.operation, (-length(o.k), o.operation)), n.friendly) AS op FROM n LEFT JOIN o ON contains(n.k, o.k) GROUP BY n.friendly)"""
_RUNS_SQL = f"""WITH {EVENTS_SQL}, {_OPS_SQL},
s AS (SELECT e.capture_id, e.seq, e.ts_us, d.category, w.op FROM e LEFT JOIN dim_category d ON {_CAT.format('e.category')} = {_CAT.format('d.category')} LEFT JOIN w ON w.friendly = e.friendly),
b AS (SELECT *, CASE WHEN category = lag(category) OVER q AND op = lag(op) OVER q AND ts_us - lag(ts_us) OVER q <= 30000000 THEN 0 ELSE 1 END AS new FROM s WINDOW q AS (PARTITION BY capture_id ORDER BY ts_us, seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT capture_id, arg_min(seq, (ts_us, seq)) AS first_seq, """
_TERMS_SQL = f"""WITH {EVENTS_SQL},
n AS (SELECT row_number() OVER () AS r, friendly FROM e WHERE trim(friendly) <> ''),
t AS (SELECT r, lower(unnest(regexp_extract_all(friendly, '[A-Z]+[a-z]*|[a-z]+'))) AS term FROM n),
c AS (SELECT term, count(*) AS n_total, count(DISTINCT r) AS n_records FROM t GROUP BY term),
m AS (SELECT *, CASE WHEN n_records <= 3 THEN 'rare' WHEN n_records > 0.05 * (SELECT count(*) FROM n) THEN 'common' END AS mark FROM c)
"""


def _patterns_sql() -> str:
    """Level by level as tables of (capture, steps, place of the last step); only frequent patterns grow."""
    route = "trim(regexp_replace(trim(e.route), '[?#].*$', ''))"
    parts = [
        EVENTS_SQL,
        f"r AS (SELECT e.capture_id, d.category || '@' || {route} AS step, row_number() OVER (PARTITION BY e.capture_id ORDER BY e.ts_us, e.seq) AS pos FROM e JOIN dim_category d ON {_CAT.format('e.category')} = {_CAT.format('d.category')} WHERE e.route IS NOT NULL)",
        "nd AS (SELECT greatest(4, ceil(round(0.03::DOUBLE * count(DISTINCT capture_id), 9))) AS need FROM r)",
        "f1 AS (SELECT step FROM r GROUP BY step HAVING count(DISTINCT capture_id) >= (SELECT need FROM nd))",
        "l1 AS (SELECT capture_id, step AS s1, pos FROM r WHERE step IN (SELECT step FROM f1))",
    ]
    for k in range(2, 6):
        steps = [f"s{i}" for i in range(1, k)]
        known = f"WHERE ({', '.join(steps)}) IN (SELECT ({', '.join(steps)}) FROM f{k - 1})" if k > 2 else ""
        parts.append(f"l{k} AS (SELECT DISTINCT a.capture_id, {', '.join('a.' + x for x in steps)}, b.s1 AS s{k}, b.pos FROM (SELECT * FROM l{k - 1} {known}) a JOIN l1 b ON b.capture_id = a.capture_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 AND b.s1 NOT IN ({', '.join('a.' + x for x in steps)}))")
        every = ", ".join([*steps, f"s{k}"])
        parts.append(f"f{k} AS (SELECT {every}, count(DISTINCT capture_id) AS n_captures FROM l{k} GROUP BY {every} HAVING count(DISTINCT capture_id) >= (SELECT need FROM nd))")
    found = " UNION ALL ".join(f"SELECT concat_ws(' > ', {', '.join(f's{i}' for i in range(1, k + 1))}) AS pattern, n_captures FROM f{k}" for k in range(3, 6))
    return f"WITH {', '.join(parts)} {found}"


ORACLE = {
    "p2_found": _patterns_sql(),
    "p6_found": _RUNS_SQL + "count(*) AS n_events, max(ts_us) - min(ts_us) AS duration_us FROM r GROUP BY capture_id, run HAVING count(*) > 1",
    "p6_collapsed": _RUNS_SQL + "min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_events FROM r GROUP BY capture_id, run",
    "p7_found": _TERMS_SQL + "SELECT term, n_total, n_records, mark FROM m WHERE mark IS NOT NULL",
    "p7_terms": _TERMS_SQL + "SELECT term, n_total, n_records, coalesce(mark, '') AS mark FROM m",
}
