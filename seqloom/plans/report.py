"""Reports as one self-contained HTML file, rendered on the driver from small aggregates.

Every value is escaped; nothing is fetched from anywhere.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import findings, panels
from seqloom.operators.compare import lift_deltas, summary_vector

#: Rows of a panel that a report shows; the tables themselves are complete.
SHOWN = 60
SECTIONS = {
    "Header": panels.header_stats, "Panels available": panels.panel_status, "Views around actions": findings.view_change, "Response envelope": panels.action_response, "Strongest pull": findings.strongest_pull, "Transitions": panels.transitions, "Route visits": panels.route_visits,
    "Rhythm": panels.rhythm_by_category, "Bursts": panels.bursts, "Dominant period": panels.dominant_period, "Hooks": findings.leading_hooks, "Hook tests": findings.tested_hooks, "Routes before actions": panels.hook_routes, "Actions": panels.triggered,
    "Hours": panels.diurnal, "Prediction": panels.prediction_summary, "Next routes": panels.next_routes, "Next categories": lambda ev: panels.next_routes(ev, state="category"), "Action soon": panels.action_probability,
    "Hover conversion": panels.hover_conversion, "Ads": findings.ad_gap, "Revisions": findings.revision_shift, "Survival": panels.survival_summary, "Survival curve": panels.survival_curve,
    "Telemetry": panels.telemetry_intervals, "Telemetry labels": panels.telemetry_labels, "Behaviour before telemetry": panels.telemetry_median_behaviour, "Anomalies": panels.anomalies, "Decoder coverage": panels.coverage, "Categories": panels.coverage_by_category,
}
#: Sections that are drawn as well: the columns that name a bar and give its length.
BARS = {"Hours": (["hour"], "n"), "Hooks": (["category"], "lift"), "Categories": (["category"], "n"), "Route visits": (["surface"], "n")}


def duration(seconds: float) -> str:
    """Seconds as s, m s, h m or d h."""
    s = int(seconds)
    if s < 60:
        return f"{s}s"
    if s < 3600:
        return f"{s // 60}m {s % 60}s"
    if s < 86400:
        return f"{s // 3600}h {s % 3600 // 60}m"
    return f"{s // 86400}d {s % 86400 // 3600}h"


def html_table(df: DataFrame, shown: int = SHOWN) -> str:
    rows = df.orderBy(*df.columns).limit(shown + 1).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows[:shown])
    more = f"<p>more than {shown} rows</p>" if len(rows) > shown else ""
    return f"<table><tr>{head}</tr>{body}</table>{more}" if rows else "<p>not enough events</p>"


def bars(df: DataFrame, names: list[str], value: str, shown: int = SHOWN) -> str:
    """Horizontal bars of the summed values, as inline SVG."""
    rows = df.groupBy(*names).agg(F.sum(value).alias("v")).orderBy(*names).limit(shown).collect()
    top = max((r["v"] for r in rows), default=0)
    if not top or top <= 0:
        return ""
    line = "<text x='0' y='{y}'>{name}</text><rect x='160' y='{top}' width='{w:.1f}' height='12' fill='#47a'/>"
    body = "".join(line.format(y=16 * i + 12, top=16 * i + 2, w=400 * max(0.0, r["v"]) / top, name=escape(" ".join(str(r[n]) for n in names))) for i, r in enumerate(rows))
    return f"<svg width='580' height='{16 * len(rows)}' font-size='12'>{body}</svg>"


def page(title: str, sections: dict[str, str]) -> str:
    body = "".join(f"<section><h2>{escape(name)}</h2>{inner}</section>" for name, inner in sections.items())
    style = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ccc;text-align:left}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


def report(ev: DataFrame, title: str = "Sequence report") -> str:
    """All panels of a canonical sequence."""
    parts = {}
    for name, panel in SECTIONS.items():
        df = panel(ev)
        parts[name] = html_table(df) + (bars(df, *BARS[name]) if name in BARS else "")
    return page(title, parts)


def diff_report(a: DataFrame, b: DataFrame, label_a: str = "A", label_b: str = "B") -> str:
    """Two sequences side by side, with their hook lifts by difference."""
    parts = {f"{label}: {name}": html_table(f(ev)) for label, ev in ((label_a, a), (label_b, b)) for name, f in (("Header", panels.header_stats), ("Summary", summary_vector), ("Hover conversion", panels.hover_conversion), ("Dominant period", panels.dominant_period))}
    return page(f"{label_a} and {label_b}", parts | {"Hook lifts": html_table(lift_deltas(panels.hook_lift(a), panels.hook_lift(b)))})


def write(spark, path: str, text: str) -> None:
    """Write a report to any file system Spark can reach, replacing what is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
