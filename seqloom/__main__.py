"""python -m seqloom report|diff|discover|store ...: the same operations over NDJSON files; sql over stored tables."""

from __future__ import annotations

import argparse
import secrets
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence(spark: SparkSession, path: str, salt: str) -> DataFrame:
    """The canonical sequence that the panels read, from NDJSON files."""
    from seqloom.functions.labels import surface
    from seqloom.session import materialise
    from seqloom.sources.ndjson import canonical_blobs, ordered_events, read_lines

    ev = ordered_events(canonical_blobs(read_lines(spark, path), salt))
    ev = ev.withColumns({"pos": F.col("seq"), "surface": surface(F.col("route")), "user": F.nullif("user_hash", F.lit(""))})
    return materialise(ev, "sequence")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    parser.add_argument("--salt", help="salt of the user hash; a random one if absent")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("report")
    one.add_argument("input")
    one.add_argument("-o", "--output", required=True)
    one.add_argument("--title", default="Sequence report")
    two = commands.add_parser("diff")
    two.add_argument("a")
    two.add_argument("b")
    two.add_argument("-o", "--output", required=True)
    two.add_argument("--label-a", default="A")
    two.add_argument("--label-b", default="B")
    names = commands.add_parser("discover")
    names.add_argument("inputs", nargs="+")
    names.add_argument("--threshold", type=float, default=0.45)
    names.add_argument("--min-count", type=int, default=2)
    names.add_argument("--html", help="write the proposals there as well")
    ask = commands.add_parser("sql")
    ask.add_argument("folder", help="Parquet tables; the view sequence holds their canonical events")
    ask.add_argument("statement")
    ask.add_argument("--panel", action="append", default=[], help="a panel to have as a view")
    store = commands.add_parser("store")
    store.add_argument("action", choices=["ingest", "list", "report"])
    store.add_argument("folder")
    store.add_argument("what", nargs="?", help="files to ingest, or the capture to report")
    store.add_argument("-o", "--output")
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and not argv[0].startswith("-") and argv[0] not in commands.choices:
        argv.insert(0, "report")  # a path alone asks for its report
    args = parser.parse_args(argv)

    from seqloom.operators.discover import propose_rules
    from seqloom.operators.store import CaptureStore
    from seqloom.plans.catalog import register_panels, register_sequence, register_tables
    from seqloom.plans.report import diff_report, html_table, page, report, write
    from seqloom.session import build_session, materialise
    from seqloom.sources.ndjson import canonical_blobs, read_lines

    spark = SparkSession.getActiveSession() or build_session()
    salt = args.salt or secrets.token_hex(16)
    if args.command == "report":
        write(spark, args.output, report(sequence(spark, args.input, salt), args.title))
    elif args.command == "diff":
        write(spark, args.output, diff_report(sequence(spark, args.a, salt), sequence(spark, args.b, salt), args.label_a, args.label_b))
    elif args.command == "discover":
        undecoded = canonical_blobs(read_lines(spark, args.inputs), salt).where(~F.col("decoded"))
        found = materialise(propose_rules(undecoded, least=args.min_count, threshold=args.threshold), "proposals")
        for r in found.toLocalIterator():
            print(f"{r['n_events']}\t{r['n_names']}\t{r['category']}\t{r['pattern']}")
            print(f"    ({r['pattern']!r}, {r['category']!r}),  # {r['example']}")
        if args.html:
            write(spark, args.html, page("Proposed rules", {"Rules": html_table(found)}))
    elif args.command == "sql":
        register_tables(spark, args.folder)
        register_panels(register_sequence(spark, args.folder, "sequence", "label", "friendly", "decoded"), *args.panel)
        spark.sql(args.statement).show(1000, truncate=False)
    else:
        held = CaptureStore(spark, args.folder)
        if args.action == "ingest":
            held.ingest(sequence(spark, args.what, salt), args.what)
        elif args.action == "list":
            for r in held.captures().toLocalIterator():
                print("\t".join(map(str, r)))
        else:
            events = held.events(args.what)
            if events is None or not events.head(1):
                print("no such capture", file=sys.stderr)
                return 1
            write(spark, args.output or f"{args.folder}/report.html", report(events.drop("bucket"), args.what))
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except KeyboardInterrupt:
        sys.exit(130)
