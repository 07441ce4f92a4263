"""python -m siltlog ROOT --column NAME:ID[:WIDTH] ... {cue,stat,spans,verify,checkpoint}: reports on a store, read-only."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import StoreError
from .operators import reports
from .operators.accounting import sealed_spans
from .operators.schema import parse_column
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("siltlog", description=__doc__)
    out.add_argument("root")
    out.add_argument("--column", action="append", default=[], metavar="NAME:ID[:WIDTH]")
    out.add_argument("--format", choices=("text", "markdown", "json"), default="text")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name, limit in (("cue", 10), ("stat", None), ("spans", None), ("verify", 20), ("checkpoint", None)):
        verb = verbs.add_parser(name)
        if limit is not None:
            verb.add_argument("--limit", type=int, default=limit, help="rows to list; 0 lists all")
        if name == "checkpoint":
            verb.add_argument("target")
    return out


def report(store: Store, verb: str, limit: int = 0, target: str = "") -> tuple[reports.Document, int]:
    """The document of a verb, and the exit code."""
    log, caveats = store.log(), []
    if not store.registry.families:
        caveats.append(("no column was declared, so none is counted", "--column NAME:ID"))
    lost = store.quarantined()
    if dead := store.dead_volumes():
        caveats.append((f"what lay on {', '.join(dead)} isn't counted", None))
    if lost:
        caveats.append((f"{reports.plural(len(lost), 'file')} beside the listed segments: {', '.join(lost[:5])}", None))
    if verb == "checkpoint":
        return reports.Document("checkpoint", store.checkpoint(target), {}, caveats), 0
    if verb == "verify":
        rows = store.verify()
        sums = rows.agg(F.count_if(F.col("records") > 0).alias("holding_segments"), F.count_if(F.col("records") == 0).alias("empty_segments"), F.count_if(F.col("faults") > 0).alias("faulted_segments"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "bytes", "faults", "dead"))).first().asDict()
        shown = rows.limit(limit).collect() if limit else rows.toLocalIterator()
        return reports.Document("verify", sums | {"not_indexed": len(lost)}, {"segments": [r.asDict() for r in shown]}, caveats), int(sums["faults"] > 0 or bool(lost))
    if verb == "spans":
        return reports.Document("spans", {}, {"columns": [r.asDict() for r in sealed_spans(log).orderBy("cf").collect()]}, caveats), 0
    if verb == "stat":
        return reports.document(verb, reports.summary(log), {"columns": reports.stat_report(log, store.registry)}, 0, caveats), 0
    made = reports.document(verb, reports.summary(log), {"segments": reports.sequence_report(log, limit), "columns": reports.column_spans(log, store.registry)}, 0, caveats)
    made.figures = {**made.figures, "floor": store.held_floor}
    made.tables = {**made.tables, "held": [{"at": at, "holders": n} for at, n in store.holds().items()]}
    return made, 0


def main(arguments: list[str]) -> int:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("siltlog").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        store = Store(spark, args.root, [parse_column(c) for c in args.column], read_only=True)
        made, code = report(store, args.verb, getattr(args, "limit", 0), getattr(args, "target", ""))
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print({"text": made.to_text, "markdown": made.to_markdown, "json": made.to_json}[args.format](), end="")
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
