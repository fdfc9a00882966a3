"""Batch jobs: ``python -m alertlens <command> ...`` (or ``spark-submit`` this file).

    mart    build the daily mart from the two inputs and store it (Parquet,
            partitioned by year), or rebuild some years of it
    absorb  add the alert files that a stored mart has not counted yet
    vacuum  remove what no recent version of a stored mart needs
    export  write the payload (rows, names, years, months, summary) as JSON
            directories, from the inputs or from a stored mart
    report  show KPIs, the status distribution and the insights for a
            selection, from a stored mart
    stream  keep a stored mart up to date from a folder of alert files
            (Structured Streaming; complete, or watermarked append)

The session comes from the environment (``spark-submit`` / cluster
defaults); ``--local`` starts a local one for trying things out.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from alertlens.config import EXCLUDED_DOMAIN, TIMESTAMP_FORMATS
from alertlens.operators.mart import (
    absorb_files,
    build_mart,
    load_mart,
    mart_quality,
    materialize_mart,
    refresh_mart,
    write_mart,
)
from alertlens.operators.store import MartStore
from alertlens.plans.dashboard import AlertDashboard
from alertlens.sources.export import export_summary, write_export
from alertlens.sources.readers import read_alert_header, read_workflow_statuses


def _session(local: bool) -> SparkSession:
    if local:
        from alertlens.session import local_session

        return local_session()
    spark = SparkSession.builder.appName("alertlens").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _csv(value: str | None) -> list[str] | None:
    return None if value is None else [v for v in value.split(",") if v != ""]


def _mart_from_args(spark: SparkSession, args: argparse.Namespace):
    if getattr(args, "mart", None):
        return load_mart(spark, args.mart)
    fact = read_alert_header(spark, args.alert_header)
    dim = read_workflow_statuses(spark, args.statuses)
    # stored first: the payload and its summary read it six times
    return materialize_mart(spark, build_mart(fact, dim, **_rules(args)))


def _rules(args: argparse.Namespace) -> dict:
    """How alerts are read: text timestamps by the layouts that the whole column votes for."""
    return {"excluded_domain": args.excluded_domain, "formats": _formats(args), "elect": not args.no_election}


def _formats(args: argparse.Namespace) -> tuple[str, ...]:
    return (*(args.timestamp_format or ()), *TIMESTAMP_FORMATS)


def cmd_mart(spark: SparkSession, args: argparse.Namespace) -> None:
    fact = read_alert_header(spark, args.alert_header)
    dim = read_workflow_statuses(spark, args.statuses)
    years = _csv(args.years)
    wanted = [int(y) for y in years] if years else None
    if wanted:
        refresh_mart(fact, dim, args.out, wanted, **_rules(args))
    else:
        write_mart(build_mart(fact, dim, **_rules(args)), args.out)
    if args.quality:
        quality = mart_quality(fact, dim, years=wanted, **_rules(args)).first().asDict()
        print(f"{args.years or 'all years'}: " + ", ".join(f"{k} {v:,}" for k, v in quality.items()))
    _say(spark, args.out)


def _say(spark: SparkSession, path: str) -> None:
    s = export_summary(load_mart(spark, path)).first()
    print(f"mart at {path}: {s.n_rows:,} rows, {s.n_names} statuses, {s.n_years} years")


def cmd_absorb(spark: SparkSession, args: argparse.Namespace) -> None:
    new = absorb_files(spark, args.alert_header, read_workflow_statuses(spark, args.statuses), args.out, **_rules(args))
    done = MartStore(spark, args.out).compact(args.compact_over)
    print(f"{len(new)} new files absorbed, {len(done)} years compacted")
    _say(spark, args.out)


def cmd_vacuum(spark: SparkSession, args: argparse.Namespace) -> None:
    gone = MartStore(spark, args.mart).vacuum(args.keep, args.older_than_hours)
    print(f"{gone} folders removed")


def cmd_export(spark: SparkSession, args: argparse.Namespace) -> None:
    mart = _mart_from_args(spark, args)
    parts = write_export(mart, args.out, null_name_label=args.null_name_label)
    s = export_summary(mart).first()
    print(f"payload written to {args.out} ({', '.join(parts)}): {s.n_names} statuses | "
          f"{s.n_years} years | {s.n_rows:,} rows")


def cmd_report(spark: SparkSession, args: argparse.Namespace) -> None:
    dash = AlertDashboard(load_mart(spark, args.mart))
    sel = {"names": _csv(args.names), "years": _csv(args.years), "months": _csv(args.months)}
    k = dash.kpis(**sel).first()
    print(f"total {k.total_alerts:,} | open {k.open_alerts:,} | closure rate {k.closure_rate}% | "
          f"escalation rate {k.escalation_rate}%")
    k = -1
    for k, row in enumerate(dash.status_distribution(**sel).toLocalIterator()):
        if args.top is None or k < args.top:
            print(f"  {row.NAME}: {row.Count:,}")
    if args.top is not None and k >= args.top:
        print(f"  ... {k + 1 - args.top} more statuses")
    for frame in (dash.trend_insights(**sel, mode=args.trend_mode), dash.status_insights(**sel),
                  dash.yearly_insights(**sel)):
        for row in frame.orderBy("rank").collect():
            print(f"- {row.text}")


def cmd_stream(spark: SparkSession, args: argparse.Namespace) -> None:
    from alertlens.streaming.mart_stream import read_alert_stream, start_mart_stream, stream_counts

    schema = spark.read.parquet(args.source).schema  # one listing, to fix the schema
    alerts = read_alert_stream(spark, args.source, schema, args.glob, args.max_files_per_trigger)
    # read again in each micro-batch: the table may change, or grow beyond a broadcast
    dim = (lambda: read_workflow_statuses(spark, args.statuses)) if args.statuses else None
    counts, finish = stream_counts(alerts, args.name_col, args.ts_col, dim=dim, status_col=args.status_col,
                                   domain_col=args.domain_col, excluded_domain=args.excluded_domain,
                                   watermark=args.watermark, formats=_formats(args))
    query = start_mart_stream(counts, args.out, args.checkpoint,
                              available_now=args.available_now,
                              processing_time=None if args.available_now else args.trigger,
                              output_mode=args.mode, finish=finish)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    print(f"stream stopped; mart at {args.out}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="alertlens", description=__doc__.split("\n\n")[0])
    p.add_argument("--local", action="store_true", help="start a local session")
    sub = p.add_subparsers(dest="command", required=True)

    m = sub.add_parser("mart", help="build and store the daily mart")
    m.add_argument("--alert-header", required=True)
    m.add_argument("--statuses", required=True)
    m.add_argument("--excluded-domain", default=EXCLUDED_DOMAIN)
    m.add_argument("--years", help="comma-separated years: rebuild and replace only these")
    m.add_argument("--quality", action="store_true",
                   help="also count what was left out (one more pass over the same years)")
    m.add_argument("--out", required=True)

    ab = sub.add_parser("absorb", help="add alert files that a stored mart has not counted yet")
    ab.add_argument("--alert-header", required=True, help="folder that alert files arrive in, each written once")
    ab.add_argument("--statuses", required=True)
    ab.add_argument("--excluded-domain", default=EXCLUDED_DOMAIN)
    ab.add_argument("--compact-over", type=int, default=20, help="rewrite years of more deltas than this as one")
    ab.add_argument("--out", required=True)

    v = sub.add_parser("vacuum", help="remove old versions of a stored mart")
    v.add_argument("--mart", required=True)
    v.add_argument("--keep", type=int, default=3, help="versions kept, whatever their age")
    v.add_argument("--older-than-hours", type=float, default=24.0)

    e = sub.add_parser("export", help="write the JSON payload")
    src = e.add_mutually_exclusive_group(required=True)
    src.add_argument("--mart", help="a stored mart")
    src.add_argument("--alert-header")
    e.add_argument("--statuses")
    e.add_argument("--excluded-domain", default=EXCLUDED_DOMAIN)
    e.add_argument("--null-name-label", default=None,
                   help="text for a missing status name (the static page uses 'None')")
    e.add_argument("--out", required=True)

    r = sub.add_parser("report", help="KPIs, distribution and insights for a selection")
    r.add_argument("--mart", required=True)
    r.add_argument("--names", help="comma-separated status names")
    r.add_argument("--years", help="comma-separated years")
    r.add_argument("--months", help="comma-separated months")
    r.add_argument("--trend-mode", default="total", choices=["total", "compare"])
    r.add_argument("--top", type=int, help="print only so many statuses and how many are left out")

    st = sub.add_parser("stream", help="keep a stored mart up to date from a folder of files")
    st.add_argument("--source", required=True, help="folder the alert files land in")
    st.add_argument("--glob", help="file name filter, e.g. '*.parquet'")
    st.add_argument("--ts-col", default="WW_CREATION_TIMESTAMP")
    st.add_argument("--name-col", default="NAME", help="status name column (no --statuses)")
    st.add_argument("--statuses", help="status table to join (then --status-col is the key)")
    st.add_argument("--status-col", default="WW_STATUS_ID")
    st.add_argument("--domain-col", default="WW_DOMAIN_CODE")
    st.add_argument("--excluded-domain", default=EXCLUDED_DOMAIN)
    st.add_argument("--mode", default="complete", choices=["complete", "append"])
    st.add_argument("--watermark", help="event-time delay, e.g. '2 days' (append mode)")
    st.add_argument("--max-files-per-trigger", type=int)
    st.add_argument("--trigger", default="1 minute", help="processing-time trigger")
    st.add_argument("--available-now", action="store_true",
                    help="process what is there, then stop")
    st.add_argument("--out", required=True)
    st.add_argument("--checkpoint", required=True, help="streaming checkpoint (shared storage)")
    for job in (m, ab, e):
        job.add_argument("--no-election", action="store_true",
                         help="try text layouts in their listed order, day before month")
    for job in (m, ab, e, st):
        job.add_argument("--timestamp-format", action="append",
                         help="a text layout to try before the built-in ones (repeatable)")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "export" and args.alert_header and not args.statuses:
        parser().error("--statuses is required with --alert-header")
    if args.command == "stream" and args.mode == "append" and not args.watermark:
        parser().error("--watermark is required with --mode append")
    spark = _session(args.local)
    commands = {"mart": cmd_mart, "absorb": cmd_absorb, "vacuum": cmd_vacuum, "export": cmd_export, "report": cmd_report, "stream": cmd_stream}
    commands[args.command](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
