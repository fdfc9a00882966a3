"""Export sink, streaming mart, dashboard facade and physical-plan checks."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from alertlens.operators import metrics
from alertlens.operators.filters import apply_filters
from alertlens.operators.mart import build_mart, materialize_mart
from alertlens.plans.catalog import clean_mart
from alertlens.plans.dashboard import AlertDashboard
from alertlens.sources import export
from alertlens.sources import fixtures as fx
from alertlens.streaming.mart_stream import daily_counts, stream_daily_mart
from tests.conftest import SF001, SF01


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df, capsys) -> str:
    df.explain("formatted")
    return capsys.readouterr().out


# -- export ----------------------------------------------------------------------

def test_export_parts(dirty_mart_001):
    s = export.export_summary(dirty_mart_001).first()
    assert (s.n_names, s.n_years, s.n_rows) == (7, 7, 883)
    names = [r.name for r in export.export_names(dirty_mart_001).collect()]
    assert names == sorted(names) and None not in names
    rows = export.export_rows(dirty_mart_001, null_name_label="None")
    assert rows.filter(F.col("n") == "None").agg(F.sum("c")).first()[0] == 99
    assert rows.columns == ["n", "y", "m", "d", "c"]


def test_write_export(spark, dirty_mart_001, tmp_path):
    parts = export.write_export(dirty_mart_001, str(tmp_path / "payload"))
    rows = [json.loads(line) for p in os.listdir(parts["rows"]) if p.endswith(".json")
            for line in open(os.path.join(parts["rows"], p))]
    assert len(rows) == 883
    assert any(r["n"] is None for r in rows)
    assert set(rows[0]) == {"n", "y", "m", "d", "c"}
    months = spark.read.json(parts["months"]).orderBy("value").collect()
    assert months[0].label == "January"


# -- streaming ---------------------------------------------------------------------

def test_stream_equals_batch(spark):
    streamed = stream_daily_mart(spark, SF001, fx.stream_events_schema(), "event_type", "ts",
                                 glob="events.parquet")
    batch = daily_counts(spark.read.parquet(f"{SF001}/events.parquet"), "event_type", "ts")
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_append_stream_writes_closed_days_only(spark):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    streamed = stream_daily_mart(spark, SF001, fx.stream_events_schema(), "event_type", "ts",
                                 glob="events.parquet", output_mode="append", watermark="2 days")
    last = events.agg(F.max("ts")).first()[0]
    batch = daily_counts(events, "event_type", "ts")
    closed = batch.filter(F.date_add("dt_creation", 1).cast("timestamp_ntz")
                          <= F.lit(last) - F.expr("INTERVAL 2 DAYS"))
    assert streamed.count() == closed.count() > 0
    assert streamed.exceptAll(closed).count() == 0


def test_stream_with_dimension_join(spark, tmp_path):
    src = tmp_path / "alerts"
    fx.dirty_fact(spark, SF001).withColumn(
        "ts", F.try_to_timestamp(F.trim("WW_CREATION_TIMESTAMP"), F.lit("yyyy-MM-dd HH:mm:ss"))
    ).drop("WW_CREATION_TIMESTAMP").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    streamed = stream_daily_mart(spark, str(src), schema, "NAME", "ts", dim=fx.dirty_dim(spark),
                                 status_col="WW_STATUS_ID", domain_col="WW_DOMAIN_CODE",
                                 excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN)
    from alertlens.plans.catalog import dirty_mart

    batch = dirty_mart(spark, SF001)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


# -- facade ------------------------------------------------------------------------

def test_dashboard_facade(spark):
    dash = AlertDashboard.from_tables(spark, fx.dirty_fact(spark, SF01), fx.dirty_dim(spark),
                                      excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN)
    assert dash.kpis().first().total_alerts == 8890
    sel = {"names": ["Escalated", "BUILDING"], "years": [1996, 1997], "months": [1, 2]}
    assert dash.kpis(**sel).first().total_alerts == 61
    assert dash.status_distribution().count() == 8
    assert dash.monthly_trend(mode="compare", dense=True).count() == 640
    assert dash.yearly_breakdown(dense=True).count() == 56
    assert dash.drilldown().count() == 8 + 56 + 633 + 7086
    assert dash.explorer_years("Escalated").count() == 7
    assert len(dash.trend_insights(mode="compare").collect()) == 4
    assert dash.available_years("New").count() == 7


def test_dashboard_refresh_runs_every_panel(spark):
    dash = AlertDashboard.from_tables(spark, fx.dirty_fact(spark, SF001), fx.dirty_dim(spark),
                                      excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN)
    out = dash.refresh(names=["New", "Closed"], years=[1997, 1998], trend_mode="compare",
                       dense=True)
    assert set(out) == {"kpis", "status_distribution", "monthly_trend", "yearly_breakdown",
                        "trend_insights", "status_insights", "yearly_insights"}
    assert out["kpis"][0].total_alerts == sum(r.Count for r in out["status_distribution"])
    assert len(out["monthly_trend"]) == 2 * len({(r.year_creation, r.mth_creation)
                                                  for r in out["monthly_trend"]})


def test_dashboard_static_options(spark):
    with AlertDashboard.from_tables(spark, fx.dirty_fact(spark, SF001), fx.dirty_dim(spark),
                                    excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN) as dash:
        assert dash.kpis(null_name_label="None").first().open_alerts == 448 + 99
        texts = [r.text for r in dash.trend_insights(static_wording=True).collect()]
        assert any(t.startswith("Trend direction: alert volume") for t in texts)
        names = [r.subject for r in dash.trend_insights(mode="compare",
                                                        null_name_label="None").collect()]
        assert len(names) == 4


def test_dashboard_context_releases_cache(spark):
    with AlertDashboard.from_tables(spark, fx.dirty_fact(spark, SF001), fx.dirty_dim(spark),
                                    excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN) as dash:
        assert dash.mart.is_cached and dash.kpis().first().total_alerts == 904
    assert not dash.mart.is_cached


def test_dashboard_from_paths_reads_files(spark, tmp_path):
    fact_path, dim_path = str(tmp_path / "alert_header"), str(tmp_path / "statuses")
    fx.dirty_fact(spark, SF001, padded_headers=True).write.parquet(fact_path)
    fx.dirty_dim(spark).toDF(" ID", "NAME ").write.parquet(dim_path)
    dash = AlertDashboard.from_paths(spark, fact_path, dim_path,
                                     excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN)
    k = dash.kpis().first()
    assert (k.total_alerts, k.open_alerts, k.closure_rate, k.escalation_rate) == (904, 448, 39.5, 12.1)
    assert dash.sorted_mart().count() == 883


# -- plans ---------------------------------------------------------------------------

def test_mart_plan_is_broadcast_one_shuffle_pruned(spark, capsys):
    m = clean_mart(spark, SF01)
    text = _formatted(m, capsys)
    assert "BroadcastHashJoin" in text
    assert _plan(m).count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_large_dimension_plan_preaggregates(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = _plan(clean_mart(spark, SF01, broadcast_max_rows=0))
    finally:
        spark.conf.set(key, old)
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    # the fact is counted per (status id, day) below the join
    join_at = plan.index("SortMergeJoin")
    assert "partial_count" in plan[join_at:]


def test_years_option_pushes_range_into_scan(spark, capsys):
    m = clean_mart(spark, SF01, years=[1996])
    text = _formatted(m, capsys)
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_stored_mart_prunes_partitions_and_pushes_names(spark, capsys):
    stored = materialize_mart(spark, clean_mart(spark, SF001))
    df = metrics.kpis(apply_filters(stored, names=["BUILDING"], years=[1996]))
    text = _formatted(df, capsys)
    assert "PartitionFilters: [isnotnull(year_creation" in text and "1996" in text
    assert "PushedFilters: [In(NAME" in text or "EqualTo(NAME" in text


def test_no_python_udfs_anywhere(spark):
    from alertlens.plans.catalog import QUERIES

    skip = {"stream_daily_mart"}
    for name, fn in QUERIES.items():
        if name in skip:
            continue
        plan = _plan(fn(spark, SF001))
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def test_no_cartesian_or_nested_loop_joins(spark):
    from alertlens.plans.catalog import QUERIES

    skip = {"stream_daily_mart", "stream_daily_mart_append", "daily_mart_refreshed"}
    for name, fn in QUERIES.items():
        if name in skip:
            continue
        plan = _plan(fn(spark, SF001))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_name_filter_over_unmaterialised_mart_reaches_dimension(spark, capsys):
    m = build_mart(fx.clean_fact(spark, SF01), fx.clean_dim(spark, SF01),
                   excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)
    text = _formatted(apply_filters(m, names="BUILDING"), capsys)
    assert "c_mktsegment" in text


# -- command line jobs ---------------------------------------------------------------

def test_cli_mart_export_report(spark, tmp_path, capsys):
    from alertlens.__main__ import main

    fact_path, dim_path = str(tmp_path / "alert_header"), str(tmp_path / "statuses")
    fx.dirty_fact(spark, SF001, padded_headers=True).write.parquet(fact_path)
    fx.dirty_dim(spark).write.parquet(dim_path)
    mart_path, out = str(tmp_path / "mart"), str(tmp_path / "payload")
    assert main(["mart", "--alert-header", fact_path, "--statuses", dim_path,
                 "--out", mart_path]) == 0
    assert "883 rows, 7 statuses, 7 years" in capsys.readouterr().out
    assert main(["export", "--mart", mart_path, "--out", out, "--null-name-label", "None"]) == 0
    assert "7 statuses | 7 years | 883 rows" in capsys.readouterr().out
    assert spark.read.json(f"{out}/rows").filter(F.col("n") == "None").count() > 0
    assert main(["report", "--mart", mart_path, "--years", "1996,1997"]) == 0
    text = capsys.readouterr().out
    assert text.startswith("total ") and "- Highest year:" in text


def test_checkpoint_dir_setting_is_respected(spark, tmp_path):
    from alertlens.session import ensure_checkpoint_dir, scratch_path

    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    target = str(tmp_path / "shared")
    sc.setCheckpointDir(target)
    try:
        assert ensure_checkpoint_dir(spark).endswith("shared") or "shared" in sc.getCheckpointDir()
        assert "shared" in scratch_path(spark, "mart")
    finally:
        if before:
            sc.setCheckpointDir(before)


def test_stream_restart_with_late_file(spark, tmp_path):
    """Second run resumes from the checkpoint; an older file arriving late is counted."""
    events = spark.read.parquet(f"{SF001}/events.parquet")
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    cutoff = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    events.filter(F.col("ts") >= cutoff).write.parquet(f"{src}/recent")
    schema = events.schema

    first = stream_daily_mart(spark, f"{src}/*", schema, "event_type", "ts",
                              sink_path=sink, checkpoint_path=ckpt)
    assert first.agg(F.min("dt_creation")).first()[0].day >= 15

    events.filter(F.col("ts") < cutoff).write.parquet(f"{src}/late")
    second = stream_daily_mart(spark, f"{src}/*", schema, "event_type", "ts",
                               sink_path=sink, checkpoint_path=ckpt)
    batch = daily_counts(events, "event_type", "ts")
    assert second.count() == batch.count()
    assert second.exceptAll(batch).count() == 0 and batch.exceptAll(second).count() == 0


def test_cli_stream_available_now(spark, tmp_path, capsys):
    from alertlens.__main__ import main

    src = str(tmp_path / "alerts")
    fx.dirty_fact(spark, SF001).withColumn(
        "ts", F.try_to_timestamp(F.trim("WW_CREATION_TIMESTAMP"), F.lit("yyyy-MM-dd HH:mm:ss"))
    ).drop("WW_CREATION_TIMESTAMP").write.parquet(src)
    dim_path = str(tmp_path / "statuses")
    fx.dirty_dim(spark).write.parquet(dim_path)
    out, ckpt = str(tmp_path / "mart"), str(tmp_path / "ckpt")
    assert main(["stream", "--source", src, "--glob", "*.parquet", "--ts-col", "ts",
                 "--statuses", dim_path, "--excluded-domain", fx.DIRTY_EXCLUDED_DOMAIN,
                 "--available-now", "--out", out, "--checkpoint", ckpt]) == 0
    from alertlens.operators.mart import load_mart
    from alertlens.plans.catalog import dirty_mart

    streamed, batch = load_mart(spark, out), dirty_mart(spark, SF001)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
