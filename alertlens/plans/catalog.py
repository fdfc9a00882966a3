"""Named queries over the driver's test tables, one per operator.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` and reads the base tables
through the fixture adapters (``orders`` + ``customer`` for the clean
fixture, ``orders`` + a literal status table for the dirty one, ``events``
for the stream), so every query's work grows with the data. Parameters
(selections, names) are fixed per query and documented in FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlens.functions.layouts import layout_votes
from alertlens.operators import explorer, filters, insights, metrics, windows
from alertlens.operators.mart import (
    absorb_files,
    attach_status_name,
    build_mart,
    daily_mart,
    duplicate_status_ids,
    exclude_domain,
    load_mart,
    mart_quality,
    refresh_mart,
    with_creation_ts,
    write_mart,
)
from alertlens.operators.store import MartStore
from alertlens.session import scratch_path
from alertlens.sources import export
from alertlens.sources import fixtures as fx
from alertlens.sources.readers import normalize_headers
from alertlens.streaming.mart_stream import daily_counts, stream_daily_mart

Query = Callable[[SparkSession, str], DataFrame]

# Selections used by the filter queries (fixed values of the fixtures).
FILTER_NAMES = ["Escalated", "BUILDING"]
FILTER_YEARS = [1996, 1997]
FILTER_MONTHS = [1, 2]
STREAM_WATERMARK = "2 days"


def clean_mart(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    return build_mart(fx.clean_fact(spark, sf_dir), fx.clean_dim(spark, sf_dir),
                      excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN, **kwargs)


def dirty_mart(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    return build_mart(fx.dirty_fact(spark, sf_dir), fx.dirty_dim(spark),
                      excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN, **kwargs)


def _on_clean(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(clean_mart(spark, sf_dir))


def _on_dirty(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(dirty_mart(spark, sf_dir))


# -- sources, row-level operators -------------------------------------------------

def q_normalized_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = normalize_headers(fx.dirty_fact(spark, sf_dir, padded_headers=True))
    return fact.select("alert_id", "WW_STATUS_ID", "WW_CREATION_TIMESTAMP", "WW_DOMAIN_CODE")


def q_filtered_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = exclude_domain(fx.dirty_fact(spark, sf_dir), fx.DIRTY_EXCLUDED_DOMAIN)
    return kept.select("alert_id", "WW_STATUS_ID", "WW_DOMAIN_CODE")


def q_parsed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_creation_ts(fx.dirty_fact(spark, sf_dir)).select("alert_id", "creation_ts")


def q_joined_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = attach_status_name(fx.clean_fact(spark, sf_dir), fx.clean_dim(spark, sf_dir))
    return joined.select("alert_id", "WW_STATUS_ID", "NAME")


def q_joined_alerts_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = attach_status_name(fx.dirty_fact(spark, sf_dir), fx.dirty_dim(spark))
    return joined.select("alert_id", "WW_STATUS_ID", "NAME")


def q_duplicate_status_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-quality check: dimension ids that fan out in the join."""
    dim = fx.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("ID"), F.col("c_mktsegment").alias("NAME"))
    return duplicate_status_ids(dim)


def q_mart_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mart over a dimension with duplicate ids (each match counts once)."""
    dim = fx.table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("bigint").alias("ID"), F.col("n_name").alias("NAME"))
    fact = fx.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 7).alias("WW_STATUS_ID"),
        F.col("o_orderdate").alias("WW_CREATION_TIMESTAMP"),
        F.col("o_orderpriority").alias("WW_DOMAIN_CODE"),
    )
    return build_mart(fact, dim, excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)


# -- marts ------------------------------------------------------------------------

def q_daily_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_mart(fx.clean_fact(spark, sf_dir), fx.clean_dim(spark, sf_dir),
                      excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)


def q_daily_mart_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_mart(fx.dirty_fact(spark, sf_dir), fx.dirty_dim(spark),
                      excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN)


def q_daily_mart_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same mart through the large-dimension path (no broadcast)."""
    return clean_mart(spark, sf_dir, broadcast_max_rows=0)


def q_daily_mart_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mart restricted to two years with the range pushed into the fact scan."""
    return clean_mart(spark, sf_dir, years=FILTER_YEARS)


def q_daily_mart_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored mart that is wrong in two years and has one without alerts, refreshed.

    Without the refresh the counts of FILTER_YEARS are doubled and the alerts of
    1997 appear a second time in a year that the input does not have.
    """
    path = scratch_path(spark, "refreshed-mart")
    mart = clean_mart(spark, sf_dir)
    empty = 2090
    wrong = mart.withColumn("Count", F.when(F.col("year_creation").isin(FILTER_YEARS), F.col("Count") * 2)
                            .otherwise(F.col("Count")))
    extra = mart.filter(F.col("year_creation") == FILTER_YEARS[-1]).withColumn("year_creation", F.lit(empty))
    write_mart(wrong.unionByName(extra), path)
    refresh_mart(fx.clean_fact(spark, sf_dir), fx.clean_dim(spark, sf_dir), path, [*FILTER_YEARS, empty],
                 excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)
    return load_mart(spark, path)


def q_mart_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_quality(fx.dirty_fact(spark, sf_dir), fx.dirty_dim(spark),
                        excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN)


def _mart_of_days(spark: SparkSession, sf_dir: str, ts) -> DataFrame:
    fact = fx.clean_fact(spark, sf_dir).withColumn("WW_CREATION_TIMESTAMP", ts)
    return build_mart(fact, fx.clean_dim(spark, sf_dir), excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)


def q_mart_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact with a DATE creation column."""
    return _mart_of_days(spark, sf_dir, F.col("WW_CREATION_TIMESTAMP").cast("date"))


def q_mart_of_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact with a TIMESTAMP (zoned) creation column."""
    return _mart_of_days(spark, sf_dir, F.col("WW_CREATION_TIMESTAMP").cast("timestamp"))


def q_mart_of_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact whose text timestamps take turns through everyday layouts."""
    ts = F.col("WW_CREATION_TIMESTAMP")
    layouts = ["yyyy-MM-dd HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm",
               "dd/MM/yyyy HH:mm:ss.SSS", "yyyy/MM/dd'T'HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyyMMdd HHmmss", "yyyy/M/d"]
    text = F.date_format(ts, layouts[0])
    for k, layout in enumerate(layouts[1:], 1):
        text = F.when(F.col("alert_id") % len(layouts) == k, F.date_format(ts, layout)).otherwise(text)
    return _mart_of_days(spark, sf_dir, text)


def _month_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.clean_fact(spark, sf_dir).withColumn(
        "WW_CREATION_TIMESTAMP", F.date_format("WW_CREATION_TIMESTAMP", "MM/dd/yyyy HH:mm:ss"))


def q_mart_of_month_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact whose text timestamps put the month first: the column elects that layout."""
    return build_mart(_month_first(spark, sf_dir), fx.clean_dim(spark, sf_dir),
                      excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN, elect=True)


def q_mart_of_mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mostly month-first text, with ISO and other layouts between: rows fall back."""
    ts, k = F.col("WW_CREATION_TIMESTAMP"), F.col("alert_id") % 10
    text = (F.when(k < 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k < 4, F.date_format(ts, "MM-dd-yyyy HH:mm"))
            .when(k < 5, F.date_format(ts, "yyyy/M/d")).otherwise(F.date_format(ts, " MM/dd/yyyy ")))
    fact = fx.clean_fact(spark, sf_dir).withColumn("WW_CREATION_TIMESTAMP", text)
    return build_mart(fact, fx.clean_dim(spark, sf_dir), excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN, elect=True)


def q_layout_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each layout parses in the month-first column."""
    return layout_votes(_month_first(spark, sf_dir)).filter("votes > 0").select("layout", "votes")


def q_mart_quality_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_quality(fx.dirty_fact(spark, sf_dir), fx.dirty_dim(spark), years=FILTER_YEARS,
                        excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN)


def q_mart_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored mart that three arrivals of alert files were added to, with one call too many."""
    source, path = scratch_path(spark, "arrivals"), scratch_path(spark, "absorbed-mart")
    dim, rules = fx.clean_dim(spark, sf_dir), {"excluded_domain": fx.CLEAN_EXCLUDED_DOMAIN}
    fact = fx.clean_fact(spark, sf_dir)
    for arrival in range(3):
        fact.filter(F.col("alert_id") % 3 == arrival).write.mode("append").parquet(source)
        absorb_files(spark, source, dim, path, **rules)
        if arrival == 1:
            absorb_files(spark, source, dim, path, **rules)  # nothing new
            MartStore(spark, path).compact()
    return load_mart(spark, path)


def q_mart_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader from before a rebuild and one from after it see."""
    path = scratch_path(spark, "versioned-mart")
    mart = clean_mart(spark, sf_dir)
    write_mart(filters.apply_filters(mart, years=FILTER_YEARS), path)
    before = load_mart(spark, path).withColumn("seen", F.lit("before"))
    write_mart(mart, path)
    return before.unionByName(load_mart(spark, path).withColumn("seen", F.lit("after")))


def q_joined_alerts_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level join with a large dimension, one status id on every third alert."""
    joined = attach_status_name(hot_status_fact(spark, sf_dir), fx.clean_dim(spark, sf_dir), broadcast_max_rows=0)
    return joined.select("alert_id", "WW_STATUS_ID", "NAME")


def q_stream_mart_append_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarked stream over ``orders`` with a dimension that is not broadcast: closed days."""
    schema = fx.table(spark, sf_dir, "orders").schema
    return stream_daily_mart(spark, sf_dir, schema, "", "o_orderdate", glob="orders.parquet",
                             dim=fx.clean_dim(spark, sf_dir), status_col="o_custkey",
                             domain_col="o_orderpriority", excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN,
                             output_mode="append", watermark=STREAM_WATERMARK, broadcast_max_rows=0)


def q_stream_mart_new_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that goes on after half of the statuses were added to the status table."""
    source, dim, sink, ckpt = (scratch_path(spark, n) for n in ("arrivals", "statuses", "stream-mart", "stream-checkpoint"))
    orders, names = fx.table(spark, sf_dir, "orders"), fx.clean_dim(spark, sf_dir)
    for arrival in range(2):
        orders.filter(F.col("o_orderkey") % 2 == arrival).write.mode("append").parquet(source)
        names.filter(F.col("ID") % 2 == arrival).write.mode("append").parquet(dim)
        mart = stream_daily_mart(spark, source, orders.schema, "", "o_orderdate", sink_path=sink, checkpoint_path=ckpt,
                                 dim=lambda: spark.read.parquet(dim), status_col="o_custkey",
                                 domain_col="o_orderpriority", excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)
    return mart


def stored_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stored-mart")
    write_mart(dirty_mart(spark, sf_dir), path)
    return load_mart(spark, path)


def q_stored_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kpis(filters.apply_filters(stored_mart(spark, sf_dir), years=FILTER_YEARS))


def q_stored_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.drilldown(stored_mart(spark, sf_dir))


def q_stored_explorer_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.explorer_dates(stored_mart(spark, sf_dir), "Escalated", 1996, "3")


def q_stream_mart_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over ``orders`` with domain and status join: equals the batch mart."""
    schema = fx.table(spark, sf_dir, "orders").schema
    return stream_daily_mart(spark, sf_dir, schema, "", "o_orderdate", glob="orders.parquet",
                             dim=fx.clean_dim(spark, sf_dir), status_col="o_custkey",
                             domain_col="o_orderpriority", excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN)


def hot_status_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A alerts with one status id (1) holding every third alert."""
    return fx.clean_fact(spark, sf_dir).withColumn(
        "WW_STATUS_ID",
        F.when(F.col("alert_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("WW_STATUS_ID")),
    )


def q_mart_hot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewed status ids through the large-dimension path (pre-aggregated join)."""
    return build_mart(hot_status_fact(spark, sf_dir), fx.clean_dim(spark, sf_dir),
                      excluded_domain=fx.CLEAN_EXCLUDED_DOMAIN, broadcast_max_rows=0)


def q_stream_daily_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_daily_mart(spark, sf_dir, fx.stream_events_schema(), "event_type", "ts",
                             glob="events.parquet")


def q_events_daily_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the streamed mart over ``events`` (fixture C)."""
    return daily_counts(fx.table(spark, sf_dir, "events"), "event_type", "ts")


def q_stream_daily_mart_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarked stream: only days the watermark has closed are written."""
    return stream_daily_mart(spark, sf_dir, fx.stream_events_schema(), "event_type", "ts",
                             glob="events.parquet", output_mode="append",
                             watermark=STREAM_WATERMARK)


# -- filters ----------------------------------------------------------------------

def q_filter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(dirty_mart(spark, sf_dir), names=[" New ", "Escalated", "ALL"])


def q_filter_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(clean_mart(spark, sf_dir), years=[1996, "1997"])


def q_filter_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(clean_mart(spark, sf_dir), months=FILTER_MONTHS)


def q_filter_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(clean_mart(spark, sf_dir), FILTER_NAMES, FILTER_YEARS,
                                 FILTER_MONTHS)


def q_filter_combined_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(dirty_mart(spark, sf_dir), FILTER_NAMES, FILTER_YEARS,
                                 FILTER_MONTHS)


# -- metrics ----------------------------------------------------------------------

def q_kpis_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kpis(filters.apply_filters(dirty_mart(spark, sf_dir), years=FILTER_YEARS))


def q_available_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.available_years(
        filters.apply_filters(dirty_mart(spark, sf_dir), names=["Escalated", "New"]))


def q_available_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = filters.apply_filters(dirty_mart(spark, sf_dir), names="Escalated", years=2001)
    return metrics.available_months(mart)


# -- explorer ---------------------------------------------------------------------

def q_explorer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.explorer_years(clean_mart(spark, sf_dir), "BUILDING")


def q_explorer_years_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'ALL' is a given name meaning every status (NULL names included)."""
    return explorer.explorer_years(dirty_mart(spark, sf_dir), "ALL")


def q_explorer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.explorer_months(dirty_mart(spark, sf_dir), "Escalated", "1996")


def q_explorer_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.explorer_dates(dirty_mart(spark, sf_dir), "Escalated", 1996, "3")


def q_drilldown_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.drilldown(dirty_mart(spark, sf_dir), ["Escalated", "New"],
                              month_labels="abbr")


# -- insights on a selection ------------------------------------------------------

def q_insight_trend_total_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = filters.apply_filters(dirty_mart(spark, sf_dir), names="Closed", years=[1999, 2000])
    return insights.trend_total_insights(mart)


def q_insight_yearly_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = filters.apply_filters(clean_mart(spark, sf_dir), years=[2000, 2001])
    return insights.yearly_insights(mart, positive_only=True)


def q_insight_status_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.status_insights(filters.apply_filters(dirty_mart(spark, sf_dir),
                                                          names="no such status"))


QUERIES: dict[str, Query] = {
    # sources and row-level operators
    "normalized_headers": q_normalized_headers,
    "filtered_alerts": q_filtered_alerts,
    "parsed_timestamps": q_parsed_timestamps,
    "joined_alerts": q_joined_alerts,
    "joined_alerts_dirty": q_joined_alerts_dirty,
    "duplicate_status_ids": q_duplicate_status_ids,
    # marts
    "daily_mart": q_daily_mart,
    "daily_mart_dirty": q_daily_mart_dirty,
    "daily_mart_shuffle": q_daily_mart_shuffle,
    "daily_mart_years": q_daily_mart_years,
    "daily_mart_refreshed": q_daily_mart_refreshed,
    "mart_fanout": q_mart_fanout,
    "mart_quality": q_mart_quality,
    "mart_quality_years": q_mart_quality_years,
    "mart_absorbed": q_mart_absorbed,
    "mart_versions": q_mart_versions,
    "mart_of_month_first": q_mart_of_month_first,
    "mart_of_mixed_layouts": q_mart_of_mixed_layouts,
    "layout_votes": q_layout_votes,
    "joined_alerts_hot": q_joined_alerts_hot,
    "stream_mart_append_joined": q_stream_mart_append_joined,
    "stream_mart_new_statuses": q_stream_mart_new_statuses,
    "mart_of_dates": q_mart_of_dates,
    "mart_of_zoned": q_mart_of_zoned,
    "mart_of_layouts": q_mart_of_layouts,
    "stored_kpis": q_stored_kpis,
    "stored_drilldown": q_stored_drilldown,
    "stored_explorer_dates": q_stored_explorer_dates,
    "stream_mart_joined": q_stream_mart_joined,
    "mart_hot_status": q_mart_hot_status,
    "events_daily_mart": q_events_daily_mart,
    "stream_daily_mart": q_stream_daily_mart,
    "stream_daily_mart_append": q_stream_daily_mart_append,
    # filters
    "filter_names": q_filter_names,
    "filter_years": q_filter_years,
    "filter_months": q_filter_months,
    "filter_combined": q_filter_combined,
    "filter_combined_dirty": q_filter_combined_dirty,
    # metrics
    "names_totals": _on_dirty(metrics.names_totals),
    "kpis": _on_clean(metrics.kpis),
    "kpis_dirty": _on_dirty(metrics.kpis),
    "kpis_filtered": q_kpis_filtered,
    "kpis_static": _on_dirty(lambda m: metrics.kpis(m, null_name_label="None")),
    "status_distribution": _on_clean(metrics.status_distribution),
    "status_distribution_dirty": _on_dirty(metrics.status_distribution),
    "trend_total": _on_clean(metrics.trend_total),
    "trend_compare": _on_dirty(metrics.trend_compare),
    "trend_compare_dense": _on_dirty(metrics.trend_compare_dense),
    "trend_periods": _on_dirty(metrics.trend_periods),
    "yearly_breakdown": _on_dirty(metrics.yearly_breakdown),
    "yearly_dense": _on_dirty(metrics.yearly_dense),
    "year_totals": _on_clean(metrics.year_totals),
    "year_total_max": _on_clean(metrics.year_total_max),
    "available_years": q_available_years,
    "available_months": q_available_months,
    # windows
    "yoy_change": _on_clean(windows.yoy_change),
    "top3_statuses": _on_dirty(windows.top_statuses),
    "status_share": _on_dirty(windows.status_share),
    "peak_period": _on_dirty(windows.peak_period),
    "peak_year": _on_clean(windows.peak_year),
    # explorer
    "explorer_years": q_explorer_years,
    "explorer_years_all": q_explorer_years_all,
    "explorer_months": q_explorer_months,
    "explorer_dates": q_explorer_dates,
    "drilldown": _on_dirty(explorer.drilldown),
    "drilldown_filtered": q_drilldown_filtered,
    # insights
    "insight_trend_total": _on_clean(insights.trend_total_insights),
    "insight_trend_total_filtered": q_insight_trend_total_filtered,
    "insight_trend_compare": _on_dirty(insights.trend_compare_insights),
    "insight_trend_compare_static": _on_dirty(
        lambda m: insights.trend_compare_insights(m, null_name_label="None")),
    "insight_status": _on_dirty(insights.status_insights),
    "insight_status_clean": _on_clean(insights.status_insights),
    "insight_status_empty": q_insight_status_empty,
    "insight_yearly": _on_clean(insights.yearly_insights),
    "insight_yearly_static": q_insight_yearly_static,
    # export
    "export_rows": _on_dirty(export.export_rows),
    "export_rows_static": _on_dirty(lambda m: export.export_rows(m, null_name_label="None")),
    "export_names": _on_dirty(export.export_names),
    "export_years": _on_clean(export.export_years),
    "export_months": _on_clean(export.export_months),
    "export_summary": _on_dirty(export.export_summary),
}
