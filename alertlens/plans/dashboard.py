"""``AlertDashboard``: the whole analytics surface over one mart.

The mart is built once from the raw tables and (by default) written under
the shared checkpoint folder, partitioned by year; every metric then reads
those files, so a year selection prunes directories and a status selection
is pushed into the Parquet scan. Each method returns a lazy DataFrame.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlens.config import BROADCAST_MAX_ROWS, CLOSED_PREFIX, ESCALATED_NAME, EXCLUDED_DOMAIN, TIMESTAMP_FORMATS
from alertlens.operators import explorer, insights, metrics, windows
from alertlens.operators.filters import apply_filters
from alertlens.operators.mart import build_mart, materialize_mart, sort_mart
from alertlens.sources import export
from alertlens.sources.readers import read_alert_header, read_workflow_statuses


def months_of(mart: DataFrame) -> DataFrame:
    """The mart by (name, year, month), the finest grain that any panel shows."""
    return mart.groupBy("year_creation", "mth_creation", "NAME").agg(
        F.sum("Count").cast("bigint").alias("Count"))


class AlertDashboard:
    def __init__(self, mart: DataFrame, closed_prefix: str = CLOSED_PREFIX,
                 escalated_name: str = ESCALATED_NAME):
        self.mart = mart
        self.closed_prefix = closed_prefix
        self.escalated_name = escalated_name

    # -- construction ---------------------------------------------------------

    @classmethod
    def from_tables(cls, spark: SparkSession, fact: DataFrame, dim: DataFrame,
                    excluded_domain: str = EXCLUDED_DOMAIN, materialize: bool = True,
                    path: str | None = None, broadcast_max_rows: int = BROADCAST_MAX_ROWS,
                    cache: bool = True, formats: Sequence[str] = TIMESTAMP_FORMATS,
                    elect: bool = True, **kwargs) -> "AlertDashboard":
        """Build the mart once; store it (``materialize``) and keep it in memory. Text
        timestamps are read by the layouts that the whole column votes for (``elect``).

        The in-memory copy (days x statuses rows) plays the role of the
        original's in-process cache; its lineage is only the stored files, so
        a lost block is re-read from them, never recomputed from raw alerts.
        """
        mart = build_mart(fact, dim, excluded_domain=excluded_domain,
                          broadcast_max_rows=broadcast_max_rows, formats=formats, elect=elect)
        if materialize:
            mart = materialize_mart(spark, mart, path)
            if cache:
                mart = mart.persist(StorageLevel.MEMORY_AND_DISK)
        return cls(mart, **kwargs)

    @classmethod
    def from_paths(cls, spark: SparkSession, alert_header_path: str,
                   workflow_statuses_path: str, **kwargs) -> "AlertDashboard":
        return cls.from_tables(spark, read_alert_header(spark, alert_header_path),
                               read_workflow_statuses(spark, workflow_statuses_path), **kwargs)

    # -- selections -----------------------------------------------------------

    def filtered(self, names: Any = None, years: Any = None, months: Any = None) -> DataFrame:
        return apply_filters(self.mart, names, years, months)

    def sorted_mart(self) -> DataFrame:
        return sort_mart(self.mart)

    # -- filter options -------------------------------------------------------

    def names(self) -> DataFrame:
        return metrics.names_totals(self.mart)

    def available_years(self, names: Any = None) -> DataFrame:
        return metrics.available_years(self.filtered(names))

    def available_months(self, names: Any = None, years: Any = None) -> DataFrame:
        return metrics.available_months(self.filtered(names, years))

    # -- metrics ----------------------------------------------------------------

    def kpis(self, names: Any = None, years: Any = None, months: Any = None,
             null_name_label: str | None = None) -> DataFrame:
        return metrics.kpis(self.filtered(names, years, months),
                            self.closed_prefix, self.escalated_name, null_name_label)

    def status_distribution(self, names: Any = None, years: Any = None,
                            months: Any = None) -> DataFrame:
        return metrics.status_distribution(self.filtered(names, years, months))

    def monthly_trend(self, names: Any = None, years: Any = None, months: Any = None,
                      mode: str = "total", dense: bool = False) -> DataFrame:
        return metrics.monthly_trend(self.filtered(names, years, months), mode, dense)

    def yearly_breakdown(self, names: Any = None, years: Any = None, months: Any = None,
                         dense: bool = False) -> DataFrame:
        df = self.filtered(names, years, months)
        return metrics.yearly_dense(df) if dense else metrics.yearly_breakdown(df)

    def year_totals(self, names: Any = None, years: Any = None, months: Any = None) -> DataFrame:
        return metrics.year_totals(self.filtered(names, years, months))

    def yoy_change(self, names: Any = None, years: Any = None, months: Any = None) -> DataFrame:
        return windows.yoy_change(self.filtered(names, years, months))

    def top_statuses(self, k: int = 3, **selection) -> DataFrame:
        return windows.top_statuses(self.filtered(**selection), k)

    # -- explorer ---------------------------------------------------------------

    def explorer_years(self, name: Any) -> DataFrame:
        return explorer.explorer_years(self.mart, name)

    def explorer_months(self, name: Any, year: Any) -> DataFrame:
        return explorer.explorer_months(self.mart, name, year)

    def explorer_dates(self, name: Any, year: Any, month: Any) -> DataFrame:
        return explorer.explorer_dates(self.mart, name, year, month)

    def drilldown(self, names: Any = None, month_labels: str = "full") -> DataFrame:
        return explorer.drilldown(self.mart, names, month_labels)

    # -- insights ---------------------------------------------------------------

    def trend_insights(self, names: Any = None, years: Any = None, months: Any = None,
                       mode: str = "total", static_wording: bool = False,
                       null_name_label: str | None = None) -> DataFrame:
        return insights.trend_insights(self.filtered(names, years, months), mode,
                                       static_wording, null_name_label)

    def status_insights(self, names: Any = None, years: Any = None,
                        months: Any = None) -> DataFrame:
        return insights.status_insights(self.filtered(names, years, months), self.closed_prefix)

    def yearly_insights(self, names: Any = None, years: Any = None, months: Any = None,
                        positive_only: bool = False) -> DataFrame:
        return insights.yearly_insights(self.filtered(names, years, months), positive_only)

    # -- one filter change ------------------------------------------------------------

    def panels(self, names: Any = None, years: Any = None, months: Any = None,
               trend_mode: str = "total", dense: bool = False) -> dict[str, DataFrame]:
        """Every panel of one dashboard refresh, as lazy DataFrames."""
        sel = {"names": names, "years": years, "months": months}
        return {
            "kpis": self.kpis(**sel),
            "status_distribution": self.status_distribution(**sel),
            "monthly_trend": self.monthly_trend(**sel, mode=trend_mode, dense=dense),
            "yearly_breakdown": self.yearly_breakdown(**sel, dense=dense),
            "trend_insights": self.trend_insights(**sel, mode=trend_mode),
            "status_insights": self.status_insights(**sel),
            "yearly_insights": self.yearly_insights(**sel),
        }

    def refresh(self, names: Any = None, years: Any = None, months: Any = None,
                trend_mode: str = "total", dense: bool = False,
                max_workers: int = 4, max_rows: int = 100_000) -> dict[str, list]:
        """Run every panel concurrently and return their rows.

        All panels work on months: the selection is aggregated once to (name, year, month)
        and kept in memory, so the mart is scanned once, and the panels are small jobs over
        that, submitted from a few driver threads so the scheduler overlaps them. Rows come to
        the driver only for a panel of at most ``max_rows`` rows, which is more
        than a dashboard can show; beyond it an error names the panel, and
        ``panels`` gives its DataFrame. Nothing is cut.
        """
        by_month = months_of(self.filtered(names, years, months)).persist(StorageLevel.MEMORY_AND_DISK)
        by_month.count()  # kept before the panels run side by side
        frames = AlertDashboard(by_month, self.closed_prefix, self.escalated_name).panels(
            trend_mode=trend_mode, dense=dense)

        def rows(name: str) -> list:
            found = frames[name].limit(max_rows + 1).collect()
            if len(found) > max_rows:
                raise ValueError(f"{name} has over {max_rows} rows: use panels() and write it")
            return found

        try:
            with ThreadPoolExecutor(max_workers=max_workers) as pool:
                futures = {name: pool.submit(rows, name) for name in frames}
                return {name: fut.result() for name, fut in futures.items()}
        finally:
            by_month.unpersist()

    # -- lifecycle ----------------------------------------------------------------

    def close(self) -> None:
        """Release the in-memory copy of the mart (the stored files stay)."""
        self.mart.unpersist()

    def __enter__(self) -> "AlertDashboard":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    # -- export -----------------------------------------------------------------

    def export(self, path: str, null_name_label: str | None = None) -> dict[str, str]:
        return export.write_export(self.mart, path, null_name_label)
