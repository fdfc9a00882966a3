"""Payload export (S7-S9): rows, dimension lists and a summary.

The payload is written by Spark as JSON-lines directories - one per part -
so no single string, task or driver ever holds the whole export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlens.functions.text import month_full
from alertlens.operators.metrics import C, D, M, N, Y


def export_rows(mart: DataFrame, null_name_label: str | None = None) -> DataFrame:
    """Mart rows as ``{n, y, m, d, c}`` with the date as ISO text.

    ``null_name_label='None'`` reproduces the static page, which prints a
    missing name as text; the default keeps it NULL.
    """
    name = F.col(N) if null_name_label is None else F.coalesce(F.col(N), F.lit(null_name_label))
    return mart.select(
        name.alias("n"),
        F.col(Y).cast("int").alias("y"),
        F.col(M).cast("int").alias("m"),
        F.date_format(F.col(D), "yyyy-MM-dd").alias("d"),
        F.col(C).cast("bigint").alias("c"),
    ).orderBy(F.asc_nulls_first("n"), "y", "m", "d")


def export_names(mart: DataFrame) -> DataFrame:
    """Sorted distinct non-null names."""
    return mart.select(F.col(N).alias("name")).dropna().distinct().orderBy("name")


def export_years(mart: DataFrame) -> DataFrame:
    return mart.select(F.col(Y).cast("int").alias("year")).dropna().distinct().orderBy("year")


def export_months(mart: DataFrame) -> DataFrame:
    months = mart.select(F.col(M).cast("int").alias("value")).dropna().distinct()
    return months.select("value", month_full(F.col("value")).alias("label")).orderBy("value")


def export_summary(mart: DataFrame) -> DataFrame:
    """One row: number of names, years and rows in the payload."""
    return mart.agg(
        F.count_distinct(N).cast("bigint").alias("n_names"),
        F.count_distinct(Y).cast("bigint").alias("n_years"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
    )


def write_export(mart: DataFrame, path: str, null_name_label: str | None = None,
                 mode: str = "overwrite") -> dict[str, str]:
    """Write every payload part under ``path``; returns part -> directory."""
    base = path.rstrip("/")
    parts = {
        "rows": export_rows(mart, null_name_label),
        "names": export_names(mart),
        "years": export_years(mart),
        "months": export_months(mart),
        "summary": export_summary(mart),
    }
    out = {}
    for part, df in parts.items():
        target = f"{base}/{part}"
        df.write.mode(mode).option("ignoreNullFields", "false").json(target)
        out[part] = target
    return out
