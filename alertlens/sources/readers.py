"""Readers and schema validation for the two inputs.

Validation works on the schema only: no Spark job runs before the mart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    CharType,
    DataType,
    IntegralType,
    StringType,
    VarcharType,
)

from alertlens.config import DIM_LABEL, DIM_REQUIRED, FACT_LABEL, FACT_REQUIRED


class SchemaError(ValueError):
    """Input columns are missing, ambiguous or of incompatible types."""


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name (S3).

    Spark resolves names case-insensitively by default, so two names that
    differ only by case (or by padding) would make later selects ambiguous;
    reject them up front with a clear message.
    """
    stripped = [c.strip() for c in df.columns]
    seen: dict[str, str] = {}
    for original, name in zip(df.columns, stripped):
        key = name.lower()
        if key in seen:
            raise SchemaError(
                f"Ambiguous columns after header normalisation: {seen[key]!r} and {original!r}"
            )
        seen[key] = original
    if stripped == df.columns:
        return df
    return df.toDF(*stripped)


def require_columns(df: DataFrame, required: Iterable[str], label: str) -> None:
    """Raise ``SchemaError`` listing the missing names, sorted.

    Names are compared case-sensitively, like a plain set difference.
    """
    missing = set(required) - set(df.columns)
    if missing:
        raise SchemaError(f"Missing columns in {label}: {sorted(missing)}")


def prepare_fact(df: DataFrame) -> DataFrame:
    df = normalize_headers(df)
    require_columns(df, FACT_REQUIRED, FACT_LABEL)
    return df


def prepare_dim(df: DataFrame) -> DataFrame:
    df = normalize_headers(df)
    require_columns(df, DIM_REQUIRED, DIM_LABEL)
    return df


def read_alert_header(spark: SparkSession, path: str) -> DataFrame:
    """Fact scan (S1): lazy; only the used columns reach the Parquet reader."""
    return prepare_fact(spark.read.parquet(path))


def read_workflow_statuses(spark: SparkSession, path: str) -> DataFrame:
    """Dimension scan."""
    return prepare_dim(spark.read.parquet(path))


def _key_family(t: DataType) -> str:
    """Types whose values Spark compares exactly: all integer types together; a DECIMAL
    only with the same DECIMAL; text with text; anything else only with itself."""
    if isinstance(t, IntegralType):
        return "integer"
    if isinstance(t, (StringType, VarcharType, CharType)):
        return "string"
    return t.simpleString()


def check_join_keys(fact: DataFrame, dim: DataFrame,
                    fact_key: str = "WW_STATUS_ID", dim_key: str = "ID") -> None:
    """Both join keys must be of the same family.

    Spark would otherwise cast implicitly: text to a number (under ANSI mode a
    non-numeric id fails mid-job), or a BIGINT to DOUBLE, where neighbouring large
    ids become equal.
    """
    ft = fact.schema[fact_key].dataType
    dt = dim.schema[dim_key].dataType
    if _key_family(ft) != _key_family(dt):
        raise SchemaError(
            f"Join key types differ: {fact_key} is {ft.simpleString()}, "
            f"{dim_key} is {dt.simpleString()}"
        )
