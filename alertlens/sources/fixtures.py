"""Adapters mapping the driver's test tables onto the alert input schema.

A - clean: orders as alerts, customer as the status dimension.
B - dirty: orders with text timestamps, padded and null domains, a literal
    seven-row status table with padded names and one unmatched id.
C - stream: events, event_type as the status name.

The adapters are plain projections of the base tables, so all work still
grows with ``orders`` / ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Fixed values of fixture B (see FIXTURES.md).
DIRTY_STATUSES = (
    (0, " New "),
    (1, "Under Review"),
    (2, "Escalated"),
    (3, "Closed - Accepted"),
    (4, "Closed - Rejected"),
    (5, "Closed"),
    (6, "closed (legacy)"),
)
CLEAN_EXCLUDED_DOMAIN = "5-LOW"
DIRTY_EXCLUDED_DOMAIN = "SUSPICIOUS ACTIVITY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clean_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A alert headers (with the order key kept as ``alert_id``)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("alert_id"),
        F.col("o_custkey").alias("WW_STATUS_ID"),
        F.col("o_orderdate").alias("WW_CREATION_TIMESTAMP"),
        F.col("o_orderpriority").alias("WW_DOMAIN_CODE"),
    )


def clean_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A statuses: one row per customer, segment as the name."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ID"),
        F.col("c_mktsegment").alias("NAME"),
    )


def dirty_fact(spark: SparkSession, sf_dir: str, padded_headers: bool = False) -> DataFrame:
    """Fixture B alert headers.

    ``padded_headers`` wraps the three column names in spaces to exercise the
    header normalisation.
    """
    o = table(spark, sf_dir, "orders")
    ts_text = F.when(
        F.col("o_orderkey") % 97 == 0, F.lit("not a date")
    ).otherwise(
        F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" "))
    )
    domain = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" SUSPICIOUS ACTIVITY "))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority"))
    )
    pad = (lambda n: f" {n} ") if padded_headers else (lambda n: n)
    return o.select(
        F.col("o_orderkey").alias("alert_id"),
        (F.col("o_custkey") % 8).cast("int").alias(pad("WW_STATUS_ID")),
        ts_text.alias(pad("WW_CREATION_TIMESTAMP")),
        domain.alias(pad("WW_DOMAIN_CODE")),
    )


def dirty_dim(spark: SparkSession) -> DataFrame:
    """Fixture B statuses: a literal seven-row table (id 7 stays unmatched).

    Built as an SQL ``VALUES`` relation: a local relation the optimizer can
    size and count without scheduling tasks.
    """
    rows = ", ".join("({}, '{}')".format(i, name.replace("'", "''"))
                     for i, name in DIRTY_STATUSES)
    return spark.sql(
        f"SELECT CAST(ID AS INT) AS ID, CAST(NAME AS STRING) AS NAME FROM VALUES {rows} AS t(ID, NAME)")


def stream_events_schema() -> StructType:
    return StructType([
        StructField("event_id", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("user_id", LongType()),
        StructField("event_type", StringType()),
        StructField("value", DoubleType()),
        StructField("props", StringType()),
    ])
