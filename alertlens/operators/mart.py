"""The daily mart: domain exclusion, status join, timestamp parse, count (A1).

Plan shape, small status table (the usual case)::

    Scan fact [3 columns] -> Filter domain/timestamp -> BroadcastHashJoin(dim)
      -> HashAggregate(partial) -> Exchange hash(y, m, d, NAME) -> HashAggregate

one shuffle, and it only carries (days x statuses) rows per map task.

Large status table: the dimension is never broadcast. The fact is first
counted per (status id, day) - map-side combine collapses a hot status id to
one row per day per task, so a status holding a third of all alerts cannot
skew the join - then joined with a shuffle and re-summed per (day, name).
Duplicate dimension ids fan out exactly as a row-level left join would:
each matching dimension row receives the pre-aggregated count.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType

from alertlens.config import (
    BROADCAST_MAX_BYTES,
    BROADCAST_MAX_ROWS,
    EXCLUDED_DOMAIN,
    HOT_IDS,
    TIMESTAMP_FORMATS,
)
from alertlens.functions.text import as_clean_string, strip_ws
from alertlens.functions.layouts import elect_layouts, parse_elected
from alertlens.functions.timestamps import creation_timestamp, is_typed_time
from alertlens.operators.store import MART_COLUMNS, MART_SCHEMA, MartStore, listed_files  # noqa: F401
from alertlens.session import scratch_path
from alertlens.sources.readers import check_join_keys, prepare_dim, prepare_fact

# -- P1 ---------------------------------------------------------------------

def domain_kept(excluded: str = EXCLUDED_DOMAIN, column: str = "WW_DOMAIN_CODE") -> Column:
    """Predicate keeping rows whose stripped domain differs from ``excluded``.

    NULL domains compare to NULL and are dropped, as in SQL. Only text that
    contains the excluded value can strip down to it, so every other non-null
    row is kept without paying for the strip (a cheap byte search instead).
    The null test stands alone, so that it reaches the scan.
    """
    text = F.col(column).cast("string")
    return F.col(column).isNotNull() & (
        ~text.contains(F.lit(excluded)) | (strip_ws(text) != F.lit(excluded)))


def exclude_domain(fact: DataFrame, excluded: str = EXCLUDED_DOMAIN) -> DataFrame:
    return prepare_fact(fact).filter(domain_kept(excluded))


# -- P3 ---------------------------------------------------------------------

def with_creation_ts(fact: DataFrame, formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """Adds ``creation_ts`` (TIMESTAMP_NTZ, NULL when unparseable)."""
    fact = prepare_fact(fact)
    return fact.withColumn("creation_ts", creation_timestamp(fact, formats=formats))


def with_day(df: DataFrame, ts_col: str, day: Column, name: str = "_d") -> DataFrame:
    """Adds the day and drops rows without one, working the expression out once per row.

    A plain ``isNotNull`` filter would be pushed below the projection and parse the
    text twice; generating the day from an array of at most one keeps a single parse.
    Typed columns are filtered instead, as their null test reaches the scan.
    """
    if is_typed_time(df, ts_col):
        return df.filter(F.col(ts_col).isNotNull()).withColumn(name, day)
    return df.withColumn(name, F.explode(F.array_compact(F.array(day))))


def _creation(alerts: DataFrame, formats: Sequence[str], elect: bool) -> Column:
    """The parsed creation column; with ``elect`` by the layouts that its text votes for."""
    if not elect or is_typed_time(alerts):
        return creation_timestamp(alerts, formats=formats)
    return parse_elected(F.col("WW_CREATION_TIMESTAMP"), elect_layouts(alerts, formats=formats))


def year_range_predicate(ts: Column, years: Iterable[int], kind: str = "timestamp_ntz") -> Column:
    """``ts`` within any of the calendar years, written as half-open ranges.

    ``year(ts) IN (...)`` is opaque to Parquet; range comparisons on the raw
    column become ``PushedFilters`` and skip row groups by min/max statistics.
    ``kind`` is the raw column's type: ``date``, ``timestamp`` or
    ``timestamp_ntz``.
    """
    pred = None
    for y in sorted(set(int(v) for v in years)):
        lo = F.lit(f"{y:04d}-01-01").cast(kind)
        hi = F.lit(f"{y + 1:04d}-01-01").cast(kind)
        term = (ts >= lo) & (ts < hi)
        pred = term if pred is None else (pred | term)
    return pred if pred is not None else F.lit(False)


def _raw_kind(df: DataFrame, column: str) -> str:
    t = df.schema[column].dataType
    if isinstance(t, DateType):
        return "date"
    if isinstance(t, TimestampNTZType):
        return "timestamp_ntz"
    return "timestamp"


# -- J1 ---------------------------------------------------------------------

def status_names(dim: DataFrame) -> DataFrame:
    """Dimension reduced to (ID, NAME) with the name cast and stripped."""
    dim = prepare_dim(dim)
    return dim.select(F.col("ID"), as_clean_string(F.col("NAME")).alias("NAME"))


def has_at_most(df: DataFrame, max_rows: int,
                max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Size check for a broadcast candidate, in one small job.

    Counts the rows and sums their size (UTF-8 bytes of string columns, 8 bytes
    for anything else) with one partial sum per task, so both the row count and
    the bytes to broadcast are proven below their bounds.
    """
    if max_rows <= 0:
        return False
    widths = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
              if isinstance(f.dataType, StringType) else F.lit(8)
              for f in df.schema.fields] or [F.lit(0)]
    row_bytes = widths[0]
    for w in widths[1:]:
        row_bytes = row_bytes + w
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(row_bytes.cast("bigint")).alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def hot_status_ids(fact: DataFrame, most: int = HOT_IDS) -> list:
    """The non-null status ids with over one ``most``-th of the rows (so fewer than ``most``),
    found by one counted aggregate."""
    total = Observation()
    counts = (prepare_fact(fact).groupBy("WW_STATUS_ID").agg(F.count(F.lit(1)).alias("_n"))
              .observe(total, F.sum("_n").alias("rows")))
    top = counts.orderBy(F.desc("_n")).limit(most).collect()
    rows = total.get["rows"] or 0
    return [r["WW_STATUS_ID"] for r in top if r["WW_STATUS_ID"] is not None and r["_n"] * most > rows]


def attach_status_name(fact: DataFrame, dim: DataFrame,
                       broadcast_max_rows: int = BROADCAST_MAX_ROWS, hot_ids: int = HOT_IDS) -> DataFrame:
    """Row-level left join fact -> dimension (J1); unmatched ids keep NULL names.

    Only the fact's own columns plus the dimension ``NAME`` come out; a
    ``NAME`` column already on the fact is replaced by the dimension's.

    A dimension too large to broadcast meets the alerts in two ways. Ids with over one
    ``hot_ids``-th of all alerts, and NULL ids, are joined where they lie with the few
    dimension rows of these ids, broadcast if they are small too (only a hot id that the
    dimension repeats very often is not). All other ids are shuffled to a sort-merge join, where
    no id is more than a ``hot_ids``-th of the rows.
    """
    fact = prepare_fact(fact)
    names = status_names(dim)
    check_join_keys(fact, names)
    fact_cols = [F.col("`" + c.replace("`", "``") + "`") for c in fact.columns if c.upper() != "NAME"]
    alerts = fact.select(*fact_cols)
    right = names.withColumnRenamed("ID", "_status_id")
    on = F.col("WW_STATUS_ID") == F.col("_status_id")
    if has_at_most(names, broadcast_max_rows):
        return alerts.join(F.broadcast(right), on, "left").drop("_status_id")
    hot = hot_status_ids(fact, hot_ids)
    if not hot and not fact.schema["WW_STATUS_ID"].nullable:
        return alerts.join(right.hint("merge"), on, "left").drop("_status_id")
    few = right.filter(F.col("_status_id").isin(hot))
    few = F.broadcast(few) if has_at_most(few, max(broadcast_max_rows, len(hot))) else few.hint("merge")
    is_hot = F.col("WW_STATUS_ID").isNull() | F.col("WW_STATUS_ID").isin(hot)
    rest = F.col("WW_STATUS_ID").isNotNull() & ~F.col("WW_STATUS_ID").isin(hot)
    return (alerts.filter(is_hot).join(few, on, "left")
            .unionByName(alerts.filter(rest).join(right.hint("merge"), on, "left")).drop("_status_id"))


# -- A1 ---------------------------------------------------------------------

def build_mart(fact: DataFrame, dim: DataFrame, excluded_domain: str = EXCLUDED_DOMAIN,
               broadcast_max_rows: int = BROADCAST_MAX_ROWS,
               years: Iterable[int] | None = None,
               formats: Sequence[str] = TIMESTAMP_FORMATS, elect: bool = False) -> DataFrame:
    """Daily alert counts per (year, month, date, status name).

    ``years`` optionally restricts the mart to some calendar years; on a
    date/timestamp column this is pushed into the fact scan. ``formats`` are
    the layouts tried on text timestamps, in this order, or with ``elect`` in the
    order that the whole column votes for (``layouts``; one more pass over text).
    """
    fact = prepare_fact(fact)
    names = status_names(dim)
    check_join_keys(fact, names)

    alerts = fact.select("WW_STATUS_ID", "WW_CREATION_TIMESTAMP", "WW_DOMAIN_CODE")
    if years is not None and is_typed_time(alerts):
        alerts = alerts.filter(year_range_predicate(
            F.col("WW_CREATION_TIMESTAMP"), years, _raw_kind(alerts, "WW_CREATION_TIMESTAMP")))
    alerts = alerts.filter(domain_kept(excluded_domain))
    alerts = with_day(alerts, "WW_CREATION_TIMESTAMP", F.to_date(_creation(alerts, formats, elect)))
    alerts = alerts.select(F.col("WW_STATUS_ID").alias("_sid"), "_d")
    if years is not None and not is_typed_time(fact):
        alerts = alerts.filter(F.year("_d").isin([int(y) for y in years]))

    right = names.withColumnRenamed("ID", "_status_id")
    on = F.col("_sid") == F.col("_status_id")
    if has_at_most(names, broadcast_max_rows):
        counted = (
            alerts.join(F.broadcast(right), on, "left")
            .groupBy("_d", "NAME")
            .agg(F.count(F.lit(1)).alias("Count"))
        )
    else:
        # Both sides are collapsed before the shuffle join: the fact to one row
        # per (status id, day), the dimension to distinct (id, name) pairs with
        # their multiplicity, so neither a hot status id nor a heavily
        # duplicated dimension id concentrates rows in one join task. The
        # fan-out of duplicate ids is kept exactly: count x multiplicity.
        per_status_day = (
            alerts.groupBy("_sid", "_d")
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        pairs = names.groupBy("ID", "NAME").agg(F.count(F.lit(1)).alias("_mult")) \
            .withColumnRenamed("ID", "_status_id")
        counted = (
            per_status_day.join(pairs.hint("merge"), on, "left")
            .groupBy("_d", "NAME")
            .agg(F.sum(F.col("_n") * F.coalesce(F.col("_mult"), F.lit(1))).alias("Count"))
        )
    return counted.select(
        F.year("_d").alias("year_creation"),
        F.month("_d").alias("mth_creation"),
        F.col("_d").alias("dt_creation"),
        F.col("NAME"),
        F.col("Count").cast("bigint").alias("Count"),
    )


def daily_mart(fact: DataFrame, dim: DataFrame, **kwargs) -> DataFrame:
    """``build_mart`` in presentation order (NAME, year, month, date)."""
    return sort_mart(build_mart(fact, dim, **kwargs))


def sort_mart(mart: DataFrame) -> DataFrame:
    return mart.orderBy("NAME", "year_creation", "mth_creation", "dt_creation")


def duplicate_status_ids(dim: DataFrame) -> DataFrame:
    """Dimension ids that occur more than once (they fan out in the join), with their rows."""
    rows = prepare_dim(dim).groupBy("ID").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    return rows.filter(F.col("n_rows") > 1)


def mart_quality(fact: DataFrame, dim: DataFrame, excluded_domain: str = EXCLUDED_DOMAIN,
                 broadcast_max_rows: int = BROADCAST_MAX_ROWS,
                 formats: Sequence[str] = TIMESTAMP_FORMATS, elect: bool = False,
                 years: Iterable[int] | None = None) -> DataFrame:
    """What the mart leaves out, one row: rows read, dropped by domain, with a NULL
    timestamp, with unparseable text, counted, and counted without a status name.

    ``years`` restricts the report to rows created in these years; on a date or timestamp
    column the range reaches the scan, so nothing else is read. Rows without a usable
    timestamp belong to no year: they are then neither read nor reported."""
    fact = prepare_fact(fact)
    names = status_names(dim)
    check_join_keys(fact, names)
    elected = _creation(fact.filter(domain_kept(excluded_domain)), formats, elect)
    if years is not None:
        years = [int(y) for y in years]
        fact = fact.filter(
            year_range_predicate(F.col("WW_CREATION_TIMESTAMP"), years, _raw_kind(fact, "WW_CREATION_TIMESTAMP"))
            if is_typed_time(fact) else F.year(elected).isin(years))
    kept = F.coalesce(domain_kept(excluded_domain), F.lit(False))
    raw = F.col("WW_CREATION_TIMESTAMP").isNotNull()
    parsed = elected.isNotNull()
    fate = (F.when(~kept, "domain").when(~raw, "null").when(~parsed, "text").otherwise("counted"))
    per_id = fact.select(F.col("WW_STATUS_ID").alias("_sid"), fate.alias("fate"))
    per_id = per_id.groupBy("_sid", "fate").agg(F.count(F.lit(1)).alias("n"))
    known = names.select(F.col("ID").alias("_status_id")).distinct().withColumn("_known", F.lit(True))
    known = F.broadcast(known) if has_at_most(known, broadcast_max_rows) else known.hint("merge")
    per_id = per_id.join(known, F.col("_sid") == F.col("_status_id"), "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    is_ = lambda x: F.col("fate") == x
    return per_id.agg(
        total(F.lit(True)).alias("rows_read"), total(is_("domain")).alias("dropped_domain"),
        total(is_("null")).alias("null_timestamp"), total(is_("text")).alias("unparseable"),
        total(is_("counted")).alias("counted"),
        total(is_("counted") & F.col("_known").isNull()).alias("unmatched_id"))


# -- persistence --------------------------------------------------------------

def write_mart(mart: DataFrame, path: str) -> None:
    """Publish ``mart`` as the whole stored mart (see ``store``): Parquet, one directory per
    year, so year filters prune whole folders. Readers see the old mart until it is whole."""
    MartStore(mart.sparkSession, path).publish(mart)


def refresh_mart(fact: DataFrame, dim: DataFrame, path: str, years: Iterable[int],
                 excluded_domain: str = EXCLUDED_DOMAIN,
                 broadcast_max_rows: int = BROADCAST_MAX_ROWS,
                 formats: Sequence[str] = TIMESTAMP_FORMATS, elect: bool = False) -> None:
    """Recompute only some years of a stored mart and replace just those.

    The year range reaches the fact scan (row groups and date partitions of other years are
    skipped). The new rows go to fresh folders and one manifest switches all years at
    once; a requested year without any alert left goes, so that the stored mart equals a
    full rebuild in the requested years. Deltas absorbed in these years are replaced too.
    """
    years = sorted({int(y) for y in years})
    MartStore(fact.sparkSession, path).replace_years(build_mart(
        fact, dim, excluded_domain=excluded_domain, broadcast_max_rows=broadcast_max_rows,
        years=years, formats=formats, elect=elect), years)


def absorb_files(spark: SparkSession, source: str, dim: DataFrame, path: str, **mart_args) -> list[str]:
    """Count the files under ``source`` that the stored mart has not absorbed yet.

    They become a delta mart of their own, whose counts are added to the stored ones, so no
    file and no year is read twice; the ledger remembers them, and a repeated call adds nothing.
    Files are taken to be written once: name, not content, tells whether one is new. Names
    are those of the status table as it is now. Returns the files absorbed.
    """
    store = MartStore(spark, path)
    new = store.new_files(listed_files(spark.read.parquet(source)))
    if new:
        store.append(build_mart(prepare_fact(spark.read.parquet(*new)), dim, **mart_args), files=new)
    return new


def load_mart(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored mart back in the canonical column order and types: the newest published
    one, or the plain Parquet folder of a stream's file sink."""
    store = MartStore(spark, path)
    if store.exists():
        return store.load()
    return spark.read.schema(MART_SCHEMA).parquet(path).select(*MART_COLUMNS)


def materialize_mart(spark: SparkSession, mart: DataFrame, path: str | None = None) -> DataFrame:
    """Write the mart under the shared checkpoint folder and read it back.

    This cuts the lineage: later metrics never re-scan the raw alerts, and a
    lost executor only costs re-reading the written files.
    """
    target = path or scratch_path(spark, "mart")
    write_mart(mart, target)
    return load_mart(spark, target)


def empty_mart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MART_SCHEMA)
