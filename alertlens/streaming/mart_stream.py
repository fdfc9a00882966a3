"""The daily mart as a Structured Streaming aggregation.

New alert files landing in a folder update the mart incrementally:

    readStream (file source) -> [domain filter] -> [stream-static left join
    with the status table] -> groupBy(day, NAME).count() -> foreachBatch

Two output modes:

* ``complete`` (default): one state row per (day, status) - bounded by days x
  statuses, never by alert volume - and every micro-batch publishes the whole
  (small) mart as the stored mart's next version. The write is idempotent when a
  batch is retried after an executor loss, and alerts arriving late, even days late,
  are still counted, so the streamed mart always equals the batch mart over the same files.
* ``append`` with a watermark: the count runs per event-time day window;
  a day is written once, when the watermark passes its end, and its state is
  dropped. State then stays bounded by the watermark delay. Alerts later
  than the watermark are not counted - the usual trade for bounded state.
  Without a join of its own the sink is Parquet (exactly-once through its commit
  log); with one, closed days are a delta of the stored mart, which remembers the
  last batch of each stream and so takes each of them once.

A status table that is too large to broadcast, or that is given as a function which
reads it, doesn't meet raw alerts in the stream: the state counts per (status id, day),
so a hot id is one row a day, and each micro-batch joins its counts with the table as it
then is, by broadcast or by shuffle as its size then asks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alertlens.config import BROADCAST_MAX_ROWS, TIMESTAMP_FORMATS
from alertlens.functions.text import as_clean_string
from alertlens.functions.timestamps import creation_timestamp
from alertlens.operators.mart import domain_kept, has_at_most, load_mart, status_names, with_day
from alertlens.operators.store import MartStore
from alertlens.session import scratch_path
from alertlens.sources.readers import check_join_keys, normalize_headers


def daily_counts(alerts: DataFrame, name_col: str, ts_col: str,
                 dim: DataFrame | None = None, status_col: str | None = None,
                 domain_col: str | None = None, excluded_domain: str | None = None,
                 broadcast_max_rows: int = BROADCAST_MAX_ROWS,
                 watermark: str | None = None,
                 formats: Sequence[str] = TIMESTAMP_FORMATS, named: bool = True) -> DataFrame:
    """Streaming or batch: count alerts per (day, status name), by the rules of the
    batch mart: headers stripped, domain excluded, timestamps of any type or listed
    text layout, join keys of one type.

    Without ``dim`` the name is read from ``name_col``; with it, ``status_col``
    is joined to the dimension's ``ID`` (left join, static side). With
    ``watermark`` (e.g. ``"2 days"``) the day is an event-time window, as
    append mode requires. ``named=False`` leaves the join out and counts per
    (status id, day), for ``name_counts``.
    """
    df = normalize_headers(alerts)
    if domain_col is not None and excluded_domain is not None:
        df = df.filter(domain_kept(excluded_domain, domain_col))
    parsed = creation_timestamp(df, ts_col, formats)
    key = as_clean_string(F.col(name_col)).alias("NAME") if dim is None else F.col(status_col).alias("_sid")
    if watermark is not None:
        # Watermarks need TIMESTAMP (with zone); NTZ wall clocks are read in
        # the session zone (UTC in our sessions), so days do not move.
        df = df.select(key, parsed.cast("timestamp").alias("_event_ts")) \
            .withWatermark("_event_ts", watermark).filter(F.col("_event_ts").isNotNull())
        df = df.withColumn("_d", F.window(F.col("_event_ts"), "1 day")).drop("_event_ts")
    else:
        df = with_day(df, ts_col, F.to_date(parsed)).select(key, "_d")
    if dim is None:
        named = df
    else:
        names = status_names(dim)
        check_join_keys(normalize_headers(alerts), names, fact_key=status_col)
        if not named:
            per_id = df.groupBy("_sid", "_d").agg(F.count(F.lit(1)).alias("_n"))
            return per_id if watermark is None else per_id.withColumn("_d", F.to_date(F.col("_d.start")))
        right = names.withColumnRenamed("ID", "_status_id")
        if has_at_most(right, broadcast_max_rows):
            right = F.broadcast(right)
        named = df.join(right, F.col("_sid") == F.col("_status_id"), "left").select("_d", "NAME")
    counted = named.groupBy("_d", "NAME").agg(F.count(F.lit(1)).alias("Count"))
    if watermark is not None:
        counted = counted.withColumn("_d", F.to_date(F.col("_d.start")))
    return counted.select(
        F.year("_d").alias("year_creation"),
        F.month("_d").alias("mth_creation"),
        F.col("_d").alias("dt_creation"),
        "NAME",
        F.col("Count").cast("bigint").alias("Count"),
    )


def name_counts(per_id: DataFrame, dim: DataFrame, broadcast_max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """The mart from counts per (status id, day), joined with the distinct (id, name)
    pairs, so that a hot id is one row per day and duplicate ids fan out. The pairs are
    broadcast if they are small, else both sides are shuffled."""
    names = status_names(dim)
    pairs = (names.groupBy("ID", "NAME").agg(F.count(F.lit(1)).alias("_mult"))
             .withColumnRenamed("ID", "_status_id"))
    pairs = F.broadcast(pairs) if has_at_most(names, broadcast_max_rows) else pairs.hint("merge")
    total = F.sum(F.col("_n") * F.coalesce(F.col("_mult"), F.lit(1))).cast("bigint")
    counted = (per_id.join(pairs, F.col("_sid") == F.col("_status_id"), "left")
               .groupBy("_d", "NAME").agg(total.alias("Count")))
    return counted.select(F.year("_d").alias("year_creation"), F.month("_d").alias("mth_creation"),
                          F.col("_d").alias("dt_creation"), "NAME", "Count")


def stream_counts(alerts: DataFrame, name_col: str, ts_col: str,
                  dim: DataFrame | Callable[[], DataFrame] | None = None, status_col: str | None = None,
                  broadcast_max_rows: int = BROADCAST_MAX_ROWS, watermark: str | None = None,
                  **kwargs) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
    """The streaming aggregate, and what is left to do on each micro-batch's result.

    With ``dim`` as a function the table is read, checked and measured again in each
    micro-batch, so a status added meanwhile gets its name; as a DataFrame it is joined in the
    stream if it is small, and per micro-batch otherwise, with or without a watermark.
    """
    read = dim if callable(dim) else lambda: dim
    later = callable(dim) or dim is not None and not has_at_most(status_names(dim), broadcast_max_rows)
    counts = daily_counts(alerts, name_col, ts_col, dim=read(), status_col=status_col,
                          broadcast_max_rows=broadcast_max_rows, watermark=watermark, named=not later, **kwargs)
    if not later:
        return counts, None

    def finish(batch: DataFrame) -> DataFrame:
        now = read()
        check_join_keys(batch, status_names(now), fact_key="_sid")
        return name_counts(batch, now, broadcast_max_rows)

    return counts, finish


def read_alert_stream(spark: SparkSession, source_dir: str, schema: StructType,
                      glob: str | None = None, max_files_per_trigger: int | None = None
                      ) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source_dir)


def start_mart_stream(counts: DataFrame, sink_path: str, checkpoint_path: str,
                      available_now: bool = True, processing_time: str | None = None,
                      output_mode: str = "complete",
                      finish: Callable[[DataFrame], DataFrame] | None = None):
    """Start the streaming mart from ``stream_counts``.

    ``complete``: each batch publishes the whole mart under ``sink_path``; versions older than
    an hour, but for the last ten, are removed. ``append``: finalised days are appended, to
    a Parquet sink or, where the join is left to ``finish``, as deltas of the stored mart.
    """
    spark = counts.sparkSession
    if output_mode == "append" and finish is not None:
        def append_batch(batch: DataFrame, batch_id: int) -> None:
            MartStore(spark, sink_path).append(finish(batch), stream=checkpoint_path, batch_id=batch_id)

        writer = (counts.writeStream.outputMode("append")
                  .option("checkpointLocation", checkpoint_path)
                  .foreachBatch(append_batch))
    elif output_mode == "append":
        writer = (counts.writeStream.outputMode("append").format("parquet")
                  .partitionBy("year_creation")
                  .option("checkpointLocation", checkpoint_path)
                  .option("path", sink_path))
    else:
        def write_batch(batch: DataFrame, _batch_id: int) -> None:
            store = MartStore(spark, sink_path)
            store.publish(finish(batch) if finish else batch)
            store.vacuum(keep=10, older_than_hours=1.0)

        writer = (counts.writeStream.outputMode("complete")
                  .option("checkpointLocation", checkpoint_path)
                  .foreachBatch(write_batch))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def stream_daily_mart(spark: SparkSession, source_dir: str, schema: StructType,
                      name_col: str, ts_col: str, glob: str | None = None,
                      sink_path: str | None = None, checkpoint_path: str | None = None,
                      output_mode: str = "complete", watermark: str | None = None,
                      max_files_per_trigger: int | None = None,
                      **count_kwargs) -> DataFrame:
    """Run the stream over everything currently in ``source_dir`` and return
    the stored mart (batch read of the sink)."""
    if output_mode == "append" and watermark is None:
        raise ValueError("append mode needs a watermark")
    sink = sink_path or scratch_path(spark, "stream-mart")
    ckpt = checkpoint_path or scratch_path(spark, "stream-checkpoint")
    alerts = read_alert_stream(spark, source_dir, schema, glob, max_files_per_trigger)
    counts, finish = stream_counts(alerts, name_col, ts_col, watermark=watermark, **count_kwargs)
    query = start_mart_stream(counts, sink, ckpt, available_now=True, output_mode=output_mode, finish=finish)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return load_mart(spark, sink)
