"""Structured Streaming jobs: event-time rollups, dedupe, cumulative counters, mention publishing, append logs.

All state is native Spark state with map-side partial aggregation, so a subject with a third of the traffic is
combined inside the tasks before it reaches its state partition.  Every sink is idempotent per batch (a batch
overwrites its own folder), checkpoints live in the cluster's shared folder, and no job keeps anything on one machine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.session import scratch_path


def parquet_stream(spark: SparkSession, folder: str, glob: str, max_files: int | None = None) -> DataFrame:
    """File stream with the schema of the landed files (read once from their footers, never inferred from rows)."""
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", glob).parquet(folder).schema)
    reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def broker_options(servers: str, topic: str, lag_seconds: float, limit_seconds: float, now_ms: int, per_trigger: int | None = None) -> dict:
    """Options of a broker source; a cursor that lags more than the limit restarts near the live head."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    if lag_seconds > limit_seconds:
        options["startingTimestamp"] = str(now_ms - int(limit_seconds * 1000))
    else:
        options["startingOffsets"] = "earliest"
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def run_to_end(df: DataFrame, label: str, mode: str = "append", partition_by: str | None = None, out: str | None = None,
               log: str | None = None) -> DataFrame:
    """Process everything available into a parquet folder and read it back.  A job that must resume names its target and checkpoint."""
    spark = df.sparkSession
    out, log = out or scratch_path(spark, label), log or scratch_path(spark, f"{label}-checkpoint")
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", log)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def run_batches(df: DataFrame, label: str, mode: str, publish: Callable[[DataFrame, int, str], None], out: str | None = None,
                log: str | None = None) -> tuple[str, list]:
    """foreachBatch until everything available is processed; returns the target folder and the progress reports."""
    spark = df.sparkSession
    out, log = out or scratch_path(spark, label), log or scratch_path(spark, f"{label}-checkpoint")
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", log)
        .foreachBatch(lambda batch, batch_id: publish(batch, batch_id, out)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out, query.recentProgress


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """A re-run of the batch replaces its own folder, so restarts do not duplicate rows."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def effective_time(event_ts: str, received: str) -> Column:
    """Event time when it is not in the future of the arrival, else arrival time."""
    return F.when(F.col(event_ts) <= F.col(received), F.col(event_ts)).otherwise(F.col(received))


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], lag: str = "3 minutes") -> DataFrame:
    """Final event-time buckets: emitted once the watermark has passed their end."""
    return events.withWatermark(ts, lag).groupBy(F.window(ts, size), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")
    ).select(F.col("window.start").alias("bucket_start"), *keys, "n", "value")


def sliding(events: DataFrame, ts: str, size: str, step: str, keys: list[str], lag: str = "3 minutes") -> DataFrame:
    """Trailing rates; distinct actors are approximate here, exact ones come from the batch rollup."""
    return events.withWatermark(ts, lag).groupBy(F.window(ts, size, step), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("approx_actors")
    ).select(F.col("window.end").alias("window_end"), *keys, "n", "approx_actors")


def deduplicated(events: DataFrame, key: list[str], ts: str, horizon: str) -> DataFrame:
    """First copy of every id inside the watermark horizon; older ids leave the state."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(key)


def cumulative_counts(events: DataFrame, key: str, kind: str, kinds: list[str], ts: str, span: str = "1 day", lag: str = "1 hour") -> DataFrame:
    """Counters per key and event-time span (update mode).  Spans leave the state once the watermark has passed their end, so state
    is bounded by the keys of a span; ``totals_of_counts`` adds the published spans up."""
    return events.withWatermark(ts, lag).groupBy(key, F.window(ts, span)).agg(
        *[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.max(ts).alias("last_at")).select(
        key, F.col("window.start").alias("span_start"), *kinds, "last_at")


def totals_of_counts(spans: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    return spans.groupBy(key).agg(*[F.sum(k).alias(k) for k in kinds], F.max("last_at").alias("last_at"))


def actor_profiles(events: DataFrame, actor: str, ts: str, weight: Column, target: str, span: str = "1 day", lag: str = "1 hour") -> DataFrame:
    """Activity per actor and event-time span; state as in ``cumulative_counts``."""
    return events.withWatermark(ts, lag).groupBy(actor, F.window(ts, span)).agg(
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.sum(weight).alias("amplification"),
        F.max_by(target, ts).alias("last_target")).select(actor, F.col("window.start").alias("span_start"), "first_at", "last_at", "amplification", "last_target")


def totals_of_profiles(spans: DataFrame, actor: str) -> DataFrame:
    return spans.groupBy(actor).agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("amplification").alias("amplification"),
        F.max_by("last_target", "last_at").alias("last_target"))


def latest_state(spark: SparkSession, out: str, *key: str) -> DataFrame:
    """Newest report per key from the batch folders of an update-mode job."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    others = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(*key, "s.*")


def progress_table(spark: SparkSession, reports: list) -> DataFrame:
    rows = [(int(p["batchId"]), int(p["numInputRows"]), int(len(p["sources"]))) for p in reports]
    return spark.createDataFrame(rows, "batch_id long, input_rows long, sources long")


def merge_pages(stored: DataFrame, page: DataFrame, key: list[str], channel: str, message: str) -> tuple[DataFrame, DataFrame]:
    """Idempotent merge of a fetched page and the new low/high water marks per channel."""
    merged = stored.unionByName(page.join(stored.select(*key), key, "left_anti").dropDuplicates(key))
    marks = merged.groupBy(channel).agg(
        F.min(message).alias("low_id"), F.max(message).alias("high_id"), F.count(F.lit(1)).alias("messages"))
    return merged, marks
