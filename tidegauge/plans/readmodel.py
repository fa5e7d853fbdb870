"""Refresh of the stored topic read models."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import rollups as ru
from tidegauge.sources.datasets import replace_days, stored_table

OVERLAP = timedelta(minutes=45)


FIRST = datetime(1970, 1, 1)


def bounds(as_of: datetime, last_end: datetime | None, lag_minutes: int = 3, recompute_hours: int = 48) -> tuple[datetime, datetime]:
    """[recompute_from, finalize_before): minutes older than the lag, from the last end minus an overlap, never further
    back than the horizon.  The first run (no last end) covers everything."""
    floor = lambda t: t.replace(second=0, microsecond=0)
    end = floor(as_of - timedelta(minutes=lag_minutes))
    start = FIRST if last_end is None else max(floor(as_of - timedelta(hours=recompute_hours)), last_end - OVERLAP)
    return (min(start, end - timedelta(minutes=1)), end)


def refresh(spark: SparkSession, mentions: DataFrame, root: str, as_of: datetime, last_end: datetime | None = None,
            lag_minutes: int = 3, recompute_hours: int = 48) -> tuple[datetime, datetime]:
    """Recompute the open range of minute buckets and the days it touches; safe to repeat.  ``last_end=None`` rebuilds all."""
    start, end = bounds(as_of, last_end, lag_minutes, recompute_hours)
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    fresh = ru.final_minutes(mentions, lit(start), lit(end)).withColumn("bucket_minute", F.col("bucket_minute").cast("timestamp_ntz"))
    path = f"{root}/minutes"
    replace_days(stored_table(spark, path), fresh, path, "bucket_minute", lit(start), lit(end))
    touched = lambda day: (day >= F.lit(start.date())) & (day <= F.lit(end.date()))
    minutes = spark.read.parquet(path).where(touched(F.col("day"))).drop("day")
    facts = mentions.where(touched(F.to_date("event_timestamp")))
    totals = ru.day_totals(minutes, facts).withColumn("__at", F.col("day").cast("timestamp_ntz"))
    # whole days are replaced, so a day whose topics all fall under the minimum goes too
    path = f"{root}/day_totals"
    stored = stored_table(spark, path)
    first, after = lit(datetime.combine(start.date(), datetime.min.time())), lit(datetime.combine(end.date() + timedelta(days=1), datetime.min.time()))
    replace_days(None if stored is None else stored.withColumn("__at", F.col("day").cast("timestamp_ntz")), totals.drop("day"), path, "__at", first, after)
    return start, end


def register_views(spark: SparkSession, root: str) -> None:
    """Named read models for SQL users."""
    spark.read.parquet(f"{root}/minutes").createOrReplaceTempView("topic_minutes_final")
    spark.read.parquet(f"{root}/day_totals").drop("__at").createOrReplaceTempView("topic_day_totals")
