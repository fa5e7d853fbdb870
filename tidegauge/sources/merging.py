"""Keyed merge of batches into a table partitioned by day.

The merge of two rows of a key is commutative, associative and idempotent, so replayed and out-of-order batches end in the rows that one
batch over everything gives.  Only the days that hold a key of the batch, before or after, are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.session import drop_scratch, materialise, scratch_path
from tidegauge.sources.datasets import stored_table

_AT = "__at"  # beside a column of the rule ``known``: the version that brought its value


@dataclass(frozen=True)
class MergeRules:
    """``version`` orders the rows of a key.  ``greatest``: the largest value wins; ``latest``: the values of the newest row, together;
    ``known``: the newest value that is not null.  Rows of the same version are ordered by their values.  No column may hold a map."""

    key: tuple[str, ...]
    version: str
    greatest: tuple[str, ...] = ()
    latest: tuple[str, ...] = ()
    known: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        rest = [c for c in (*self.greatest, *self.latest, *self.known) if c not in self.key and c != self.version]
        return [*self.key, self.version, *dict.fromkeys(rest)]


def with_versions(rows: DataFrame, rules: MergeRules) -> DataFrame:
    """Rows of a batch in the stored form; columns without a rule are left out."""
    beside = [F.when(F.col(k).isNotNull(), F.col(rules.version)).alias(f"{k}{_AT}") for k in rules.known]
    return rows.select(*rules.columns(), *beside)


def merge_rows(rows: DataFrame, rules: MergeRules) -> DataFrame:
    """One row per key of rows in the stored form.  Null keys are keys; a null version is older than any other."""
    known = [F.max(F.when(F.col(k).isNotNull(), F.struct(F.col(f"{k}{_AT}").alias("at"), F.col(k).alias("value")))).alias(f"__{k}") for k in rules.known]
    merged = rows.groupBy(*rules.key).agg(
        F.max(rules.version).alias(rules.version), *[F.max(g).alias(g) for g in rules.greatest if g != rules.version],
        F.max(F.struct(F.col(rules.version).alias("__version"), *rules.latest)).alias("__latest"), *known)
    values = {**{x: F.col("__latest")[x] for x in rules.latest}, **{k: F.col(f"__{k}")["value"] for k in rules.known}}
    return merged.select(
        *[values.get(c, F.col(c)).alias(c) for c in rules.columns()], *[F.col(f"__{k}")["at"].alias(f"{k}{_AT}") for k in rules.known])


def day_of(ts: str) -> Column:
    """Partition of a row; rows without a time lie in the first day of the calendar."""
    return F.coalesce(F.to_date(ts), F.to_date(F.lit("1970-01-01")))


def merge_days(batch: DataFrame, path: str, rules: MergeRules, ts: str, horizon_days: int | None = None, files: int = 8) -> list:
    """Merge a batch into the table at ``path``; returns the days that were written.

    Rows move when their time changes.  ``horizon_days`` says how far at most: days further from those of the batch are then not
    looked at (a partition filter); None looks for the keys in all days, reading key columns only.  A merge that failed midway is mended by its
    repetition: both places of a moved row are found again and merged."""
    spark = batch.sparkSession
    fresh = materialise(merge_rows(with_versions(batch, rules), rules).withColumn("day", day_of(ts)), "merge-batch")
    stored = stored_table(spark, path)
    own = sorted(r["day"] for r in fresh.select("day").distinct().collect())  # days of one batch
    if not own:
        return []
    touched, before = set(own), set()
    if stored is not None:
        near = stored
        if horizon_days is not None:
            near = stored.where(F.exists(F.array(*[F.lit(d) for d in own]), lambda d: F.abs(F.datediff(F.col("day"), d)) <= horizon_days))
        keys = fresh.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(rules.key)])
        same = F.lit(True)
        for i, k in enumerate(rules.key):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        before = {r["day"] for r in near.select("day", *rules.key).join(keys, same, "left_semi").select("day").distinct().collect()}
        touched |= before
        fresh = stored.where(F.col("day").isin(*touched)).select(*fresh.columns).unionByName(fresh)
    merged = merge_rows(fresh.drop("day"), rules).withColumn("day", day_of(ts))
    # staged first: the target's partitions are both read and replaced
    stage = scratch_path(spark, "merge-stage")
    merged.write.parquet(stage)
    out = spark.read.schema(merged.schema).parquet(stage)
    left = {r["day"] for r in out.select("day").distinct().collect()}
    out.repartition("day", F.pmod(F.xxhash64(*rules.key), F.lit(files))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for gone in before - left:  # every row of the day has moved
        drop_scratch(spark, f"{path}/day={gone}")
    drop_scratch(spark, stage)
    return sorted(touched)


def read_merged(spark: SparkSession, path: str, rules: MergeRules) -> DataFrame:
    return spark.read.parquet(path).select(*rules.columns())
