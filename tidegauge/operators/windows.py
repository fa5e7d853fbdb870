"""Per-key ordering operators that stay safe when one key holds a large part of all rows.

``top_n`` filters on a rank directly, so Spark trims every key to n rows inside each task before the shuffle
(window group limit).  The ``chunked_*`` operators never bring a whole key to one task: rows are dealt by range over key and
order columns, so a hot key is many ranges of even size; work happens inside a range, and one summary row per key and range
carries over.  The dealt rows are written once, so every use sees the same ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.session import materialise

RANK = "__rank"
CHUNK = "__chunk"


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_col: str | None = None) -> DataFrame:
    """Best n rows per key; ``order`` must be total for a repeatable answer."""
    ranked = df.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(RANK) <= n)
    return ranked.withColumnRenamed(RANK, rank_col) if rank_col else ranked.drop(RANK)


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def _dealt(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows by range over (keys, order), with the number of the range."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id()), "ranges")


def _chunk_offsets(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier chunks of the key (one input row per key and chunk)."""
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, CHUNK).agg(value.alias("__part"))
        .withColumn(name, F.coalesce(F.sum("__part").over(before), F.lit(0)))
        .drop("__part")
    )


def _with_chunk(left: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    cond = [left[k].eqNullSafe(carry[k]) for k in [*keys, CHUNK]]
    joined = left.join(carry, reduce(lambda a, b: a & b, cond), "left")
    for k in [*keys, CHUNK]:
        joined = joined.drop(carry[k])
    return joined


def chunked_rank(df: DataFrame, keys: list[str], order: list[Column], rank_col: str) -> DataFrame:
    """row_number per key; ``order`` must be total for a repeatable answer."""
    base = _dealt(df, keys, order)
    inner = base.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    carry = _chunk_offsets(base, keys, F.count(F.lit(1)), "__before")
    out = _with_chunk(inner, carry, keys)
    return out.withColumn(rank_col, (F.col("__before") + F.col(RANK)).cast("long")).drop(CHUNK, RANK, "__before")


def chunked_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: str, out_col: str
) -> DataFrame:
    base = _dealt(df, keys, order)
    frame = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = base.withColumn("__run", F.sum(value).over(frame))
    carry = _chunk_offsets(base, keys, F.sum(value), "__before")
    out = _with_chunk(inner, carry, keys)
    return out.withColumn(out_col, F.col("__before") + F.col("__run")).drop(CHUNK, "__run", "__before")


def chunked_lag(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Previous row's values per key in ascending ``order``."""
    base = _dealt(df, keys, order)
    payload = F.struct(*cols)
    inner = base.withColumn("__prev", F.lag(payload).over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    last = base.groupBy(*keys, CHUNK).agg(F.max_by(payload, F.struct(*order)).alias("__last"))
    carry = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy(CHUNK))).drop("__last")
    out = _with_chunk(inner, carry, keys).withColumn("__prev", F.coalesce("__prev", "__carry"))
    for name in cols:
        out = out.withColumn(f"{prefix}{name}", F.col("__prev")[name])
    return out.drop(CHUNK, "__prev", "__carry")


def global_rank(df: DataFrame, order: list[Column], rank_col: str) -> DataFrame:
    """Position in one total order over all rows, without a single-task sort.

    Rows are dealt by range over all order columns, so equal leading values are split by the tie columns; a rank inside each range
    plus the number of rows in earlier ranges is the position.  Counts come back by a join on the range (one row per range).
    ``order`` must be total and cheap (columns): the ranges are written, so ranks and counts see the same ones."""
    dealt = _dealt(df, [], order)
    inner = dealt.withColumn(RANK, F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order)))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = dealt.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return inner.join(sizes, CHUNK).withColumn(rank_col, (F.col("__before") + F.col(RANK)).cast("long")).drop(CHUNK, RANK, "__before")


def modal_label(df: DataFrame, keys: list[str], label: str, out_col: str) -> DataFrame:
    """Most frequent label per key; ties go to the longer, then the alphabetically first label."""
    counted = df.where(F.nullif(F.trim(label), F.lit("")).isNotNull()).groupBy(
        *keys, F.trim(label).alias(out_col)
    ).agg(F.count(F.lit(1)).alias("__n"))
    return best(
        counted, keys, [F.col("__n").desc(), F.length(out_col).desc(), F.col(out_col).asc()]
    ).drop("__n")


def normalise_to_max(df: DataFrame, col: str, out_col: str, scale: float = 100.0) -> DataFrame:
    """Value as a share of the largest one (scalar subquery; no single-partition window)."""
    top = df.agg(F.max(col)).scalar()
    return df.withColumn("__top", top).withColumn(
        out_col, F.when(F.col("__top") > 0, F.col(col) / F.col("__top") * scale).otherwise(0.0)
    ).drop("__top")


def share_of_total(df: DataFrame, col: str, out_col: str, scale: float = 100.0) -> DataFrame:
    total = df.agg(F.sum(col)).scalar()
    return df.withColumn("__sum", total).withColumn(
        out_col, F.when(F.col("__sum") > 0, F.col(col) / F.col("__sum") * scale).otherwise(0.0)
    ).drop("__sum")
