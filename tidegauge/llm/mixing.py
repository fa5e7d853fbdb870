"""Mixing sources to target weights: budgets fitted as subset sums.

Every source gets a budget in words.  Whole passes over the source come first; what remains is fitted by document length:
documents are counted by exact length, each length gives its share, and a bounded knapsack over lengths (dynamic programming
on a bounded remainder) closes the gap, to the word where lengths allow it.  Which documents of a length are taken is decided
by a seeded hash of the id.

Null texts have size 0, a null source is a source of its own (last), rows with equal ids, sources and sizes are interchangeable.
No document is taken more than twice.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.shared import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # passes over a source at most
SEED = 20240607
GAP = 1 << 17  # remainder, in words, that the dynamic programme fits
BUCKETS = 1024  # hash ranges of a length, so that choosing documents never sorts a whole length


def size_of(text) -> Column:
    """Runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """docs with __source, __size, __h (seeded hash) and __b (its range)."""
    return docs.withColumns({"__source": F.col(source), "__size": size_of(text), "__h": F.xxhash64(F.lit(seed), F.col(doc_id).cast("long"))}
                            ).withColumn("__b", F.pmod("__h", F.lit(BUCKETS)).cast("int"))


def targets(hist: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(__source, __source_size, __target) from (__source, __size, n).

    Targets are min(most x size, level x weight) for the one level at which they add up to the share of all words: what
    capping a source frees goes to the others by weight until none is above.  The level is found on one row per source."""
    sizes = hist.groupBy("__source").agg(F.sum(F.col("__size") * F.col("n")).alias("__source_size"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("__source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("__source_size").cast("double") * most
    table = sizes.withColumn("w", w).withColumn("room", cap / F.col("w"))
    before = F.coalesce(F.sum(cap).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum(F.col("__source_size").cast("double")).over(everything) * share - before) / open_w
    table = table.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything))  # the first source not capped
    return table.select("__source", "__source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("__target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(passes over everything, further documents of each length).  Words taken = passes x all words + lengths . further."""
    total = int((lengths * counts).sum())
    if not total or target <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    passes = min(MOST, int(target // total))
    budget = int(round(target - passes * total)) if passes < MOST else 0
    take = np.zeros(len(lengths), np.int64)
    if budget >= total:
        return passes + 1, take
    if budget <= 0:
        return passes, take
    usable = lengths > 0
    take[usable] = np.minimum(counts[usable], [int(c) * budget // total for c in counts[usable]])
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths):  # the longest first, down to what the programme can fit
        if rest <= GAP or not lengths[i]:
            break
        more = min(int(counts[i] - take[i]), (rest - GAP // 2) // int(lengths[i]))
        if more > 0:
            take[i] += more
            rest -= more * int(lengths[i])
    return passes, take + knapsack(lengths, counts - take, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: how many of each length come nearest to the budget (of two equally near sums, the smaller); exact if the
    lengths allow.  Sums run to the budget and one more document."""
    take = np.zeros(len(lengths), np.int64)
    most = budget + int(lengths[counts > 0].max(initial=0))
    came = np.full(most + 1, -1, np.int64)  # bundle by which a sum was first reached
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    bundles: list[tuple[int, int]] = []
    for i in np.argsort(lengths):
        length = int(lengths[i])
        left, size = (min(int(counts[i]), most // length), 1) if length else (0, 1)
        while left > 0 and not reached[budget]:
            k = min(size, left)
            step = k * length
            new = np.zeros(most + 1, bool)
            new[step:] = reached[:most + 1 - step] & ~reached[step:]
            came[new] = len(bundles)
            reached |= new
            bundles.append((i, k))
            left, size = left - k, size * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, k = bundles[came[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__size").reset_index(drop=True)
    passes, take = fit_budget(pdf["__size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["__target"].iloc[0]))
    return pd.DataFrame({"__source": pdf["__source"], "__size": pdf["__size"], "__source_size": pdf["__source_size"],
                         "__target": pdf["__target"], "__passes": passes, "further": take})


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def plan(rows: DataFrame) -> DataFrame:
    """Stored decision per (__source, __size, __b): __source_size, __target, __passes, and ``__some`` of its documents once more.

    rows: __source, __size, __b.  A source's lengths meet in one task (as many rows as it has different lengths, never its documents)."""
    cells = rows.groupBy("__source", "__size", "__b").agg(F.count(F.lit(1)).alias("n"))
    hist = cells.groupBy("__source", "__size").agg(F.sum("n").alias("n"))
    wanted = targets(hist)
    fitted = hist.join(wanted, _same(hist, wanted, ["__source"])).drop(wanted["__source"]).groupBy("__source").applyInPandas(
        _fit, f"__source {hist.schema['__source'].dataType.simpleString()}, __size long, __source_size long, __target double, __passes int, further long")
    ordered = Window.partitionBy("__source", "__size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(ordered), F.lit(0)))
    joined = cells.join(fitted, _same(cells, fitted, ["__source", "__size"])).drop(fitted["__source"], fitted["__size"])
    some = F.least(F.col("n"), F.greatest(F.lit(0), F.col("further") - F.col("before")))
    return materialise(joined.select("__source", "__size", "__b", "__source_size", "__target", "__passes", some.alias("__some"),
                                     ((some > 0) & (some < F.col("n"))).alias("__split")), "mix-plan")


def apply(rows: DataFrame, decided: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows (as ``prepared`` gives them) with __source_size, __target and ``__copies`` (0 to 2).

    Only hash ranges that are taken in part are ranked, inside the range."""
    out = rows.join(decided.hint("merge"), _same(rows, decided, ["__source", "__size", "__b"])).drop(*[decided[c] for c in ("__source", "__size", "__b")])
    rank = F.row_number().over(Window.partitionBy("__source", "__size", "__b").orderBy("__h", doc_id))
    whole = out.where(~F.col("__split")).withColumn("__copies", F.col("__passes") + (F.col("__some") > 0).cast("int"))
    part = out.where("__split").withColumn("__r", rank).withColumn("__copies", F.col("__passes") + (F.col("__r") <= F.col("__some")).cast("int")).drop("__r")
    return whole.unionByName(part).drop("__passes", "__some", "__split")


__all__ = ["apply", "fit_budget", "knapsack", "plan", "prepared", "size_of", "targets"]
