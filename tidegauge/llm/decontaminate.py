"""Benchmark decontamination: which documents contain test items.

A document contains an item when it holds at least 80 % of the item's different shingles (five words; an item of fewer words is one
shingle of all its words).  The search is a size-partitioned MinHash containment search:

* items and documents are partitioned by the number of their shingles (powers of two).  An item's partition fixes how many of the
  lowest hash values its signature keeps: with n shingles and threshold t, floor((1 - t) n) + 1 values, so a document that contains
  the item holds at least one of them.  Candidates are therefore never missed, which banded signatures cannot promise for an item
  of forty words in a document of twenty thousand.  Document partitions too small for an item are skipped.
* candidates are verified by exact containment: the shingles themselves, not hashes, are compared.

Documents are probed shingle by shingle where they are; only (document, item) candidates leave a task.  The signatures are written
first, so the planner knows their size: it broadcasts them while they are small and shuffles beyond.

Items or documents without words match nothing.  Equal items give the same result each; repeated document rows count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.arrays import Words, distinct_per_row, fold, parts
from tidegauge.llm.shared import bounded, materialise

SHINGLE = 5
THRESHOLD = 0.8
ITEMS_IN_MEMORY = 2_000_000  # signature values that a task keeps as one sorted array (16 MB); beyond, they are joined


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signature_size(n: np.ndarray, threshold: float) -> np.ndarray:
    """Values kept for n shingles: one more than may be missing."""
    return (n - np.ceil(n * threshold - 1e-9) + 1).astype(np.int64)


def signatures(items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(item, n, size_class, value): the lowest hash values of each item, as many as its size class asks for its n shingles."""

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for first, end, data, offsets in parts(batch.column("text")):
                values, at = distinct_per_row(*Words(data, offsets).shingles(k))
                n = np.diff(at)
                keep = np.minimum(signature_size(n, threshold), n)
                # rows are sorted by value: the lowest come first
                low = np.arange(len(values)) - np.repeat(at[:-1], n) < np.repeat(keep, n)
                row = np.repeat(np.arange(first, end), n)[low]
                size = np.repeat(n, n)[low]
                yield pa.record_batch([batch.column("item").take(pa.array(row)), pa.array(size), pa.array(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)),
                                       signed(values[low])], ["item", "n", "size_class", "value"])

    return items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).mapInArrow(
        sign, "item long, n long, size_class long, value long")


def probes(docs: DataFrame, key: str, text: str, wanted: np.ndarray | None, least: int, k: int = SHINGLE) -> DataFrame:
    """(doc, n, value): different shingles of documents with at least ``least``; only wanted values, if they fit in memory."""

    def probe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for first, end, data, offsets in parts(batch.column("text")):
                values, at = Words(data, offsets).shingles(k)
                n = np.diff(at)
                row = np.repeat(np.arange(end - first), n)
                if wanted is not None:
                    hit = np.flatnonzero(_member(values, wanted))
                    values, row = values[hit], row[hit]
                some = np.flatnonzero(np.repeat(n >= least, n)[hit] if wanted is not None else np.repeat(n >= least, n))
                values, row = values[some], row[some]
                if len(values):
                    order = np.lexsort((values, row))
                    values, row = values[order], row[order]
                    new = np.ones(len(values), bool)
                    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
                    values, row = values[new], row[new]
                    yield pa.record_batch([batch.column("doc").take(pa.array(row + first)), pa.array(n[row]), signed(values)], ["doc", "n", "value"])

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(probe, "doc long, n long, value long")


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Membership in a sorted array, after a look at a bit table of the top 20 bits."""
    table = np.zeros(1 << 20, bool)
    table[(wanted >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(values >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, values[maybe]), len(wanted) - 1)
    out = np.zeros(len(values), bool)
    out[maybe[wanted[at] == values[maybe]]] = True
    return out


def shingle_set(text: str | None, k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), hashes=False)
    low = fold(data).tobytes()
    words = [low[s:e] for s, e in zip(w.start.tolist(), w.end.tolist())]
    if len(words) <= k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, item, containment) of every pair that reaches the threshold.  Rows without a document or item id take no part in the
    result (a caller that filters gives every row a key first)."""
    marks = materialise(signatures(items, item_id, item_text, k, threshold).where("item is not null"), "signatures")
    facts = marks.agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).first()
    least = max(1, math.ceil((facts["least"] or 1) * threshold - 1e-9))
    wanted = None
    if facts["n"] <= ITEMS_IN_MEMORY:  # counted: at most 16 MB
        wanted = np.unique(np.array([r[0] for r in marks.select("value").distinct().collect()], np.int64).view(np.uint64))
        if not len(wanted):
            wanted = np.zeros(1, np.uint64)
    rows = bounded(docs).where(F.col(key).isNotNull())
    found = probes(rows, key, text, wanted, least, k)
    pairs = found.join(marks.withColumnRenamed("n", "m"), "value").where(
        F.col("n") >= F.ceil(F.col("m") * F.lit(threshold) - F.lit(1e-9))).select("doc", "item").distinct()
    pairs = materialise(pairs, "candidates")
    texts = rows.select(F.col(key).alias("doc"), F.col(text).alias("doc_text")).join(pairs, "doc")
    item_texts = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("item_text"))

    def verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in stream:
            doc, item, share = [], [], []
            for d, i, dt, it in zip(*(batch.column(c).to_pylist() for c in ("doc", "item", "doc_text", "item_text"))):
                if last[0] != dt:
                    last = (dt, shingle_set(dt, k))
                want = shingle_set(it, k)
                got = len(want & last[1]) / max(1, len(want))
                if want and got >= threshold - 1e-12:
                    doc.append(d)
                    item.append(i)
                    share.append(got)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["doc", "item", "containment"])

    checked = texts.join(item_texts, "item").select("doc", "item", "doc_text", "item_text").mapInArrow(verify, "doc long, item long, containment double")
    return checked.groupBy("doc", "item").agg(F.max("containment").alias("containment"))


__all__ = ["contained_items", "shingle_set", "signature_size", "signatures"]
