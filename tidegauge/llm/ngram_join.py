"""Jaccard self-join on word shingles with Bayesian candidate pruning.

Documents with equal shingle sets collapse to one representative first, so copies cost one row each.  128 MinHash values of a
representative give 32 band keys of 4 values; two texts with similarity 0.8 share one except with probability 5e-8.  Buckets are
compared in tasks of two blocks of bounded size: a pair is taken in the first bucket that holds both, its MinHash values are
compared 16 at a time, and it is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold
falls below the tolerance.  What is left is verified exactly on the shingle sets.

Tasks return counts of links and a spanning forest, never pairs, so a group of thousands of near copies stays a few rows per text.
Classes are the connected components of links and copies.

Shingles are five words (fewer words: one shingle); similarity 0.8 or more.  Texts without words link to nothing and are classes
of their own.  Rows that repeat an id are one document.  Rows without an id are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.arrays import Words, distinct_per_row, mix, parts, reduce_rows
from tidegauge.llm.shared import bounded, materialise, row_key
from tidegauge.operators.grouping import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-9
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
SEED = 7919


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[rows, HASHES] minima of the shingle hashes under as many permutations (odd multiplication of mixed values)."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint64)
    with np.errstate(over="ignore"):
        for j, a in enumerate(_multipliers()):
            out[:, j] = reduce_rows(np.minimum, values * a, offsets, 0)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """[rows, BANDS] keys; the number of the band is part of the key."""
    key = np.zeros((len(signature), BANDS), np.uint64)
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + grouped[:, :, r] + np.uint64(r + 1))
        return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64))


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[rows, 2] hash of each set of distinct values."""
    with np.errstate(over="ignore"):
        return np.stack([reduce_rows(np.add, mix(values ^ np.uint64(c)), offsets, 0) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)


def posterior_minimum(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: the fewest equal ones with which a pair goes on.

    With a uniform prior P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(docs: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(rid, n, a, b, bands): size and 128-bit key of the shingle set, band keys; texts without words have n = 0."""

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for first, end, data, offsets in parts(batch.column("text")):
                values, at = distinct_per_row(*Words(data, offsets).shingles(k))
                bands = band_keys(minhash(values, at))
                keys = set_keys(values, at).view(np.int64)
                yield pa.record_batch([
                    batch.column("rid").slice(first, end - first), pa.array(np.diff(at)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))],
                    ["rid", "n", "a", "b", "bands"])

    return bounded(docs).select(F.col(key).alias("rid"), F.col(text).alias("text")).mapInArrow(
        sign, "rid long, n long, a long, b long, bands array<long>")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """(rep, a, b, buckets: array<struct<pos,bucket,blocks>>) of representatives that share a bucket with another.

    Buckets with the same members count once (the smallest key stands for them); what tells members apart fits into a long for any count."""
    rows = reps.select("rep", "n", F.posexplode("bands").alias("pos", "bucket"))
    member = F.xxhash64("rep")
    buckets = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.bit_xor(member).alias("s1"),
        F.sum(F.pmod(F.xxhash64(member, F.lit(1)), F.lit(2**31))).alias("s2")).where("m > 1")
    buckets = buckets.groupBy("m", "size", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    buckets = materialise(buckets.select("bucket", blocks.alias("blocks")), "buckets")
    kept = rows.join(buckets, "bucket").groupBy("rep").agg(F.collect_list(F.struct("pos", "bucket", "blocks")).alias("buckets"))  # at most BANDS
    return kept.join(reps.select("rep", "a", "b"), "rep")


def links(docs: DataFrame, members: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v, n): rows with v null count n links of u; the others are edges of spanning forests.  docs: rid, text."""
    least = posterior_minimum(threshold)
    keyed = F.aggregate("buckets", F.array_repeat(F.lit(0).cast("long"), BANDS), lambda acc, x: F.transform(
        acc, lambda v, i: F.when(i == x["pos"], x["bucket"]).otherwise(v)))
    # both sides grow with the documents: a merge at every size
    rows = bounded(members).hint("merge").join(docs, docs["rid"] == members["rep"]).select("rep", "a", "b", "text", keyed.alias("held"), F.explode("buckets").alias("x"))
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("x.blocks"))
    rows = rows.select("rep", "a", "b", "text", "held", F.col("x.pos").alias("pos"), F.col("x.bucket").alias("bucket"), own.alias("own"),
                       F.explode(F.sequence(F.lit(0), F.col("x.blocks") - 1)).alias("other"))
    rows = rows.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rep", "own", "pos", "a", "b", "held", "text")
    tasks = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "rep")

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        at = None
        for batch in stream:
            cols = {c: batch.column(c).to_pylist() for c in ("bucket", "p", "q", "rep", "own", "pos", "a", "b")}
            held = batch.column("held").flatten().to_numpy().reshape(-1, BANDS)
            out = []
            for first, end, data, offsets in parts(batch.column("text")):
                values, rows_at = distinct_per_row(*Words(data, offsets).shingles(k))
                sets = set_keys(values, rows_at).view(np.int64)
                signature = minhash(values, rows_at)
                for i in range(first, end):
                    j = i - first
                    now = (cols["bucket"][i], cols["p"][i], cols["q"][i])
                    if now != at:
                        out += _compared(group, at, threshold, least)
                        group, at = [], now
                    if (sets[j, 0], sets[j, 1]) != (cols["a"][i], cols["b"][i]) or group and group[-1][0] == cols["rep"][i]:
                        continue  # another text of a repeated id, or the same again
                    group.append((cols["rep"][i], cols["own"][i], cols["pos"][i], held[i].copy(), signature[j], values[rows_at[j]:rows_at[j + 1]]))
            yield _result(out)
        yield _result(_compared(group, at, threshold, least))

    return tasks.mapInArrow(compare, "u long, v long, n long")


def _result(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["u", "v", "n"])


def _compared(group: list[tuple], at: tuple | None, threshold: float, least: list[int]) -> list[tuple]:
    """Links of one bucket between blocks p and q (or inside p): counts and a spanning forest."""
    if len(group) < 2:
        return []
    _, p, q = at
    left = [i for i, g in enumerate(group) if g[1] == p]
    right = left if p == q else [i for i, g in enumerate(group) if g[1] == q]
    if not left or not right:
        return []
    pos = group[0][2]
    sizes = np.array([len(g[5]) for g in group])
    held = np.stack([g[3] for g in group])
    signature = np.stack([g[4] for g in group])
    li, ri = np.array(left), np.array(right)
    small, large = np.minimum.outer(sizes[li], sizes[ri]), np.maximum.outer(sizes[li], sizes[ri])
    alive = small >= threshold * large - 1e-9
    if p == q:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    for earlier in range(pos):  # the pair belongs to the first bucket that holds both
        a, b = held[li, earlier], held[ri, earlier]
        if a.any() and b.any():
            alive &= (a[:, None] != b[None, :]) | (a[:, None] == 0)
    x, y = np.nonzero(alive)
    i, j = li[x], ri[y]
    equal = np.zeros(len(i), np.int64)
    for n, need in enumerate(least):
        if not len(i):
            return []
        equal += np.count_nonzero(signature[i, n * STEP:(n + 1) * STEP] == signature[j, n * STEP:(n + 1) * STEP], axis=1)
        go = equal >= need
        i, j, equal = i[go], j[go], equal[go]
    count = np.zeros(len(group), np.int64)
    root = list(range(len(group)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    begin = 0
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for one in np.unique(i):
        stop = int(np.searchsorted(i, one, "right"))
        mine = group[one][5]
        while begin < stop:  # partners in runs of bounded size
            end = min(stop, begin + max(1, BLOCK_SHINGLES // max(1, int(sizes[j[begin:stop]].max()))))
            partners = j[begin:end]
            theirs = np.concatenate([group[t][5] for t in partners])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            ends = np.cumsum(sizes[partners])
            both = np.diff(np.concatenate([[0], np.cumsum(mine[place] == theirs)[ends - 1]]))
            similar = both >= threshold * (sizes[one] + sizes[partners] - both) - 1e-9
            for other in partners[similar].tolist():
                count[one] += 1
                count[other] += 1
                a, b = find(int(one)), find(other)
                if a != b:
                    low, high = (a, b) if group[a][0] < group[b][0] else (b, a)
                    root[high] = low
            begin = end
    for v in range(len(group)):
        if count[v]:
            out.append((group[v][0], None, int(count[v])))
            if (r := find(v)) != v:
                out.append((group[v][0], group[r][0], 0))
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, class_id, n_links, n_copies) per row of docs: the smallest id of its class, the number of different texts it is linked to,
    and the number of other rows with the same shingles.  ``rid`` is the id (or a hash of the text where there is none)."""
    texts = docs.select(row_key(key, text).alias("rid"), F.col(text).alias("text"))
    signed = materialise(signatures(texts, "rid", "text", k), "signatures")
    reps = signed.where("n > 0").groupBy("a", "b").agg(
        F.min("rid").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialise(reps, "representatives")
    found = materialise(links(texts, materialise(shared_buckets(reps), "members"), k, threshold), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n_links"))
    parts_ = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    table = reps.select("a", "b", "rep", "rows").join(counts, "rep", "left").join(parts_, "rep", "left")
    table = table.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.coalesce("component", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("links"), "rows")
    out = signed.select("rid", "n", "a", "b").join(table, (F.col("n") > 0) & (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), "left")
    return out.select("rid", F.coalesce("class", "rid").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      (F.coalesce("rows", F.lit(1)) - 1).alias("n_copies"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: the one with the smallest id.  Texts without a word, which have no shingles, are of one class if they are equal;
    rows without a text (null) each stay."""
    keyed = docs.withColumn("__rid", row_key(key, text))
    found = classes(docs, key, text, k, threshold)
    bare = ~F.col(text).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    plain = docs.where(bare).select(row_key(key, text).alias("rid"), F.sha2(F.col(text).cast("binary"), 256).alias("same"))
    first = plain.groupBy("same").agg(F.min("rid").alias("first"))
    wordless = materialise(plain.join(first, "same").groupBy("rid").agg(F.min("first").alias("first")), "wordless")
    found = found.join(wordless, "rid", "left").withColumn("class_id", F.least("class_id", F.coalesce("first", "class_id")))
    decided = found.groupBy("rid").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("__rows"))
    kept = materialise(decided.where("class_id = rid").select(F.col("rid").alias("__rid"), "__rows"), "kept")
    out = keyed.join(kept.hint("merge"), "__rid")  # both sides grow with the documents
    once, again = out.where(F.col("__rows") == 1), out.where(F.col("__rows") > 1).dropDuplicates(["__rid"])
    return once.unionByName(again).select(*docs.columns)


__all__ = ["band_keys", "classes", "links", "minhash", "one_of_each", "posterior_minimum", "signatures"]
