"""Search for the phrases that can win: bounds of every phrase's score from counts by code, and whole rows of the phrases whose bound reaches what is sure to be won.

Most phrases of a large table can neither be the best of a document nor among the best of all, yet statistics of all of them take many times the size
of the texts.  Here the words of the documents are written once, some documents to a row (a batch).  A batch sends every code of its phrases with the number of
documents and their weight to the code's bucket, which adds up and answers with two bounds of the phrase's score.  Every batch then keeps, for
each of its documents, the codes whose upper bound reaches the best lower ones.  Only those codes are looked up again as words, in all documents, and
``grouping.phrase_stats`` counts them exactly.

Upper bounds hold whatever two phrases share a code (48 bits).  Lower ones are only a guess: what was found is compared with the level that was searched, and the search goes on
where the exact score stays below it, in the end with all phrases of the document.  Codes are dealt in up to ``PASSES`` ranges, one after the other, and the files that dealt a range are
removed when its answers are written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidegauge.functions import labels as lb
from tidegauge.session import drop_scratch, materialise, scratch_path

PASSES, PASS = 4, 1 << 22  # ranges of codes at most, and codes that make a further one
BUCKET = 1 << 20  # codes that one bucket gets in one pass, about
KEPT = 16  # lower bounds of a document that the codes kept for it must reach
BATCH_ROWS, BATCH_BYTES = 60_000, 8 << 20
DOC = np.uint64(16)  # bits of a sorted code that hold the document's place in its batch
LEAST_BITS, MOST_BITS, PAGE = 1 << 16, 1 << 28, 32768


@contextmanager
def tidy(spark: SparkSession):
    """Queries that end in here remove the files of their shuffles at once: what they return is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    with tidy(df.sparkSession):
        return materialise(df, label)


@contextmanager
def passing(df: DataFrame, label: str):
    """df, written, and removed behind the block: nothing that leaves it may read the table."""
    path = scratch_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    yield df.sparkSession.read.schema(df.schema).parquet(path)
    drop_scratch(df.sparkSession, path)


# -- batches --------------------------------------------------------------------------------


def batches(docs: DataFrame, doc: str, text: str, keep: list[str]) -> DataFrame:
    """(batch, n, words, ids, lens, rows), written: the informative words of some documents as numbers of the batch's different words, and the documents' other columns."""
    flat = docs.select(doc, *keep, lb.informative_tokens(lb.narrative_tokens(text)).alias("__toks"))
    held = T.StructType([f for f in flat.schema.fields if f.name != "__toks"])
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())),
                           T.StructField("ids", T.BinaryType()), T.StructField("lens", T.BinaryType()), T.StructField("rows", T.ArrayType(held))])

    def pack(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for whole in some:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                toks = b.column(b.schema.get_field_index("__toks"))
                lens = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int32)
                coded = toks.flatten().dictionary_encode()
                others = pa.StructArray.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in held.fields], names=[f.name for f in held.fields])
                words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                ids = pa.compress(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([int(lens.sum())], pa.int64()), words, pa.array([ids], pa.binary()), pa.array([lens.tobytes()], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(others)], pa.int32()), others)], names=["batch", "n", "words", "ids", "lens", "rows"])
                number += 1

    flat.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return written(flat.mapInArrow(pack, schema), "informative-words")


class Batch:
    """Words of some documents: ``code`` of every word, and the document of every place."""

    def __init__(self, words: pa.Array, ids: bytes, lens: bytes, n: int):
        self.words = words
        self.ids = np.frombuffer(pa.decompress(ids, decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32)
        self.lens = np.frombuffer(lens, np.int32)
        hashes = pd.util.hash_array(np.asarray(self.words.to_numpy(zero_copy_only=False), dtype=object), categorize=False) if len(self.words) else np.zeros(0, np.uint64)
        self.code = hashes[self.ids]
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, code) of every run of so many words of a document; the code is that of the set of its words."""
        m = max(0, len(self.code) - size + 1)
        word = [self.code[j:j + m] for j in range(size)]
        out = word[0].copy()
        for j in range(1, size):
            again = reduce(lambda x, y: x | y, [word[j] == word[k] for k in range(j)])
            out ^= np.where(again, np.uint64(0), word[j])
        whole = np.flatnonzero(self.doc[:m] == self.doc[size - 1:size - 1 + m])
        return whole, out[whole] >> DOC << DOC

    def spelling(self, at: np.ndarray, size: int) -> np.ndarray:
        """Code of the words of a run in their order."""
        with np.errstate(over="ignore"):
            return reduce(lambda x, y: x * np.uint64(0x9E3779B97F4A7C15) + y, [self.code[at + j] for j in range(size)], np.full(len(at), size, np.uint64))

    def phrases(self, sizes, of: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, doc, spellings) of the phrases of each document in one of the equal ranges of codes, by code and document."""
        codes, docs, spelled = [], [], []
        for size in sizes:
            at, code = self.runs(size)
            mine = place(code, parts) == of
            at, code = at[mine], code[mine]
            codes.append(code)
            docs.append(self.doc[at].astype(np.uint64))
            spelled.append(self.spelling(at, size))
        key = np.concatenate(codes) | np.concatenate(docs)
        order = np.argsort(key)
        key, spelled = key[order], np.concatenate(spelled)[order]
        first = np.flatnonzero(changes(key))
        times = np.diff(np.append(first, len(key)))
        n = np.ones(len(first), np.int64)
        if (often := times > 1).any():  # phrases that come again in their document, perhaps in another order of the words
            inside = np.repeat(often, times)
            group, spell = np.repeat(np.arange(len(first)), times)[inside], spelled[inside]
            order = np.lexsort((spell, group))
            new = changes(group[order]) | changes(spell[order])
            n[often] = np.bincount(group[order][new], minlength=len(first))[often]
        key = key[first]
        return key >> DOC << DOC, (key & np.uint64(0xFFFF)).astype(np.int64), n


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def place(code: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges a code lies in."""
    return (code >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


# -- bounds --------------------------------------------------------------------------------


def _sent(base: DataFrame, weight: str, sizes, of: int, parts: int, buckets: int) -> DataFrame:
    """(bucket, batch, codes, docs, w): what the batches send of one range of codes."""

    def work(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for i in range(b.num_rows):
                x = {c: b.column(j) for j, c in enumerate(b.schema.names)}
                batch = Batch(x["words"][i].values, x["ids"][i].as_py(), x["lens"][i].as_py(), x["n"][i].as_py())
                code, doc, n = batch.phrases(sizes, of, parts)
                first = np.flatnonzero(changes(code))
                if not len(first):
                    continue
                docs = np.diff(np.append(first, len(code))).astype(np.uint16)
                w = np.add.reduceat(pc.fill_null(x["weights"][i].values, 0.0).to_numpy(zero_copy_only=False)[doc] * n, first)
                code = code[first]
                # six bytes of a code; a weight's upper half, rounded up
                six = np.ascontiguousarray((code >> DOC).view(np.uint8).reshape(-1, 8)[:, :6])
                short = _short(w)
                to = (place(code, parts * buckets) - np.uint64(of * buckets)).astype(np.int64)
                cuts = np.flatnonzero(changes(to))
                pack = lambda v: pa.compress(np.ascontiguousarray(v).tobytes(), codec="zstd", asbytes=True)
                spans = list(zip(cuts, np.append(cuts[1:], len(code))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cuts], pa.int64()), pa.array(np.full(len(cuts), x["batch"][i].as_py()), pa.int64()), pa.array([e - s for s, e in spans], pa.int32()),
                     pa.array([six[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([pack(docs[s:e]) for s, e in spans], pa.binary()),
                     pa.array([pack(short[s:e]) for s, e in spans], pa.binary())], names=["bucket", "batch", "n", "codes", "docs", "w"])

    return base.select("batch", "n", "words", "ids", "lens", F.col(f"rows.{weight}").cast("array<double>").alias("weights")).mapInArrow(
        work, "bucket long, batch long, n int, codes binary, docs binary, w binary")


def _short(w: np.ndarray) -> np.ndarray:
    """Upper halves of the least short floats that are not below."""
    near = w.astype(np.float32)
    near = np.where(near < w, np.nextafter(near, np.float32(np.inf)), near)
    bits = near.view(np.uint32)
    up = (near > 0) & (bits & np.uint32(0xFFFF) > 0)
    return ((bits >> np.uint32(16)) + up).astype(np.uint16)


class Limits:
    """Bounds of a phrase's score from the documents (rows) and weights of its code."""

    def __init__(self, sizes, roots: int, authors: int, sources: int, copies: int):
        self.words, self.most, self.copies = min(72, 12 * max(sizes)), ((10, roots), (12, authors), (16, sources)), max(1, copies)

    def __call__(self, docs: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper), zero and minus infinity where the code stands in one document only."""
        upper = w + docs * 28 + sum(v * np.minimum(docs, most) for v, most in self.most) + self.words
        lower = w - np.abs(w) / 128 + np.ceil(docs / self.copies) * 28
        one = docs < 2
        return np.where(one, -np.inf, lower).astype(np.float32), np.where(one, -np.inf, upper * (1 + 1e-6 * np.sign(upper)) + 1e-3).astype(np.float32)


def _added(table: pa.Table) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(batch and number of codes of every row, code of every entry, its group, documents and weight of every group) of a bucket."""
    rows = table.to_pylist()
    open_ = lambda r, c, size: pa.decompress(r[c], decompressed_size=size * r["n"], codec="zstd", asbytes=True)
    six = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(-1, 6) for r in rows])
    code = np.zeros((len(six), 8), np.uint8)
    code[:, 2:] = six
    code = code.view(np.uint64).ravel()
    docs = np.concatenate([np.frombuffer(open_(r, "docs", 2), np.uint16) for r in rows]).astype(np.float64)
    w = np.concatenate([np.frombuffer(open_(r, "w", 2), np.uint16) for r in rows]).astype(np.uint32) << np.uint32(16)
    unique, group = np.unique(code, return_inverse=True)
    add = lambda v: np.bincount(group, v, len(unique))
    return [(r["batch"], r["n"]) for r in rows], unique, group, add(docs), add(w.view(np.float32).astype(np.float64))


def _answers(sent: DataFrame, limits: Limits) -> DataFrame:
    """(batch, bucket, bounds): the lower and the upper bounds of the codes that a batch sent, in their order."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        heads, _, group, docs, w = _added(table)
        lower, upper = limits(docs, w)
        ends = np.cumsum([n for _, n in heads])
        both = [np.concatenate([lower[group[e - n:e]], upper[group[e - n:e]]]).tobytes() for (_, n), e in zip(heads, ends)]
        return pa.table({"batch": pa.array([b for b, _ in heads], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(heads), pa.int64()),
                         "bounds": pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in both], pa.binary()), "n": pa.array([n for _, n in heads], pa.int32())})

    return sent.groupBy("bucket").applyInArrow(work, "batch long, bucket long, bounds binary, n int")


def _best_of(doc: np.ndarray, lower: np.ndarray, upper: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries kept, best lower bound, n-th best one of each entry's document): the entries whose upper bound reaches the n-th best lower one."""
    order = np.lexsort((-lower, doc))
    first = np.flatnonzero(changes(doc[order]))
    sizes = np.diff(np.append(first, len(order)))
    best = lower[order[first]]
    last = np.where(sizes >= n, lower[order[np.minimum(first + n - 1, len(order) - 1)]], -np.inf).astype(np.float32)
    best, last = np.repeat(best, sizes), np.repeat(last, sizes)
    kept = upper[order] >= last
    return order[kept], best[kept], last[kept]


def _kept(base: DataFrame, answers: DataFrame, sizes, of: int, parts: int) -> DataFrame:
    """(batch, docs, codes, lower, upper): what each document of a batch keeps of one range of codes."""

    def work(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["batch", "docs", "codes", "lower", "upper"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c == "batch" else pa.binary()) for c in names})
        x = left.combine_chunks().to_batches()[0]
        x = {c: x.column(j) for j, c in enumerate(x.schema.names)}
        code, doc, _ = Batch(x["words"][0].values, x["ids"][0].as_py(), x["lens"][0].as_py(), x["n"][0].as_py()).phrases(sizes, of, parts)
        group = np.cumsum(changes(code)) - 1
        bounds = [np.frombuffer(pa.decompress(r["bounds"], decompressed_size=8 * r["n"], codec="zstd", asbytes=True), np.float32).reshape(2, -1)
                  for r in sorted(right.to_pylist(), key=lambda r: r["bucket"])]
        lower, upper = np.concatenate(bounds, axis=1)
        shared = np.flatnonzero((upper > -np.inf)[group])
        code, doc, lower, upper = code[shared], doc[shared], lower[group[shared]], upper[group[shared]]
        kept = _best_of(doc, lower, upper, KEPT)[0]
        values = [doc[kept].astype(np.int32), code[kept], lower[kept], upper[kept]]
        return pa.table({"batch": x["batch"].slice(0, 1), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(names[1:], values)}})

    return base.select("batch", "n", "words", "ids", "lens").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        work, "batch long, docs binary, codes binary, lower binary, upper binary")


def best_codes(base: DataFrame, weight: str, sizes, limits: Limits) -> DataFrame:
    """(row, code, best, last, first), written: for every document the codes whose upper bound reaches its ``KEPT``-th best lower bound (``last``; minus infinity if
    all its shared codes are here), and whether it reaches the best one too."""
    def work(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        doc, code, lower, upper = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (
            ("docs", np.int32), ("codes", np.uint64), ("lower", np.float32), ("upper", np.float32)))
        at, best, last = _best_of(doc, lower, upper, KEPT)
        return pa.table({"row": pa.array((key[0].as_py() << 16) + doc[at].astype(np.int64), pa.int64()), "code": pa.array(code[at].view(np.int64), pa.int64()),
                         "best": pa.array(best, pa.float32()), "last": pa.array(last, pa.float32()), "first": pa.array(upper[at] >= best, pa.bool_())})

    with ExitStack() as passes:
        kept = []
        for of, parts, buckets in _ranges(base, sizes):
            with passing(_answers(_sent(base, weight, sizes, of, parts, buckets), limits), "phrase-bounds") as answers:
                kept.append(passes.enter_context(passing(_kept(base, answers, sizes, of, parts), "phrases-kept")))
        return written(reduce(DataFrame.unionAll, kept).groupBy("batch").applyInArrow(work, "row long, code long, best float, last float, first boolean"), "phrases-to-count")


def top_codes(base: DataFrame, weight: str, sizes, limits: Limits, n: int) -> tuple[DataFrame, float]:
    """(code), written, of all codes whose upper bound reaches the n-th best lower bound of all, and that bound; minus infinity if these are all shared codes."""

    def work(_: tuple, table: pa.Table) -> pa.Table:
        _, code, _, docs, w = _added(table)
        lower, upper = limits(docs, w)
        shared = np.flatnonzero(upper > -np.inf)
        code, lower, upper = code[shared], lower[shared], upper[shared]
        kept = _best_of(np.zeros(len(code), np.int64), lower, upper, n)[0]
        return pa.table({"code": pa.array(code[kept].view(np.int64), pa.int64()), "lower": pa.array(lower[kept], pa.float32()), "upper": pa.array(upper[kept], pa.float32())})

    found = [written(_sent(base, weight, sizes, of, parts, buckets).groupBy("bucket").applyInArrow(work, "code long, lower float, upper float"), "bounded-phrases")
             for of, parts, buckets in _ranges(base, sizes)]
    every = reduce(DataFrame.unionAll, found)
    level = every.orderBy(F.col("lower").desc()).select("lower").limit(n).agg(F.count("lower").alias("n"), F.min("lower").alias("level")).first()
    level = level["level"] if level["n"] == n else float("-inf")
    return written(every.where(F.col("upper") >= F.lit(level)).select("code"), "phrases-to-count"), level


def _ranges(base: DataFrame, sizes) -> list[tuple[int, int, int]]:
    """(number, of how many, buckets) of every range of codes."""
    codes = (base.agg(F.sum("n")).first()[0] or 0) * len(sizes)
    passes = min(PASSES, 1 + codes // PASS)
    return [(of, passes, max(1, ceil(codes / passes / BUCKET))) for of in range(passes)]


# -- rows of some codes -----------------------------------------------------------------------


class Filter:
    """Membership of bounded size: a wrong yes costs a row that the join behind it drops."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def holds(self, code: np.ndarray) -> np.ndarray:
        at = (code >> DOC & np.uint64(len(self.data) * 8 - 1)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def filter_of(codes: DataFrame) -> Filter:
    count, bits = codes.count(), LEAST_BITS
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    at = F.shiftrightunsigned("code", 16).bitwiseAND(bits - 1) + 1  # Spark numbers bits from 1
    pages = codes.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    data = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():
        data[(r.page - 1) * PAGE // 8:r.page * PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return Filter(data)


def rows_of(base: DataFrame, sizes, codes: DataFrame) -> DataFrame:
    """(row, doc, keep.., code, phrase): every different phrase of each document whose code is among the given ones."""
    test = filter_of(codes)
    held = base.schema["rows"].dataType.elementType
    schema = T.StructType([T.StructField("row", T.LongType()), *held.fields, T.StructField("code", T.LongType()), T.StructField("phrase", T.StringType())])

    def work(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for i in range(b.num_rows):
                x = {c: b.column(j) for j, c in enumerate(b.schema.names)}
                batch = Batch(x["words"][i].values, x["ids"][i].as_py(), x["lens"][i].as_py(), x["n"][i].as_py())
                found = []
                for size in sizes:
                    at, code = batch.runs(size)
                    mine = test.holds(code)
                    at, code = at[mine], code[mine]
                    phrase = pc.binary_join_element_wise(*[batch.words.take(pa.array(batch.ids[at + j])) for j in range(size)], " ")
                    found.append(pa.table({"doc": pa.array(batch.doc[at]), "code": pa.array(code.view(np.int64)), "phrase": phrase.cast(pa.string())}))
                out = pa.concat_tables(found).group_by(["doc", "code", "phrase"]).aggregate([]).combine_chunks()
                if not out.num_rows:
                    continue
                at = out["doc"].combine_chunks()
                others = x["rows"][i].values
                row = pa.array((x["batch"][i].as_py() << 16) + at.to_numpy().astype(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([row, *[others.field(f.name).take(at) for f in held.fields], out["code"].combine_chunks(), out["phrase"].combine_chunks()], names=schema.names)

    return base.mapInArrow(work, schema).join(codes, "code", "left_semi").select(*schema.names)


def in_two(rows: DataFrame, doc: str) -> DataFrame:
    """Rows whose code stands in two documents."""
    shared = rows.groupBy("code").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo <> hi").select("code")
    return rows.join(shared, "code", "left_semi").select(*rows.columns)


def codes_of(base: DataFrame, sizes, rows: DataFrame) -> DataFrame:
    """(code), written, of all phrases of the given documents (rows)."""
    wanted = rows.select(F.shiftright("row", 16).alias("batch"), F.col("row").bitwiseAND(0xFFFF).cast("int").alias("i")).groupBy("batch").agg(F.collect_list("i").alias("wanted"))

    def work(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for i in range(b.num_rows):
                x = {c: b.column(j) for j, c in enumerate(b.schema.names)}
                batch = Batch(x["words"][i].values, x["ids"][i].as_py(), x["lens"][i].as_py(), x["n"][i].as_py())
                mine = np.zeros(len(batch.lens), bool)
                mine[x["wanted"][i].values.to_numpy()] = True
                code = np.unique(np.concatenate([code[mine[batch.doc[at]]] for at, code in map(batch.runs, sizes)]))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64))], names=["code"])

    return written(base.join(wanted, "batch").select("n", "words", "ids", "lens", "wanted").mapInArrow(work, "code long").distinct(), "phrases-to-count")


# -- the two searches ---------------------------------------------------------------------------


def limits_of(docs: DataFrame, doc: str, root: str, author: str, source: str, sizes) -> Limits:
    n = docs.agg(*[F.count_distinct(x).alias(k) for k, x in (("roots", root), ("authors", author), ("sources", source))]).first().asDict()
    copies = docs.groupBy(doc).count().agg(F.max("count")).first()[0]
    return Limits(sizes, copies=copies or 1, **n)


def top_phrases(docs: DataFrame, doc: str, text: str, keep: list[str], weight: str, root: str, author: str, source: str, limit: int, stats: Callable[[DataFrame], DataFrame], sizes=(2, 3, 4)) -> DataFrame:
    """The ``limit`` phrases of the highest score among those that ``stats`` gives for rows."""
    base, limits, n = batches(docs, doc, text, keep), limits_of(docs, doc, root, author, source, sizes), limit * 3
    while True:
        codes, level = top_codes(base, weight, sizes, limits, n)
        with passing(rows_of(base, sizes, codes), "phrases") as rows:
            found = written(stats(in_two(rows, doc)).orderBy(F.round("score", 6).desc(), F.col("key").asc()).limit(limit), "best-phrases")
        if level == float("-inf"):
            return found
        sure = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        if sure["n"] == limit and sure["least"] >= level:
            return found.orderBy(F.round("score", 6).desc(), F.col("key").asc())
        n *= 16


def winners(docs: DataFrame, doc: str, text: str, keep: list[str], weight: str, root: str, author: str, source: str, stats: Callable[[DataFrame], DataFrame], scored: Callable[[DataFrame, DataFrame], DataFrame], sizes=(2, 3, 4)) -> DataFrame:
    """(row, doc, best), best a struct of s and key: the best phrase of every document that has one; ``scored`` gives (row, doc, best) from rows and what ``stats`` gives for them.

    Documents are searched at three levels: the codes that reach their best lower bound, all codes kept, all codes."""
    base, limits = batches(docs, doc, text, keep), limits_of(docs, doc, root, author, source, sizes)
    kept = best_codes(base, weight, sizes, limits)

    def found(codes: DataFrame, among: DataFrame) -> DataFrame:
        with passing(rows_of(base, sizes, codes), "phrases") as rows:
            shared = in_two(rows, doc)
            with passing(stats(shared), "phrase-stats") as known:
                return written(scored(shared, known).join(among.select("row"), "row", "left_semi"), "phrases-won")

    def below(won: DataFrame, levels: DataFrame, level: Column) -> DataFrame:
        """Documents whose best phrase so far is not sure to be the best."""
        sure = won.select("row", (-F.col("best.s")).alias("score"))
        return written(levels.join(sure, "row", "left").where((level > F.lit(float("-inf"))) & ~F.coalesce(F.col("score") >= level, F.lit(False))).select("row", "last"), "documents-left")

    every = kept.groupBy("row").agg(F.max("best").alias("best"), F.max("last").alias("last"))
    won = found(written(kept.where("first").select("code").distinct(), "phrases-to-count"), every)
    settled, open_ = [], below(won, every.withColumnRenamed("best", "level"), F.col("level"))
    for again in (lambda left: written(kept.join(left.select("row"), "row", "left_semi").select("code").distinct(), "phrases-to-count"),
                  lambda left: codes_of(base, sizes, left)):
        if open_.isEmpty():
            break
        settled.append(won.join(open_, "row", "left_anti"))
        won = found(again(open_), open_)
        open_ = below(won, open_, F.col("last"))
    return reduce(DataFrame.unionAll, [*settled, won])
