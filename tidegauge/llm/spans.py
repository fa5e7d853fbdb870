"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? with white space behind, and at line ends; each keeps its trailing white space).  At every
sentence the run of consecutive sentences that first reaches ``least`` words is hashed, and likewise the run that ends there, so
a repeated passage is covered to both its ends.  With ``passage`` the runs are ``least`` words around every sentence, wherever the
sentences beside it begin and end, so edge sentences that have grown or were edited count with the words they still share.  Hashes (96 bits over the words) are joined globally; the first occurrence by
document id and place stays, and the sentences covered by any other occurrence are removed.  Everything else stays byte for byte.

Words count as in ``arrays``.  Null texts stay null.  Rows that repeat an id and a text are one document; different texts of one id
are documents of their own, ordered by a hash of the text.  Documents without an id come first and are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.arrays import Words, mix, parts
from tidegauge.llm.shared import bounded, row_key

LEAST = 40  # words of a span
PASSAGE = 51  # shared words around a sentence, parts of its neighbours included, that are always found


def sentences(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where sentences begin, the beginnings of rows included (empty rows have none)."""
    white = (data == 32) | (data >= 9) & (data <= 13)
    if len(data) < 2:
        return np.unique(offsets[:-1][np.diff(offsets) > 0])
    start = np.zeros(len(data), bool)  # rows do not see each other
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    before = lambda flags: np.concatenate([[False], flags[:-1]]) & ~start
    stop = (data == 46) | (data == 33) | (data == 63)
    stop |= (data == 34) & before(stop)  # a quote closes behind the stop
    begins_white = white & ~before(white)  # first byte of a run of white space
    ends_here = begins_white & before(stop)
    runs = np.cumsum(begins_white) * white
    cut = np.zeros(int(runs.max()) + 1 if len(runs) else 1, bool)
    cut[runs[ends_here]] = True
    cut[runs[data == 10]] = True
    cut[0] = False
    after = ~white & before(white)  # first byte after a run
    begin = np.flatnonzero(after)
    begin = begin[cut[runs[begin - 1]]]
    return np.unique(np.concatenate([begin, offsets[:-1][np.diff(offsets) > 0]]))


class Spans:
    """Spans of consecutive rows: ``row``, first and last sentence (numbers inside the row), two hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, passage: int | None = None):
        begin = sentences(data, offsets)
        words = Words(data, offsets)
        row_of = np.searchsorted(offsets, begin, "right") - 1
        first_of_row = np.searchsorted(begin, offsets)  # sentence offsets of rows
        at = np.append(np.searchsorted(words.start, begin), len(words.start))  # first word of each sentence
        n = len(begin)
        ends = first_of_row[row_of + 1]  # sentence after the row's last
        starts = first_of_row[row_of]
        i = np.arange(n)
        if passage:
            self._windows(words, at, starts, ends, row_of, least, passage - least + 1)
            return
        # forward: the least e with at[e] - at[i] >= least; backward: the greatest s with at[i + 1] - at[s] >= least
        e = np.searchsorted(at, at[:-1] + least, "left")
        forward = e <= ends
        s = np.searchsorted(at, at[1:] - least, "right") - 1
        backward = (at[1:] >= least) & (s >= starts)
        low = np.concatenate([i[forward], s[backward]])
        high = np.concatenate([e[forward], i[backward] + 1])
        if len(low):
            low, high = np.unique(np.stack([low, high]), axis=1)
        self.row = row_of[low] if n else low
        self.first, self.last = low - starts[low] if n else low, high - 1 - starts[low] if n else high
        self.a, self.b = (self._hash(words.hash, at[low], at[high], base) for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

    def _windows(self, words: Words, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, row_of: np.ndarray, least: int, step: int) -> None:
        """Runs of ``least`` words around every sentence, ``step`` words apart, and longer sentences by themselves.

        A shared run of words leaves an interval of places for a window that holds the sentence and stays inside of it: one of ``step``
        places at least if it has least + step - 1 words.  The outermost places, where the window begins or ends with the sentence, are always
        taken, so whole sentences of ``least`` words together are covered as well."""
        size = at[1:] - at[:-1]
        short = np.flatnonzero(size <= least)
        many = (least - size[short]) // step + 1
        which = np.repeat(short, many)
        back = (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * step
        low = np.concatenate([at[which] - back, at[short + 1] - least])
        anchor = np.concatenate([which, short])
        inside = (low >= at[starts[anchor]]) & (low + least <= at[ends[anchor]])
        low, unique = np.unique(low[inside], return_index=True)
        anchor = anchor[inside][unique]
        first = np.maximum(np.searchsorted(at[:-1], low, "left"), starts[anchor])
        last = np.minimum(np.searchsorted(at[1:], low + least, "right"), ends[anchor]) - 1
        long = np.flatnonzero(size > least)
        low, high = np.concatenate([low, at[long]]), np.concatenate([low + least, at[long + 1]])
        self.first, self.last = np.concatenate([first, long]), np.concatenate([last, long])
        anchor = np.concatenate([anchor, long])
        self.row, self.first, self.last = row_of[anchor], self.first - starts[anchor], self.last - starts[anchor]
        self.a, self.b = (self._hash(words.hash, low, high, base) for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

    @staticmethod
    def _hash(h: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
        """Hash of the words from low to high, from running sums."""
        with np.errstate(over="ignore"):
            up, down = np.full(len(h) + 1, base | 1, np.uint64), np.full(len(h) + 1, pow(base | 1, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h ^ np.uint64(base)) * up[:-1], out=sums[1:])
            return mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))


def span_table(docs: DataFrame, key: str, text: str, least: int = LEAST, passage: int | None = None) -> DataFrame:
    """(a, b, doc, version, first, last) of every span; version is a hash of the text, as ranges hold for that text only."""

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for first, _, data, offsets in parts(batch.column("text")):
                s = Spans(data, offsets, least, passage)
                yield pa.record_batch([pa.array(s.a.view(np.int64)), pa.array((s.b >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column("doc").take(pa.array(s.row + first)),
                                       batch.column("version").take(pa.array(s.row + first)), pa.array(s.first.astype(np.int32)),
                                       pa.array(s.last.astype(np.int32))], ["a", "b", "doc", "version", "first", "last"])

    return bounded(docs).select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text")).mapInArrow(
        cut, "a long, b int, doc long, version long, first int, last int")


def repeated(spans: DataFrame) -> DataFrame:
    """(doc, version, covered): sentence ranges of every occurrence but the first.

    Spans are shuffled once, by hash; a hash's rows are sorted and ranked as a stream, so a hot one costs its rows in one task."""
    place = F.struct("doc", "version", "first")
    later = spans.withColumn("rank", F.rank().over(Window.partitionBy("a", "b").orderBy(place))).where("rank > 1")
    return later.groupBy("doc", "version").agg(F.collect_set(F.struct("first", "last")).alias("covered"))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, count: str = "n_removed",
            passage: int | None = None) -> DataFrame:
    """docs with covered sentences taken out of the text, and the number of sentences taken out.

    With ``passage`` a sentence is covered as soon as the words that it shares together with its neighbourhood, partial sentences
    included, are so many; without it whole sentences alone have to reach ``least`` words."""
    keyed = docs.withColumn("__doc", row_key(key, text)).withColumn("__version", F.xxhash64(text))
    covered = repeated(span_table(keyed, "__doc", text, least, passage)).toDF("__doc", "__version", "__covered")
    fields = docs.schema.fields
    joined = keyed.join(covered, ["__doc", "__version"], "left").select(*docs.columns, F.col("__covered.first").alias("__first"), F.col("__covered.last").alias("__last"))

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts, n = batch.column(text).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for i, (low, high) in enumerate(zip(batch.column("__first").to_pylist(), batch.column("__last").to_pylist())):
                if low and texts[i]:
                    texts[i], n[i] = without(texts[i], low, high)
            columns = [pa.array(texts, batch.column(text).type) if f.name == text else batch.column(f.name) for f in fields]
            yield pa.record_batch([*columns, pa.array(n)], [*(f.name for f in fields), count])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{count}` long"
    return joined.mapInArrow(cut, schema)


def without(text: str, low: list[int], high: list[int]) -> tuple[str, int]:
    """Text without the sentences of the given ranges, and how many those are."""
    data = np.frombuffer(text.encode(), np.uint8)
    begin = np.append(sentences(data, np.array([0, len(data)])), len(data))
    marks = np.zeros(len(begin) + 1, np.int64)
    for a, b in zip(low, high):
        if a < len(begin) - 1:
            marks[a] += 1
            marks[min(b + 1, len(begin))] -= 1
    gone = np.cumsum(marks)[:len(begin) - 1] > 0
    kept = [data[begin[i]:begin[i + 1]].tobytes() for i in np.flatnonzero(~gone)]
    return b"".join(kept).decode(), int(gone.sum())


__all__ = ["Spans", "removed", "repeated", "sentences", "span_table", "without"]
