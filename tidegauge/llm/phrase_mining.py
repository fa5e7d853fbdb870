"""Phrase collocation mining by Toivonen's method.

A sample of the documents proposes phrases: level by level it finds the phrases that are frequent there at a lowered threshold.  One pass over
all documents then counts the proposals together with their negative border, that is every phrase that is not proposed although both
its front and its rest are (all words are: they have no parts).  This pass counts by a 64-bit code, which is never too low for any phrase; a further pass
counts the phrases themselves that reach the threshold there.  A border phrase that turns out frequent is a failure: its extensions may
be frequent too, and were not counted.  The further pass counts as well what the failures newly allow, and takes every newly allowed phrase as proposed, so
what those could allow in turn is counted with them: after it no failure is left.  Results do not depend on the sample.

The proposals reach the tasks as a filter of bounded size (``filters``).  A wrong yes of the filter means one more phrase counted.  Words have
dictionary codes inside a batch, and a batch's counts per phrase are what is shuffled.

Texts: A-Z become lower case, pieces end at . , ; : ! ? and line ends, words at spaces and tabs.  Null and empty texts have no words,
a language that is null is ``und`` (so are its rows that say ``und``).  Rows that repeat count every time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm import filters
from tidegauge.llm.arrays import mix, parts
from tidegauge.llm.shared import bounded, materialise

LONGEST = 4  # words of a phrase
SAMPLE = 0.1  # share of the documents that proposes
BATCH_BYTES = 2 << 20
UNKNOWN = "und"


def _classes() -> np.ndarray:
    """0: part of a word, 1: between words, 2: between pieces."""
    out = np.zeros(256, np.uint8)
    out[[0x20, 0x09]] = 1
    out[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return out


CLASS = _classes().tobytes()  # tables for bytes.translate
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_STEP = np.uint64(0x9FB21C651E98DF25)
MARKS = np.uint64(7)


class Phrases:
    """Words of consecutive rows as codes, and the phrases that they form, level by level."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(CLASS), np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = kind == 0
        start = np.flatnonzero(inside[1:] > inside[:-1])
        end = np.concatenate([np.flatnonzero(inside[1:] < inside[:-1]), np.full(int(inside[-1]), len(data), np.int64)])
        # a word ends where its row ends
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        inner = inner[(inside[inner] > 0) & (inside[inner + 1] > 0)]
        if len(inner):
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        ends = np.concatenate([[0], np.cumsum(end - start)])
        letters = np.frombuffer(raw.translate(LOWER), np.uint8)[inside[1:].view(bool)]
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = langs.fill_null(UNKNOWN).dictionary_encode()
        self.langs = np.array(names.dictionary.to_pylist(), object)
        lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(offsets, start, "right") - 1]
        # pieces are numbered: neighbours of one number stand together
        breaks = np.sort(np.concatenate([np.flatnonzero(kind == 2), offsets]))
        piece = np.searchsorted(breaks, start, "right")
        self.joined = np.zeros(len(start), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]
        # the lowest two bits of a phrase's hash are its words less one; a code has whether it is proposed in the third
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs], np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        n = max(1, len(self.words))
        unique, self.id = coded_keys(lang * n + code)
        # level 1: language, words and hash of every different phrase; ``at``: where phrases of the level stand, ``which``: the phrase there
        self.lang, self.parts = unique // n, [unique % n]
        with np.errstate(over="ignore"):
            self.word_hash = mix(hashes[unique % n] + salt[unique // n] * _STEP) & ~MARKS if len(unique) else np.zeros(0, np.uint64)
        self.hash, self.counts = self.word_hash, np.bincount(self.id, minlength=len(unique))
        self.at, self.which = np.arange(len(start)), self.id

    def longer(self, allowed: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """To the next level: places where the phrase and the one a word later are both allowed.

        Returns which of the new phrases have a front or rest in ``wanted`` (all, without it)."""
        live = allowed[self.which]
        at, which = self.at[live], self.which[live]
        follows = np.zeros(len(at), bool)
        follows[:-1] = (at[1:] == at[:-1] + 1) & self.joined[at[:-1]]
        here = np.flatnonzero(follows)
        size = len(self.parts)
        at, front, rest = at[here], which[here], which[here + 1]
        last = self.id[at + size]
        n = max(1, len(self.word_hash))
        unique, place = coded_keys(front * n + last)
        counts = np.bincount(place, minlength=len(unique))
        f, w = unique // n, unique % n
        if wanted is None:
            new = np.ones(len(unique), bool)
        else:
            r = np.zeros(len(unique), np.int64)
            r[place] = rest
            new = wanted[f] | wanted[r]
        word = self.first_words[w] if size > 1 else self.parts[0][w]
        if size == 1:
            self.first_words = self.parts[0]
        self.parts = [p[f] for p in self.parts] + [word]
        with np.errstate(over="ignore"):
            self.hash = mix(self.hash[f] * _STEP + self.word_hash[w]) & ~MARKS | np.uint64(size) if len(unique) else np.zeros(0, np.uint64)
        self.lang, self.counts, self.at, self.which = self.lang[f], counts, at, place
        return new

    def texts(self, keep: np.ndarray) -> pa.RecordBatch:
        """Rows (lang, phrase, words, n) of the level's phrases."""
        i = np.flatnonzero(keep)
        columns = [self.words.take(pa.array(p[i])).cast(pa.large_string()).cast(pa.string()) for p in self.parts]
        phrase = pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]
        return pa.record_batch([pa.array(self.langs[self.lang[i]], pa.string()), phrase, pa.array(np.full(len(i), len(self.parts), np.int32)),
                                pa.array(self.counts[i].astype(np.int64))], ["lang", "phrase", "words", "n"])

    def sizes(self) -> pa.RecordBatch:
        """The number of words of each language, as the count of a phrase without words."""
        n = np.bincount(self.lang, weights=self.counts, minlength=len(self.langs)).astype(np.int64)
        return pa.record_batch([pa.array(self.langs, pa.string()), pa.array([""] * len(n)), pa.array(np.zeros(len(n), np.int32)),
                                pa.array(n)], ["lang", "phrase", "words", "n"])


def coded_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and the place of each key in them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def codes(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return (hashes | known.astype(np.uint64) << np.uint64(2)).view(np.int64)


def _levels(docs: DataFrame, proposed: list[filters.Filter], levels: range, schema: str, emit) -> DataFrame:
    """Rows that ``emit`` makes of a level, which phrases of it are newly allowed, and which are proposed.

    Newly allowed: front or rest is proposed by none of the filters but the last, or is itself newly allowed (with one filter: any allowed phrase).  With several
    filters, newly allowed phrases count as proposed."""
    shared = docs.sparkSession.sparkContext.broadcast([f.data for f in proposed])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [filters.Filter(data) for data in shared.value]

        def held(hashes: np.ndarray, some: list[filters.Filter]) -> np.ndarray:
            out = np.zeros(len(hashes), bool)
            for test in some:
                out |= test.holds(hashes)
            return out

        for batch in stream:
            for first, end, data, offsets in parts(batch.column("text"), BATCH_BYTES):
                if not len(data):
                    continue
                level = Phrases(data, offsets, batch.column("lang").slice(first, end - first))
                new = np.full(len(level.hash), len(tests) < 2)
                for size in range(1, levels.stop):
                    earlier = held(level.hash, tests[:-1])
                    known = earlier | held(level.hash, tests[-1:])
                    if len(tests) > 1:
                        known |= new
                    if size in levels:
                        yield from emit(level, size, new, known)
                    if size + 1 < levels.stop:
                        new = level.longer(known, None if len(tests) < 2 else new | ~earlier)

    return bounded(docs, BATCH_BYTES).mapInArrow(work, schema)


def count_codes(docs: DataFrame, proposed: list[filters.Filter], levels: range) -> DataFrame:
    """(code, n): counts of the phrases of the given levels whose front and rest are both proposed (words have neither), by their codes."""

    def emit(level: Phrases, size: int, new: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(codes(level.hash, known)), pa.array(level.counts.astype(np.int64))], ["code", "n"])

    return _levels(docs, proposed, levels, "code long, n long", emit).groupBy("code").agg(F.sum("n").alias("n"))


def count_texts(docs: DataFrame, proposed: list[filters.Filter], also: filters.Filter, longest: int) -> DataFrame:
    """(lang, phrase, words, n): exact counts of the newly allowed phrases (of none, with one filter) and of those in ``also``.

    A phrase without words holds the words of its language."""
    shared = docs.sparkSession.sparkContext.broadcast(also.data)
    further = len(proposed) > 1

    def emit(level: Phrases, size: int, new: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = filters.Filter(shared.value).holds(level.hash)
        if further:
            keep |= new
        if size == 1:
            yield level.sizes()
        if keep.any():
            yield level.texts(keep)

    rows = _levels(docs, proposed, range(1, longest + 1), "lang string, phrase string, words int, n long", emit)
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _failed(table: DataFrame, longest: int) -> DataFrame:
    """Codes of phrases that are not proposed and can be extended."""
    return table.where((F.col("code").bitwiseAND(4) == 0) & (F.col("code").bitwiseAND(3) < longest - 1))


def _filter(table: DataFrame) -> filters.Filter:
    return filters.build(table, "code", table.count())


def _together(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every


def propose(docs: DataFrame, least: int, share: float, longest: int) -> filters.Filter:
    """Phrases that are frequent in a sample, of all lengths that can have extensions; the threshold is lowered to about half of the sample's share."""
    sample = materialise(docs.where(F.pmod(F.xxhash64("__place", "text"), F.lit(1_000_000)) < int(share * 1_000_000)).select("lang", "text"), "phrase-sample")
    low = max(2, int(least * share * 0.6))
    found: list[filters.Filter] = []
    tables = []
    for size in range(1, longest):
        every = [_filter(_together(tables))] if tables else []
        tables.append(materialise(count_codes(sample, every, range(size, size + 1)).where(F.col("n") >= low), f"proposed-{size}"))
    return _filter(_together(tables))


def frequent(docs: DataFrame, least: int, longest: int = LONGEST, share: float = SAMPLE, lang: str = "lang", text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of every phrase of at most ``longest`` words with n >= least, and (lang, n) words of each language."""
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(key).cast("string").alias("__place"))
    proposed = [propose(docs, least, share, longest)]
    texts = docs.select("lang", "text")
    full = materialise(count_codes(texts, proposed, range(1, longest + 1)).where(F.col("n") >= least), "phrase-codes")
    failed = _failed(full, longest)
    n = failed.count()
    if n:
        proposed.append(filters.build(failed, "code", n))
    counted = materialise(count_texts(texts, proposed, _filter(full), longest).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    return counted.where((F.col("words") > 0) & (F.col("n") >= least)).select("lang", "phrase", "words", "n"), counted.where("words = 0").select("lang", "n")


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, first: int = 2000, longest: int = LONGEST, share: float = SAMPLE,
                 lang: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two words or more.

    A phrase is scored at its weakest cut, floor(2000000 * a / (l + r)) with a the phrase's and l, r its sides' counts, exact in 38 digits.  Phrases
    are left out that stand inside a longer frequent one with ``covered`` percent of their count or more."""
    phrases, sizes = frequent(docs, least, longest, share, lang, text, key)
    return ranked(materialise(phrases, "frequent"), sizes, covered, first)


def ranked(phrases: DataFrame, sizes: DataFrame, covered: int = 80, first: int = 2000) -> DataFrame:
    """The best of frequent phrases (lang, phrase, words, n), which are all there; ``sizes``: lang, n."""
    wide = "decimal(38,0)"
    candidates = phrases.where("words > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    # phrases inside longer ones
    inner = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    inside = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    # every cut with the counts of its sides
    cuts = left.select("lang", "phrase", "a", F.posexplode(F.expr("transform(sequence(1, words - 1), k -> struct(array_join(slice(w, 1, k), ' ') AS l, array_join(slice(w, k + 1, words - k), ' ') AS r))"))
                       .alias("k", "cut")).select("lang", "phrase", "a", "k", "cut.*")
    count_of = phrases.select("lang", F.col("phrase").alias("side"), "n")
    fronts = cuts.join(count_of.select("lang", F.col("side").alias("l"), F.col("n").alias("nl")), ["lang", "l"])
    both = fronts.join(count_of.select("lang", F.col("side").alias("r"), F.col("n").alias("nr")), ["lang", "r"])
    score = F.expr(f"CAST((CAST(2000000 AS {wide}) * CAST(a AS decimal(20,0))) div (CAST(nl AS decimal(20,0)) + CAST(nr AS decimal(20,0))) AS long)")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "nl", "nr")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.select("lang", "phrase", "a", F.col("x.nl").alias("l"), F.col("x.nr").alias("r"), F.col("x.score").alias("score")).withColumn(
        "rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


__all__ = ["collocations", "count_codes", "count_texts", "frequent", "propose", "ranked"]
