"""Cross-tokenizer alignment by lockstep merging.

Every text is encoded by a byte-level BPE model (A, over a space and the text) and a piece model (B, which adds the space itself).
The byte ends of both token sequences are merged for all documents of a batch at once: one state vector holds the A and B pointers of
every document (a long one has several, each for a run of its A tokens), a step compares all ends, emits a link where both end on the same byte,
which also cuts a group, and moves the pointers that are behind; finished documents leave the vector.

A linked pair of ids counts over the whole corpus.  A batch is a block: it has one dictionary of its pairs with their counts, which alone is
shuffled by pair; the totals come back to the blocks, and every document looks its pairs up in its block's dictionary.  So a pair
that every document holds is one row a block, and no table of all pairs is held anywhere.

Texts that are null, empty, or that one of the models does not give back byte for byte have no tokens: zeros and empty groups.
Every row is aligned by itself (repeated rows, repeated or missing ids); other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.shared import bounded, materialise

BATCH_BYTES = 4 << 20  # texts of a block (one longer text is a block of its own)
LANE = 1024  # A tokens that one pointer pair walks
CACHE = 800_000  # pieces that a worker keeps with their ids
PIECE = 64  # longer pieces are not kept


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Ids:
    """Token ids of pieces, end to end, and where each piece begins."""

    def __init__(self):
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def plus(self, lists: list) -> "Ids":
        out = Ids()
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        out.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))])
        out.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        return out

    def of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of pieces, and offsets of the pieces in them."""
        sizes = self.at[pieces + 1] - self.at[pieces]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.at[pieces] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class PairEncoder:
    """Both encodings of texts, each different piece between single spaces encoded once.

    No A token begins before a space and ends behind it, and no piece of B has its space mark anywhere but in front, so texts may be cut
    before a space with something else in front of it.  Texts with longer runs of spaces, and pieces with white space at an end, are encoded whole.
    So are texts with two spaces before a character that no piece joins to its space mark ("a  1"): B makes one piece of the two marks."""

    def __init__(self, byte_model: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        codes = byte_characters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(codes[c] for c in token) if all(c in codes for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)  # else every text is encoded whole
        self.mark = self.b.piece_to_id("▁")
        kept = [self.b.get_score(i) for i, p in enumerate(pieces) if p.strip("▁") and not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.last = "▁▁" not in pieces or self.b.get_score(self.b.piece_to_id("▁▁")) < min(kept)  # two marks are joined after all else
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.line = self.a.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.known, self.odd, self.bare = (Ids(), Ids()), np.zeros(0, bool), np.zeros(0, bool)

    def _a_ids(self, pieces: list[str]) -> list:
        """A's ids of pieces behind a space: lines of one text, as a line end is a token of its own between a word and a space."""
        out: list = []
        for at in range(0, len(pieces), 4096):
            chunk = pieces[at:at + 4096]
            lines = self.a.encode_batch_fast([" " + "\n ".join(chunk) + "\n"], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(np.array(lines, np.int32) == self.line[0]).tolist() if len(self.line) == 1 else []
            if len(ends) == len(chunk) and not any("\n" in p for p in chunk):
                out += [lines[i:j] for i, j in zip([0, *(e + 1 for e in ends)], ends)]
            else:
                out += [e.ids for e in self.a.encode_batch_fast([" " + p for p in chunk], add_special_tokens=False)]
        return out

    def _right(self, text: str, a: list, b: list) -> bool:
        want = (" " + text).encode()
        return b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b])

    def _pieces(self, pieces: list[str]) -> tuple[list, list, list[bool], list[bool]]:
        """Ids of both models, whether the piece has to be seen in its text, and whether it has to if a second space is in front of it."""
        odd = [p[:1].isspace() or p[-1:].isspace() for p in pieces]
        plain = [p for p, x in zip(pieces, odd) if not x]
        broken = [p for p in plain if "\n" in p]
        found = dict(zip(whole := [p for p in plain if "\n" not in p], self._a_ids(whole))) | dict(zip(broken, self._a_ids(broken)))
        a = [found.get(p, []) for p in pieces]
        b = self.b.encode([p if p else "." for p in pieces], num_threads=1) if pieces else []
        b = [[self.mark] if not p else x for p, x in zip(pieces, b)]
        bare = [not self.last or x[:1] == [self.mark] for x in b]
        return a, b, [x or not self._right(p, i, j) for p, x, i, j in zip(pieces, odd, a, b)], bare

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, their text offsets, B ids, their text offsets."""
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy()
        values = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        words, codes = values.dictionary.to_pylist(), values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.slot) + len(words) > CACHE:
            self._clear()
        slots = np.array([self.slot.get(w, -1) for w in words], np.int64)
        new = [w for w, s in zip(words, slots) if s < 0 and len(w) <= PIECE]
        if new:
            a, b, odd, bare = self._pieces(new)
            self.slot.update(zip(new, range(len(self.odd), len(self.odd) + len(new))))
            self.known = self.known[0].plus(a), self.known[1].plus(b)
            self.odd, self.bare = np.concatenate([self.odd, odd]), np.concatenate([self.bare, bare])
        long = [w for w, s in zip(words, slots) if s < 0 and len(w) > PIECE]
        a, b, odd_long, bare_long = self._pieces(long)
        extra = dict(zip(long, range(len(self.odd), len(self.odd) + len(long))))
        slots = np.array([self.slot[w] if len(w) <= PIECE else extra[w] for w in words], np.int64)
        odd, bare = np.concatenate([self.odd, np.array(odd_long, bool)]), np.concatenate([self.bare, np.array(bare_long, bool)])
        pieces = slots[codes]
        empty = slots == slots[words.index("")] if "" in words else np.zeros(len(words), bool)
        empty = empty[codes]
        strange = odd[pieces]
        strange[1:] |= empty[:-1] & bare[pieces][1:]
        marks = np.concatenate([[0], np.cumsum(strange)])
        whole = (marks[at[1:]] > marks[at[:-1]]) | (not self.cuts)
        blank = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        sizes = np.diff(at)
        keep = np.repeat(~(whole | blank), sizes)
        rows = np.flatnonzero(whole & ~blank)
        for row in rows:
            text = texts[int(row)].as_py()
            i, j = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
            right = self._right(text, i, j)
            a.append(i if right else [])
            b.append(j if right else [])
        # texts that were encoded whole are one piece each
        sizes = np.where(whole | blank, 0, sizes)
        sizes[rows] = 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        sequence = np.zeros(offsets[-1], np.int64)
        single = np.zeros(offsets[-1], bool)
        single[offsets[rows]] = True
        sequence[~single] = pieces[keep]
        sequence[single] = len(odd) + np.arange(len(rows))
        a_ids, a_ends = self.known[0].plus(a).of(sequence)
        b_ids, b_ends = self.known[1].plus(b).of(sequence)
        return a_ids, a_ends[offsets], b_ids, b_ends[offsets]


def merged(a_end: np.ndarray, b_end: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For every A token the B token that ends on the same byte, or -1.

    ``a_end`` and ``b_end`` are the byte ends of the tokens of all documents, end to end, ``begin`` and ``end`` the A tokens of each document."""
    cut = np.full(len(a_end), -1, np.int64)
    runs = -(-(end - begin) // lane)
    i = np.repeat(begin, runs) + lane * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    stop = np.minimum(i + lane, np.repeat(end, runs))
    before = np.concatenate([[0], a_end])
    j = np.searchsorted(b_end, before[i], "right")  # the B token that holds the first byte
    while len(i):
        at_a, at_b = a_end[i], b_end[j]
        both = at_a == at_b
        cut[i[both]] = j[both]
        i, j = i + (at_a <= at_b), j + (at_b <= at_a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    return cut


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, left-aligned, and how many."""
    text = np.char.mod("%d", np.arange(max(n, 1))).astype("S")
    return text.view(np.uint8).reshape(len(text), -1), np.char.str_len(text).astype(np.int64)


class Groups:
    """Group texts ``a1,a2|b1;a3|b2,b3`` of documents."""

    def __init__(self, a_vocabulary: int, b_vocabulary: int):
        self.tables = _digits(a_vocabulary), _digits(b_vocabulary)

    def __call__(self, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, rows: np.ndarray) -> pa.Array:
        """``rows``: offsets of the documents in the groups; a_last, b_last: last token of each group."""
        n = len(a_ids) + len(b_ids)
        b_before = np.concatenate([[0], b_last + 1])
        group = np.zeros(len(a_ids) + 1, np.int64)
        group[a_last + 1] = 1
        group = np.cumsum(group)[:len(a_ids)]
        a_place = np.arange(len(a_ids)) + b_before[group]
        group = np.zeros(len(b_ids) + 1, np.int64)
        group[b_last + 1] = 1
        group = np.cumsum(group)[:len(b_ids)]
        b_place = np.arange(len(b_ids)) + (a_last + 1)[group]
        mark = np.full(n, ord(","), np.uint8)
        mark[a_place[a_last]], mark[b_place[b_last]] = ord("|"), ord(";")
        size = np.zeros(n, np.int64)
        size[a_place], size[b_place] = self.tables[0][1][a_ids], self.tables[1][1][b_ids]
        ends = np.cumsum(size + 1)
        starts = ends - size - 1
        out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
        for ids, place, (digits, sizes) in ((a_ids, a_place, self.tables[0]), (b_ids, b_place, self.tables[1])):
            begin, many = starts[place], sizes[ids]
            for d in range(digits.shape[1]):
                live = many > d
                out[begin[live] + d] = digits[ids[live], d]
        out[ends - 1] = mark
        # a document's text ends before its last mark
        group_end = np.concatenate([[0], ends[b_place[b_last]]]) if n else np.zeros(1, np.int64)
        data, at = out.tobytes(), group_end[rows].tolist()
        return pa.array([data[i:j - 1] if j > i else b"" for i, j in zip(at[:-1], at[1:])], pa.large_binary()).cast(pa.large_string())


_WORKERS: dict[int, tuple[PairEncoder, Groups]] = {}

ROWS = ("block string, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>, "
        "table array<long>, counts array<long>")
ARROW = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("groups", pa.large_string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
                   ("table", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def blocks(docs: DataFrame, byte_model: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document (its groups, the block's pairs it holds and how often) and one per block (``table``, ``counts``: its pairs)."""
    with open(byte_model, encoding="utf-8") as a, open(piece_model, "rb") as b:
        models = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(models.value)
        if key not in _WORKERS:
            _WORKERS.clear()
            encoder = PairEncoder(*models.value)
            _WORKERS[key] = encoder, Groups(len(encoder.a_bytes), len(encoder.b_bytes))
        encoder, groups = _WORKERS[key]
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(stream):
            if not batch.num_rows:
                continue
            a_ids, a_at, b_ids, b_at = encoder.encode(batch.column("text"))
            cut = merged(np.cumsum(encoder.a_size[a_ids]), np.cumsum(encoder.b_size[b_ids]), a_at[:-1], a_at[1:])
            a_last = np.flatnonzero(cut >= 0)
            b_last = cut[a_last]
            rows = np.searchsorted(a_last, a_at)
            table, place, counts = np.unique(a_ids[a_last].astype(np.int64) << 32 | b_ids[b_last], return_inverse=True, return_counts=True)
            n = batch.num_rows
            per_row, times = np.unique(np.repeat(np.arange(n), np.diff(rows)) * max(1, len(table)) + place, return_counts=True)
            held = np.searchsorted(per_row // max(1, len(table)), np.arange(n + 1))
            block = f"{partition}-{number}"
            yield pa.record_batch([
                pa.array([block] * n), batch.column("doc_id"), pa.array(np.diff(a_at)), pa.array(np.diff(b_at)), pa.array(np.diff(rows)),
                groups(a_ids, b_ids, a_last, b_last, rows), _lists((per_row % max(1, len(table))).astype(np.int32), held, pa.int32()),
                _lists(times.astype(np.int32), held, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=ARROW)
            yield pa.RecordBatch.from_pylist([{"block": block, "table": table, "counts": counts}], schema=ARROW)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return bounded(rows, BATCH_BYTES).mapInArrow(work, ROWS)


def pair_totals(table: DataFrame) -> DataFrame:
    """pair, total, best (no other pair of its B id is linked more often) of the written blocks."""
    pairs = table.where("table IS NOT NULL").select(F.explode(F.arrays_zip("table", "counts")).alias("x"))
    total = pairs.groupBy(F.col("x.table").alias("pair")).agg(F.sum("x.counts").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = total.groupBy("b").agg(F.max("total").alias("most"))  # a B id has at most a vocabulary of pairs
    return total.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_model: str, piece_model: str, doc_id: str = "doc_id", text: str = "text",
          groups: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum of every row of docs.

    ``groups`` is the text ``a1,a2|b1;...`` of ids, or what the given function makes of it before anything is stored."""
    rows = blocks(docs, byte_model, piece_model, doc_id, text)
    if groups:
        rows = rows.withColumn("groups", groups(F.col("groups")))
    table = materialise(rows, "alignment")
    totals = materialise(pair_totals(table), "pair-totals")
    named = table.where("table IS NOT NULL").select("block", F.posexplode("table").alias("at", "pair"))
    found = named.join(totals, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "total", "best"))).alias("x"))
    looked = found.select(F.col("block").alias("of"), F.col("x.total").alias("total"), F.col("x.best").alias("best"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs, times = left.column("pairs").combine_chunks(), left.column("times").combine_chunks()
        at = pairs.offsets.to_numpy()
        place, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        at = at - at[0]
        total = right.column("total").combine_chunks().flatten().to_numpy() if right.num_rows else np.zeros(0, np.int64)
        best = right.column("best").combine_chunks().flatten().to_numpy(zero_copy_only=False) if right.num_rows else np.zeros(0, bool)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times, times * best[place], times * total[place])]
        columns = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups")]
        return pa.table([*columns, *(pa.array(x[at[1:]] - x[at[:-1]]) for x in sums)], ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"])

    documents = table.where("table IS NULL").drop("table", "counts")
    kind = "doc_id long, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long"
    return documents.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(count, kind)


__all__ = ["Groups", "PairEncoder", "align", "blocks", "merged", "pair_totals"]
