"""Token ids as Arrow stream files of equal-length sequences.

A shard is a pair of files in Arrow's stream format, without compression, so a memory map of either is usable as it is:

* ``tokens``: one row per sequence of ``length`` tokens, ``ids`` fixed_size_list<uint16 or uint32> and ``mask``
  fixed_size_list<bool> (false: padding after the last document of the shard);
* ``docs``: doc_id, place of its first token in the shard, number of tokens with the end id.

Ids take 16 bits when the whole vocabulary fits, else 32.  Documents are in ascending id order over all shards
(no id: first), repeated ids in the order of their texts.  Null and empty texts are one end id.  A repeated or restarted task
writes its files anew under a name of its own and renames them when finished.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.arrays import parts
from tidegauge.llm.shared import FileStore, bounded, materialise

END_ID = 0
LENGTH = 2048
ROWS = 128  # sequences of a record batch
SHARD_TOKENS = 1 << 26  # a shard is closed at the first document beyond
ENCODE_BYTES = 8 << 20  # texts encoded at once
CACHE = 600_000  # pieces that a worker keeps (about 25 MB)


class PieceEncoder:
    """Whole-text encoding by the tokenizers library, with each different piece encoded once.

    Byte-level BPE never merges over a single space or line end between two other characters, so texts are cut there.  Known pieces
    and their ids are two Arrow arrays: a batch is looked up, and its ids are put together, without touching single pieces in
    Python.  New pieces are encoded as the lines of one text, where every line end is a token of its own; marks behind a letter or digit
    are a word of their own, so a piece that ends in marks is its front and its tail.  Texts where a cut could matter (runs of
    white space, white space first, the library's added tokens) go to the library whole.

    A piece that begins with a line end stands for the text behind it without a space; every text is given one in front."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.line_code = np.array([self.line_end], self.kind).tobytes()
        self.known, self.coded = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.whole, self.used = np.zeros(0, bool), np.zeros(0, bool)  # pieces that need their whole text; pieces met since the last clean-up

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _encode_lines(self, texts: list[str]) -> list[bytes]:
        out, size = [], self.kind.itemsize
        for at in range(0, len(texts), 8192):
            chunk = texts[at:at + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(chunk) + "\n"], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(chunk):
                out += [self._ids(t) for t in chunk]
                continue
            data, ends = ids.tobytes(), ends * size
            starts = np.concatenate([[0], ends[:-1] + size])
            out += map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))
        return out

    def _add(self, pieces: list[str], codes: list[bytes | None]) -> None:
        self.known = pa.concat_arrays([self.known, pa.array(pieces, pa.large_string())])
        self.coded = pa.concat_arrays([self.coded, pa.array([c or b"" for c in codes], pa.large_binary())])
        self.whole = np.concatenate([self.whole, [c is None for c in codes]])
        self.used = np.concatenate([self.used, np.ones(len(codes), bool)])

    def _learn(self, new: list[str]) -> bool:
        """Adds new pieces at the end; True when old ones have been dropped before."""
        clean = len(self.known) + len(new) > CACHE
        if clean:
            keep = pa.array(self.used)
            self.known, self.coded, self.whole = self.known.filter(keep), self.coded.filter(keep), self.whole[self.used]
            self.used = np.zeros(len(self.known), bool)
        fronts = [p.rstrip(punctuation) for p in new]
        cut = [(p, f, p[len(f):]) for p, f in zip(new, fronts) if len(f) != len(p) and len(f) > (f[:1] == "\n") and f[-1].isalnum()]
        pieces = dict.fromkeys(p for p, f in zip(new, fronts) if len(f) == len(p) or len(f) <= (f[:1] == "\n") or not f[-1].isalnum())
        parts_ = list(dict.fromkeys(x for _, f, t in cut for x in (f, "\n" + t)))
        at = pc.index_in(pa.array(parts_, pa.large_string()), value_set=self.known)
        have = dict(zip(parts_, self.coded.take(at).to_pylist()))
        pieces.update((p, None) for p in parts_ if have[p] is None)
        # a piece with white space at either end, or none, stands at a cut that the library would not make
        good = [p for p in pieces if p and p != "\n" and not p[-1].isspace() and not p[p[0] == "\n"].isspace()]
        for p, code in zip(good, self._encode_lines([p[1:] if p[0] == "\n" else " " + p for p in good])):
            pieces[p] = self.line_code + code if p[0] == "\n" else code
        skip = len(self.line_code)
        whole = {}
        for p, front, tail in cut:
            a, b = have.get(front) or pieces.get(front), have.get("\n" + tail) or pieces.get("\n" + tail)
            whole[p] = a + b[skip:] if a and b else None
        pieces.update(whole)
        self._add(list(pieces), list(pieces.values()))
        return clean

    def encode(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """Ids of each text, in order."""
        texts = texts.cast(pa.large_string()).fill_null("")
        empty, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        lists = pc.split_pattern(pc.binary_join_element_wise(empty, pc.replace_substring(texts, "\n", " \n"), line), " ")
        values, at = lists.values, lists.offsets.to_numpy()
        index = pc.index_in(values, value_set=self.known)
        if index.null_count:
            self.used[index.drop_null().to_numpy()] = True
            missing, n = pc.is_null(index), len(self.known)
            lost = values.filter(missing)
            if self._learn(lost.unique().to_pylist()):  # places have changed
                index = pc.index_in(values, value_set=self.known).to_numpy().astype(np.int64)
            else:
                index = index.fill_null(0).to_numpy().astype(np.int64)
                index[missing.to_numpy(zero_copy_only=False)] = pc.index_in(lost, value_set=self.known.slice(n)).to_numpy() + n
        else:
            index = index.to_numpy().astype(np.int64)
        self.used[index] = True
        marks = np.concatenate([[0], np.cumsum(self.whole[index])])
        by_library = marks[at[1:]] > marks[at[:-1]]
        for token in self.added:
            by_library |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        taken = self.coded.take(pa.array(index))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:][at]
        data, skip = memoryview(taken.buffers()[2]), len(self.line_code)
        for i, low, high in zip(range(len(texts)), ends[:-1].tolist(), ends[1:].tolist()):
            if by_library[i]:
                yield self._ids(texts[i].as_py())
            else:
                yield data[low + skip:high]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(model: str) -> PieceEncoder:
    """One encoder per worker process, kept from task to task."""
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = PieceEncoder(model)
    return _ENCODERS[model]


def id_type(vocabulary: int):
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def schemas(kind, length: int) -> tuple[pa.Schema, pa.Schema]:
    ids = pa.list_(pa.from_numpy_dtype(kind), length)
    return (pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))]),
            pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))


class ShardWriter:
    """Streams one shard: memory holds one record batch of tokens and one of documents."""

    def __init__(self, store: FileStore, name: str, attempt: str, kind, length: int):
        self.store, self.name, self.attempt, self.kind, self.length = store, name, attempt, kind, length
        self.schema, self.doc_schema = schemas(kind, length)
        self.files = [store.write(f"{name}.{x}.arrows", attempt) for x in ("tokens", "docs")]
        self.out = pa.ipc.new_stream(self.files[0], self.schema)
        self.doc_out = pa.ipc.new_stream(self.files[1], self.doc_schema)
        self.kept: list[bytes] = []
        self.docs: list[tuple] = []
        self.waiting = self.n_tokens = self.n_docs = 0

    def add(self, doc_id: int | None, code: bytes | memoryview) -> None:
        n = len(code) // self.kind.itemsize + 1
        self.kept += [code, np.array([END_ID], self.kind).tobytes()]
        self.docs.append((doc_id, self.n_tokens, n))
        self.n_tokens += n
        self.n_docs += 1
        self.waiting += n
        if self.waiting >= ROWS * self.length:
            self._flush(False)
        if len(self.docs) >= 4096:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.kept), self.kind)
        size, tokens = ROWS * self.length, len(ids)
        if last and tokens % self.length:
            ids = np.concatenate([ids, np.zeros(self.length - tokens % self.length, self.kind)])
        at = 0
        while len(ids) - at >= size or last and at < len(ids):
            part = ids[at:at + size]
            mask = np.arange(at, at + len(part)) < tokens
            self.out.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((part, mask), self.schema)], self.schema))
            at += len(part)
        self.kept, self.waiting = [ids[at:].tobytes()], len(ids) - at

    def _flush_docs(self) -> None:
        if self.docs:
            self.doc_out.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.docs)], self.doc_schema))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        self._flush_docs()
        for out in (self.out, self.doc_out, *self.files):
            out.close()
        for x in ("tokens", "docs"):
            self.store.commit(f"{self.name}.{x}.arrows", self.attempt)


def write_shards(docs: DataFrame, store: FileStore, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text",
                 length: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts and write the shards; returns their list (part, seq, name, n_docs, n_tokens, first), already stored.

    One range shuffle by id brings documents in order; texts stream through the encoder."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's copy serves every executor; a few MB
        model = spark.sparkContext.broadcast(f.read())
    rows = bounded(docs, ENCODE_BYTES).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt, seq, shard, out = task.partitionId(), f"a{task.taskAttemptId()}", 0, None, []
        for batch in stream:
            encoder = encoder_of(model.value)
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, end, _, _ in parts(texts, ENCODE_BYTES):
                for key, code in zip(ids[first:end].to_pylist(), encoder.encode(texts[first:end])):
                    if shard is None:
                        shard = ShardWriter(store, f"{part:06d}-{seq:04d}", attempt, encoder.kind, length)
                    shard.add(key, code)
                    if shard.n_tokens >= shard_tokens:
                        shard.close()
                        out.append((part, seq, shard.name, shard.n_docs, shard.n_tokens))
                        seq, shard = seq + 1, None
        if shard is not None:
            shard.close()
            out.append((part, seq, shard.name, shard.n_docs, shard.n_tokens))
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out)], ["part", "seq", "name", "n_docs", "n_tokens"])

    shards = materialise(ordered.mapInArrow(write, "part long, seq long, name string, n_docs long, n_tokens long"), "token-shards")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def documents_of(store: FileStore, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the shard, ids) of one shard; holds one record batch, or one document if that is longer."""
    with store.read(f"{name}.tokens.arrows") as tokens, store.read(f"{name}.docs.arrows") as index:
        sequences = pa.ipc.open_stream(tokens)
        rest, rest_at = np.zeros(0, np.uint16), 0
        for docs in pa.ipc.open_stream(index):
            for key, start, n in zip(*(c.to_pylist() for c in docs.columns)):
                if start + n > rest_at + len(rest):
                    got, have = [rest[start - rest_at:]], rest_at + len(rest)
                    while have < start + n:
                        more = sequences.read_next_batch().column("ids").flatten().to_numpy(zero_copy_only=True)
                        got.append(more)
                        have += len(more)
                    rest, rest_at = np.concatenate([x for x in got if len(x)]), start
                yield key, start, rest[start - rest_at:start - rest_at + n]


def read_documents(shards: DataFrame, store: FileStore) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32, read back from the files, one task per shard."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist()):
                rows = []
                for key, start, ids in documents_of(store, name):
                    rows.append((key, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], schema)

    count = shards.count()
    return shards.select("name", "first").repartition(max(1, count)).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence(store: FileStore, name: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``i`` of a shard, a view of the mapped file, and its mask."""
    system, root = store._at()
    local = f"{root}/{name}.tokens.arrows"
    source = pa.memory_map(local) if system.type_name == "local" else store.read(f"{name}.tokens.arrows")
    for at, batch in enumerate(pa.ipc.open_stream(source)):
        if at == i // ROWS:
            ids, mask = (c[i % ROWS].values for c in batch.columns)
            return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)
    raise IndexError(i)


__all__ = ["PieceEncoder", "documents_of", "read_documents", "sequence", "write_shards"]
