"""Exact substring dedup with suffix arrays: every byte goes that is covered by a string of ``length`` bytes which also starts anywhere else.

* Routing.  Every window of ``length`` bytes has a key, the least hash of the ``GRAM``-byte strings in it.  Equal windows have equal keys, and windows that
  follow each other mostly share theirs, so a text becomes segments: the bytes of a run of windows with one key.  A first pass counts the
  places of every least string; keys with a single place cannot repeat and are left out of the second pass by a filter of bounded size.
* Segments of equal bytes collapse to one with a count.  All segments of a key meet in a shard (a lane of ``suffix_arrays``), whose suffix
  array is made by induced sorting; suffixes that share ``length`` bytes with a neighbour in order, by the permuted common prefixes, are repeated windows.
* Keys with more than ``SHARD`` bytes of different segments (a passage in very many surroundings) are cut again: their segments go the same way as texts, with
  strings so much longer that a window has a quarter of them.  Segments that agree only in the shorter string part there; those that stand alone go.  At
  last a string is a window, whose places are counted.  A large group costs some rows a segment and round, not one a window.
* The repeated ranges return to the texts.  Everything is judged on the input.

Matches never cross documents.  Null texts are empty.  Rows that repeat are documents of their own, whose texts repeat each other; ids
do not matter.  Any extra columns stay, in ``removed``; the columns that it adds must not be there before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import filters
from tidegauge.llm.arrays import mix, parts
from tidegauge.llm.shared import bounded, materialise
from tidegauge.llm.suffix_arrays import common_prefixes, suffix_arrays

LENGTH = 200
GRAM = 48
SHARD = 1 << 15  # bytes of the largest group that is a shard of its own
DEALT = 1 << 13  # the same, of segments that were cut again
LANE = 1 << 12  # small groups share a lane of about so many bytes
CELLS = 1 << 21  # lanes x longest lane that are sorted at once
WINDOWS = 1 << 20  # windows looked at together, also of one long text

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _reduced(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every run of ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


class Keys:
    """Keys of all windows of consecutive rows: ``first`` and ``last`` window of every segment, its ``key``; ``places``: hashes of the least strings, one a place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        n = len(data)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.row = none
        self.key = self.places = np.zeros(0, np.uint64)
        if n < length:
            return
        up, down = _powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            h = mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1]) | np.uint64(1)
        width = length - gram + 1
        key = _reduced(np.minimum, h, width)
        start = np.arange(len(key))
        row = np.searchsorted(offsets, start, "right") - 1
        whole = start + length <= offsets[row + 1]
        key[~whole] = 0
        wide = np.concatenate([np.zeros(width - 1, np.uint64), key, np.zeros(width - 1, np.uint64)])
        self.places = h[_reduced(np.maximum, wide, width) == h]
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        if width == 1:  # every window by itself
            change[:] = True
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(key)) - 1
        real = key[first] > 0
        self.first, self.last = first[real], last[real]
        self.key, self.row = key[self.first], row[self.first]


def _slices(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte in it, bytes, row offsets): short rows together, a long row in slices that overlap by a window less a byte.

    The fewer strings a window has, the more segments come of a slice, and the shorter it is."""
    many = max(1, WINDOWS * (length - gram + 2) // length)
    for first, _, data, offsets in parts(batch.column("text"), many):
        if len(offsets) == 2 and len(data) > many + length:
            for at in range(0, len(data) - length + 1, many):
                piece = data[at:at + many + length - 1]
                yield first, at, piece, np.array([0, len(piece)])
        else:
            yield first, 0, data, offsets


def repeated_keys(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Keys (key) with more than one place."""

    def places(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for _, _, data, offsets in _slices(batch, length, gram):
                keys, n = np.unique(Keys(data, offsets, length, gram).places, return_counts=True)
                if len(keys):
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.minimum(n, 2))], ["key", "n"])

    return bounded(texts.select("text")).mapInArrow(places, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def segments(texts: DataFrame, wanted: filters.Filter, length: int, gram: int) -> DataFrame:
    """(key, text_id, low, high, n, sid, bytes) of the segments whose key may be wanted: a row for each different one of a text, with the runs of its n places."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted.data)

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = filters.Filter(shared.value)
        for batch in stream:
            ids = batch.column("text_id")
            for first, begin, data, offsets in _slices(batch, length, gram):
                found = Keys(data, offsets, length, gram)
                keep = test.holds(found.key)
                low, high, row = found.first[keep], found.last[keep] + length, found.row[keep]
                if not len(low):
                    continue
                buffer = data.tobytes()
                pieces = [buffer[i:j] for i, j in zip(low.tolist(), high.tolist())]
                digests = [xxhash.xxh3_128_digest(p) for p in pieces]
                same: dict[tuple[int, bytes], list[int]] = {}
                for i, x in enumerate(zip(row.tolist(), digests)):
                    same.setdefault(x, []).append(i)
                one = [p[0] for p in same.values()]
                low, high = low - offsets[row] + begin, high - offsets[row] + begin
                places = [runs(low[p], high[p]) if len(p) > 1 else (low[p[0]:p[0] + 1], high[p[0]:p[0] + 1]) for p in same.values()]
                a, b = (pa.ListArray.from_arrays(np.cumsum([0, *(len(x[0]) for x in places)]).astype(np.int32), np.concatenate([x[side] for x in places])) for side in (0, 1))
                yield pa.record_batch([pa.array(found.key[keep][one].view(np.int64)), ids.take(pa.array(row[one] + first)), a, b, pa.array([len(p) for p in same.values()], pa.int64()),
                                       pa.array([digests[i] for i in one], pa.binary()), pa.array([pieces[i] for i in one], pa.binary())],
                                      ["key", "text_id", "low", "high", "n", "sid", "bytes"])

    return bounded(texts).mapInArrow(cut, "key long, text_id binary, low array<long>, high array<long>, n long, sid binary, bytes binary")


class Shards:
    """Groups of segments packed into lanes; ``flush`` sorts them and gives the repeated ranges of every segment."""

    def __init__(self, length: int):
        self.length = length
        self.lanes: list[list[tuple[bytes, bytes, bool]]] = []
        self.sizes: list[int] = []
        self.open = False

    def add(self, group: list[tuple[bytes, bytes, bool]]) -> None:
        size = sum(len(x[1]) + 1 for x in group)
        if self.open and self.sizes[-1] + size <= LANE:
            self.lanes[-1] += group
            self.sizes[-1] += size
        else:
            self.lanes.append(group)
            self.sizes.append(size)
        self.open = self.sizes[-1] < LANE

    def full(self) -> bool:
        return len(self.sizes) * LANE > 2 * CELLS or sum(self.sizes) > 2 * CELLS

    def flush(self) -> Iterator[pa.RecordBatch]:
        order = np.argsort(self.sizes, kind="stable")[::-1].tolist()
        at = 0
        while at < len(order):
            many = max(1, CELLS // (self.sizes[order[at]] + 1))
            yield from self._sort([self.lanes[i] for i in order[at:at + many]])
            at += many
        self.lanes, self.sizes, self.open = [], [], False

    def _sort(self, lanes: list[list[tuple[bytes, bytes, bool]]]) -> Iterator[pa.RecordBatch]:
        """Symbols are bytes plus 2, 1 behind each segment, 0 at the lane's end."""
        pieces = [x for lane in lanes for x in lane]
        lengths = np.array([len(x[1]) for x in pieces])
        per_lane = np.array([len(lane) for lane in lanes])
        last = np.cumsum(per_lane) - 1
        room = lengths + 1  # the last segment's mark is the lane's end
        ends = np.cumsum(room)
        begin = ends - room
        symbol = np.ones(ends[-1], np.uint16)
        mark = np.zeros(ends[-1], bool)
        mark[ends - 1] = True
        symbol[~mark] = np.frombuffer(b"".join(x[1] for x in pieces), np.uint8).astype(np.uint16) + 2
        symbol[ends[last] - 1] = 0
        starts = begin[np.concatenate([[0], last[:-1] + 1])]
        sizes = ends[last] - starts
        grid = np.zeros((int(sizes.max()), len(lanes)), np.uint16)
        of_lane = np.repeat(np.arange(len(lanes)), sizes)
        grid[np.arange(len(symbol)) - starts[of_lane], of_lane] = symbol
        sa = suffix_arrays(grid, sizes, 258)
        inside = np.arange(grid.shape[0])[None, :] < sizes[:, None]
        ordered = sa.T[inside] + starts[of_lane]
        shared, before = common_prefixes(symbol, starts, sizes, ordered)
        # a window is whole if its segment reaches so far
        left = np.repeat(ends - 1, room) - np.arange(len(symbol))
        hit = np.flatnonzero((shared >= self.length) & (left >= self.length))
        step = np.zeros(len(symbol) + 1, np.int64)
        window = np.zeros(len(symbol), bool)
        window[hit] = window[before[hit]] = True
        whole = np.array([x[2] for x in pieces])
        for i in np.flatnonzero(whole).tolist():
            window[begin[i]:ends[i] - self.length] = True
        window = np.flatnonzero(window)
        np.add.at(step, window, 1)
        np.add.at(step, window + self.length, -1)
        covered = np.concatenate([[0], np.cumsum(step)[:-1] > 0, [0]]).astype(np.int8)
        change = np.diff(covered)
        low, high = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        of = np.searchsorted(begin, low, "right") - 1
        split = np.searchsorted(of, np.arange(len(pieces) + 1))
        some = np.flatnonzero(np.diff(split))
        a, b = (low - begin[of]).tolist(), (high - begin[of]).tolist()
        cut = [(int(split[i]), int(split[i + 1])) for i in some]
        yield _ranges([pieces[i][0] for i in some], [a[i:j] for i, j in cut], [b[i:j] for i, j in cut])


def _ranges(sids: list[bytes], low: list[list[int]], high: list[list[int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(sids, pa.binary()), pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32()))], ["sid", "low", "high"])


def sorted_shards(different: DataFrame, length: int) -> DataFrame:
    """Repeated ranges (sid, low, high) of segments (key, sid, bytes, copies), a shard for each key."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, group, of = Shards(length), [], None
        alone = ([], [], [])

        def close():
            if len(group) == 1 and group[0][2]:  # its copies are all there is
                for out, x in zip(alone, (group[0][0], [0], [len(group[0][1])])):
                    out.append(x)
            elif group:
                shards.add(group)

        for batch in stream:
            for key, sid, data, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "sid", "bytes", "copies"))):
                if key != of:
                    close()
                    group, of = [], key
                group.append((sid, data, copies > 1))
            if shards.full():
                yield from shards.flush()
            if len(alone[0]) > 10_000:
                yield _ranges(*alone)
                alone = ([], [], [])
        close()
        yield from shards.flush()
        yield _ranges(*alone)

    return bounded(different.repartition("key").sortWithinPartitions("key"), 1 << 20).mapInArrow(work, "sid binary, low array<int>, high array<int>")


def repeated_in_groups(different: DataFrame, length: int, gram: int, shard: int) -> DataFrame:
    """Repeated ranges (sid, low, high) of segments (key, sid, bytes, copies): groups as shards, the segments of larger ones cut again."""
    width = length - gram + 1
    if width == 1:  # a segment is a window
        return different.where("copies > 1").select("sid", F.array(F.lit(0)).alias("low"), F.array(F.lit(length)).alias("high"))
    sizes = different.groupBy("key").agg(F.sum(F.length("bytes") + 1).alias("size"))
    large = materialise(sizes.where(F.col("size") > shard), "large-groups")
    small = sorted_shards(different.join(large, "key", "left_anti"), length)
    if large.isEmpty():
        return small
    twice = F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(2)).cast("int")))  # more copies say no more
    again = different.join(large, "key").select(F.col("sid").alias("text_id"), F.col("bytes").alias("text"), twice.alias("copy")).drop("copy")
    cut = covered(again, length, length - max(1, width // 4) + 1, DEALT)
    return small.unionByName(cut.select(F.col("text_id").alias("sid"), *(F.col(c).cast("array<int>").alias(c) for c in ("low", "high"))))


def covered(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int | None = None) -> DataFrame:
    """(text_id, low, high): sorted byte ranges, which may overlap, of every text (text_id, text) that repeated strings cover."""
    keys = materialise(repeated_keys(texts, length, gram), "repeated-keys")
    found = materialise(segments(texts, filters.build(keys, "key", keys.count()), length, gram), "segments")
    different = materialise(found.groupBy("key", "sid", "bytes").agg(F.sum("n").alias("copies")), "different-segments")
    ranges = repeated_in_groups(different, length, gram, SHARD if shard is None else shard)
    ranges = materialise(ranges.select("sid", F.arrays_zip("low", "high").alias("r")), "ranges")
    places = found.select("text_id", "low", "high", "n", "sid").distinct()
    # a segment with several places in its text is covered at all of them
    at = F.when(F.col("n") > 1, F.arrays_zip("low", "high")).otherwise(F.transform("r", lambda x: F.struct((x["low"] + F.col("low")[0]).alias("low"), (x["high"] + F.col("low")[0]).alias("high"))))
    listed = places.join(ranges, "sid").select("text_id", at.alias("r")).groupBy("text_id").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("r"))
    return listed.select("text_id", F.col("r.low").alias("low"), F.col("r.high").alias("high"))


def runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that are sorted by their beginnings."""
    reach = np.maximum.accumulate(high)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return low[begin], reach[np.append(begin[1:], len(low)) - 1]


def removed(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs without the text, with ``kept`` (binary: what remains of its bytes), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs)."""
    others = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*others).alias("row") if others else F.lit(0).alias("row"), F.unhex(F.md5(body.cast("binary"))).alias("text_id"), body.alias("text"))
    found = covered(keyed.select("text_id", "text"), length, gram).withColumnRenamed("text_id", "of")
    joined = keyed.join(found, F.col("text_id") == F.col("of"), "left").select("row", "text", "low", "high")

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            kept, sizes, gone, spans = [], [], [], []
            for body, low, high in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("low"), batch.column("high")):
                sizes.append(len(body))
                if low.is_valid:
                    a, b = runs(low.values.to_numpy(), high.values.to_numpy())
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(body)]
                    kept.append(b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2])))
                    gone.append(int((b - a).sum()))
                    spans.append(len(a))
                else:
                    kept.append(body)
                    gone.append(0)
                    spans.append(0)
            yield pa.record_batch([batch.column("row"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans))],
                                  ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    row = joined.schema["row"].dataType.simpleString()
    out = bounded(joined).mapInArrow(cut, f"row {row}, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.select(*([F.col(f"row.`{c}`").alias(c) for c in others]), "kept", "n_bytes", "n_removed", "n_spans")


__all__ = ["Keys", "Shards", "covered", "removed", "repeated_in_groups", "repeated_keys", "runs", "segments", "sorted_shards"]
