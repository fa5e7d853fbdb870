"""WARC archives of pages, and their capture index by external merge.

1. Payloads are digested; of equal payloads of at least 1000 bytes the one with the largest page id is stored (response), the others
   refer to it (revisit).
2. Tasks write archives (WARC 1.1, one gzip member per record), closed at a size limit.
3. Each archive is read back and gives one locally sorted run of captures: URL key, timestamp, page id.
4. Runs are merged by loser trees, FAN_IN at a time until at most that many are left; the last merge is cut into key ranges, one task
   each, so a URL with a third of all captures is many ranges.  A task holds one record batch of each run it merges.

Null html is an empty payload; a null url has the empty key; rows without a page id are never referred to; rows that repeat
the largest page id of their payload are all responses.  Without a timestamp column, captures are one second apart by page id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.shared import FileStore, bounded, materialise

LEAST = 1000  # payload bytes from which copies become revisits
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond; one archive's captures are sorted in memory
FAN_IN = 64
RUN_ROWS = 1024  # captures of a record batch
RANGE_ROWS = 200_000  # captures of a key range of the last merge
GZIP_LEVEL = 3
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)

CAPTURE = pa.schema([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()),
                     ("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("refers_to", pa.int64())])
CAPTURE_DDL = ("urlkey string, timestamp string, page_id long, archive string, offset long, length long, record_type string, "
               "payload_bytes long, payload_digest string, refers_to long")


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query: captures of a site sort together."""
    if not url:
        return ""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(?::(?:80|443)(?=[/?#]|$))?(:\d+)?([^?#]*)(\?[^#]*)?", url)
    host, port, path, query = (m.group(i) or "" for i in (1, 2, 3, 4))
    return ",".join(reversed(host.lower().split("."))) + port + ")" + (path.lower() or "/") + query.lower()


# -- archives --------------------------------------------------------------------------------------


def deduplicated(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """pages with __digest (hex SHA-1 of the payload) and __refers_to (null: response).

    Only payloads that occur twice are kept in the table that pages join; it is written, so its size is known to the planner."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.withColumn("__digest", F.sha1(payload))
    copies = rows.where(F.octet_length(html) >= LEAST).groupBy("__digest").agg(
        F.max(F.col(page_id).cast("long")).alias("__original"), F.count(F.lit(1)).alias("n")).where("n > 1 and __original is not null").drop("n")
    copies = materialise(copies, "page-copies")
    refers = F.when(F.col("__original").isNotNull() & ~F.col("__original").eqNullSafe(F.col(page_id)), F.col("__original"))
    return rows.join(copies, "__digest", "left").withColumn("__refers_to", refers).drop("__original")


def record(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record.  A revisit holds the HTTP headers only; their Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_uri(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def uri_page(uri: str | None) -> int | None:
    tail = uri[12:-1] if uri else ""
    return int(tail) if tail else None


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, store: FileStore, page_id: str = "page_id", url: str = "url", html: str = "html",
                   timestamp: str | None = None) -> DataFrame:
    """Writes the archives; returns their stored list (name, records)."""
    pages = bounded(pages).select(*dict.fromkeys((page_id, url, html, *([timestamp] if timestamp else []))))
    rows = deduplicated(pages, page_id, html).select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
        "__digest", "__refers_to", (F.unix_seconds(F.col(timestamp).cast("timestamp")) if timestamp else F.lit(None).cast("long")).alias("seconds"))

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        attempt, done, out, size, n = f"a{task.taskAttemptId()}", [], None, 0, 0
        name = ""
        for batch in stream:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, link, payload, digest, refers, seconds = row
                if out is None:
                    name, size, n = f"pages-{task.partitionId():06d}-{len(done):04d}.warc.gz", 0, 0
                    out = store.write(name, attempt)
                    info = b"software: tidegauge\r\nformat: WARC File Format 1.1\r\n"
                    out.write(gzip_member((f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{name}>\r\nWARC-Date: "
                                           f"{EPOCH:%Y-%m-%dT%H:%M:%SZ}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n").encode() + info + b"\r\n\r\n"))
                date = capture_time(seconds, key)
                data = gzip_member(record(key, link, date, payload, digest, refers))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    store.commit(name, attempt)
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            store.commit(name, attempt)
            done.append((name, n))
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], ["name", "records"])

    return materialise(rows.mapInArrow(write, "name string, records long"), "archives")


def capture_time(seconds: int | None, page_id: int | None) -> str:
    if seconds is None:
        seconds = EPOCH.timestamp() + (page_id or 0) % 10**9
    return f"{datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds):%Y-%m-%dT%H:%M:%SZ}"


def records_of(store: FileStore, name: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record; holds one record."""
    with store.read(name) as f:
        z, kept, start, at, waiting = zlib.decompressobj(31), [], 0, 0, b""
        while True:
            data = waiting or f.read(1 << 20)
            if not data:
                break
            kept.append(z.decompress(data))
            waiting = z.unused_data
            at += len(data) - len(waiting)
            if z.eof:
                head, _, rest = b"".join(kept).partition(b"\r\n\r\n")
                headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                yield start, at - start, headers, rest[:int(headers["Content-Length"])]
                z, kept, start = zlib.decompressobj(31), [], at


def captures_of(store: FileStore, name: str) -> Iterator[tuple]:
    """Captures of an archive, size and digest of responses computed from what is stored."""
    for offset, length, headers, block in records_of(store, name):
        kind = headers["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        said = int(re.search(rb"Content-Length: (\d+)", http).group(1))
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != said or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged record at {offset} of {name}")
        yield (url_key(headers.get("WARC-Target-URI")), re.sub(r"[^0-9]", "", headers["WARC-Date"]), uri_page(headers["WARC-Record-ID"]), name, offset,
               length, kind, said, digest, uri_page(headers.get("WARC-Refers-To")))


# -- runs and their merge ----------------------------------------------------------------------------


def order(capture: tuple) -> tuple:
    """URL key, timestamp, page id (none first), place."""
    key, time, page = capture[:3]
    return key, time, page is not None, page or 0, capture[3], capture[4]


class RunWriter:
    """A sorted run as an Arrow file: batches can be read by their number."""

    def __init__(self, store: FileStore, name: str, attempt: str):
        self.store, self.name, self.attempt = store, name, attempt
        self.file = store.write(name, attempt)
        self.out = pa.ipc.new_file(self.file, CAPTURE)
        self.rows: list[tuple] = []
        self.firsts: list[tuple] = []

    def add(self, capture: tuple) -> None:
        self.rows.append(capture)
        if len(self.rows) == RUN_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            self.firsts.append(self.rows[0])
            self.out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.rows), CAPTURE)], CAPTURE))
            self.rows = []

    def close(self) -> None:
        self._flush()
        self.out.close()
        self.file.close()
        self.store.commit(self.name, self.attempt)


class Run:
    """Captures of a stored run, from the first one at or after ``low``; holds one batch."""

    def __init__(self, store: FileStore, name: str, low: tuple | None = None):
        self.file = store.read(name)
        self.reader = pa.ipc.open_file(self.file)
        self.batch, self.rows, self.low = 0, iter(()), low
        if low is not None:
            first, last = 0, self.reader.num_record_batches
            while first < last:  # first batch that starts at or after low; the one before may reach it
                mid = (first + last) // 2
                if order(next(self._rows(mid))) < low:
                    first = mid + 1
                else:
                    last = mid
            self.batch = max(0, first - 1)

    def _rows(self, i: int) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in self.reader.get_batch(i).columns))

    def __iter__(self) -> Iterator[tuple]:
        for i in range(self.batch, self.reader.num_record_batches):
            for row in self._rows(i):
                if self.low is None or order(row) >= self.low:
                    yield row


class LoserTree:
    """Merges k sorted sources.  Inner nodes keep the loser of their match, the winner stands on top; after the winner leaves, only
    the matches on its path to the top are played again."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = [iter(s) for s in sources]
        self.k = len(sources)
        self.heads = [next(s, None) for s in self.sources]
        self.keys = [None if h is None else order(h) for h in self.heads]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return self.keys[a] < self.keys[b]

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # while the tree is filled, the first to arrive waits here
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[self.tree[0]] is not None:
            top = self.tree[0]
            yield self.heads[top]
            self.heads[top] = next(self.sources[top], None)
            self.keys[top] = None if self.heads[top] is None else order(self.heads[top])
            self._play(top)


_FIRST_DDL = "run string, captures long, urlkey string, timestamp string, page_id long, archive string, offset long"


def _listed(run: RunWriter, captures: int) -> pa.RecordBatch:
    """The first capture of every batch: the sample that key ranges are cut by."""
    cols = list(zip(*[(run.name, captures if i == 0 else 0, *f[:5]) for i, f in enumerate(run.firsts)]))
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["run", "captures", *CAPTURE.names[:5]])


def sorted_runs(archives: DataFrame, store: FileStore) -> DataFrame:
    """One sorted run per archive; returns the stored sample of their keys."""

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = f"a{TaskContext.get().taskAttemptId()}"
        for batch in stream:
            for name in batch.column("name").to_pylist():
                captures = sorted(captures_of(store, name), key=order)
                run = RunWriter(store, f"run-{name}.arrow", attempt)
                for capture in captures:
                    run.add(capture)
                run.close()
                if captures:
                    yield _listed(run, len(captures))

    return materialise(archives.select("name").repartition(max(1, archives.count())).mapInArrow(read, _FIRST_DDL), "runs")


def merged(sample: DataFrame, store: FileStore, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in order: (range, at, capture columns); ``range`` then ``at`` is the global order."""
    level = 0
    while (runs := sample.select("run").distinct().count()) > fan_in:
        groups = -(-runs // fan_in)
        numbered = sample.groupBy("run").agg(F.sum("captures").alias("captures")).withColumn(
            "g", (F.row_number().over(Window.orderBy("run")) - 1) % groups)  # one row per run
        grouped = numbered.groupBy("g").agg(F.collect_list("run").alias("runs"), F.sum("captures").alias("captures"))  # at most fan_in names

        def merge(stream: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            attempt = f"a{TaskContext.get().taskAttemptId()}"
            for batch in stream:
                for g, names, captures in zip(*(batch.column(c).to_pylist() for c in ("g", "runs", "captures"))):
                    run = RunWriter(store, f"merged-{level}-{g:06d}.arrow", attempt)
                    for capture in LoserTree([Run(store, n) for n in names]):
                        run.add(capture)
                    run.close()
                    yield _listed(run, captures)

        sample = materialise(grouped.repartition(groups, "g").mapInArrow(merge, _FIRST_DDL), "runs")
        level += 1
    names = [r["run"] for r in sample.select("run").distinct().collect()]  # at most fan_in
    total = sample.agg(F.sum("captures")).first()[0] or 0
    keys = ["urlkey", "timestamp", "page_id", "archive", "offset"]
    n = max(1, -(-total // range_rows), min(8, total // 2000))
    ranges = sample.select(F.struct(*keys).alias("low")).repartitionByRange(n, "low").select("low", F.spark_partition_id().alias("p")).groupBy("p").agg(
        F.min("low").alias("low"))
    in_order = Window.orderBy("low")  # one row per range
    ranges = ranges.select((F.row_number().over(in_order) - 1).alias("range"), "low", F.lead("low").over(in_order).alias("high"))
    ranges = materialise(ranges, "ranges")

    def merge_range(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for number, low, high in zip(*(batch.column(c).to_pylist() for c in ("range", "low", "high"))):
                low = order(tuple(low[k] for k in keys)) if number else None  # the first range begins at the beginning
                high = order(tuple(high[k] for k in keys)) if high else None
                rows, at = [], 0
                for capture in LoserTree([Run(store, name, low) for name in names]):
                    if high is not None and order(capture) >= high:
                        break
                    rows.append(capture)
                    if len(rows) == 4096:
                        yield _ranged(number, at, rows)
                        at, rows = at + len(rows), []
                if rows:
                    yield _ranged(number, at, rows)

    return ranges.repartition(n).mapInArrow(merge_range, f"range long, at long, {CAPTURE_DDL}")


def _ranged(number: int, at: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([number] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64())]
    return pa.record_batch(columns + [pa.array(c, f.type) for c, f in zip(zip(*rows), CAPTURE)], ["range", "at", *CAPTURE.names])


def capture_index(pages: DataFrame, store: FileStore, **columns: str) -> DataFrame:
    """Archives, runs and merge in one: the ordered captures of pages."""
    return merged(sorted_runs(write_archives(pages, store, **columns), store), store)


__all__ = ["LoserTree", "capture_index", "captures_of", "deduplicated", "merged", "sorted_runs", "url_key", "write_archives"]
