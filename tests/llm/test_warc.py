import heapq
import random

import pytest

from tidegauge.llm import warc
from tidegauge.llm.shared import file_store

PAGE = "page_id long, url string, html string, __original string"


def test_loser_tree_merges_like_a_heap():
    r = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted([(f"k{r.randrange(6)}", str(r.randrange(5)), r.choice([None, 1, 2]), "a", i * 1000 + j) for j in range(r.randrange(9))], key=warc.order)
                for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == list(heapq.merge(*runs, key=warc.order))


@pytest.mark.parametrize("url,key", [
    ("https://www.Example.com/A/b?q=1#top", "com,example)/a/b?q=1"), ("http://a.b.org", "org,b,a)/"), ("http://a.org:80/x", "org,a)/x"),
    ("http://a.org:8080/x", "org,a:8080)/x"), (None, ""), ("", ""), ("not a url", "not a url)/")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_copies_runs_and_ranges(spark, make, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    big, small = "é" * 500, "s" * 999
    rows = [(i, f"http://h{i % 3}.com/{i % 5}\r\nx", big if i % 2 else small + str(i), "x") for i in range(60)]
    rows += [(100 + i, "http://h0.com/0", small, "x") for i in range(2)] + [(200, None, None, "x"), (201, None, "", "x"), (None, "http://h1.com/1", big, "x"), (59, "u", big, "x")]
    pages = make(rows, PAGE).repartition(6)
    store = file_store(spark, "warc")
    sample = warc.sorted_runs(warc.write_archives(pages, store), store)
    assert sample.select("run").distinct().count() > 9
    got = warc.merged(sample, store, fan_in=3, range_rows=13).orderBy("range", "at").collect()
    assert len(got) == len(rows) and len({r.range for r in got}) > 1
    keys = [warc.order(tuple(r)[2:]) for r in got]
    assert keys == sorted(keys)
    for r in got:
        if r.payload_bytes == 1000 and r.payload_digest == next(x.payload_digest for x in got if x.page_id == 1):
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 59 else ("revisit", 59))
        else:
            assert (r.record_type, r.refers_to) == ("response", None)


def test_records_round_trip(spark, make):
    html = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 100_000
    pages = make([(7, "http://a.org/ü", html, "x")], PAGE)
    store = file_store(spark, "warc")
    (name,), = warc.write_archives(pages, store).select("name").collect()
    info, page = list(warc.records_of(store, name))
    assert info[2]["WARC-Type"] == "warcinfo" and page[2]["WARC-Target-URI"] == "http://a.org/ü" and page[3].endswith(html.encode())
    with store.read(name) as f:  # the index leads to the record
        import zlib
        f.seek(page[0])
        assert zlib.decompress(f.read(page[1]), 31).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert warc.capture_index(pages.limit(0), store).count() == 0
