import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import substring_dedup
from tidegauge.llm.queries import QUERIES
from tidegauge.llm.suffix_arrays import common_prefixes, suffix_arrays


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha) by a table of all windows."""
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for body in bodies:
        for i in range(len(body) - length + 1):
            w = body[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for body in bodies:
        gone = bytearray(len(body))
        reach = 0
        for i in range(len(body) - length + 1):
            if seen[body[i:i + length]] > 1:
                for j in range(max(i, reach), i + length):
                    gone[j] = 1
                reach = i + length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(body)))
        out.append((len(body), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(body, gone) if not g)).hexdigest()))
    return out


def found(df):
    return [tuple(r) for r in df.select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 200)))
    got = QUERIES["op11_repeated_bytes"](spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(2, 30))) for _ in range(6)]
    texts = [None, "", "x", "-" * 900, "-" * 39, "ab" * 300, "\x00" * 100, "a" * 40, "a" * 40]
    for _ in range(80):
        texts.append("".join(rnd.choice([*passages, word(), word(), word()]) for _ in range(rnd.randint(1, 12))))
    return texts + texts[20:30]


@pytest.mark.parametrize("shard, dealt, windows", [(1 << 16, 1 << 13, 1 << 20), (200, 100, 97), (1, 1, 1 << 20), (1, 400, 1 << 20)])
def test_shards_large_groups_and_slices(make, monkeypatch, shard, dealt, windows):
    """The same rows whether groups are one shard or dealt to several, and however long texts are sliced."""
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "DEALT", dealt)
    monkeypatch.setattr(substring_dedup, "WINDOWS", windows)
    texts = corpus(5)
    docs = make([(None if i % 5 == 0 else i % 9, t, "c", i) for i, t in enumerate(texts)], "doc_id long, text string, low string, sid long").repartition(6)
    got = substring_dedup.removed(docs, length=40, gram=12)
    assert got.columns == ["doc_id", "low", "sid", "kept", "n_bytes", "n_removed", "n_spans"]
    assert sorted((r.sid, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got.withColumn("h", F.sha2("kept", 256)).collect()) == [
        (i, *b) for i, b in enumerate(brute(texts, 40))]


def test_one_passage_in_many_surroundings(make):
    rnd = random.Random(3)
    passage = " ".join(str(rnd.random()) for _ in range(30))
    texts = [f"{rnd.random()} {rnd.random()} {passage} {rnd.random()}" for _ in range(400)]
    got = substring_dedup.removed(make([(t,) for t in texts], "text string"))
    assert sorted(found(got)) == sorted(brute(texts, 200))


def test_large_groups_cost_rows_by_segments(make, monkeypatch):
    """No table of the way has a row for every window of a passage in many surroundings; runs of one byte and cut characters go the same way."""
    rnd = random.Random(4)
    passage = "é" + " ".join(str(rnd.random()) for _ in range(12)) + "ü"
    texts = [f"{rnd.random()} {rnd.random()} {passage} {rnd.random()} {rnd.random()}" for _ in range(400)] + ["-" * n for n in range(150, 450)] + ["é" * n for n in range(90, 240)]
    rows = []
    write = substring_dedup.materialise

    def counted(df, label):
        out = write(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "materialise", counted)
    got = substring_dedup.removed(make([(t,) for t in texts], "text string"))
    assert sorted(found(got)) == sorted(brute(texts, 200))
    assert max(rows) < 20 * len(texts)


def test_empty_table(make):
    assert substring_dedup.removed(make([], "doc_id long, text string")).count() == 0


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        texts = [rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)) for _ in range(rng.integers(1, 10))] + [np.ones(90, int), np.array([1, 2] * 50)]
        sizes = np.array([len(t) + 1 for t in texts])
        grid = np.full((sizes.max(), len(texts)), 3)
        for m, t in enumerate(texts):
            grid[:len(t), m], grid[len(t), m] = t, 0
        sa = suffix_arrays(grid, sizes, 6)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([np.append(t, 0) for t in texts]).astype(np.uint16)
        shared, before = common_prefixes(flat, starts, sizes, np.concatenate([sa[:n, m] + starts[m] for m, n in enumerate(sizes)]))
        for m, t in enumerate(texts):
            x = [*t, 0]
            order = sorted(range(len(x)), key=lambda i: x[i:])
            assert order == sa[:len(x), m].tolist()
            for j, i in zip(order, order[1:]):
                n = next(k for k in range(len(x)) if x[i + k] != x[j + k])
                assert (shared[starts[m] + i], before[starts[m] + i]) == (n, starts[m] + j)
