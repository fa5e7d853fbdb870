import random
from collections import defaultdict

from tests.llm.conftest import prose
from tidegauge.llm import ngram_join as nj
from tidegauge.llm.decontaminate import shingle_set
from tidegauge.llm.queries import op5


def brute(docs, t=0.8):
    sets = {d: frozenset(shingle_set(x)) for d, x in docs}
    parent = {d: d for d in sets}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    linked, copies = defaultdict(set), defaultdict(int)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= t * len(x | y) - 1e-9:
                parent[max(find(a), find(b))] = min(find(a), find(b))
                if x == y:
                    copies[a] += 1
                    copies[b] += 1
                else:
                    linked[a].add(y)
                    linked[b].add(x)
    return {d: (find(d), len(linked[d]), copies[d]) for d in ids}


def result(frame):
    return {r.rid: (r.class_id, r.n_links, r.n_copies) for r in nj.classes(frame).collect()}


def test_query_matches_brute_force(spark, sf_dir, documents):
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in op5(spark, sf_dir).collect()}
    assert got == want


def test_large_group_of_near_copies_in_many_blocks(make, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_DOCS", 16)
    r = random.Random(3)
    base = prose(120, 1).split()
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, prose(50, 100 + i)) for i in range(30)]
    assert result(make(docs, "doc_id long, text string")) == brute(docs)


def test_threshold_is_exact(make):
    # 9 words in common of 10 shared shingles: 8 / 10 and 7 / 9
    a, b = prose(13, 1), " ".join(prose(13, 1).split()[:12] + ["z"])
    rows = [(1, a), (2, b), (3, " ".join(prose(13, 1).split()[:-1])), (4, "one two"), (5, "One, two!"), (6, "one three")]
    assert result(make(rows, "doc_id long, text string")) == brute(rows)


def test_edges_and_one_of_each(make):
    long = prose(60_000, 7)
    rows = [(1, None, "a"), (2, "", "b"), (3, "!!", "c"), (5, prose(30), "d"), (5, prose(30), "e"), (6, prose(30), "f"), (None, "no id", "g"), (8, long, "h"),
            (9, long + " x", "i"), (None, None, "j")]
    frame = make(rows, "doc_id long, text string, rid string")
    got = defaultdict(list)
    for r in nj.classes(frame).collect():
        got[r.rid].append((r.class_id, r.n_links, r.n_copies))
    assert got[1] == [(1, 0, 0)] and got[2] == [(2, 0, 0)] and got[3] == [(3, 0, 0)]
    assert got[5] == [(5, 0, 2)] * 2 and got[6] == [(5, 0, 2)] and got[8] == [(8, 1, 0)] and got[9] == [(8, 1, 0)]
    kept = nj.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 8]
    assert nj.classes(frame.limit(0)).count() == 0


def test_bucket_of_a_million_different_members(spark):
    reps = spark.range(1_000_000).selectExpr("id AS rep", "5L AS n", "id AS a", "id AS b", "array(11L, 12L, -id - 1) AS bands")
    got = nj.shared_buckets(reps)
    assert got.count() == 1_000_000  # both shared buckets have the same members and count once
    assert {r.n for r in got.selectExpr("size(buckets) AS n").distinct().collect()} == {1}


def test_posterior_tolerance():
    least = nj.posterior_minimum()
    assert len(least) == nj.HASHES // nj.STEP and all(a <= b for a, b in zip(least, least[1:]))
    assert least[-1] / nj.HASHES > 0.5  # clearly dissimilar pairs are dropped


def test_wordless_copies_leave_one(make):
    rows = [(i, "---") for i in range(50)] + [(60, None), (61, ""), (62, "..."), (63, "a b c d e f"), (64, "..."), (None, "---"), (65, ""), (66, None)]
    kept = [(r.doc_id, r.text) for r in nj.one_of_each(make(rows, "doc_id long, text string").repartition(4)).collect()]
    assert [t for _, t in kept].count("---") == 1
    assert sorted((i, t) for i, t in kept if t != "---" and t is not None) == [(61, ""), (62, "..."), (63, "a b c d e f")]
    assert sorted(i for i, t in kept if t is None) == [60, 66]
