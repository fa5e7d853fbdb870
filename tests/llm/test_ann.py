from collections import defaultdict

import numpy as np

from tidegauge.llm import collision_ann as ann
from tidegauge.llm.queries import op8


def exact(ids, vectors, query_id, k=10):
    q = vectors[list(ids).index(query_id)]
    d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query_id][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_recall_of_the_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(dict)
    for r in op8(spark, sf_dir).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in ids[ids % 100 == 0]:
        want = exact(ids, vectors, q)
        mine = [got[q][i] for i in range(1, 11)]
        assert mine == sorted(mine, key=lambda x: (x[1], x[0]))
        hits += len({i for i, _ in want} & {i for i, _ in mine})
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.95


def test_many_blocks_and_clusters(make):
    r = np.random.default_rng(2)
    centres = r.normal(0, 5, (30, 24))
    vectors = centres[r.integers(0, 30, 3000)] + r.normal(0, 0.5, (3000, 24))
    frame = ann.usable(make([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"))
    single = vectors.astype(np.float32).astype(float)
    found = defaultdict(set)
    for x in ann.search(frame, frame.where("vec_id % 100 = 0"), block=500, query_block=7).collect():
        found[x.query_id].add(x.vec_id)
    recall = np.mean([len(found[q] & {i for i, _ in exact(np.arange(3000), single, q)}) / 10 for q in range(0, 3000, 100)])
    assert recall >= 0.95


def test_edges(make):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1),
            (7, [float("inf"), 1.0], 1), (8, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [1.0], 1), (100, [3.0, 0.0], 1), (0, [9.0, 0.0], 1), (200, [], 1)]
    vectors = ann.usable(make(rows, "vec_id long, embedding array<double>, score int"))
    assert sorted(r.vec_id for r in vectors.collect()) == [0, 0, 1, 2, 8, 9, 100]
    out = defaultdict(list)
    for r in sorted(ann.search(vectors, vectors.where("vec_id = 100")).collect(), key=lambda r: r["rank"]):
        out[r.query_id].append((r.vec_id, r.score))
    assert out[100] == [(8, 1.0), (0, 2.0), (1, 2.0), (2, 2.0), (0, 6.0)]
    none = vectors.limit(0)
    assert ann.search(none, none).count() == 0 and ann.search(vectors, none).count() == 0


def test_repeated_rows_and_queries(make):
    """Copies of query and candidate rows change nothing; an id with two vectors asks with the smaller."""
    r = np.random.default_rng(5)
    vectors = r.normal(0, 1, (300, 8)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    copies = rows + [rows[100], rows[100], rows[7]] + [(200, [99.0] * 8)]
    frame = ann.usable(make(copies, "vec_id long, embedding array<float>").repartition(3))
    got = defaultdict(list)
    for x in sorted(ann.search(frame, frame.where("vec_id % 100 = 0")).collect(), key=lambda x: x["rank"]):
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    for q in (0, 100, 200):
        assert got[q] == [(n + 1, i, d) for n, (i, d) in enumerate(exact(np.arange(300), vectors, q))]
