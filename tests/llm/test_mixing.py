import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidegauge.llm import mixing
from tidegauge.llm.queries import op7


def water(sizes, weights, share=1.5):
    """Targets by resharing what is cut off."""
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > 2 * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / w for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def check(rows, texts):
    sizes, taken, targets = Counter(), Counter(), {}
    for doc_id, source, size, source_size, target, got in rows:
        sizes[source] += size
        taken[source] += got
        targets[source] = (target, source_size)
        assert got in (0, size, 2 * size)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in order:
        assert targets[s] == (pytest.approx(want[s]), sizes[s])
        yield s, abs(taken[s] - want[s])


def test_query(spark, sf_dir, documents):
    info = {r.doc_id: r for r in documents.collect()}
    rows = op7(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(info)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", info[r.doc_id].text or "")) for r in rows)
    gaps = dict(check([(r.doc_id, info[r.doc_id].source, r["size"], r.source_size, r.target, r.taken) for r in rows], info))
    sizes = [len((r.text or "").split()) for r in info.values()]
    assert max(gaps.values()) < np.median(sizes)  # ten documents a source: not every sum can be reached
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op7(spark, sf_dir).collect()))


def test_edges(make):
    rows = [(i, "a " * (i % 7), None if i % 3 else "s", 1) for i in range(400)] + [(1, None, "s", 1), (None, "x y", "s", 1), (2, "a a ", None, 1), (9, "q " * 9000, "one", 1)]
    docs = make(rows, "doc_id long, text string, source string, target int")
    sized = mixing.prepared(docs)
    out = mixing.apply(sized, mixing.plan(sized)).collect()
    assert len(out) == len(rows) and docs.columns == out[0].__fields__[:4]
    gaps = dict(check([(r.doc_id, r.source, r["__size"], r["__source_size"], r["__target"], r["__copies"] * r["__size"]) for r in out], None))
    assert gaps[None] <= 2 and gaps["s"] <= 2
    empty = mixing.prepared(docs.limit(0))
    assert mixing.apply(empty, mixing.plan(empty)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.floats(0, 2))
def test_budget_is_met_as_far_as_lengths_allow(hist, share):
    lengths, counts = np.array([h[0] for h in hist]), np.array([h[1] for h in hist])
    total = int((lengths * counts).sum())
    target = share * total
    passes, take = mixing.fit_budget(lengths, counts, target)
    assert (take >= 0).all() and (take <= counts).all() and passes <= 2
    got = passes * total + int((lengths * take).sum())
    assert abs(got - target) <= lengths.max() / 2 + 1 and (passes < 2 or got == 2 * total)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 5)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 120))
def test_knapsack_is_optimal(hist, budget):
    lengths, counts = np.array([h[0] for h in hist]), np.array([h[1] for h in hist])
    sums = {0}
    for length, n in hist:
        sums = {s + k * length for s in sums for k in range(n + 1)}
    take = mixing.knapsack(lengths, counts, budget)
    assert (take <= counts).all() and int((lengths * take).sum()) == min(sums, key=lambda s: (abs(s - budget), s))
