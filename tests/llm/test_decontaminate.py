import pytest

from tests.llm.conftest import prose
from tidegauge.llm import decontaminate as dc
from tidegauge.llm.queries import op3


def brute(docs, items, t=0.8):
    out = {}
    sets = {i: dc.shingle_set(x) for i, x in items}
    for d, text in docs:
        have = dc.shingle_set(text)
        for i, want in sets.items():
            if want and len(want & have) / len(want) >= t - 1e-12:
                out[d, i] = len(want & have) / len(want)
    return out


def test_query_matches_brute_force(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()], items)
    got = {(r.doc_id, r.item_id): r.containment for r in op3(spark, sf_dir).collect()}
    assert want and got == pytest.approx(want)


@pytest.mark.parametrize("in_memory", [True, False])
def test_short_items_in_long_documents(spark, make, monkeypatch, in_memory):
    if not in_memory:
        monkeypatch.setattr(dc, "ITEMS_IN_MEMORY", -1)
    item = prose(40, 1).split()
    docs = [(1, f"{prose(20_000, 2)} {' '.join(item).upper()}! {prose(20_000, 3)}", "x"),  # other case, other marks
            (2, " ".join(item[:20]) + " gap " + " ".join(item[20:]), "x"),  # 32 of 36 shingles
            (3, " ".join(item[:30]), "x"),  # 26 of 36
            (4, None, "x"), (5, "", "x"), (6, "alpha beta", "x"), (1, prose(10, 9), "x"), (None, " ".join(item), "x")]
    items = [(7, " ".join(item)), (8, "alpha beta"), (9, None), (10, ""), (11, " ".join(item))]
    got = {(r.doc, r.item): round(r.containment, 3) for r in dc.contained_items(
        make(docs, "doc_id long, text string, item string"), make(items, "item_id long, text string")).collect()}
    assert got == {(1, 7): 1.0, (1, 11): 1.0, (2, 7): 0.889, (2, 11): 0.889, (6, 8): 1.0}


def test_empty_tables(make):
    docs, items = make([(1, "a b c d e f")], "doc_id long, text string"), make([], "item_id long, text string")
    assert dc.contained_items(docs, items).count() == 0
    assert dc.contained_items(docs.limit(0), make([(1, "a b c")], "item_id long, text string")).count() == 0
