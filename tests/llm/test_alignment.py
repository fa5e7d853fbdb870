import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import alignment
from tidegauge.llm.queries import QUERIES, tokenizer_file

BYTE, PIECE = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "   x", "a  b", "a   b", "x ▁y", "a \nb", "a\n b", "a\n\n  b ", "\ta", "é ﬁ  x", "😀 a", "<|endoftext|> <s> x</s>", "x" * 500 + " y", "don't 's",
       "\x00 a", "a ", " a ", "word " * 3000, "-" * 4000, "  a "]


@pytest.fixture(scope="module")
def encoder():
    with open(BYTE, encoding="utf-8") as a, open(PIECE, "rb") as b:
        return alignment.PairEncoder(a.read(), b.read())


def plain(encoder, text):
    """Ids and groups of one text, token by token."""
    if not text:
        return [], [], []
    a, b = encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text)
    joined = [b"".join(table[i] for i in ids) for table, ids in ((encoder.a_bytes, a), (encoder.b_bytes, b))]
    if joined != [(" " + text).encode()] * 2:
        return [], [], []
    ends = [set(np.cumsum([len(table[i]) for i in ids]).tolist()) for table, ids in ((encoder.a_bytes, a), (encoder.b_bytes, b))]
    groups, at = [], [0, 0, 0, 0]
    for cut in sorted(ends[0] & ends[1]):
        group = []
        for side, (table, ids) in enumerate(((encoder.a_bytes, a), (encoder.b_bytes, b))):
            first = at[side]
            while at[2 + side] < cut:
                at[2 + side] += len(table[ids[at[side]]])
                at[side] += 1
            group.append(ids[first:at[side]])
        groups.append(group)
    return a, b, groups


def expected(encoder, texts):
    found = [plain(encoder, t) for t in texts]
    total = Counter((x[-1], y[-1]) for _, _, groups in found for x, y in groups)
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def test_query_equals_token_by_token(spark, sf_dir, encoder):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *e) for r, e in zip(rows, expected(encoder, [r.text for r in rows])))
    got = sorted(map(tuple, QUERIES["op13_token_links"](spark, sf_dir).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    assert got == want


def test_odd_rows_over_several_blocks(make, encoder):
    texts = ODD * 2 + ["same words here"] * 40
    rows = [(None if i % 7 == 0 else i % 50, t, "x", i) for i, t in enumerate(texts)]
    docs = make(rows, "doc_id int, text string, block string, n_a int").repartition(5)
    got = alignment.align(docs, BYTE, PIECE, groups=lambda g: F.when(g == "", "").otherwise(F.sha2(g.cast("binary"), 256)))
    want = sorted([(r[0] if r[0] is not None else -1, *e) for r, e in zip(rows, expected(encoder, texts))])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect()) == want


def test_groups_are_texts(make, encoder):
    row = alignment.align(make([(1, "some words")], "doc_id long, text string"), BYTE, PIECE).first()
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(encoder, "some words")[2])


def test_long_text_walks_in_lanes(encoder):
    text = "lorem ipsüm dolor 12345 " * 5000
    a, a_at, b, b_at = encoder.encode(pa.array([text, "x", text]))
    ends = np.cumsum(encoder.a_size[a]), np.cumsum(encoder.b_size[b])
    whole = alignment.merged(*ends, a_at[:-1], a_at[1:], lane=1 << 40)
    assert (alignment.merged(*ends, a_at[:-1], a_at[1:], lane=17) == whole).all() and (whole >= 0).sum() == len(np.intersect1d(*ends))


def test_cache_is_emptied(encoder, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 10)
    texts = [f"wörd{i} next{i}" for i in range(30)]
    for t in texts:
        a, _, b, _ = encoder.encode(pa.array([t]))
        assert a.tolist() == plain(encoder, t)[0] and b.tolist() == plain(encoder, t)[1]


def test_empty_table(make):
    assert alignment.align(make([], "doc_id long, text string"), BYTE, PIECE).count() == 0


def test_two_spaces_before_a_bare_character(encoder):
    texts = [" 1", "a  1", "a  1 b", " ѫ", "x  23  y", " ́a", " Ω", "a  b", "1  ", " 😀" * 3, "a  " + "1" * 80]
    a, a_at, b, b_at = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert (a[a_at[i]:a_at[i + 1]].tolist(), b[b_at[i]:b_at[i + 1]].tolist()) == plain(encoder, t)[:2]
