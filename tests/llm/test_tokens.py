import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import tokens
from tidegauge.llm.queries import op1, tokenizer_file
from tidegauge.llm.shared import file_store


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return tokens.PieceEncoder(f.read())


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_like_the_library(encoder):
    r = random.Random(5)
    bits = ["a", "B", "é", " ", " ", "\n", "\n", "\t", "\r", "'s", ".", "!!", "1", "\x85", "<|endoftext|>", "日", "\0", "🙂", " foo"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None, "", " ", "\n"]
    for text, code in zip(texts, encoder.encode(pa.array(texts))):
        assert np.frombuffer(bytes(code), "<u2").tolist() == direct(encoder, text), repr(text)


def test_cache_generations(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    texts = [f"one two w{i % 7} one v{i}" for i in range(40)]
    for i in range(0, 40, 4):
        for text, code in zip(texts[i:i + 4], encoder.encode(pa.array(texts[i:i + 4]))):
            assert np.frombuffer(bytes(code), "<u2").tolist() == direct(encoder, text)


def test_query_matches_direct_encoding(spark, sf_dir, encoder, documents):
    at = 0
    got = {r.doc_id: r for r in op1(spark, sf_dir).collect()}
    rows = sorted(documents.select("doc_id", "text").collect())
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = direct(encoder, text) + [0]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_edges_and_random_access(spark, make, encoder):
    rows = [(3, "b c d e", "x"), (None, "no id", "x"), (1, None, "x"), (2, "", "x"), (3, "b c d e", "y"), (9, "long " * 5000, "x")]
    docs = make(rows, "doc_id long, text string, start string")  # a column named like one of the result
    store = file_store(spark, "tokens")
    shards = tokens.write_shards(docs, store, tokenizer_file(), length=8, shard_tokens=50)
    out = tokens.read_documents(shards, store).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 3, 9]
    assert [r.n_tokens for r in out][1:3] == [1, 1]
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])[:-1]]).tolist()
    first = shards.orderBy("part", "seq").first()
    ids, mask = tokens.sequence(store, first["name"], 0)
    assert len(ids) == len(mask) == 8 and ids[:2].tolist() == direct(encoder, "no id")[:2]
    assert sum(tokens.sequence(store, first["name"], i)[1].sum() for i in range(-(-first["n_tokens"] // 8))) == first["n_tokens"]
    assert tokens.read_documents(tokens.write_shards(docs.limit(0), store, tokenizer_file()), store).count() == 0
