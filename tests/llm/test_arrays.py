import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tidegauge.llm.arrays import Words, distinct_per_row, parts

ALPHABET = st.sampled_from(list("abAB1 .,\n-éÉßñ") + ["🙂", "日"])


def words_of(text):
    out, word = [], b""
    for ch in (text or ""):
        low = ch.lower() if ch.isascii() or "À" <= ch <= "Þ" and ch != "×" else ch
        code = low.encode()
        if not ch.isascii() or ch.isalnum():
            word += code
        elif word:
            out.append(word)
            word = b""
    return out + [word] if word else out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=30)), max_size=8), st.integers(1, 40))
def test_words_and_shingles_do_not_depend_on_batching(texts, limit):
    seen = {}
    for first, end, data, offsets in parts(pa.array(texts, pa.string()), limit):
        w = Words(data, offsets)
        shingles, at = w.shingles(3)
        for i in range(end - first):
            mine = words_of(texts[first + i])
            assert w.row[i + 1] - w.row[i] == len(mine)
            for word, h in zip(mine, w.hash[w.row[i]:w.row[i + 1]].tolist()):
                assert seen.setdefault(word, h) == h
            want = [tuple(mine[j:j + 3]) for j in range(len(mine) - 2)] if len(mine) > 2 else [tuple(mine)] * bool(mine)
            assert at[i + 1] - at[i] == len(want)
            for s, h in zip(want, shingles[at[i]:at[i + 1]].tolist()):
                assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_very_long_word_and_text():
    text = "x" * 3_000_000 + " " + "yes no " * 400_000
    (_, _, data, offsets), = parts(pa.array([text]))
    w = Words(data, offsets)
    assert len(w.hash) == 800_001 and len(set(w.hash.tolist())) == 3


def test_distinct_per_row():
    values, at = distinct_per_row(np.array([3, 1, 3, 2, 2], np.uint64), np.array([0, 3, 3, 5]))
    assert values.tolist() == [1, 3, 2] and at.tolist() == [0, 2, 2, 3]
