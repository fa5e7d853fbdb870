import numpy as np

from tests.llm.conftest import prose
from tidegauge.llm import spans
from tidegauge.llm.arrays import Words
from tidegauge.llm.queries import op4


def cut(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    begin = np.append(spans.sentences(data, np.array([0, len(data)])), len(data))
    out = []
    for a, b in zip(begin[:-1], begin[1:]):
        w = Words(data[a:b], np.array([0, b - a]))
        out.append((data[a:b].tobytes(), w.hash.tolist()))
    return out


def brute(docs, least):
    """Text after removal: every shortest run of sentences from, and to, each sentence; only the first occurrence stays."""
    seen, out = {}, {}
    for d, text in sorted(docs):
        s = cut(text)
        runs = set()
        for i in range(len(s)):
            ahead = [j for j in range(i, len(s)) if sum(len(x[1]) for x in s[i:j + 1]) >= least]
            back = [j for j in range(i + 1) if sum(len(x[1]) for x in s[j:i + 1]) >= least]
            runs |= {(i, ahead[0])} if ahead else set()
            runs |= {(back[-1], i)} if back else set()
        gone = set()
        for a, b in sorted(runs):
            key = tuple(h for x in s[a:b + 1] for h in x[1])
            if seen.setdefault(key, (d, a)) != (d, a):
                gone |= set(range(a, b + 1))
        out[d] = b"".join(x[0] for i, x in enumerate(s) if i not in gone).decode()
    return out


def test_query_matches_brute_force(spark, sf_dir, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect() if len(r.text) < 6000]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in spans.removed(frame).collect()}
    assert got == brute(docs, spans.LEAST)
    assert op4(spark, sf_dir).count() == documents.count()


def test_passage_is_removed_to_both_ends(make):
    passage = f"{prose(30, 1)}. {prose(7, 2)}! {prose(40, 3)}?"
    rows = [(1, f"Start one. {passage} End one."), (2, f"Start two.\n{passage.upper()}\nEnd two."), (3, "Start one. End one."), (4, passage)]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.removed(make(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Start two.\nEnd two.", 3), 3: (rows[2][1], 0), 4: ("", 3)}


def test_sentences_do_not_see_other_rows():
    texts = ["Ends here.", " starts. Then", "\n", "", "said \"no.\" Yes", "\" x. y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    together = spans.sentences(data, offsets)
    alone = np.concatenate([spans.sentences(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) + o for t, o in zip(texts, offsets)])
    assert together.tolist() == alone.astype(int).tolist()


def test_one_id_with_two_texts(make):
    a, b = f"{prose(50, 1)}. {prose(50, 2)}.", f"{prose(50, 3)}. {prose(50, 4)}."
    got = {(r.doc_id, r.text) for r in spans.removed(make([(3, a), (7, a), (7, b)], "doc_id long, text string")).collect()}
    assert got == {(3, a), (7, ""), (7, b)}


def shared(docs, words):
    """(document, sentence) of every sentence that an earlier place has too, with so many shared words around and in it."""
    seen, out = {}, set()
    for d, text in sorted(docs):
        s = cut(text)
        flat, at = [h for x in s for h in x[1]], np.cumsum([0] + [len(x[1]) for x in s])
        for i, x in enumerate(s):
            for other, a in seen.setdefault(tuple(x[1]), []) if x[1] else []:
                left = right = 0
                while left < words and min(at[i], a) > left and flat[at[i] - left - 1] == other[a - left - 1]:
                    left += 1
                while left + right < words and max(at[i] - len(flat), a - len(other)) + right < 0 and flat[at[i] + right] == other[a + right]:
                    right += 1
                if left + right >= words:
                    out.add((d, x[0].decode()))
                    break
            seen.setdefault(tuple(x[1]), []).append((flat, at[i]))
    return out


def test_passages_with_grown_edges(make):
    rows = []
    for n, (left, inner, right) in enumerate([(20, [11], 20), (22, [8, 8], 20), (1, [30], 20), (35, [1], 15), (25, [3, 9, 5], 9), (40, [10], 1), (26, [39], 0), (10, [10], 10)]):
        words = lambda k, m: prose(k, f"{n}p{m}")  # noqa: E731, B023
        passage = ". ".join([words(left, 0), *(words(k, i + 1) for i, k in enumerate(inner)), words(right, 9)]).strip()
        for copy in (0, 100):
            rows.append((n + copy, f"Own {prose(9, f'o{n + copy}')} {passage} and {prose(9, f'e{n + copy}')}."))
    want = shared(rows, 51)
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.removed(make(rows, "doc_id long, text string"), passage=spans.PASSAGE).collect()}
    assert len(want) == 10 and all(sentence not in got[d][0] for d, sentence in want)
    assert sum(n for _, n in got.values()) == len(want)  # 31 shared words stay
    assert all(got[d] == (text, 0) for d, text in rows if d < 100)


def test_query_leaves_no_passage(spark, sf_dir, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect() if len(r.text) < 6000]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in spans.removed(frame, passage=spans.PASSAGE).collect()}
    assert not [1 for d, sentence in shared(docs, spans.PASSAGE) if sentence.encode() in [x[0] for x in cut(got[d])]
                and [x[0] for x in cut(dict(docs)[d])].count(sentence.encode()) == 1]


def test_edges(make):
    p = prose(60, 4) + "."
    long = " ".join(f"{prose(9, i)}." for i in range(6000))
    rows = [(1, None, 7), (2, "", 7), (3, p, 7), (3, p, 7), (None, p, 7), (5, long, 7), (6, long, 7)]
    out = spans.removed(make(rows, "doc_id long, text string, covered long")).collect()
    assert len(out) == 7 and [r.covered for r in out] == [7] * 7
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[5] == [long] and by[6] == [""]
    assert sorted(by[None] + by[3]).count(p) >= 1
    assert spans.removed(make([], "doc_id long, text string")).count() == 0
