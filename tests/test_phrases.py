import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidegauge import catalog
from tidegauge.functions import phrases as ph
from tidegauge.operators import grouping as gr, phrase_search as ps
from tidegauge.session import shared_dir


def plain(text, phrases, pattern=ph.fixed.PROFILE_WORD_PATTERN):
    normal = " ".join((text or "").split()).lower()
    words = set(re.findall(pattern, normal))
    return sorted(p for p in phrases if (p in words if re.fullmatch(pattern, p) else p in normal))


def test_many_phrases_equal_plain_search(spark):
    """Two thousand phrases, also across word parts, repeated blanks, marks and capitals."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcd'-.") for _ in range(rnd.randint(1, 4)))
    book = ph.PhraseDictionary({"x": [" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(1500)], "y": [word() for _ in range(500)], "none": []})
    texts = [None, "", " ", "A\u0020 B  c", "ab", *(rnd.choice([" ", "  ", "\n"]).join(rnd.choice([word(), word().upper()]) for _ in range(rnd.randint(1, 60))) for _ in range(80))]
    every = sorted({p for g in book.groups.values() for p in g})
    got = book.staged(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t").withColumn("n", book.count("y")).withColumn("z", book.count("none")).collect()
    for r in got:
        want = plain(texts[r.i], every)
        assert sorted(r.found) == want and r.n == sum(p in book.groups["y"] for p in want) and r.z == 0


def test_profile_scenarios(spark):
    rows = [(0, "A viral frog clip", None), (1, "tariff talk", None), (2, "tariff meme", None), (3, "", " Gaming_Meme "), (4, None, "no such"), (5, "AI companion " + "word " * 20_000 + "deepfake", "x")]
    got = {r.i: r for r in ph.attention_profile(spark.createDataFrame(rows, "i long, t string, c string"), ["t"], "c").collect()}
    # frog, clip, frog as object; viral and clip as distribution
    assert got[0].hits.animal_meme == 1 and got[0].hits.meme_distribution == 2 and got[0].hits.tokenizable_object == 2
    assert got[0].attention_score == 8 + 12 + 12 + 10 and got[0].inferred_category == "tokenizable object" and got[0].bucket is None
    assert got[1].attention_score == -12 - 8 - 18 and not got[1].memeified_politics and got[1].inferred_category is None
    assert got[2].memeified_politics and got[2].attention_score == 6 - 12
    assert (got[3].inferred_category, got[3].bucket) == ("gaming meme", "gaming")
    assert got[4].inferred_category is None and got[4].attention_score == -20
    assert got[5].hits.ai_meme_wave == 3 and got[5].inferred_category == "ai meme wave"


def test_profile_plan_has_no_python(spark):
    df = ph.attention_profile(spark.createDataFrame([(1, "x")], "i long, t string"), ["t"])
    assert "Python" not in df._jdf.queryExecution().toString()


def _posts(spark, n=120, seed=3):
    """Texts of few words in four spellings of their order, short and empty ones, documents that come twice, and missing values."""
    rnd = random.Random(seed)
    pool = ["solar", "storm", "market", "rally", "openly", "driver", "ion", "eda", "thursday", "www", "harbour", "lantern", "copper", "meadow"]
    rows = [(i, " ".join(rnd.choices(pool, range(len(pool), 0, -1), k=rnd.randint(0, 14))) + (f" only{i}x" if i % 3 else ""), rnd.choice(["s1", "s2", "s3", None]), i % 5 or None, i % 7, 1.0 + i % 3) for i in range(n)]
    rows += [(900, None, "s1", 1, 1, 1.0), (901, "", "s1", 1, 1, 1.0), (902, "ion eda ion eda", "s1", 1, 1, None), (903, "eda ion", "s2", 1, 1, -2.5), *rows[:9], (5, "copper meadow lantern", "s2", 2, 2, 4.0)]
    return spark.createDataFrame(rows, "doc long, text string, source string, author long, root long, weight double")


def _whole(docs):
    rows = gr.phrase_rows(docs, "doc", "text", ["source", "author", "root", "weight"])
    return rows, gr.phrase_stats(rows, "doc", "weight", "root", "author", "source", None)


def test_searched_phrases_equal_those_of_all(spark, monkeypatch):
    """At one code kept a document, so that every level of the search is taken, and at the usual number."""
    docs, columns = _posts(spark), ("doc", "text", "weight", "root", "author", "source")
    rows, stats = _whole(docs)
    rounded = lambda df: sorted((r.doc, r.group_key, r.by_phrase) for r in df.collect())
    want = rounded(gr.phrase_winner(rows, stats, docs, "doc", F.lit("none")))
    scores = sorted(((r.key, r.docs, r.roots, r.authors, r.sources, round(r.score, 6)) for r in stats.collect()), key=lambda r: (-r[-1], r[0]))
    assert {w[2] for w in want} == {True, False} and len(scores) > 60
    full = []
    monkeypatch.setattr(ps, "codes_of", lambda *a, of=ps.codes_of: full.append(1) or of(*a))
    for kept, codes in ((1, 1000), (16, 1 << 22)):
        monkeypatch.setattr(ps, "KEPT", kept)
        monkeypatch.setattr(ps, "PASS", codes)
        assert rounded(gr.phrase_groups(docs, *columns, F.lit("none"))) == want
    assert full  # some documents had to look at all their phrases
    for n in (20, 100_000):
        got = [(r.key, r.docs, r.roots, r.authors, r.sources, round(r.score, 6)) for r in gr.top_phrases(docs, *columns, n).collect()]
        assert sorted(got, key=lambda r: (-r[-1], r[0])) == scores[:n]


def test_phrase_queries_keep_no_table_of_all_phrases(spark, sf_dir):
    """Rows of phrases are written for those that can win, and removed when they are counted; the words of the texts are a table of batches."""
    catalog.load()
    at = f"{shared_dir(spark)}/tidegauge"
    for name in ("phrase_groups", "phrase_statistics"):
        before = set(os.listdir(at)) if os.path.exists(at) else set()
        catalog.QUERIES[name](spark, sf_dir).collect()
        left = {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before}
        assert "informative-words" in left and not left & {"phrases", "phrase-bounds", "phrases-kept", "phrase-stats"}


def test_no_text_and_no_phrase(spark):
    none = spark.createDataFrame([(1, None, "s", 1, 1, 1.0), (2, "solar", "s", 1, 1, 1.0)], "doc long, text string, source string, author long, root long, weight double")
    assert gr.top_phrases(none, "doc", "text", "weight", "root", "author", "source").count() == 0
    for docs in (none, none.limit(0)):
        got = gr.phrase_groups(docs, "doc", "text", "weight", "root", "author", "source", F.lit("own")).collect()
        assert all(r.group_key == "own" and not r.by_phrase for r in got) and len(got) == docs.count()


def test_upper_bounds_are_not_below(spark):
    rnd = random.Random(2)
    w = np.array([0.0, 1e-30, 1.0, 1 / 3, 9.123456789, 1e6 + 0.1, -2.5, -1 / 3, *(rnd.uniform(-50, 5000) for _ in range(2000))])
    short = (ps._short(w).astype(np.uint32) << np.uint32(16)).view(np.float32)
    assert (short >= w).all() and (short - w <= np.abs(w) / 100 + 1e-20).all()
