import difflib
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import links as lk


def words(rnd, n, pool):
    return sorted({f"w{min(int(rnd.paretovariate(0.7)), pool)}" for _ in range(n)})


def all_pairs(topics, assets, k, floor):
    out = {}
    for t, tw in topics:
        rows = []
        for a, aw in assets:
            s = len(set(tw) & set(aw))
            if s:
                lex = round(s / min(len(tw), len(aw)) * 0.6 + s / (len(tw) + len(aw) - s) * 0.4, 6)
                rows.append((-lex, -s, a))
        out[t] = [(a, -s, -x) for x, s, a in sorted(rows) if -x >= floor][:k]
    return {t: r for t, r in out.items() if r}


@pytest.mark.parametrize("floor", [0.0, 0.25])
def test_top_overlaps_equal_all_pairs(spark, floor):
    rnd = random.Random(11)
    topics = [(f"t{i}", words(rnd, rnd.randint(1, 9), 60)) for i in range(120)] + [("hot", ["w1"]), ("none", ["absent"]), ("empty", [])]
    assets = [(i, words(rnd, rnd.randint(1, 12), 60)) for i in range(300)] + [(900 + i, []) for i in range(3)]
    got = lk.top_overlaps(spark.createDataFrame(topics, "topic string, tw array<string>"), spark.createDataFrame(assets, "asset long, aw array<string>"), "topic", "tw", "asset", "aw", 5, floor)
    found = {}
    for r in got.orderBy("topic", "place").collect():
        found.setdefault(r.topic, []).append((r.asset, r.shared, r.lexical))
    want = all_pairs([t for t in topics if t[1]], [a for a in assets if a[1]], 5, floor)
    assert {t: [(a, s, pytest.approx(x, abs=2e-6)) for a, s, x in rows] for t, rows in want.items()} == found


def test_assets_of_equal_words_are_the_k_smallest(spark, monkeypatch):
    """2,000 assets of four sets of words, in any order of the words: at most k of a set go on, and the best of every topic are those of all assets."""
    rows = {}
    write = lk.materialise

    def counted(df, label):
        out = write(df, label)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    monkeypatch.setattr(lk, "materialise", counted)
    sets = [["x", "y"], ["z", "x"], ["y", "z", "x"], ["z"]]
    assets = [(7 * i % 2000, sets[i % 4][::-1] if i % 3 else sets[i % 4]) for i in range(2000)]
    topics = [("a", ["x", "y"]), ("b", ["z"]), ("c", ["q", "y", "z"])]
    got = lk.top_overlaps(spark.createDataFrame(topics, "topic string, tw array<string>"), spark.createDataFrame(assets, "asset long, aw array<string>"), "topic", "tw", "asset", "aw", 5)
    found = {}
    for r in got.orderBy("topic", "place").collect():
        found.setdefault(r.topic, []).append((r.asset, r.shared, pytest.approx(r.lexical, abs=2e-6)))
    assert all_pairs(topics, assets, 5, 0.25) == found
    assert rows["asset-words"] <= 20


def test_a_word_of_half_of_all_assets_makes_no_pairs(spark, monkeypatch):
    """2,000 topics and 4,000 assets share one word: 4 million pairs; the stored rounds hold a few rows per topic."""
    seen = []
    real = lk.materialise
    monkeypatch.setattr(lk, "materialise", lambda df, label: seen.append((label, real(df, label))) or seen[-1][1])
    topics = spark.range(2000).select(F.col("id").alias("topic"), F.array(F.lit("hot"), F.concat(F.lit("r"), F.col("id") % 50)).alias("tw"))
    assets = spark.range(4000).select(F.col("id").alias("asset"), F.array(F.when(F.col("id") % 2 == 0, "hot").otherwise("cold"), F.concat(F.lit("r"), F.col("id") % 400)).alias("aw"))
    got = lk.top_overlaps(topics, assets, "topic", "tw", "asset", "aw", 5, 0.25)
    assert got.groupBy("topic").count().where("count = 5").count() == 2000
    assert max(df.count() for label, df in seen if label == "overlaps") <= 2000 * 5
    plans = " ".join(df._jdf.queryExecution().toString() for _, df in seen)
    assert "CartesianProduct" not in plans and "BroadcastNestedLoopJoin" not in plans


def test_containments_equal_plain_search(spark):
    rnd = random.Random(4)
    text = lambda a, b: "".join(rnd.choice("abc") for _ in range(rnd.randint(a, b)))
    texts, terms = [(i, text(0, 30)) for i in range(150)] + [(999, None)], [(i, text(0, 6)) for i in range(80)] + [(99, "zz"), (98, None)]
    got = lk.containments(spark.createDataFrame(texts, "p long, body string"), spark.createDataFrame(terms, "q long, word string"), "p", "body", "q", "word")
    assert sorted(map(tuple, got.collect())) == sorted((p, q) for p, t in texts for q, w in terms if t and w and w in t)


def test_posts_that_share_a_run_store_a_row_per_class(spark, monkeypatch):
    """3,000 posts of 150 texts whose symbols all begin alike: classes and terms are stored, no rows for the characters of posts."""
    seen = []
    real = lk.materialise
    monkeypatch.setattr(lk, "materialise", lambda df, label: seen.append(real(df, label)) or seen[-1])
    rows = [(f"p{i}", f"t{i % 3}", f"Say $K{i % 150}!", [f"K{i % 50}"], float(i % 7)) for i in range(3000)]
    assets = [(i, f"K{i}", f"Coin K{i}") for i in range(200)]
    got = lk.support(spark.createDataFrame(rows, "post string, topic string, text string, cashtags array<string>, weight double"),
                     spark.createDataFrame(assets, "asset long, symbol string, name string"), "topic", "asset")
    want = {}
    for _, topic, text, tags, weight in rows:
        flat = "".join(ch for ch in text.lower() if ch.isalnum())
        for a, symbol, name in assets:
            if symbol in tags or symbol.lower() in flat or name.lower().replace(" ", "") in flat:
                n, w = want.get((topic, a), (0, 0.0))
                want[topic, a] = (n + 1, w + weight)
    assert {(r.topic, r.asset): (r.posts, r.interactions) for r in got.collect()} == want
    assert max(df.count() for df in seen) <= 2 * len(assets)


def test_name_similarity_equals_the_standard_library(spark):
    """100,000 pairs, with and without the bound."""
    rnd = random.Random(8)
    names = ["".join(rnd.choice("abcdeABC 1-") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    pairs = [(i, rnd.choice(names), rnd.choice(names)) for i in range(100_000)]
    flat = lambda x: "".join(ch for ch in x.lower() if ch.isalnum())

    def partial(a, b):
        s, g = sorted((a, b), key=len)
        if a == b or len(s) < 4:
            return 0.0
        return len(s) / len(g) if s in g else 0.87 if s[:4] == g[:4] else 0.0

    want = {}
    for _, a, b in pairs:
        x, y = flat(a), flat(b)
        if (x, y) not in want:
            want[x, y] = (difflib.SequenceMatcher(None, x, y).ratio(), partial(x, y)) if x and y else (0.0, 0.0)
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    for r in lk.name_similarity(df, "a", "b").collect():
        assert r.similarity == pytest.approx(max(want[flat(r.a), flat(r.b)]))
    for r in lk.name_similarity(df.limit(20_000), "a", "b", least=0.6).collect():
        ratio, part = want[flat(r.a), flat(r.b)]
        assert r.similarity == pytest.approx(max(ratio, part)) if ratio >= 0.6 else r.similarity <= max(ratio, part) + 1e-9


def test_link_scores_and_choice(spark):
    base = dict(exact=0, phrase=0, entity=0, alias=0, partial=0, seed=0, generic=0, longest_exact=0, name_similarity=0.0, symbol_similarity=0.0, posts=0, interactions=0.0, matched=False,
                hours=None, volume_1h=0.0, volume_24h=0.0, culture_hits=0, asset_political=False, topic_political=False)
    rows = [dict(base, topic="a", asset=1, exact=2, phrase=2, entity=2, matched=True, posts=2, interactions=50.0, hours=2.0, volume_1h=10.0, volume_24h=100.0, longest_exact=6),
            dict(base, topic="a", asset=2, generic=3), dict(base, topic="a", asset=3, partial=1), dict(base, topic="a", asset=3, partial=1),
            dict(base, topic="b", asset=2, generic=3), dict(base, topic="b", asset=4)]
    schema = ("topic string, asset long, exact int, phrase int, entity int, alias int, partial int, seed int, generic int, longest_exact int, name_similarity double, symbol_similarity double, posts long, "
              "interactions double, matched boolean, hours double, volume_1h double, volume_24h double, culture_hits int, asset_political boolean, topic_political boolean")
    scored = lk.link_scores(spark.createDataFrame([tuple(r[x.split()[0]] for x in schema.split(", ")) for r in rows], schema))
    got = {(r.topic, r.asset): r for r in scored.collect()}
    one = got["a", 1]
    assert (one.match_type, one.evidence_score, one.timing_score) == ("explicit_origin", 18 + 30 + 30 + 16 + 6, 17.0) and one.lexical_score == 68 + 8
    assert got["a", 2].link_score == 0.0 and got["a", 2].match_type == "fallback"
    picked = lk.chosen_links(scored, "topic", "asset", [F.col("link_score").desc(), F.col("asset").asc()])
    assert sorted((r.topic, r["rank"], r.asset) for r in picked.collect()) == [("a", 1, 1), ("a", 2, 3), ("b", 1, 2), ("b", 2, 4)]


def test_thematic_fit(spark):
    rows = [(1, "a meme dog coin on x.com", "DOGE", ["dex_boosts_top"], False, "https://t.me telegram, twitter", ["t"]), (2, "staking protocol bridge", "BRDG", [], False, "", []),
            (3, None, None, [], True, None, [])]
    got = {r.id: r for r in lk.thematic_fit(spark.createDataFrame(rows, "id long, text string, name string, sources array<string>, takeover boolean, socials string, topics array<string>"),
                                            "text", "name", "sources", "takeover", "socials", "topics").collect()}
    # meme and dog as style, doge as the name's style; meme, dog and "com" as culture; telegram and twitter; one topic
    assert got[1].culture_hits == 3 and got[1].fit == pytest.approx(16 + 4 + 5.4 + 10 + 3 + 1.5)
    assert got[2].fit == 0.0 and got[3].fit == 14.0
