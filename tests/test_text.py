import re

from pyspark.sql import functions as F

from tidegauge.functions import labels as lb, text as tx
from tidegauge.operators import topics as tp

POST = "New $DOGE memecoin drop + dropshipping product idea https://example.com #Crypto @alice"


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()["x"]


def test_sentiment_scenario(spark):
    m = one(spark, tx.sentiment("t"), "I love this but hate the bad execution, still ok overall.")
    assert (m["positive"], m["negative"], m["neutral"], m["label"]) == (3, 4, 1, "negative")


def test_post_scenario(spark):
    df = spark.createDataFrame([(1, POST)], "id long, text string")
    row = tp.post_features(df, "text", F.lit(0)).first()
    assert row["mentions"] == ["alice"] and row["domains"] == ["example.com"] and row["hashtags"] == ["crypto"] and row["cashtags"] == ["doge"]
    assert {"crypto", "memecoin", "dropshipping", "product", "link", "hashtagged"} <= set(row["tags"])


def test_topic_candidates_follow_the_rules(spark):
    df = spark.createDataFrame([
        (1, POST), (2, "Talks between Donald Trump and Bank of England continue. Yesterday Apple fell. The IRAN deal; Apple again"),
        (3, "breaking news about openai and ethereum wallets"), (4, "Protest #NoKings in Portland today, Elon Musk of Tesla said."), (5, ""), (6, "the and of"),
    ], "id long, text string")
    got = {}
    for r in tp.topic_candidates(df, "id", "text").orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["topic_type"], r["topic_key"]))
    assert got[1][0][0] == "cashtag" and len(got[1][0][1].split()) == 2
    assert ("entity", "donald trump") in got[2] and ("entity", "bank england") in got[2]
    assert not any("yesterday" in k for _, k in got[2])  # first word of a sentence, used once
    assert {t for t, _ in got[3]} == {"keyword"}  # only without better candidates
    assert ("hashtag", "no kings") in got[4]
    assert 5 not in got and 6 not in got


def test_candidate_score_table(spark):
    rows = [("climate summit", "entity", 0.56 + 0.12 + 0.08), ("trump", "entity", 0.56 + 0.14), ("one two", "entity", 0.0), ("the", "keyword", 0.0)]
    df = spark.createDataFrame(rows, "k string, t string, want double")
    for r in df.withColumn("got", tx.candidate_score("k", "t", F.lit(0.0), F.lit(0.0))).collect():
        assert abs(r["got"] - r["want"]) < 1e-9, r


def test_topic_key(spark):
    assert one(spark, tx.topic_key("t"), "  Trump’s  #No_Kings!! ") == "trumps #no kings"
    assert one(spark, tx.initcap("t"), "no-kings rally") == "No-Kings Rally"


def test_fragment_variant(spark):
    df = spark.createDataFrame([("itchen", "kitchen", True), ("market", "markets", True), ("abcd", "wxyz", False), ("iran", "iran", False),
                                ("republic", "republican", True)], "a string, b string, want boolean")
    for r in df.withColumn("got", lb.fragment_variant("a", "b")).collect():
        assert r["got"] == r["want"], r


def test_whole_texts_are_used(spark):
    text = " ".join(f"word{i}" for i in range(5000)) + " scam"
    assert one(spark, F.size(tx.tokens("t")), text) == 5001
    assert one(spark, tx.sentiment("t")["negative"], text) == 2


def test_name_runs_of_a_very_long_capitalised_text(spark):
    from pyspark.sql import functions as F

    from tidegauge.operators import topics as tp

    text = " ".join(f"Solar{chr(97 + i % 26)} Storm{chr(97 + i % 7)}" for i in range(10_000))
    row = spark.createDataFrame([(text,)], "t string").select(F.size(tp.name_runs("t", [])).alias("n")).first()
    assert row["n"] == 4000  # names of five words


def test_words_of_a_name_are_looked_at_and_plain_words_are_not(spark):
    texts = {
        "the bank of england and Bank of the England, for 3and Foo-bar of- The Tesla.": ["Bank", "England", "Foo-bar", "Tesla"],
        "we saw Elon Musk at the office of Tesla Motors in Palo Alto": ["Elon Musk", "Tesla Motors in Palo Alto"],
        "it is eBay of many\x01Sony Music, plain\x01 words": ["eBay", "Sony Music"],
    }
    for text, names in texts.items():
        assert one(spark, tp.name_runs("t", []), text) == names, text
    taken = spark.createDataFrame([("so many plain words of a text, and one Name " * 50,)], "t string").select(
        F.regexp_replace("t", tp._PLAIN, tp._CUT).alias("m")).select(F.size(F.regexp_extract_all("m", F.lit(tp._WORD), F.lit(2))).alias("n")).first()
    assert taken["n"] == 50


def test_word_key_is_the_topic_key_of_a_word(spark):
    for word in ("--Open-Source-", "rock'n'roll", "o’clock", "a_b", "AT&T", "x", "", None, "don't", "münchen"):
        df = spark.createDataFrame([(word,)], "t string").select(tx.word_key("t").alias("a"), tx.topic_key("t").alias("b")).first()
        assert df["a"] == df["b"], word
    assert not any(r in tp._WORD + tp._PLAIN for r in ("a-z", "A-Z", "0-9"))


def test_title_words_are_cut_once_for_the_whole_text(spark):
    texts = ["--a-- 'Big' b-c, (Storm)!  $x# ... é", "", " ", "Ends with dash- -begins", "many Ⅳ words—here … \u0085 end\u0085"]
    for text in texts:
        got = one(spark, lb.title_check("t"), text)
        words = [w for w in (re.sub(r"^[^A-Za-z0-9$#]+|[^A-Za-z0-9$#]+$", "", w).lower() for w in re.sub(r"[ \t\n\r\f\v]+", " ", text).strip(" ").split(" ")) if w]
        assert got["word_count"] == len(words), text
    df = spark.createDataFrame([("a",)], "t string").select(lb.title_check("t").alias("r")).select("r.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
