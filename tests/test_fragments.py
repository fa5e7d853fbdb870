import random

from pyspark.sql import functions as F

from tidegauge import catalog
from tidegauge.operators import fragments as fr


def test_contained_names_equal_all_pairs(spark):
    rnd = random.Random(4)
    names = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(300)] + ["naïve x", "ïve ", None, "", None]
    got = sorted(tuple(r) for r in fr.contained_names(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect())
    every = {n for n in names if n and len(n) >= 4}
    assert got == sorted((s, w) for s in every for w in every if s != w and s in w)


def test_a_run_in_half_of_all_names_makes_no_pairs(spark):
    """20,000 names share a run of letters; each has a rarer run of its own, so the join stays linear."""
    names = spark.range(20_000).select(F.concat(F.lit("storm"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("name"))
    pairs = fr.contained_names(names.union(spark.createDataFrame([("storm",)], "name string")), "name")
    assert pairs.count() == 20_000  # the word itself lies in all of them, and nothing else in anything


def test_names_of_the_same_common_runs_make_no_pairs(spark):
    """Names of one small set of syllables: none has a rare run, and a name still gives a row for each of its own parts only."""
    syllables = ["stor", "mlan", "dtha", "ting"]
    names = ["".join(syllables[(i // 4 ** k) % 4] for k in range(6)) for i in range(4 ** 6)]
    df = spark.createDataFrame([(n, 1) for n in names] + [("stormlan", 1), ("landthat", 5000)], "name string, support long")
    parts = fr.pieces(df, "name", df, "name")
    assert parts.count() <= len(names) * 21 * 2  # places x lengths (8, 24)
    kept = {r.name for r in fr.drop_fragments(df, "name", "support").collect()}
    assert kept == set(names) | {"landthat"}


def test_fragments_go_only_under_enough_support(spark):
    rows = [("Elon Musk", 10), ("Musk", 10), ("usk", 3), ("Elonmusk", 11), ("Storm", None), ("Solar Storm", 0), ("lar Storm", 1), (None, 5), ("", 5), ("MUSK!", 2), ("rocket", 7), ("rockets", 6)]
    kept = [r.label for r in fr.drop_fragments(spark.createDataFrame(rows, "label string, support long"), "label", "support").collect()]
    # both spellings of one name go together; two words stay; a name with more support than its holder stays
    assert sorted(kept, key=str) == sorted(["Elon Musk", "usk", "Elonmusk", "Solar Storm", "lar Storm", None, "", "rocket", "rockets"], key=str)
    assert fr.drop_fragments(spark.createDataFrame([], "label string, support long"), "label", "support").count() == 0


def test_cut_letters_and_stock_summaries(spark):
    rows = [("qtesla", "tesla", 9, None), ("tesla", "tesla", 9, None), ("tesla", "tesla", 4, None), ("tesla", None, 9, "Topic key appears malformed."),
            ("tesla", None, 9, "Buyers line up for the new car"), ("backlash", None, 9, None), (None, "x", 9, "one two three four five six"), ("tesla", None, 9, "a b c too few unique authors support the cluster")]
    df = spark.createDataFrame(rows, "label string, key string, support int, summary string")
    none = F.lit(None).cast("string")
    got = df.select(fr.board_row_ok("label", "key", none, none, none, "support", ["summary"]).alias("ok"),
                    fr.cut_alias("label", F.array("key"), F.lit(False)).alias("cut")).collect()
    assert [r.ok for r in got] == [False, True, False, False, True, True, False, False]
    assert [r.cut for r in got] == [True] + [False] * 7


def test_rows_of_the_query_take_both_ways(spark, sf_dir):
    catalog.load()
    seen = catalog.QUERIES["board_row_filter"](spark, sf_dir).groupBy("shown", "is_cut_alias").count().collect()
    assert {(r.shown, r.is_cut_alias) for r in seen} >= {(True, False), (False, False), (False, True)}


def test_every_phrase_of_a_long_text_counts(spark):
    from tidegauge.operators import queues as qu

    text = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    df = spark.createDataFrame([(text, "a", 1.0), (text, "b", 2.0), (None, "a", 1.0), ("", "b", 1.0)], "text string, source string, weight double")
    got = qu.breakout_phrases(df, "text", "source", "weight", ["the"]).collect()
    assert len(got) == 298 + 299 and all((r.sources, r.weight) == (2, 3.0) for r in got)
    assert qu.breakout_phrases(df, "text", "source", "weight", ["the"], per_text=8).count() == 8
