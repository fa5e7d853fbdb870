import time

from tidegauge.operators import queues as qu


def test_breakout_phrases_need_one_shuffle(spark, tmp_path):
    rows = [("one two three one two", "a", 1.0), ("one two three", "b", 2.0), ("one two one two", "a", 4.0), ("the two", None, 8.0), (None, "c", 16.0), ("one two", None, 32.0)]
    spark.createDataFrame(rows, "text string, source string, weight double").write.parquet(str(tmp_path / "texts"))
    out = qu.breakout_phrases(spark.read.parquet(str(tmp_path / "texts")), "text", "source", "weight", ["the"])
    want = {("one two", 2, 39.0), ("two three", 2, 3.0), ("three one", 1, 1.0), ("two one", 1, 4.0), ("one two three", 2, 3.0), ("two three one", 1, 1.0),
            ("three one two", 1, 1.0), ("one two one", 1, 4.0), ("two one two", 1, 4.0)}
    assert {(r["phrase"], r["sources"], r["weight"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_long_text_costs_no_pair_of_its_words(spark):
    """Different runs of a text are found by hash: 120,000 words take seconds, comparing all runs with each other took minutes."""
    word = lambda i: "w" + "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    text = " ".join(word(i) for i in range(120_000)) + f" {word(0)} {word(1)}"
    df = spark.createDataFrame([(text, "a", 1.0), (f"{word(0)} {word(1)}", "b", 2.0)], "text string, source string, weight double")
    began = time.time()
    got = qu.breakout_phrases(df, "text", "source", "weight", []).where(f"sources > 1 OR phrase LIKE '{word(119_999)}%'").collect()
    assert time.time() - began < 60
    last, a, b = word(119_999), word(0), word(1)
    assert {tuple(r) for r in got} == {(f"{a} {b}", 2, 3.0), (f"{last} {a}", 1, 1.0), (f"{last} {a} {b}", 1, 1.0)}
