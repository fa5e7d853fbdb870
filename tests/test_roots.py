from pyspark.sql import functions as F

from tidegauge.operators import roots as ro


def roots(spark, edges):
    return {r.x: r.root for r in ro.find_roots(spark.createDataFrame(edges, "x long, p long"), "x", "p").collect()}


def test_small_forest(spark):
    got = roots(spark, [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 5), (7, 7), (8, None), (3, 2), (20, 21), (21, 22), (22, 20), (23, 20), (30, 31), (31, 30)])
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 99, 6: 99, 7: 7, 8: 8, 20: None, 21: None, 22: None, 23: None, 30: None, 31: None}


def test_chain_of_ten_thousand_and_star(spark, monkeypatch):
    rounds = []
    real = ro.materialise
    monkeypatch.setattr(ro, "materialise", lambda df, label: rounds.append(label) or real(df, label))
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    star = spark.range(100_000).select((F.col("id") + 1_000_000).alias("id"), F.when(F.col("id") > 0, F.lit(1_000_000)).alias("p"))
    got = ro.find_roots(chain.unionByName(star), "id", "p").groupBy("root").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10_000), (1_000_000, 100_000)]
    assert len(rounds) <= 2 + 2 * 15


def test_no_posts(spark):
    assert roots(spark, []) == {}


def test_candidates_and_groups(spark):
    posts = spark.createDataFrame([(1, 1, ["a"], ["p"], ["h1"]), (2, 1, ["a", "a"], ["p", "q"], ["h2"]), (3, 1, ["b"], ["q"], []), (4, 4, ["x"], ["x"], []), (5, 5, [], [], [""])],
                                  "post long, root long, e array<string>, f array<string>, h array<string>")
    got = ro.candidate_keys(posts, {"entity": "e", "phrase": "f", "hashtag": "h"})
    rows = {(r.root, r.kind, r.key): (r.support, r.priority) for r in got.collect()}
    assert rows[1, "hybrid", "a__p"] == (2, 460) and rows[1, "entity", "a"] == (2, 360) and (4, "hybrid", "x__x") not in rows and not [k for k in rows if k[0] == 5]
    groups = {r.root: r.group for r in ro.root_groups(posts.select("root").distinct(), got).collect()}
    assert groups == {1: "hybrid:a__p", 4: "entity:x", 5: "root:5"}
