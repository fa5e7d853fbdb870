"""Plan shapes that must hold at scale."""

import pytest
from pyspark.sql import functions as F

from tidegauge import catalog
from tidegauge.operators import windows as wi

catalog.load()
CHECKED = ["topic_mentions", "topic_minutes", "topic_day_totals", "topic_day_series_5m", "series_shape_signals", "snapshot_deltas", "established_scores",
           "market_run_board", "topic_asset_links", "cascade_leaders"]


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_n_trims_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(wi.top_n(df, ["k"], [F.col("id").desc()], 2))
    assert text.count("WindowGroupLimit") >= 2


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(catalog.QUERIES["split_rank_per_key"](spark, sf_dir))
    schema = [line for line in text.splitlines() if "ReadSchema" in line]
    assert schema and all("props" not in line for line in schema)


def test_split_rank_with_one_hot_key(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = wi.chunked_rank(df, ["k"], [F.col("id").asc()], "n").where("k = 'hot'")
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 3000, 3000)


def test_global_rank_is_total(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("s"))
    got = wi.global_rank(df, [F.col("s").desc(), F.col("id").asc()], "n")
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 5000, 5000)


def test_momentum_components_are_stages(spark, sf_dir):
    """As one expression the components repeat each other."""
    from tidegauge.catalog import market
    from tidegauge.operators import market as mk

    df = mk.momentum(market.coins(spark, sf_dir)).select("id", "momentum", "signal")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 6


def test_read_model_refresh_reads_written_facts(spark, sf_dir, monkeypatch):
    from tidegauge import catalog as cat
    from tidegauge.catalog import storage

    cat.load()
    seen, refresh = [], storage.rm.refresh

    def look(session, facts, *rest):
        seen.append(facts._jdf.queryExecution().optimizedPlan().toString())
        return refresh(session, facts, *rest)

    monkeypatch.setattr(storage.rm, "refresh", look)
    cat.QUERIES["read_model_refresh"](spark, sf_dir)
    assert len(seen) == 2 and all("Join" not in plan and "parquet" in plan for plan in seen)


def test_topic_minutes_hold_each_mention_once(spark, monkeypatch):
    """No row is held once for every distinct count, tasks follow the number of mentions, and blank authors and posts do not count."""
    from tidegauge.operators import rollups as ru

    monkeypatch.setattr(ru, "TASK_ROWS", 10)
    rows = [("2024-01-01 00:00:00", "p", f"t{i % 3}", None if i % 5 == 0 else "" if i % 5 == 1 else f"u{i % 4}", i // 2 if i % 7 else None, None if i % 6 == 0 else i / 8, i % 4, i % 2 == 0, False, True,
             "neutral") for i in range(200)]
    df = spark.createDataFrame(rows, "bucket_minute string, platform string, normalized_topic string, author_id string, raw_post_id long, quality_score double, topic_priority int, is_repost boolean, "
                               "is_reply boolean, has_link boolean, sentiment_label string")
    out = ru.topic_minutes(df.withColumn("bucket_minute", df.bucket_minute.cast("timestamp_ntz")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and ", 20), REPARTITION_BY_NUM" in plan
    got = {r.topic_key: r for r in out.collect()}
    for t in ("t0", "t1", "t2"):
        of = [r for r in rows if r[2] == t]
        scores = [r[5] for r in of if r[5] is not None]
        r = got[t]
        assert (r.mention_count, r.unique_authors, r.unique_posts) == (len(of), len({x[3] for x in of} - {None, ""}), len({x[4] for x in of} - {None}))
        assert (r.total_quality_score, r.best_topic_priority, r.repost_count, r.link_post_count, r.neutral_count) == (sum(scores), min(x[6] for x in of), sum(x[7] for x in of), len(of), len(of))
        assert abs(r.avg_quality_score - sum(scores) / len(scores)) < 1e-9
