"""Headline queries, one JSON line.  BENCH_SF_DIR, BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegauge import catalog  # noqa: E402
from tidegauge.session import build_session  # noqa: E402

HEADLINE = [
    "topic_mentions", "topic_minutes", "topic_day_totals", "topic_day_series_5m", "topic_rolling_24h", "cluster_totals", "series_shape_signals",
    "series_halves_and_trust", "post_features", "post_topic_candidates", "snapshot_deltas", "cascade_leaders", "interaction_scores", "established_scores",
    "emerging_board", "leaderboard_attention", "near_duplicate_texts", "connected_components", "market_momentum", "market_run_board", "topic_asset_links",
    "runs_expensive_topics", "stream_tumbling_1m", "stream_mentions_publish",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM threads
    times = {}
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
