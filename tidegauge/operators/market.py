"""Market rows: gates, health, momentum, best rows, boards, and matching of topics to assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.functions import text as tx
from tidegauge.functions.basic import barrier, Col, c, clamp
from tidegauge.operators.links import top_overlaps
from tidegauge.operators.windows import best, top_n

PAIR = T.StructType([
    T.StructField("chainId", T.StringType()), T.StructField("pairAddress", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("baseToken", T.StructType([T.StructField(x, T.StringType()) for x in ("address", "symbol", "name")])),
    T.StructField("volume", T.StructType([T.StructField(x, T.DoubleType()) for x in ("h1", "h6", "h24")])),
    T.StructField("txns", T.StructType([T.StructField("h24", T.StructType([
        T.StructField("buys", T.LongType()), T.StructField("sells", T.LongType())]))])),
    T.StructField("liquidity", T.StructType([T.StructField("usd", T.DoubleType())])),
])


def flatten_pairs(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Nested pair JSON -> flat columns (typed parse once, struct fields after)."""
    p = df.withColumn("p", F.from_json(payload, PAIR))
    return p.select(
        *keep, F.lower("p.chainId").alias("chain"), F.lower("p.pairAddress").alias("pair"), F.col("p.url").alias("url"),
        F.lower("p.baseToken.address").alias("token"), F.upper("p.baseToken.symbol").alias("symbol"), F.col("p.baseToken.name").alias("name"),
        F.coalesce("p.volume.h1", F.lit(0.0)).alias("volume_1h"), F.coalesce("p.volume.h6", F.lit(0.0)).alias("volume_6h"),
        F.coalesce("p.volume.h24", F.lit(0.0)).alias("volume_24h"), F.coalesce("p.txns.h24.buys", F.lit(0)).alias("buys"),
        F.coalesce("p.txns.h24.sells", F.lit(0)).alias("sells"), F.coalesce("p.liquidity.usd", F.lit(0.0)).alias("liquidity"),
    )


def best_pair(pairs: DataFrame, token: list[str]) -> DataFrame:
    """Deepest pair per token: liquidity, day volume, recent volume, has a URL, address."""
    return best(pairs, token, [
        F.col("liquidity").desc(), F.col("volume_24h").desc(), F.col("volume_1h").desc(), F.col("url").isNotNull().desc(), F.col("pair").desc()])


def merge_hints(hints: DataFrame, key: list[str]) -> DataFrame:
    """Union of discovery sources, seeds and matched topics per token."""
    return hints.groupBy(*key).agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("seed")).alias("seeds"),
        F.count_distinct("topic").alias("topics"))


# --- fixed values: gate thresholds ---------------------------------------------------------
GATES = {
    "basic_liquidity": 750.0, "basic_volume": 400.0, "basic_txns": 2, "max_ratio": 180.0, "dead_volume": 1200.0, "dead_txns": 3,
    "drained_liquidity": 350.0, "dead_liquidity": 2500.0, "dead_age_hours": 24.0, "rug_drop_pct": 94.0,
    "min_liquidity": 6000.0, "min_volume": 2500.0, "min_txns": 6, "new_pair_hours": 1.5, "min_fit": 4.0,
}


def reject_reason(g: dict = GATES) -> Column:
    """First failing market gate, NULL when the row may be used."""
    v24, v6, v1, liq = F.col("volume_24h"), F.col("volume_6h"), F.col("volume_1h"), F.col("liquidity")
    t24, t6, t1, buys, sells = F.col("txns_24h"), F.col("txns_6h"), F.col("txns_1h"), F.col("buys"), F.col("sells")
    import math

    has_volume = (v24 >= g["basic_volume"]) | (v6 >= g["basic_volume"] * 0.4) | (v1 >= g["basic_volume"] * 0.18)
    has_txns = (t24 >= g["basic_txns"]) | (t6 >= max(1, math.ceil(g["basic_txns"] * 0.5))) | (t1 >= 1)
    present = (liq >= g["basic_liquidity"]) & (has_volume | has_txns) & (((buys + sells) > 0) | has_txns)
    ratio = F.when(liq > 0, v24 / liq)
    dried = (
        (v24 <= g["dead_volume"]) & (v6 <= max(80.0, g["dead_volume"] * 0.15)) & (t24 <= g["dead_txns"])
        & (t6 <= max(1, math.ceil(g["dead_txns"] * 0.34))) & ((buys + sells) <= max(4, g["dead_txns"] + 1))
    )
    dump = (
        (F.col("change_24h") <= -g["rug_drop_pct"]) & (sells >= F.greatest(F.lit(8), buys * 2)) & (v6 <= max(120.0, g["dead_volume"] * 0.2))
        & (t6 <= max(1, math.ceil(g["dead_txns"] * 0.5))) & (liq <= max(g["dead_liquidity"], g["drained_liquidity"] * 3))
    )
    return (
        F.when(F.coalesce("url", F.lit("")) == "", "missing_url")
        .when((F.coalesce("name", F.lit("")) == "") | (F.coalesce("symbol", F.lit("")) == "") | F.lower("symbol").isin("null", "none", "token"), "broken_metadata")
        .when(~present, "no_basic_market_presence")
        .when((F.col("price") <= 0) | F.coalesce(F.col("pair") == "", F.lit(True)), "broken_metadata")
        .when((ratio > g["max_ratio"]) | (F.abs("change_24h") >= 1600) | ((liq <= 0) & (v24 <= 0) & (t24 <= 0)), "anti_rug_failed")
        .when((liq <= g["drained_liquidity"]) & dried, "liquidity_drained")
        .when((F.col("age_hours") >= g["dead_age_hours"]) & (liq <= g["dead_liquidity"]) & dried, "dead_pair_activity")
        .when(dump, "rug_pull_signature")
    )


def _log_weight(x: Col, weight: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.log10(F.greatest(c(x), F.lit(0.0)) + 1) * weight)


def market_health() -> Column:
    activity = F.when(F.col("volume_24h") > 0, F.col("volume_1h") / F.col("volume_24h")).otherwise(0.0)
    return clamp(
        _log_weight("liquidity", 10.0, 28.0) + _log_weight("volume_24h", 8.0, 22.0) + F.least(F.lit(16.0), F.log1p(F.greatest(F.lit(0), F.col("txns_24h"))) * 3.2)
        + F.least(F.lit(10.0), F.greatest(F.lit(0.0), activity) * 85) + F.when(F.col("age_hours") >= 1, 3.0).when(F.col("age_hours") >= 0.1, 1.5).otherwise(0.0),
        0.0, 100.0)


def soft_penalties(g: dict = GATES) -> Column:
    """map reason -> penalty for rows below the preferred (not required) levels."""
    def gap(x: str, want: float, base: float, span: float, reason: str) -> Column:
        short = 1 - clamp(F.col(x) / F.lit(float(want)), 0.0, 1.0)
        return F.when(F.col(x) < want, F.struct(F.lit(reason).alias("k"), F.round(base + short * span, 3).alias("v")))

    return F.map_from_entries(F.array_compact(F.array(
        gap("liquidity", g["min_liquidity"], 1.2, 2.6, "low_liquidity"), gap("volume_24h", g["min_volume"], 1.0, 2.4, "low_volume"),
        gap("txns_24h", g["min_txns"], 0.8, 2.0, "low_txns"), gap("age_hours", g["new_pair_hours"], 0.4, 1.2, "fresh_pair"),
        gap("fit", g["min_fit"], 0.35, 1.4, "low_fit"))))


def force_fill_score(penalties: Col, matched: Col, g: dict = GATES) -> Column:
    total = F.round(F.aggregate(F.map_values(c(penalties)), F.lit(0.0), lambda a, x: a + x), 3)
    bonus = (
        F.when(F.size(c(penalties)) == 0, 1.0).otherwise(0.0) + F.when(F.col("liquidity") >= g["min_liquidity"], 1.0).otherwise(0.0)
        + F.when(F.col("volume_24h") >= g["min_volume"], 1.0).otherwise(0.0) + F.when(F.col("txns_24h") >= g["min_txns"], 0.6).otherwise(0.0)
        + F.least(F.lit(4.0), c(matched) * 1.2)
    )
    return F.round(F.col("market_score") * 0.6 + F.col("fit") * 0.25 + bonus - total, 3)


# -- momentum ----------------------------------------------------------------------------------


def _lin(x: Col, low: float, high: float) -> Column:
    return F.coalesce(clamp((c(x) - low) / F.lit(high - low), 0.0, 1.0), F.lit(0.0))


def _logs(x: Col, low: float, high: float) -> Column:
    import math

    span = math.log10(high) - math.log10(low)
    return F.when(c(x) > 0, clamp((F.log10(c(x)) - math.log10(low)) / F.lit(span), 0.0, 1.0)).otherwise(0.0)


def _ratio(x: Col, base: Col, neutral: float, strong: float, fallback: float) -> Column:
    score = clamp((c(x) / c(base) - neutral) / F.lit(strong - neutral), 0.0, 1.0)
    return F.when(F.coalesce(c(x), F.lit(0.0)) <= 0, 0.0).when(F.coalesce(c(base), F.lit(0.0)) <= 0, fallback).otherwise(score)


def _mean(*xs: Column) -> Column:
    return sum(xs[1:], xs[0]) / F.lit(float(len(xs)))


def momentum(df: DataFrame) -> DataFrame:
    """Seven components, three penalties, score 0..100 and the leading signal.

    Stages stand apart, as in one expression the components repeat each other."""
    df = barrier(df)
    p1, p6, p24 = F.col("change_1h"), F.col("change_6h"), F.col("change_24h")
    price = _lin(p1, 0.5, 8.5) * 0.56 + _lin(p6, 1.4, 18) * 0.31 + _lin(p24, 2, 38) * 0.13
    price = price * F.when(p1 < 0, 0.4).otherwise(1.0) * F.when(p6 < 0, 0.6).otherwise(1.0)
    now = F.when(p1 > 0, F.when(p6 <= 0, _lin(p1, 0.5, 6)).otherwise(_ratio(p1, F.greatest(F.abs(p6) / 6, F.lit(0.45)), 1.05, 3.2, 0.42))).otherwise(0.0)
    six = F.when(p6 > 0, F.when(p24 <= 0, _lin(p6, 1.5, 12)).otherwise(_ratio(p6 / 6, F.greatest(F.abs(p24) / 24, F.lit(0.35)), 1, 2.6, 0.4))).otherwise(0.0)
    v24, t24 = F.col("volume_24h"), F.col("txns_24h")
    vol = _mean(_ratio("volume_1h", v24 / 24, 1.02, 4.4, 0.35), _ratio("volume_6h", v24 / 4, 1, 2.8, 0.34))
    txn = _mean(_ratio("txns_1h", t24 / 24, 1, 4, 0.34), _ratio("txns_6h", t24 / 4, 1, 2.7, 0.34))
    df = df.withColumn("m_price", clamp(price, 0.0, 1.0)).withColumn("m_turn", clamp(_mean(now, six), 0.0, 1.0))
    df = barrier(df.withColumn("m_vol", vol).withColumn("m_txn", txn))
    df = df.withColumn("m_accel", clamp(F.col("m_turn") * 0.46 + F.col("m_vol") * 0.33 + F.col("m_txn") * 0.21, 0.0, 1.0))
    turnover = _ratio(v24, "liquidity", 0.9, 7.5, 0.3)
    df = df.withColumn("m_volume", clamp(
        _mean(_logs("volume_1h", 10_000, 450_000), _logs("volume_6h", 45_000, 1_900_000), _logs(v24, 120_000, 6_000_000)) * 0.62
        + _mean(F.col("m_vol"), turnover) * 0.38, 0.0, 1.0))
    df = df.withColumn("m_trades", clamp(
        _mean(_logs("txns_1h", 18, 320), _logs("txns_6h", 80, 1_250), _logs(t24, 220, 6_000)) * 0.6 + F.col("m_txn") * 0.4, 0.0, 1.0))
    total = F.col("buys") + F.col("sells")
    raw = clamp((F.col("buys") / total - 0.48) / F.lit(0.18), 0.0, 1.0)
    df = df.withColumn("m_flow", F.when(total <= 0, 0.5).otherwise(clamp(raw * (0.65 + clamp(total / 400, 0.0, 1.0) * 0.35), 0.0, 1.0)))
    df = barrier(df)
    share = F.col("market_cap") / F.col("fdv")
    sane = (
        F.when((F.col("fdv") <= 0) | (F.col("market_cap") <= 0) | share.isNull(), 0.58).when(share.between(0.55, 1.12), 1.0)
        .when((share >= 0.38) & (share < 0.55), 0.82).when((share >= 0.2) & (share < 0.38), 0.48).when((share > 1.12) & (share <= 1.35), 0.74).otherwise(0.2)
    )
    whole = F.col("url").isNotNull() & F.col("pair").isNotNull()
    df = barrier(df.withColumn("m_sane", sane)).withColumn("m_quality", clamp(
        _logs("liquidity", 40_000, 2_500_000) * 0.42 + _lin("market_score", 54, 86) * 0.22 + _ratio(v24, "liquidity", 0.8, 6.5, 0.36) * 0.16
        + F.col("m_sane") * 0.12 + F.when(whole, 1.0).otherwise(0.2) * 0.08, 0.0, 1.0))
    age = F.col("age_hours")
    fresh = (
        F.when(age.isNull() | (age < 0), 0.4).when(age < 1, 0.05).when(age < 4, 0.18).when(age < 12, 0.5).when(age < 72, 1.0)
        .when(age < 336, 0.86).when(age < 1080, 0.56).when(age < 2160, 0.32).otherwise(0.12)
    )
    pts = lambda cond, x: F.when(cond, x).otherwise(0.0)
    over = pts(p24 >= 45, _lin(p24, 45, 180) * 10 + pts(p1.isNull() | (p1 <= 0.8), _lin(p24, 45, 180) * 9) + pts(p6.isNull() | (p6 <= 2), 4.5)
               + pts(_ratio("volume_1h", v24 / 24, 0.9, 2, 0.28) < 0.26, 3.5))
    over = over + pts((p24 >= 35) & (p1 < F.greatest(F.lit(0.35), p6 / 6 * 0.35)), 4.5) + pts((p24 >= 90) & (p1 < 0), 7.0)
    liq = F.col("liquidity")
    rug = (
        pts(~whole, 18.0) + F.when(liq.isNull() | (liq < 25_000), 22.0).when(liq < 50_000, 14.0).when(liq < 80_000, 7.0).otherwise(0.0)
        + F.when(v24.isNull() | (v24 < 60_000), 16.0).when(v24 < 120_000, 8.0).otherwise(0.0) + F.when(t24 < 80, 8.0).when(t24 < 160, 4.0).otherwise(0.0)
        + pts(F.col("price") <= 0, 30.0) + pts((liq > 0) & (v24 / liq > 18), 6.0) + pts(F.col("m_sane") < 0.25, 8.0)
        + pts((F.col("links") == 0) & (F.col("market_score").isNull() | (F.col("market_score") < 60)), 3.0) + pts(age < 1, 8.0)
    )
    stale = pts(age >= 336, pts(p1.isNull() | (p1 < 0.6), 4.0) + pts(p6.isNull() | (p6 < 2), 4.0) + pts(F.col("m_vol") < 0.34, 3.5)
                + pts(F.col("m_txn") < 0.34, 3.5)) + pts(age >= 1080, 2.0)
    df = barrier(df.withColumn("m_over", clamp(over, 0.0, 28.0)))
    positive = (
        F.col("m_price") * 0.24 + F.col("m_accel") * 0.19 + F.col("m_volume") * 0.17 + F.col("m_trades") * 0.13 + F.col("m_flow") * 0.09
        + F.col("m_quality") * 0.11 + fresh * 0.07
    ) * 100
    penalty = F.col("m_over") * 0.95 + clamp(rug, 0.0, 38.0) + clamp(stale, 0.0, 18.0) * 0.9
    df = barrier(df.withColumn("momentum", F.floor(F.round(clamp(positive - penalty, 0.0, 100.0), 9) + 0.5).cast("long")))
    acc, vo, tr = F.col("m_accel"), F.col("m_volume"), F.col("m_trades")
    signal = (
        F.when((acc >= 0.74) & (vo >= 0.62) & (tr >= 0.56) & (F.col("m_over") <= 8), "Breakout starting").when(acc >= 0.76, "Acceleration")
        .when((vo >= 0.72) & (tr >= 0.6), "Volume confirmation").when((F.col("m_price") >= 0.68) & (F.col("m_over") <= 10), "Early continuation")
        .when((F.col("m_flow") >= 0.66) & (F.col("momentum") >= 55), "Order flow").otherwise("Early strength")
    )
    out = df.withColumn("signal", signal)
    return out.drop(*[x for x in out.columns if x.startswith("m_")])


def momentum_order(rank: str) -> list[Column]:
    return [F.col("momentum").desc(), F.col("change_1h").desc(), F.col("volume_1h").desc(), F.col("txns_1h").desc(), F.col("liquidity").desc(), F.col(rank).asc()]


# -- boards and links ----------------------------------------------------------------------------


def run_board(runs: DataFrame, results: DataFrame, assets: DataFrame, snapshots: DataFrame, links: DataFrame, n_runs: int) -> DataFrame:
    """Latest n good runs joined with results, assets and snapshots, links nested per (run, asset); best row per asset."""
    recent = runs.where("status = 'succeeded' AND published > 0").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(n_runs)
    nested = links.groupBy("run_id", "asset_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("link_score")).alias("s"), F.col("topic").alias("t")))), lambda z: z["t"]).alias("topics"))
    df = results.join(recent.select("run_id", "completed_at"), "run_id").join(assets, "asset_id").join(snapshots, "snapshot_id", "left").join(
        nested, ["run_id", "asset_id"], "left")
    return best(df, ["asset_id"], [F.col("score").desc(), F.col("completed_at").desc(), F.col("run_id").desc(), F.col("snapshot_id").desc()])


def fallback_match(links: DataFrame, assets: DataFrame, rungs: list[str], link_key: str, asset_key: str) -> DataFrame:
    """Match by the first rung that fits (address, pair, URL, symbol), always inside the chain.

    Both sides become (rung, chain, value) rows: one equi join instead of four, with one asset per value."""
    keys = F.array_compact(F.array(*[
        F.when(F.coalesce(r, F.lit("")) != "", F.struct(F.lit(i).alias("rung"), F.lower(r).alias("value"))) for i, r in enumerate(rungs)]))
    a = links.select(link_key, F.lower("chain").alias("chain"), F.explode(keys).alias("x")).select(link_key, "chain", "x.*")
    b = assets.select(asset_key, F.lower("chain").alias("chain"), F.explode(keys).alias("x")).select(asset_key, "chain", "x.*")
    # only the smallest asset of a value can win, so a symbol that very many share is one row
    b = b.groupBy("chain", "rung", "value").agg(F.min(asset_key).alias(asset_key))
    return best(a.join(b, ["chain", "rung", "value"]), [link_key], [F.col("rung").asc(), F.col(asset_key).asc()]).select(link_key, asset_key, "rung")


def topic_asset_links(topics: DataFrame, assets: DataFrame, topic: str, topic_text: str, asset: str, asset_text: str, per_topic: int = 5,
                      floor: float = 0.25) -> DataFrame:
    """Best assets per topic by shared words (``links.top_overlaps``: exact, and no pairs are formed on frequent words that cannot matter)."""
    return top_overlaps(topics, assets, topic, tx.tokens(topic_text), asset, tx.tokens(asset_text), per_topic, floor)


def link_plausible(match_type: Col, overlaps: Column, name_similarity: Col, support: Col, score: Col) -> Column:
    """A link may be shown: explicit origin, any overlap or supporting post, a close name, or a high score."""
    return (c(match_type) == "explicit_origin") | (overlaps > 0) | (c(support) > 0) | (c(name_similarity) >= 0.46) | (c(score) >= 16)


def match_type_priority(match_type: Col) -> Column:
    m = F.lower(F.trim(c(match_type)))
    return F.when(m == "explicit_origin", 3).when(m == "strong_narrative", 2).when(m == "fallback", 1).otherwise(0)


def capped_board(rows: DataFrame, token: str, order: list[Column], flag: str, flag_cap: int, theme: str, theme_cap: int, size: int) -> DataFrame:
    """Unique tokens, at most so many flagged rows and rows per theme, best first."""
    one = best(rows, [token], order)
    per_theme = top_n(one, [theme], order, theme_cap)
    flagged = top_n(per_theme.where(flag).withColumn("__one", F.lit(1)), ["__one"], order, flag_cap).drop("__one")
    return flagged.unionByName(per_theme.where(f"NOT {flag}")).orderBy(*order).limit(size)


def merge_universe(rows: DataFrame, key: list[str], complete: Column, fields: list[str], maxima: list[str], arrays: list[str]) -> DataFrame:
    """One row per identity: fields of the most complete row, maxima of scores, unions of arrays."""
    return rows.withColumn("__c", complete).groupBy(*key).agg(
        *[F.max_by(f, F.struct("__c", f)).alias(f) for f in fields], *[F.max(m).alias(m) for m in maxima],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in arrays], F.count(F.lit(1)).alias("sources"))


def fill_from_latest(assets: DataFrame, snapshots: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """NULL fields of an asset are filled from its latest snapshot."""
    last = snapshots.groupBy(key).agg(*[F.max_by(f, ts).alias(f"l_{f}") for f in fields])
    joined = assets.join(last, key, "left")
    return joined.select(*[x for x in assets.columns if x not in fields], *[F.coalesce(f, f"l_{f}").alias(f) for f in fields])


def recent_publications(links: DataFrame, token: str, theme: str) -> DataFrame:
    """How often every token and every theme was published, in one aggregation."""
    both = F.explode(F.array(F.struct(F.lit("token").alias("kind"), c(token).cast("string").alias("id")),
                             F.struct(F.lit("theme").alias("kind"), c(theme).cast("string").alias("id"))))
    return links.select(both.alias("x")).select("x.*").groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))


def funnel(rows: DataFrame, group: str, checks: dict[str, Column]) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(cond).alias(name) for name, cond in checks.items()])
