"""Log analytics over enrichment runs, read models and the market board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.basic import c
from tidegauge.operators.windows import best

UNKNOWN = "unknown"


def named(x: str) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(UNKNOWN))


def since(runs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return runs.where(F.col("generated_at") >= as_of - F.make_interval(hours=F.lit(hours)))


def usage(runs: DataFrame, *keys: Column, minimum: int = 1) -> DataFrame:
    """Runs, tokens and latest write per key; the one shape behind most reports."""
    out = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("run_count"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"), F.max("generated_at").alias("latest_write_at"),
    )
    return out.where(F.col("run_count") >= minimum) if minimum > 1 else out


def duplicates(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")


def latest_per_topic(runs: DataFrame, authoritative_only: bool) -> DataFrame:
    src = runs.where("name_status = 'ready' AND name_source IN ('ai_exact', 'historical_exact', 'historical_alias')"
                     " AND canonical_name IS NOT NULL") if authoritative_only else runs
    return best(src, ["topic_key"], [F.col("generated_at").desc(), F.col("id").desc()])


def silent_writers(runs: DataFrame, heartbeats: DataFrame, as_of: Column) -> DataFrame:
    """Writers that wrote in the last day without a heartbeat near their latest write."""
    w = since(runs, as_of, 24).groupBy(named("writer_identity").alias("writer")).agg(
        F.max("generated_at").alias("latest_write_at"), F.count(F.lit(1)).alias("run_count"))
    h = heartbeats.where(F.col("last_seen_at") >= as_of - F.expr("INTERVAL 24 HOURS")).groupBy("writer").agg(
        F.max("last_seen_at").alias("latest_heartbeat_at"))
    return w.join(h, "writer", "left").where(
        F.col("latest_heartbeat_at").isNull() | (F.col("latest_heartbeat_at") < F.col("latest_write_at") - F.expr("INTERVAL 15 MINUTES")))


def writer_report(runs: DataFrame, as_of: Column) -> DataFrame:
    """One row with nested, ordered JSON arrays (few writers, few models: bounded by their dictionaries)."""
    src = since(runs, as_of, 24)

    def rows(keys: list[Column], name: str) -> DataFrame:
        agg = usage(src, *keys)
        cols = [x for x in agg.columns if x not in ("prompt_tokens", "completion_tokens", "latest_write_at")]
        order = F.struct((-F.col("run_count")).alias("o"), *[F.col(x) for x in cols])
        return agg.agg(F.to_json(F.transform(
            F.sort_array(F.collect_list(order)), lambda z: F.struct(*[z[x].alias(x) for x in cols]))).alias(name))

    writers = rows([named("writer_identity").alias("writer"), F.col("authoritative").alias("authoritative")], "writers")
    models = rows([F.col("model_name")], "models")
    return src.agg(
        F.count(F.lit(1)).alias("run_count"), F.bool_or(named("writer_identity") == UNKNOWN).alias("has_unknown"),
        F.count_if(~F.col("authoritative")).alias("unauthorised"),
    ).withColumn("writers", writers.scalar()).withColumn("models", models.scalar())


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Full outer comparison of two aggregates with the difference."""
    joined = left.select(*keys, F.col(a).alias("a")).join(right.select(*keys, F.col(b).alias("b")), keys, "full_outer")
    return joined.select(
        *keys, F.coalesce("a", F.lit(0)).alias(a), F.coalesce("b", F.lit(0)).alias(b),
        (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"),
    )


def coverage(keys: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"))
    return keys.join(a, key, "left").join(b, key, "left").fillna(0, ["left_rows", "right_rows"]).withColumn(
        "delta", F.col("left_rows") - F.col("right_rows"))


def pollution_reason() -> Column:
    """First reason why a stored name looks polluted, NULL when it does not."""
    live = F.col("status").isin("ok", "mixed")
    summary, abstain = F.lower(F.coalesce("summary", F.lit(""))), F.lower(F.coalesce("abstain_reason", F.lit("")))
    compact = F.regexp_replace(F.lower(F.coalesce("raw_label", F.lit(""))), "[^a-z0-9]+", "")
    return (
        F.when(summary.contains("safe fallback because ai enrichment was unavailable")
               | summary.contains("using the cleaned fallback label"), "fallback_narrative")
        .when(abstain.contains("visible runtime ai naming failed"), "runtime_failure")
        .when(live & F.nullif(F.trim("canonical_name"), F.lit("")).isNotNull()
              & (F.lower(F.trim("canonical_name")) == F.lower(F.coalesce(F.trim("raw_label"), F.lit("")))), "canonical_equals_raw")
        .when(live & (F.col("evidence_count") == 0), "missing_evidence")
        .when(live & compact.rlike("(apital|eneral|etting|hased|arket|tion|ment|ally|ized)$"), "fragment_like_raw_label")
    )


def refresh_due(state: DataFrame, as_of: Column, model: str, prompt: str, stale_h: float, cooldown_h: float) -> DataFrame:
    """(due, reason) of every topic; ``state`` is topics left-joined with their stored enrichment."""
    hours = lambda h: F.make_interval(mins=F.lit(int(max(0.5, h) * 60)))
    changed = F.col("stored_hash") != F.col("input_hash")
    cooled = F.col("refreshed_at") + hours(cooldown_h) <= as_of
    reason = (
        F.when(F.col("stored_hash").isNull() & F.col("refreshed_at").isNull(), "missing")
        .when(F.coalesce("stored_hash", F.lit("")) == "", "missing_hash")
        .when(F.col("prompt_version") != prompt, "prompt_version_changed").when(F.col("model_name") != model, "model_changed")
        .when(F.col("expires_at") <= as_of, "expired").when(F.col("refreshed_at").isNull(), "missing_timestamp")
        .when(changed & cooled, "input_hash_changed").when(changed, "input_hash_changed_during_cooldown")
        .when(F.col("refreshed_at") + hours(stale_h) <= as_of, "stale").otherwise("unchanged")
    )
    return state.withColumn("reason", reason).withColumn(
        "due", ~F.col("reason").isin("input_hash_changed_during_cooldown", "unchanged"))


def nearest_window(rows: DataFrame, key: str, target: Column, window_end: str, drift_minutes: int, order: list[Column]) -> DataFrame:
    """Best row per key whose window end lies within the drift around the target."""
    gap = F.abs(F.unix_timestamp(c(window_end)) - F.unix_timestamp(target))
    return best(rows.where(gap <= drift_minutes * 60), [key], order)


def live_status(alive: Column, age_seconds: Column, live: int = 30, delayed: int = 120) -> Column:
    return (
        F.when(~alive, "disconnected").when(age_seconds.isNull(), "stale").when(age_seconds <= live, "live")
        .when(age_seconds <= delayed, "delayed").otherwise("stale")
    )


def token_cost(usage_rows: DataFrame, prices: DataFrame) -> DataFrame:
    return usage_rows.join(prices, "model_name", "left").withColumn(
        "cost", F.col("prompt_tokens") / 1e6 * F.coalesce("prompt_price", F.lit(0.0))
        + F.col("completion_tokens") / 1e6 * F.coalesce("completion_price", F.lit(0.0)))
