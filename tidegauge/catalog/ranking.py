"""Score models and leaderboards on one row per subject, derived from all events."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.series import TOTALS_SQL, TRUST_SQL, topic_totals, week, week_sql
from tidegauge.catalog.sqlkit import arr, big, r1, r6, split_list as _split, ts
from tidegauge.functions import scores as sc
from tidegauge.operators import ranking as rk, series as se
from tidegauge.plans import standins as st

_C = "TIMESTAMP '2024-01-30 12:00:00'"
_N = _C.replace("TIMESTAMP", "TIMESTAMP_NTZ")


def _base(c, count, bool_or):
    return f"""k, round(sum(value), 2) AS total,
 round(sum(CASE WHEN ts >= {c} - INTERVAL 7 DAY THEN value ELSE 0 END), 2) AS current,
 round(sum(CASE WHEN ts < {c} - INTERVAL 7 DAY AND ts >= {c} - INTERVAL 14 DAY THEN value ELSE 0 END), 2) AS prior,
 count(*) AS documents, {count}(DISTINCT user_id) AS authors, {count}(DISTINCT event_type) AS spread,
 sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS narrative,
 sum(CASE WHEN event_type IN ('view', 'click') AND ts >= {c} - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS current_narrative,
 sum(CASE WHEN event_type IN ('view', 'click') AND ts < {c} - INTERVAL 7 DAY AND ts >= {c} - INTERVAL 14 DAY THEN 1 ELSE 0 END) AS prior_narrative,
 min(ts) AS first_seen, max(ts) AS last_seen"""


_DERIVED = """k % 101 AS freshness, CAST(k % 100 AS DOUBLE) AS live_share, CAST(k % 23 AS DOUBLE) AS live_velocity, k % 9 AS threads,
 CAST(least(100, documents) AS DOUBLE) AS persistence, k % 7 AS sources, k % 5 AS roots, k % 60 AS label_quality, k % 3 AS confirmed_spread,
 k % 100 / {hundred} AS concentration, k % 11 = 0 AS has_spike, k % 4 = 0 AS low_data, k % 6 = 0 AS is_established,
 CASE k % 5 WHEN 0 THEN 'Emerging' WHEN 1 THEN 'Expanding' WHEN 2 THEN 'Established' WHEN 3 THEN 'Fading' ELSE 'Declining' END AS stage,
 CASE k % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'delayed' WHEN 2 THEN 'mixed' ELSE 'stale' END AS freshness_state, k * 37 AS first_seen_minutes"""
_PC = "(({a}) - ({b})) / greatest({b}, {one}) * 100"

ROWS = f"""{st.ACTIONS_SQL}, b0 AS (SELECT {_base(_C, 'count', 'bool_or')} FROM actions GROUP BY k),
b1 AS (SELECT *, {r1(_PC.format(a='current', b='prior', one='1.0::DOUBLE'))} AS growth_rate, {r1('(current - prior) / 40')} AS acceleration,
 {_DERIVED.format(hundred='100.0::DOUBLE')} FROM b0),
b2 AS (SELECT *, {r1('least(documents / 250.0::DOUBLE, 1) * 44 + least(threads / 8.0::DOUBLE, 1) * 18 + least(greatest(sources, authors) / 6.0::DOUBLE, 1) * 18 + least(roots / 5.0::DOUBLE, 1) * 12 + least(current / 40.0::DOUBLE, 1) * 10 - least(12.0::DOUBLE, greatest(0, concentration) * 18)')} AS raw_confidence FROM b1),
trend AS (SELECT *, {r1('raw_confidence * ' + r1('least(1, greatest(0.55::DOUBLE, 0.55::DOUBLE + least(100, freshness) / 100.0::DOUBLE * 0.45::DOUBLE))') + " * CASE freshness_state WHEN 'fresh' THEN 1 WHEN 'delayed' THEN 0.96 WHEN 'mixed' THEN 0.9 ELSE 0.78 END::DOUBLE")} AS confidence FROM b2)"""


def rows(spark, sf):
    from tidegauge.functions.basic import pct_change, round1

    df = st.actions(spark, sf).groupBy("k").agg(*[
        F.expr(e) for e in _split(_base(_N, "count", "bool_or"))[1:]
    ])
    df = df.withColumn("growth_rate", round1(pct_change("current", "prior"))).withColumn("acceleration", round1((F.col("current") - F.col("prior")) / 40))
    df = df.selectExpr("*", *_split(_DERIVED.format(hundred="100.0D")))
    df = df.withColumn("raw_confidence", sc.confidence("documents", "threads", "sources", "current", "authors", "roots", "concentration"))
    return df.withColumn("confidence", sc.adjusted_confidence("raw_confidence", "freshness", "freshness_state"))


@query("confidence_scores", f"WITH {ROWS} SELECT k, {r6('raw_confidence')} AS raw_confidence, {r6('confidence')} AS confidence, {r6('growth_rate')} AS growth_rate FROM trend")
def _(spark, sf):
    return rows(spark, sf).select("k", "raw_confidence", "confidence", "growth_rate")


_NORM = lambda x: f"CASE WHEN {x} > 0 THEN {r1(f'{x} / greatest(max({x}) OVER (), 1) * 100')} ELSE 0 END"
_CL = lambda x, a=0, b=100: f"least({b}::DOUBLE, greatest({a}::DOUBLE, {x}))"
_RF = lambda f, lo=0.55, sp=0.45: r1(f"least(1, greatest({lo}::DOUBLE, {lo}::DOUBLE + {_CL(f)} / 100 * {sp}::DOUBLE))")
EST = f"""{ROWS}, e0 AS (SELECT *, live_share * log2(authors + 1) AS dom FROM trend),
e1 AS (SELECT *, {r1(f"({_NORM('total')}) * 0.54::DOUBLE + ({_NORM('current')}) * 0.2::DOUBLE + ({_NORM('narrative')}) * 0.12::DOUBLE + ({_NORM('current_narrative')}) * 0.04::DOUBLE + ({_NORM('live_velocity')}) * 0.05::DOUBLE + ({_NORM('dom')}) * 0.05::DOUBLE")} AS base FROM e0),
e2 AS (SELECT *, {r1(_CL('base * ' + _RF('freshness')))} AS attention_score FROM e1),
est AS (SELECT *, {r1(_CL(f"attention_score * 0.3::DOUBLE + confidence * 0.18::DOUBLE + {_CL('50 + growth_rate * 2.4::DOUBLE')} * 0.18::DOUBLE + {_CL('50 + acceleration * 7.5::DOUBLE')} * 0.14::DOUBLE + {_CL('spread / 6.0::DOUBLE * 100')} * 0.08::DOUBLE + persistence * 0.12::DOUBLE + {_CL('(live_share - 35) * 0.18::DOUBLE', 0, 8)}"))} AS strength,
 attention_score BETWEEN 14 AND 62 AND growth_rate >= -4 AND acceleration >= 1.8 AND spread >= CASE WHEN live_share >= 45 THEN 1 ELSE 2 END AND spread <= 4
  AND persistence BETWEEN 14 AND 92 AND stage IN ('Emerging', 'Expanding') AS is_early FROM e2)"""


@query("established_scores", f"WITH {EST} SELECT k, {r6('attention_score')} AS attention_score, {r6('strength')} AS strength, is_early FROM est")
def _(spark, sf):
    return rk.established(rows(spark, sf)).select("k", "attention_score", "strength", "is_early")


@query(
    "rank_changes",
    f"""WITH {ROWS} SELECT k, row_number() OVER (ORDER BY current DESC, k) AS rank_now, row_number() OVER (ORDER BY prior DESC, k) AS rank_before,
    row_number() OVER (ORDER BY prior DESC, k) - row_number() OVER (ORDER BY current DESC, k) AS position_change FROM trend""",
)
def _(spark, sf):
    return rk.rank_change(rows(spark, sf), "k", "current", "prior").select("k", "rank_now", "rank_before", "position_change")


_MOM = lambda x, s: r1(_CL(f"50 + {x} * {s}::DOUBLE"))
_LIFT = lambda a, b: r1(_CL(f"(log2(({a} + 2) / ({b} + 2)) + 0.2::DOUBLE) * 32 + least(14, log10({a} + 1) * 10)"))


@query(
    "emerging_from_established",
    f"""WITH {EST}, r AS (SELECT *, row_number() OVER (ORDER BY attention_score DESC, k) AS rnk FROM est),
    x AS (SELECT *, {r1(f"{_MOM('growth_rate', 1.7)} * 0.22::DOUBLE + {_MOM('acceleration', 8)} * 0.28::DOUBLE + {_LIFT('current', 'prior')} * 0.28::DOUBLE + {_LIFT('current_narrative', 'prior_narrative')} * 0.22::DOUBLE")} AS abn,
      {r1(_CL('16 + least(44, spread * 15) + least(36, threads * 7) + least(16, log2(authors + 1) * 4)'))} AS spr,
      {r1(_CL('confidence + CASE WHEN low_data AND confidence >= 34 THEN 6 ELSE 0 END - CASE WHEN confidence < 28 THEN 12 WHEN confidence < 36 THEN 5 ELSE 0 END'))} AS conf,
      CASE WHEN attention_score <= 52 THEN least(18, (52 - attention_score) * 0.45::DOUBLE) ELSE 0 END AS small,
      {r1("CASE WHEN attention_score > 58 THEN least(30, (attention_score - 58) * 0.85::DOUBLE) ELSE 0 END + CASE WHEN rnk <= 3 THEN 18 WHEN rnk <= 6 THEN 10 WHEN rnk <= 10 THEN 4 ELSE 0 END + CASE stage WHEN 'Established' THEN 8 WHEN 'Fading' THEN 12 WHEN 'Declining' THEN 18 ELSE 0 END")} AS pen FROM r)
    SELECT k, rnk AS attention_rank, {r6(r1(_CL("abn * 0.42::DOUBLE + spr * 0.18::DOUBLE + CASE stage WHEN 'Emerging' THEN 100 WHEN 'Expanding' THEN 92 WHEN 'Established' THEN 36 WHEN 'Fading' THEN 22 ELSE 8 END * 0.15::DOUBLE + conf * 0.15::DOUBLE + small + CASE WHEN has_spike THEN 4 ELSE 0 END - pen")))} AS emerging_score FROM x""",
)
def _(spark, sf):
    from tidegauge.operators.windows import global_rank

    df = rk.established(rows(spark, sf))
    df = global_rank(df, [F.col("attention_score").desc(), F.col("k").asc()], "attention_rank")
    return rk.emerging_from_established(df).select("k", "attention_rank", "emerging_score")


_REP = "CASE WHEN concentration > 0.88 THEN 18 WHEN concentration > 0.76 THEN 10 ELSE 0 END"
_L2 = lambda x, f, cap: f"least({cap}, log2({x} + 1) * {f})"


@query(
    "emerging_board",
    f"""WITH {ROWS}, v AS (SELECT *, {_LIFT('current', 'prior')} AS il, {_LIFT('current_narrative', 'prior_narrative')} AS nl,
      {_CL('least(56, total / greatest(documents, 1) * 3) + least(24, log10(current + 1) * 16)')} AS inten FROM trend),
    w AS (SELECT *, {r1(_CL(f"{_MOM('growth_rate', 1.9)} * 0.26::DOUBLE + {_MOM('acceleration', 8.4)} * 0.28::DOUBLE + il * 0.24::DOUBLE + nl * 0.14::DOUBLE + inten * 0.12::DOUBLE + CASE WHEN has_spike THEN 6 ELSE 0 END"))} AS velocity,
      {r1(_CL(f"CASE WHEN first_seen_minutes <= 60 THEN 100 WHEN first_seen_minutes <= 360 THEN 88 WHEN first_seen_minutes <= 720 THEN 72 WHEN first_seen_minutes <= 1440 THEN 54 WHEN first_seen_minutes <= 2880 THEN 34 ELSE 16 END * 0.56::DOUBLE + il * 0.18::DOUBLE + CASE WHEN prior <= current THEN greatest(0, 30 - least(30, prior * 2.2::DOUBLE)) ELSE 0 END + CASE WHEN concentration <= 0.55 THEN 14 WHEN concentration <= 0.72 THEN 8 ELSE 0 END - {_REP} - CASE WHEN is_established THEN 12 ELSE 0 END"))} AS novelty,
      {r1(_CL(f"14 + least(30, confirmed_spread * 16) + least(24, sources * 6) + {_L2('authors', 7, 20)} + least(14, roots * 4) - CASE freshness_state WHEN 'mixed' THEN 6 WHEN 'stale' THEN 16 ELSE 0 END"))} AS confirmation FROM v),
    z AS (SELECT *, {r1(_CL(f"velocity * 0.3::DOUBLE + novelty * 0.24::DOUBLE + confirmation * 0.16::DOUBLE + {_CL('freshness')} * 0.1::DOUBLE + {_CL('confidence')} * 0.08::DOUBLE + {_CL('50 + growth_rate * 2.4::DOUBLE')} * 0.07::DOUBLE + {_CL('50 + acceleration * 7.5::DOUBLE')} * 0.05::DOUBLE + CASE WHEN has_spike THEN 4 ELSE 0 END - CASE WHEN is_established THEN 24 ELSE 0 END - CASE stage WHEN 'Established' THEN 10 WHEN 'Fading' THEN 14 WHEN 'Declining' THEN 18 ELSE 0 END - CASE WHEN total >= 160 THEN 10 WHEN total >= 90 THEN 4 ELSE 0 END - CASE WHEN label_quality < 42 THEN 10 WHEN label_quality < 50 THEN 4 ELSE 0 END - {_REP}"))} AS breakout FROM w)
    SELECT k, {r6('velocity')} AS velocity, {r6('novelty')} AS novelty, {r6('confirmation')} AS confirmation, {r6('breakout')} AS breakout,
      {r6(r1(_CL(f"(least(100, log10(total + 1) * 28) * 0.62::DOUBLE + least(100, log10(current + 1) * 34) * 0.38::DOUBLE) * {_RF('freshness', 0.42, 0.58)}")))} AS attention_score
    FROM z WHERE breakout >= 30 OR current >= 10""",
)
def _(spark, sf):
    return rk.emerging_board(rows(spark, sf)).select("k", "velocity", "novelty", "confirmation", "breakout", "attention_score")


# -- stable path: totals + trust -> scores -> leaderboards
_ST = f"""{week_sql()}, {TOTALS_SQL}, {TRUST_SQL}, mood AS (SELECT subject, count(*) FILTER (WHERE event_id % 4 = 0) AS pos, count(*) FILTER (WHERE event_id % 4 = 1) AS neg,
 count(*) FILTER (WHERE event_id % 4 > 1) AS neu, CAST(greatest(0, floor((1706616000 - floor(epoch(max(ts)))) / 60 + 0.5)) AS BIGINT) + subject * 15 AS age FROM items GROUP BY 1),
s0 AS (SELECT *, {_CL('100 - age * 1.6::DOUBLE')} AS freshness, {_CL('log2(greatest(1, m) + 1) * 12 + log2(greatest(1, p) + 1) * 16')} AS vol, greatest(0, growth_rate) AS g,
 (pos - neg) / (pos + neg + neu) AS bal FROM trust JOIN mood USING (subject)),
stable AS (SELECT subject, m AS total_mentions, p AS posts, a AS unique_authors, growth_rate, acceleration, velocity, freshness, vol AS volume, bal AS sentiment_balance,
 {_CL('vol * 0.85::DOUBLE + freshness * 0.15::DOUBLE')} AS confidence, {_CL('g * 0.55::DOUBLE + least(24, velocity * 0.35::DOUBLE)')} AS novelty,
 {_CL('vol * 0.72::DOUBLE + freshness * 0.08::DOUBLE + least(20, p * 0.45::DOUBLE)')} AS confirmation,
 {_CL('velocity * 0.34::DOUBLE + g * 0.28::DOUBLE + vol * 0.28::DOUBLE + freshness * 0.10::DOUBLE + greatest(0, bal) * 4')} AS breakout,
 {_CL('vol * 0.68::DOUBLE + g * 0.10::DOUBLE + freshness * 0.12::DOUBLE + least(10, velocity * 0.10::DOUBLE)')} AS strength,
 {_CL('m + p * 0.35::DOUBLE + g * 0.4::DOUBLE + freshness * 0.08::DOUBLE', 0, 1000)} AS attention_score,
 CASE WHEN age <= 12 THEN 'fresh' WHEN age <= 30 THEN 'mixed' WHEN age <= 90 THEN 'delayed' ELSE 'stale' END AS state FROM s0)"""
_SCOLS = ["growth_rate", "velocity", "freshness", "volume", "sentiment_balance", "confidence", "novelty", "confirmation", "breakout", "strength", "attention_score"]


def stable(spark, sf):
    mood = st.actions(spark, sf).withColumn("subject", F.col("k") % 10).groupBy("subject").agg(
        F.count_if(F.col("event_id") % 4 == 0).alias("positive"), F.count_if(F.col("event_id") % 4 == 1).alias("negative"),
        F.count_if(F.col("event_id") % 4 > 1).alias("neutral"),
        F.greatest(F.lit(0), F.floor((F.lit(1706616000) - F.unix_timestamp(F.max("ts"))) / 60 + 0.5)).alias("age0"),
    ).withColumn("age_minutes", F.col("age0") + F.col("subject") * 15)
    trust = se.halves_and_trust(week(spark, sf), topic_totals(spark, sf), "subject", 336, 30)
    return rk.stable_scores(trust.join(mood, "subject"))


@query(
    "stable_scores",
    f"""WITH {_ST} SELECT subject, {', '.join(f'{r6(x)} AS {x}' for x in _SCOLS)}, state, CASE WHEN state = 'stale' AND growth_rate < -20 THEN 'Declining' WHEN growth_rate >= 60 THEN 'Emerging'
    WHEN growth_rate >= 20 THEN 'Expanding' WHEN growth_rate <= -35 THEN 'Fading' ELSE 'Established' END AS stage FROM stable""",
)
def _(spark, sf):
    return stable(spark, sf).select("subject", *_SCOLS, "state", "stage")


for _mode, _order in rk.ORDERS.items():
    query(
        f"leaderboard_{_mode}",
        f"""WITH {_ST} SELECT subject, {r6(_order[0])} AS sort_value FROM stable
        ORDER BY {', '.join(f'round(CAST({x} AS DOUBLE), 9) DESC' for x in _order)}, subject LIMIT 5""",
    )(lambda spark, sf, mode=_mode, first=_order[0]: rk.leaderboard(stable(spark, sf), mode, "subject", 5).select(
        "subject", F.col(first).cast("double").alias("sort_value")))


_TIER = """CASE WHEN k % 17 = 0 THEN 'audit_low_information' WHEN k % 13 = 0 OR k % 100 / 100.0 >= 0.72 THEN 'audit_template' WHEN k % 11 = 0 THEN 'audit_fallback'
 WHEN roots = 2 AND authors <= 2 AND concentration >= 0.5 AND (total < 6 OR confidence < 6) THEN 'audit_low_information'
 WHEN roots <= 1 THEN CASE WHEN k % 3 = 0 THEN 'audit_low_information' ELSE 'secondary_singleton' END ELSE 'primary_grouped' END"""


@query(
    "leaderboard_tiers",
    f"""WITH {ROWS}, t AS (SELECT k, confidence, {_TIER} AS tier FROM trend) SELECT k, tier, {r6('confidence')} AS quality FROM t
    ORDER BY list_position(['primary_grouped','secondary_singleton','audit_fallback','audit_template','audit_low_information'], tier), confidence DESC, k LIMIT 40""",
)
def _(spark, sf):
    df = rows(spark, sf).withColumn("spam", F.col("k") % 100 / 100.0).withColumn("quality", F.col("confidence"))
    t = rk.tier("roots", "authors", "concentration", "total", "confidence", "spam", F.col("k") % 17 == 0, F.col("k") % 13 == 0,
                F.col("k") % 11 == 0, F.col("k") % 3 == 0)
    return rk.tier_first(df.withColumn("tier", t), "k", 40).select("k", "tier", "quality")


@query(
    "pinned_row",
    f"""WITH {ROWS}, r AS (SELECT k, total, row_number() OVER (ORDER BY total DESC, k) AS n FROM trend), last_ AS (SELECT k FROM r ORDER BY n DESC LIMIT 1)
    SELECT k, {r6('total')} AS total, CASE WHEN n < 12 THEN n ELSE 12 END AS place, n > 12 AS pinned FROM r WHERE n < 12 OR k = 42 AND n >= 12 OR (n = 12 AND EXISTS (SELECT 1 FROM r WHERE k = 42 AND n <= 12))""",
)
def _(spark, sf):
    return rk.pin(rows(spark, sf).select("k", "total"), "k", [F.col("total").desc(), F.col("k").asc()], 42, 12)


@query(
    "related_rows",
    f"""WITH {ROWS} SELECT a.k, b.k AS mate, {r6('b.total')} AS mate_score, row_number() OVER (PARTITION BY a.k ORDER BY b.total DESC, b.k) AS place
    FROM trend a JOIN trend b ON a.k % 8 = b.k % 8 AND a.k <> b.k QUALIFY place <= 4""",
)
def _(spark, sf):
    df = rows(spark, sf).withColumn("cluster", F.col("k") % 8)
    return rk.related(df, "cluster", "k", "total").select("k", "mate", "mate_score", "place")


@query(
    "series_seed_rows",
    f"""WITH {ROWS}, r AS (SELECT k, documents AS m, documents AS p, authors AS a, last_seen, row_number() OVER (ORDER BY documents DESC, authors DESC, k) AS n FROM trend),
    rest AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC, p DESC, k) AS f FROM r WHERE n > 28 AND m >= 4 AND (m >= 8)::INT + (p >= 4)::INT + (a >= 3)::INT >= 2)
    SELECT k, 'volume' AS seed FROM r WHERE n <= 28 UNION ALL SELECT k, 'fresh' FROM rest WHERE f <= 12""",
)
def _(spark, sf):
    df = rows(spark, sf).selectExpr("k", "documents AS total_mentions", "documents AS unique_posts", "authors AS unique_authors", "last_seen AS last_seen_at")
    return rk.series_seeds(df, "k", 40).select("k", "seed")


@query(
    "queue_interleave",
    """SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn,
    CAST(floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1) / 3) AS BIGINT) AS chunk FROM supplier""",
)
def _(spark, sf):
    df = rk.round_robin(st.table(spark, sf, "supplier"), "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey").asc()])
    return df.select("s_suppkey", "s_nationkey", "turn", rk.chunk_number("turn", 3).alias("chunk"))


@query(
    "queue_weights",
    "SELECT n_nationkey, CAST(n_regionkey + 1 AS BIGINT) AS weight, unnest(range(1, n_regionkey + 2)) AS turn FROM nation",
)
def _(spark, sf):
    df = st.table(spark, sf, "nation").selectExpr("n_nationkey", "n_regionkey + 1 AS weight")
    return rk.repeat_by_weight(df, "weight")


@query(
    "queue_rotating_slice",
    "SELECT c_custkey, c_mktsegment, n FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM customer) WHERE (n - 1 - 7 + 1000 * m) % m < 6",
)
def _(spark, sf):
    from tidegauge.operators.windows import chunked_rank

    ring = chunked_rank(st.table(spark, sf, "customer"), ["c_mktsegment"], [F.col("c_custkey").asc()], "n")
    return rk.rotating_slice(ring, "c_mktsegment", "n", 7, 6).select("c_custkey", "c_mktsegment", "n")


@query(
    "relevance_bands",
    f"""WITH {EST}, r AS (SELECT k, attention_score AS s, row_number() OVER (ORDER BY attention_score DESC, k) AS n, count(*) OVER () AS c FROM est),
    l AS (SELECT *, CASE WHEN c >= 100 THEN 48 ELSE greatest(greatest(1, floor(c * 0.25 + 0.5)), floor(c * 0.52 + 0.5)) END AS hm, CASE WHEN c >= 100 THEN 45 ELSE c - greatest(1, floor(c * 0.25 + 0.5)) END AS mm FROM r),
    h AS (SELECT *, s >= 50 AND row_number() OVER (PARTITION BY s >= 50 ORDER BY n) <= hm AS high FROM l)
    SELECT k, n AS attention_rank, CASE WHEN high THEN 'high' WHEN s >= 34 AND row_number() OVER (PARTITION BY high, s >= 34 ORDER BY n) <= mm THEN 'medium' ELSE 'low' END AS band FROM h""",
)
def _(spark, sf):
    from tidegauge.operators.windows import global_rank

    df = rk.established(rows(spark, sf))
    df = global_rank(df, [F.col("attention_score").desc(), F.col("k").asc()], "attention_rank")
    return rk.relevance_bands(df, "attention_rank", "attention_score").select("k", "attention_rank", "band")


_ARCH = "CASE p_size % 9 WHEN 0 THEN 'mascot' WHEN 1 THEN 'visual_absurdity' WHEN 2 THEN 'catchphrase' WHEN 3 THEN 'personality' WHEN 4 THEN 'community_joke' WHEN 5 THEN 'pop_culture' WHEN 6 THEN 'tech_drama' WHEN 7 THEN 'political_meme' ELSE 'other' END"


@query(
    "narrative_quality",
    f"""SELECT p_partkey, {r6(f"p_size * 2 * 0.48::DOUBLE + p_partkey % 100 * 0.2::DOUBLE + p_partkey % 10 / 10.0::DOUBLE * 100 * 0.18::DOUBLE + least(20, p_size % 5 * 4 + p_size % 3 * 2) + CASE {_ARCH} WHEN 'mascot' THEN 8 WHEN 'visual_absurdity' THEN 7 WHEN 'catchphrase' THEN 5 WHEN 'personality' THEN 4 WHEN 'community_joke' THEN 3 WHEN 'pop_culture' THEN 2 WHEN 'tech_drama' THEN -2 WHEN 'political_meme' THEN -4 ELSE 0 END + CASE WHEN p_partkey % 90 <= 6 THEN 9 WHEN p_partkey % 90 <= 24 THEN 6 WHEN p_partkey % 90 <= 72 THEN 3 ELSE 0 END - p_partkey % 80 * 0.22::DOUBLE")} AS quality FROM part""",
)
def _(spark, sf):
    df = st.table(spark, sf, "part").selectExpr(
        "p_partkey", "p_size * 2 AS meme", "p_partkey % 100 AS visual", "p_partkey % 10 / 10.0D AS conf", "p_partkey % 80 AS dry",
        "p_size % 5 AS evidence", "p_size % 3 AS sources", f"{_ARCH} AS arch", "p_partkey % 90 AS age_h")
    return df.select("p_partkey", rk.narrative_quality("meme", "visual", "conf", "dry", "evidence", "sources", "arch", "age_h").alias("quality"))


_BUCKETS = list(rk.CATEGORY_BONUS)
_BUCKET = "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BUCKETS)) + " ELSE 'other' END"
_case = lambda table: "CASE b " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


@query(
    "matching_priority_parts",
    f"""WITH t AS (SELECT p_partkey, p_size, {_BUCKET} AS b FROM part) SELECT p_partkey, b AS bucket, {r6(_case(rk.CATEGORY_BONUS))} AS category_bonus,
    {r6(f"least(18.0::DOUBLE, p_size % 4 * 1.8::DOUBLE + least(8.0::DOUBLE, p_size % 9 * 1.2::DOUBLE) + {_case(rk.CULTURE_BONUS)} + CASE WHEN p_size % 15 >= 10 THEN 3.0 WHEN p_size % 15 >= 6 THEN 1.5 ELSE 0 END::DOUBLE)")} AS culture_bonus,
    {r6("CASE WHEN p_partkey % 5 = 0 THEN 18 ELSE 0 END + CASE WHEN p_partkey % 10 = 0 THEN 8 WHEN p_partkey % 10 < 2 THEN 6 ELSE 0 END + CASE WHEN p_size % 15 <= 2 THEN 10 WHEN p_size % 15 <= 4 THEN 6 WHEN p_size % 15 <= 6 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 6 ELSE 0 END + CASE WHEN p_partkey % 6 = 0 THEN 16 + CASE WHEN p_size % 9 = 0 THEN 8 ELSE 0 END ELSE 0 END + CASE WHEN b IN ('politics','macro','finance','news') THEN 6 ELSE 0 END")} AS penalty FROM t""",
)
def _(spark, sf):
    df = st.table(spark, sf, "part").selectExpr(
        "p_partkey", f"{_BUCKET} AS bucket", "p_size % 4 AS hits", "p_size % 9 AS entities", "p_size % 15 AS posts", "p_partkey % 10 / 10.0D AS conf")
    m = lambda n: F.col("p_partkey") % n == 0
    return df.select(
        "p_partkey", "bucket", rk.category_bonus("bucket").alias("category_bonus"), rk.culture_bonus("hits", "entities", "bucket", "posts").alias("culture_bonus"),
        rk.topic_quality_penalty("conf", "posts", m(6), "entities", m(7), m(5), "bucket").alias("penalty"))
