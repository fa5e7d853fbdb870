"""Market operators: line items are market snapshots, parts assets, orders runs."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import arr, big, r6, split_list, ts
from tidegauge.catalog.texts import _TOK
from tidegauge.operators import market as mk
from tidegauge.plans import standins as st

_COINS = """l_orderkey * 10 + l_linenumber AS id, l_partkey AS token, concat('pair', l_suppkey) AS pair, CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('https://x/', l_suppkey) END AS url,
 concat('T', l_partkey % 100) AS symbol, CASE WHEN l_partkey % 41 = 0 THEN '' ELSE concat('Token ', l_partkey) END AS name, l_extendedprice * (1 + l_partkey % 50) * (CASE WHEN l_suppkey % 9 = 0 THEN 0.001 ELSE 1.0 END) AS liquidity,
 l_extendedprice * l_quantity * (CASE WHEN l_suppkey % 9 = 0 THEN 0.0001 ELSE 1.0 END) AS volume_24h, l_extendedprice * l_quantity * (l_linenumber / 14.0) * (CASE WHEN l_suppkey % 9 = 0 THEN 0.0001 ELSE 1.0 END) AS volume_6h,
 l_extendedprice * (1 + l_discount * 30) * (CASE WHEN l_suppkey % 9 = 0 THEN 0.0001 ELSE 1.0 END) AS volume_1h, CAST(l_quantity * (CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 40 END) AS BIGINT) AS txns_24h,
 CAST(l_quantity * l_linenumber * (CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS txns_6h, CAST(l_quantity * (CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 3 END) AS BIGINT) AS txns_1h,
 CAST(l_quantity * (CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 22 END) AS BIGINT) AS buys, CAST(l_quantity * (CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 10 + l_linenumber END) AS BIGINT) AS sells,
 l_extendedprice / 1000.0 AS price, l_discount * 100 - 2 AS change_1h, l_tax * 300 - 6 AS change_6h, (l_partkey % 200) * 1.0 - 60 AS change_24h, (l_orderkey % 3000) * 0.7 AS age_hours,
 40.0 + l_partkey % 60 AS market_score, (l_suppkey % 30) * 1.0 AS fit, l_extendedprice * 10 AS fdv, l_extendedprice * (l_linenumber * 2) AS market_cap, l_linenumber % 3 AS links, l_shipdate AS seen_at"""
COINS = f"coins AS (SELECT {_COINS.replace('14.0)', '14.0::DOUBLE)').replace('0.001 ELSE 1.0', '0.001 ELSE 1.0::DOUBLE').replace('0.0001 ELSE 1.0', '0.0001 ELSE 1.0::DOUBLE').replace('* 0.7', '* 0.7::DOUBLE').replace('/ 1000.0', '/ 1000.0::DOUBLE')} FROM lineitem)"


def coins(spark, sf):
    text = _COINS
    for plain in ("14.0)", "/ 1000.0", "* 0.7", "* 1.0", "40.0 "):
        text = text.replace(plain, plain[:-1] + "D" + plain[-1] if plain[-1] in ") " else plain + "D")
    text = text.replace("0.001 ELSE 1.0 ", "0.001D ELSE 1.0D ").replace("0.0001 ELSE 1.0 ", "0.0001D ELSE 1.0D ")
    return st.table(spark, sf, "lineitem").selectExpr(*split_list(text))


_REJ = """CASE WHEN coalesce(url, '') = '' THEN 'missing_url' WHEN name = '' THEN 'broken_metadata'
 WHEN NOT (liquidity >= 750 AND ((volume_24h >= 400 OR volume_6h >= 160 OR volume_1h >= 72) OR (txns_24h >= 2 OR txns_6h >= 1 OR txns_1h >= 1)) AND (buys + sells > 0 OR (txns_24h >= 2 OR txns_6h >= 1 OR txns_1h >= 1))) THEN 'no_basic_market_presence'
 WHEN price <= 0 THEN 'broken_metadata' WHEN volume_24h / liquidity > 180 OR abs(change_24h) >= 1600 THEN 'anti_rug_failed'
 WHEN liquidity <= 350 AND volume_24h <= 1200 AND volume_6h <= 180 AND txns_24h <= 3 AND txns_6h <= 2 AND buys + sells <= 4 THEN 'liquidity_drained'
 WHEN age_hours >= 24 AND liquidity <= 2500 AND volume_24h <= 1200 AND volume_6h <= 180 AND txns_24h <= 3 AND txns_6h <= 2 AND buys + sells <= 4 THEN 'dead_pair_activity'
 WHEN change_24h <= -94 AND sells >= greatest(8, buys * 2) AND volume_6h <= 240 AND txns_6h <= 2 AND liquidity <= 2500 THEN 'rug_pull_signature' END"""
_PEN = lambda x, want, base, span: f"CASE WHEN {x} < {want} THEN round({base}::DOUBLE + (1 - least(1, greatest(0, {x} / {want}::DOUBLE))) * {span}::DOUBLE, 3) ELSE 0 END"
_PENS = [("liquidity", 6000.0, 1.2, 2.6), ("volume_24h", 2500.0, 1.0, 2.4), ("txns_24h", 6, 0.8, 2.0), ("age_hours", 1.5, 0.4, 1.2), ("fit", 4.0, 0.35, 1.4)]
_PSUM = " + ".join(_PEN(*p) for p in _PENS)
_PCNT = " + ".join(f"CASE WHEN {p[0]} < {p[1]} THEN 1 ELSE 0 END" for p in _PENS)


@query(
    "market_gates",
    f"""WITH {COINS} SELECT id, {_REJ} AS reject_reason, {r6('least(28.0::DOUBLE, log10(liquidity + 1) * 10) + least(22.0::DOUBLE, log10(volume_24h + 1) * 8) + least(16.0::DOUBLE, ln(1 + txns_24h) * 3.2::DOUBLE) + least(10.0::DOUBLE, CASE WHEN volume_24h > 0 THEN volume_1h / volume_24h ELSE 0 END * 85) + CASE WHEN age_hours >= 1 THEN 3.0 WHEN age_hours >= 0.1 THEN 1.5 ELSE 0 END::DOUBLE')} AS health,
    {big(_PCNT)} AS penalties, {r6(f"round(market_score * 0.6::DOUBLE + fit * 0.25::DOUBLE + CASE WHEN {_PCNT} = 0 THEN 1 ELSE 0 END + CASE WHEN liquidity >= 6000 THEN 1 ELSE 0 END + CASE WHEN volume_24h >= 2500 THEN 1 ELSE 0 END + CASE WHEN txns_24h >= 6 THEN 0.6 ELSE 0 END::DOUBLE + least(4.0::DOUBLE, links * 1.2::DOUBLE) - round({_PSUM}, 3), 3)")} AS force_fill FROM coins""",
)
def _(spark, sf):
    df = coins(spark, sf).withColumn("pens", mk.soft_penalties())
    return df.select("id", mk.reject_reason().alias("reject_reason"), mk.market_health().alias("health"), F.size("pens").alias("penalties"),
                     mk.force_fill_score("pens", "links").alias("force_fill"))


_lin = lambda x, a, b: f"least(1, greatest(0, ({x} - {a}) / ({b} - {a})::DOUBLE))"
_log = lambda x, a, b: f"CASE WHEN {x} > 0 THEN least(1, greatest(0, (log10({x}) - log10({a})) / (log10({b}) - log10({a})))) ELSE 0 END"
_rat = lambda x, y, n, s, f: f"CASE WHEN {x} <= 0 THEN 0 WHEN {y} <= 0 THEN {f} ELSE least(1, greatest(0, ({x} / ({y}) - {n}) / ({s} - {n})::DOUBLE)) END"
_MOM = f"""{COINS}, a AS (SELECT *, least(1, greatest(0, ({_lin('change_1h', 0.5, 8.5)} * 0.56 + {_lin('change_6h', 1.4, 18)} * 0.31 + {_lin('change_24h', 2, 38)} * 0.13) * CASE WHEN change_1h < 0 THEN 0.4 ELSE 1 END * CASE WHEN change_6h < 0 THEN 0.6 ELSE 1 END)) AS mp,
 (CASE WHEN change_1h > 0 THEN CASE WHEN change_6h <= 0 THEN {_lin('change_1h', 0.5, 6)} ELSE {_rat('change_1h', 'greatest(abs(change_6h) / 6, 0.45)', 1.05, 3.2, 0.42)} END ELSE 0 END
  + CASE WHEN change_6h > 0 THEN CASE WHEN change_24h <= 0 THEN {_lin('change_6h', 1.5, 12)} ELSE {_rat('(change_6h / 6)', 'greatest(abs(change_24h) / 24, 0.35)', 1, 2.6, 0.4)} END ELSE 0 END) / 2 AS turn,
 ({_rat('volume_1h', 'volume_24h / 24', 1.02, 4.4, 0.35)} + {_rat('volume_6h', 'volume_24h / 4', 1, 2.8, 0.34)}) / 2 AS vol, ({_rat('txns_1h', 'txns_24h / 24', 1, 4, 0.34)} + {_rat('txns_6h', 'txns_24h / 4', 1, 2.7, 0.34)}) / 2 AS txn,
 CASE WHEN fdv <= 0 OR market_cap <= 0 THEN 0.58 WHEN market_cap / fdv BETWEEN 0.55 AND 1.12 THEN 1 WHEN market_cap / fdv >= 0.38 AND market_cap / fdv < 0.55 THEN 0.82 WHEN market_cap / fdv >= 0.2 AND market_cap / fdv < 0.38 THEN 0.48 WHEN market_cap / fdv > 1.12 AND market_cap / fdv <= 1.35 THEN 0.74 ELSE 0.2 END AS sane FROM coins),
b AS (SELECT *, least(1, greatest(0, turn * 0.46 + vol * 0.33 + txn * 0.21)) AS acc,
 ({_log('volume_1h', 10000, 450000)} + {_log('volume_6h', 45000, 1900000)} + {_log('volume_24h', 120000, 6000000)}) / 3 * 0.62 + (vol + {_rat('volume_24h', 'liquidity', 0.9, 7.5, 0.3)}) / 2 * 0.38 AS mv,
 ({_log('txns_1h', 18, 320)} + {_log('txns_6h', 80, 1250)} + {_log('txns_24h', 220, 6000)}) / 3 * 0.6 + txn * 0.4 AS mt,
 CASE WHEN buys + sells <= 0 THEN 0.5 ELSE least(1, greatest(0, (buys / (buys + sells) - 0.48) / 0.18::DOUBLE)) * (0.65 + least(1, (buys + sells) / 400) * 0.35) END AS flow,
 {_log('liquidity', 40000, 2500000)} * 0.42 + {_lin('market_score', 54, 86)} * 0.22 + {_rat('volume_24h', 'liquidity', 0.8, 6.5, 0.36)} * 0.16 + sane * 0.12 + CASE WHEN url IS NOT NULL THEN 1 ELSE 0.2 END * 0.08 AS qual,
 CASE WHEN age_hours < 1 THEN 0.05 WHEN age_hours < 4 THEN 0.18 WHEN age_hours < 12 THEN 0.5 WHEN age_hours < 72 THEN 1 WHEN age_hours < 336 THEN 0.86 WHEN age_hours < 1080 THEN 0.56 WHEN age_hours < 2160 THEN 0.32 ELSE 0.12 END AS fresh,
 least(28, CASE WHEN change_24h >= 45 THEN {_lin('change_24h', 45, 180)} * 10 + CASE WHEN change_1h <= 0.8 THEN {_lin('change_24h', 45, 180)} * 9 ELSE 0 END + CASE WHEN change_6h <= 2 THEN 4.5 ELSE 0 END + CASE WHEN {_rat('volume_1h', 'volume_24h / 24', 0.9, 2, 0.28)} < 0.26 THEN 3.5 ELSE 0 END ELSE 0 END
  + CASE WHEN change_24h >= 35 AND change_1h < greatest(0.35, change_6h / 6 * 0.35) THEN 4.5 ELSE 0 END + CASE WHEN change_24h >= 90 AND change_1h < 0 THEN 7 ELSE 0 END) AS over,
 least(38, CASE WHEN url IS NULL THEN 18 ELSE 0 END + CASE WHEN liquidity < 25000 THEN 22 WHEN liquidity < 50000 THEN 14 WHEN liquidity < 80000 THEN 7 ELSE 0 END + CASE WHEN volume_24h < 60000 THEN 16 WHEN volume_24h < 120000 THEN 8 ELSE 0 END
  + CASE WHEN txns_24h < 80 THEN 8 WHEN txns_24h < 160 THEN 4 ELSE 0 END + CASE WHEN price <= 0 THEN 30 ELSE 0 END + CASE WHEN liquidity > 0 AND volume_24h / liquidity > 18 THEN 6 ELSE 0 END + CASE WHEN sane < 0.25 THEN 8 ELSE 0 END
  + CASE WHEN links = 0 AND market_score < 60 THEN 3 ELSE 0 END + CASE WHEN age_hours < 1 THEN 8 ELSE 0 END) AS rug,
 least(18, CASE WHEN age_hours >= 336 THEN CASE WHEN change_1h < 0.6 THEN 4 ELSE 0 END + CASE WHEN change_6h < 2 THEN 4 ELSE 0 END + CASE WHEN vol < 0.34 THEN 3.5 ELSE 0 END + CASE WHEN txn < 0.34 THEN 3.5 ELSE 0 END ELSE 0 END + CASE WHEN age_hours >= 1080 THEN 2 ELSE 0 END) AS stale FROM a),
mom AS (SELECT *, CAST(floor(round(CAST(least(100, greatest(0, 100 * (mp * 0.24 + acc * 0.19 + mv * 0.17 + mt * 0.13 + flow * 0.09 + qual * 0.11 + fresh * 0.07) - over * 0.95 - rug - stale * 0.9)) AS DOUBLE), 9) + 0.5) AS BIGINT) AS momentum FROM b)"""


@query(
    "market_momentum",
    f"""WITH {_MOM} SELECT id, momentum, CASE WHEN acc >= 0.74 AND mv >= 0.62 AND mt >= 0.56 AND over <= 8 THEN 'Breakout starting' WHEN acc >= 0.76 THEN 'Acceleration' WHEN mv >= 0.72 AND mt >= 0.6 THEN 'Volume confirmation'
    WHEN mp >= 0.68 AND over <= 10 THEN 'Early continuation' WHEN flow >= 0.66 AND momentum >= 55 THEN 'Order flow' ELSE 'Early strength' END AS signal FROM mom""",
)
def _(spark, sf):
    return mk.momentum(coins(spark, sf)).select("id", "momentum", "signal")


@query("market_momentum_board", f"WITH {_MOM} SELECT id, momentum FROM mom ORDER BY momentum DESC, round(change_1h, 9) DESC, round(volume_1h, 6) DESC, txns_1h DESC, round(liquidity, 6) DESC, id LIMIT 100")
def _(spark, sf):
    df = mk.momentum(coins(spark, sf)).withColumn("change_1h", F.round("change_1h", 9)).withColumn("volume_1h", F.round("volume_1h", 6)).withColumn("liquidity", F.round("liquidity", 6))
    return df.orderBy(*mk.momentum_order("id")).limit(100).select("id", "momentum")


_PJSON = """concat('{"chainId":"C', l_suppkey % 3, '","pairAddress":"P', l_suppkey, '","url":"https://x/', l_orderkey, '","baseToken":{"address":"A', l_partkey, '","symbol":"s', l_partkey % 50, '","name":"n"},"volume":{"h1":', l_linenumber, ',"h24":', CAST(l_quantity AS BIGINT), '},"txns":{"h24":{"buys":', l_linenumber, ',"sells":2}},"liquidity":{"usd":', CAST(floor(l_extendedprice) AS BIGINT), '}}')"""


@query(
    "market_best_pair",
    """SELECT 'c' || l_suppkey % 3 AS chain, 'a' || l_partkey AS token, 'p' || l_suppkey AS pair, 'S' || l_partkey % 50 AS symbol, """ + r6("floor(l_extendedprice)") + """ AS liquidity, CAST(l_linenumber AS BIGINT) AS buys FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey % 3, l_partkey ORDER BY floor(l_extendedprice) DESC, l_quantity DESC, l_linenumber DESC, 'p' || l_suppkey DESC) = 1""",
)
def _(spark, sf):
    raw = st.table(spark, sf, "lineitem").selectExpr(f"{_PJSON} AS payload")
    return mk.best_pair(mk.flatten_pairs(raw, "payload"), ["chain", "token"]).select("chain", "token", "pair", "symbol", "liquidity", "buys")


@query(
    "market_hints",
    "SELECT l_partkey AS token, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS sources, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS seeds, count(DISTINCT l_suppkey) AS topics FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    h = st.table(spark, sf, "lineitem").selectExpr("l_partkey AS token", "l_returnflag AS source", "l_linestatus AS seed", "l_suppkey AS topic")
    return mk.merge_hints(h, ["token"])


@query(
    "market_run_board",
    """WITH runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status, o_custkey % 5 AS published, o_orderdate AS completed_at FROM orders),
    rr AS (SELECT * FROM runs WHERE status = 'succeeded' AND published > 0 ORDER BY completed_at DESC, run_id DESC LIMIT 400),
    res AS (SELECT l_orderkey AS run_id, l_partkey AS asset_id, l_orderkey * 10 + l_linenumber AS snapshot_id, round(l_extendedprice, 2) AS score FROM lineitem),
    ln AS (SELECT l_orderkey AS run_id, l_partkey AS asset_id, string_agg('t' || l_suppkey, '|' ORDER BY l_quantity DESC, 't' || l_suppkey) AS topics FROM lineitem GROUP BY 1, 2)
    SELECT asset_id, run_id, snapshot_id, """ + r6("score") + """ AS score, p_name AS asset_name, topics FROM res JOIN rr USING (run_id) JOIN part ON p_partkey = asset_id LEFT JOIN ln USING (run_id, asset_id)
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY res.score DESC, completed_at DESC, run_id DESC, snapshot_id DESC) = 1""",
)
def _(spark, sf):
    runs = st.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id", "IF(o_orderstatus = 'F', 'failed', 'succeeded') AS status", "o_custkey % 5 AS published", "o_orderdate AS completed_at")
    li = st.table(spark, sf, "lineitem")
    res = li.selectExpr("l_orderkey AS run_id", "l_partkey AS asset_id", "l_orderkey * 10 + l_linenumber AS snapshot_id", "round(l_extendedprice, 2) AS score")
    snaps = li.selectExpr("l_orderkey * 10 + l_linenumber AS snapshot_id", "l_quantity AS quantity")
    links = li.selectExpr("l_orderkey AS run_id", "l_partkey AS asset_id", "concat('t', l_suppkey) AS topic", "l_quantity AS link_score")
    assets = st.table(spark, sf, "part").selectExpr("p_partkey AS asset_id", "p_name AS asset_name")
    return mk.run_board(runs, res, assets, snaps, links, 400).select("asset_id", "run_id", "snapshot_id", "score", "asset_name", "topics")


_SIDE = "SELECT {id} AS {name}, 'c' || {id} % 4 AS chain, {a} AS address, {b} AS pair, {s} AS symbol FROM {t}"


@query(
    "market_fallback_match",
    """WITH l AS (SELECT c_custkey AS link, 'C' || c_custkey % 4 AS chain, CASE WHEN c_custkey % 3 = 0 THEN 'ADDR' || c_custkey END AS address, CASE WHEN c_custkey % 2 = 0 THEN 'Pair' || c_custkey % 500 END AS pair, 'sym' || c_custkey % 50 AS symbol FROM customer),
    a AS (SELECT p_partkey AS asset, 'c' || p_partkey % 4 AS chain, 'addr' || p_partkey AS address, 'pair' || p_partkey % 500 AS pair, 'SYM' || p_partkey % 50 AS symbol FROM part),
    m AS (SELECT link, asset, 0 AS rung FROM l JOIN a ON lower(l.chain) = a.chain AND lower(l.address) = lower(a.address) UNION ALL SELECT link, asset, 1 FROM l JOIN a ON lower(l.chain) = a.chain AND lower(l.pair) = lower(a.pair)
      UNION ALL SELECT link, asset, 2 FROM l JOIN a ON lower(l.chain) = a.chain AND lower(l.symbol) = lower(a.symbol))
    SELECT link, asset, CAST(rung AS BIGINT) AS rung FROM m QUALIFY row_number() OVER (PARTITION BY link ORDER BY rung, asset) = 1""",
)
def _(spark, sf):
    links = st.table(spark, sf, "customer").selectExpr(
        "c_custkey AS link", "concat('C', c_custkey % 4) AS chain", "IF(c_custkey % 3 = 0, concat('ADDR', c_custkey), NULL) AS address",
        "IF(c_custkey % 2 = 0, concat('Pair', c_custkey % 500), NULL) AS pair", "concat('sym', c_custkey % 50) AS symbol")
    assets = st.table(spark, sf, "part").selectExpr(
        "p_partkey AS asset", "concat('c', p_partkey % 4) AS chain", "concat('addr', p_partkey) AS address", "concat('pair', p_partkey % 500) AS pair", "concat('SYM', p_partkey % 50) AS symbol")
    return mk.fallback_match(links, assets, ["address", "pair", "symbol"], "link", "asset")


_TXT = lambda c: f"list_distinct({_TOK.format(x=c)})"


@query(
    "topic_asset_links",
    f"""WITH t AS (SELECT DISTINCT p_name AS topic FROM part), a AS (SELECT p_partkey AS asset, concat(p_name, ' ', p_type, ' ', replace(p_brand, '#', ' ')) AS txt FROM part),
    tw AS (SELECT topic, unnest({_TXT('topic')}) AS w FROM t), aw AS (SELECT asset, unnest({_TXT('txt')}) AS w FROM a), na AS (SELECT topic, count(*) AS n FROM tw GROUP BY 1), nb AS (SELECT asset, count(*) AS n FROM aw GROUP BY 1),
    s AS (SELECT topic, asset, count(*) AS shared FROM tw JOIN aw USING (w) GROUP BY 1, 2), x AS (SELECT topic, asset, shared, round(shared / least(na.n, nb.n) * 0.6::DOUBLE + shared / (na.n + nb.n - shared) * 0.4::DOUBLE, 6) AS lex FROM s JOIN na USING (topic) JOIN nb USING (asset))
    SELECT topic, asset, shared, {r6('lex')} AS lexical, row_number() OVER (PARTITION BY topic ORDER BY lex DESC, shared DESC, asset) AS place,
      CASE WHEN shared >= 2 THEN 2 ELSE 1 END::BIGINT AS match_priority, shared >= 2 OR lex >= 0.46 AS plausible FROM x WHERE lex >= 0.25 QUALIFY place <= 5""",
)
def _(spark, sf):
    part = st.table(spark, sf, "part")
    topics = part.select(F.col("p_name").alias("topic")).distinct()
    assets = part.selectExpr("p_partkey AS asset", "concat(p_name, ' ', p_type, ' ', replace(p_brand, '#', ' ')) AS txt")
    out = mk.topic_asset_links(topics, assets, "topic", "topic", "asset", "txt")
    kind = F.when(F.col("shared") >= 2, "strong_narrative").otherwise("fallback")
    ok = mk.link_plausible(kind, F.when(F.col("shared") >= 2, 1).otherwise(0), "lexical", F.lit(0), F.lit(0.0))
    return out.select("topic", "asset", "shared", "lexical", "place", mk.match_type_priority(kind).alias("match_priority"), ok.alias("plausible"))


@query(
    "market_capped_board",
    f"""WITH {COINS}, o AS (SELECT * FROM coins QUALIFY row_number() OVER (PARTITION BY token ORDER BY round(liquidity, 6) DESC, id) = 1), t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(liquidity, 6) DESC, id) <= 3),
    f AS (SELECT * FROM t WHERE token % 4 = 0 ORDER BY round(liquidity, 6) DESC, id LIMIT 5), u AS (SELECT * FROM f UNION ALL SELECT * FROM t WHERE token % 4 <> 0) SELECT id, token, symbol FROM u ORDER BY round(liquidity, 6) DESC, id LIMIT 60""",
)
def _(spark, sf):
    df = coins(spark, sf).withColumn("liquidity", F.round("liquidity", 6)).withColumn("political", F.col("token") % 4 == 0)
    return mk.capped_board(df, "token", [F.col("liquidity").desc(), F.col("id").asc()], "political", 5, "symbol", 3, 60).select("id", "token", "symbol")


@query(
    "market_universe_merge",
    """SELECT l_partkey AS token, arg_max('pair' || l_suppkey, {'c': l_linenumber, 'p': 'pair' || l_suppkey}) AS pair, """ + r6("max(l_extendedprice)") + """ AS price, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS tags, count(*) AS sources FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    li = st.table(spark, sf, "lineitem").selectExpr("l_partkey AS token", "concat('pair', l_suppkey) AS pair", "l_linenumber AS filled", "l_extendedprice AS price", "array(l_returnflag) AS tags")
    return mk.merge_universe(li, ["token"], F.col("filled"), ["pair"], ["price"], ["tags"])


@query(
    "market_asset_fill",
    """SELECT p_partkey AS token, coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, l) AS price FROM (SELECT p_partkey, p_size, p_retailprice, arg_max(l_extendedprice, {'d': l_shipdate, 'o': l_orderkey * 10 + l_linenumber}) AS l FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)""".replace(
        "coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, l)", r6("coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, l)")),
)
def _(spark, sf):
    assets = st.table(spark, sf, "part").selectExpr("p_partkey AS token", "IF(p_size % 2 = 0, p_retailprice, NULL) AS price")
    snaps = st.table(spark, sf, "lineitem").selectExpr("l_partkey AS token", "l_extendedprice AS price", "struct(l_shipdate, l_orderkey * 10 + l_linenumber) AS at")
    return mk.fill_from_latest(assets, snaps, "token", "at", ["price"])


@query("market_recent_publications", "SELECT 'token' AS kind, CAST(l_partkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'theme', l_returnflag, count(*) FROM lineitem GROUP BY 2")
def _(spark, sf):
    return mk.recent_publications(st.table(spark, sf, "lineitem"), "l_partkey", "l_returnflag")


@query(
    "market_funnel",
    f"WITH {COINS} SELECT symbol, count(*) AS n, count(*) FILTER (WHERE url IS NULL) AS missing_url, count(*) FILTER (WHERE name = '') AS missing_name, count(*) FILTER (WHERE liquidity < 1500) AS thin FROM coins GROUP BY 1",
)
def _(spark, sf):
    return mk.funnel(coins(spark, sf), "symbol", {"missing_url": F.col("url").isNull(), "missing_name": F.col("name") == "", "thin": F.col("liquidity") < 1500})
