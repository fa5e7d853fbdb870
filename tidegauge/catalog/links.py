"""Topic-asset evidence: parts are assets and their names topics, line items posts."""

from pyspark.sql import functions as F

from tidegauge import fixed
from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import arr, big, r6
from tidegauge.catalog.texts import _TOK
from tidegauge.operators import links as lk, market as mk
from tidegauge.plans import standins as st

_ASSET = "concat(p_name, ' ', p_type, ' ', replace(p_brand, '#', ' '))"
_ASSET_COLUMNS = ["p_partkey AS asset", "p_name AS own_topic", f"{_ASSET} AS txt", "concat('K', p_partkey) AS symbol", "concat('Coin K', p_partkey) AS name", "p_size AS size", "p_retailprice AS price"]
_POST_TEXT = "concat('talk of ', p_brand, ' and $K', l_partkey + l_linenumber % 3)"
_POST = "concat_ws('-', l_orderkey, l_linenumber, l_partkey)"
_DIST = lambda x: f"list_distinct({_TOK.format(x=x)})"
_N = {"exact": 5, "phrase": 4, "entity": 4, "partial": 5, "generic": 5}
_OVERLAP = "CASE WHEN x = y OR least(length(x), length(y)) < 4 THEN 0.0 WHEN contains(CASE WHEN length(x) <= length(y) THEN y ELSE x END, CASE WHEN length(x) <= length(y) THEN x ELSE y END) THEN least(length(x), length(y)) / greatest(length(x), length(y)) WHEN left(x, 4) = left(y, 4) THEN 0.87 ELSE 0.0 END"


@query(
    "topic_asset_evidence",
    f"""WITH a AS (SELECT {', '.join(_ASSET_COLUMNS)} FROM part), t AS (SELECT DISTINCT p_name AS topic FROM part),
    tw AS (SELECT topic, {_DIST('topic')} AS tt FROM t), aw AS (SELECT asset, {_DIST('txt')} AS ax FROM a),
    tu AS (SELECT topic, len(tt) AS na, unnest(tt) AS w FROM tw), au AS (SELECT asset, len(ax) AS nb, unnest(ax) AS w FROM aw),
    s AS (SELECT topic, asset, count(*) AS shared, any_value(na) AS na, any_value(nb) AS nb FROM tu JOIN au USING (w) GROUP BY 1, 2),
    c AS (SELECT topic, asset FROM (SELECT *, round(shared / least(na, nb) * 0.6::DOUBLE + shared / (na + nb - shared) * 0.4::DOUBLE, 6) AS lex FROM s) WHERE lex >= 0.25
      QUALIFY row_number() OVER (PARTITION BY topic ORDER BY lex DESC, shared DESC, asset) <= 20),
    posts AS (SELECT {_POST} AS post, p_name AS topic, {_POST_TEXT} AS text, concat('K', l_partkey + l_linenumber % 3) AS tag, sum(l_quantity) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    dt AS (SELECT DISTINCT text, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS k FROM posts),
    held AS (SELECT text, asset FROM dt JOIN a ON contains(k, lower(symbol)) OR contains(k, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'))),
    named AS (SELECT post, topic, weight, asset FROM posts JOIN held USING (text) UNION SELECT post, topic, weight, asset FROM posts JOIN a ON upper(symbol) = tag),
    sup AS (SELECT topic, asset, count(*) AS posts, sum(weight) AS interactions FROM named GROUP BY 1, 2),
    pairs AS (SELECT topic, asset FROM c UNION SELECT topic, asset FROM sup),
    e AS (SELECT topic, asset, coalesce(sup.posts, 0) AS posts, coalesce(interactions, 0) AS interactions, own_topic = topic AS matched, size AS hours, price / 100 AS v1, price AS v24,
      {_TOK.format(x='topic')} AS tl, {_TOK.format(x='txt')} AS al, list_intersect(tt, ax) AS sh, tt, ax,
      regexp_replace(lower(topic), '[^a-z0-9]+', '', 'g') AS x, regexp_replace(lower(own_topic), '[^a-z0-9]+', '', 'g') AS y, regexp_replace(lower(txt), '[^a-z0-9]+', '', 'g') AS z
      FROM pairs JOIN a USING (asset) JOIN tw USING (topic) JOIN aw USING (asset) LEFT JOIN sup USING (topic, asset)),
    f AS (SELECT *, len(list_filter(sh, lambda w: length(w) >= 5)) AS n_exact, coalesce(list_max(list_transform(sh, lambda w: length(w))), 0) AS longest, len(list_filter(sh, lambda w: length(w) < 5)) AS n_generic,
      len(list_intersect(list_distinct(list_transform(range(1, len(tl)), lambda i: tl[i] || ' ' || tl[i + 1])), list_distinct(list_transform(range(1, len(al)), lambda i: al[i] || ' ' || al[i + 1])))) AS n_phrase,
      CASE WHEN contains(z, x) THEN 1 ELSE 0 END AS n_entity,
      len(list_filter(tt, lambda w: len(list_filter(ax, lambda v: v <> w AND length(v) >= 4 AND length(w) >= 4 AND left(v, 4) = left(w, 4))) > 0)) AS n_partial, CAST({_OVERLAP} AS DOUBLE) AS sim FROM e),
    g AS (SELECT *, {', '.join(f'least(n_{k}, {m}) AS {k}' for k, m in _N.items())}, ln(1 + interactions) AS lw, n_exact = 0 AND n_phrase = 0 AND n_entity = 0 AS broad FROM f),
    h AS (SELECT *, least(68.0, exact * 11.0 + phrase * 13.0 + entity * 16.0 + partial * 4.0 + sim * 16.0) + CASE WHEN matched AND NOT broad THEN 8 ELSE 0 END + CASE WHEN sim >= 0.82 THEN 8 ELSE 0 END AS lexical_score,
      least(34.0, posts * 6.5 + lw * 4.5) AS mention, CASE WHEN hours <= 6 THEN 8.0 WHEN hours <= 24 THEN 4.0 ELSE 0.0 END + least(12.0, v1 / v24 * 90.0) AS timing,
      CASE WHEN matched AND NOT broad THEN 6.0 ELSE 0.0 END AS culture,
      least(14.0, generic * 2.6) + CASE WHEN broad AND generic > 0 THEN least(10.0, generic * 1.4) ELSE 0 END AS penalty,
      CASE WHEN matched AND NOT broad THEN 18.0 ELSE 0.0 END + least(30.0, phrase * 16.0) + least(30.0, entity * 18.0) + least(20.0, exact * 8.0) + CASE WHEN posts > 0 AND NOT broad THEN least(10.0, posts * 3.0) ELSE 0 END AS ev0,
      exact * 8.0 + partial * 5.0 + least(10.0, posts * 3.5) + least(8.0, lw * 2.2) + least(8.0, sim * 8.0) + CASE WHEN matched AND NOT broad THEN 8.0 ELSE 0.0 END AS st0 FROM g),
    i AS (SELECT *, least(100.0, CASE WHEN broad THEN least(ev0, 22.0) ELSE ev0 END) AS ev, least(100.0, CASE WHEN broad THEN least(st0, 34.0) ELSE st0 END) AS story FROM h),
    j AS (SELECT *, CASE WHEN (n_phrase > 0 OR n_entity > 0 OR n_exact >= 2 OR (n_exact > 0 AND longest >= 5)) AND ev >= 58 THEN 'explicit_origin'
      WHEN (n_exact > 0 OR n_partial > 0 OR posts > 0 OR matched) AND story >= 42 AND NOT broad THEN 'strong_narrative' ELSE 'fallback' END AS match_type FROM i),
    k AS (SELECT *, greatest(0.0, least(100.0, CASE match_type WHEN 'explicit_origin' THEN ev WHEN 'strong_narrative' THEN story ELSE least(34.0, story * 0.55 + posts * 2.0) END * 0.72 + mention * 0.18 + timing * 0.1 + culture * 0.06 - penalty)) AS l0 FROM j),
    l AS (SELECT *, round(CASE WHEN broad THEN least(l0, 36.0) ELSE l0 END, 3) AS link_score FROM k),
    m AS (SELECT *, NOT broad OR posts > 0 OR n_partial > 0 OR sim >= 0.46 OR link_score >= 16 AS ok FROM l)
    SELECT topic, asset, {big('posts')} AS posts, match_type, {r6('link_score')} AS link_score, {r6('round(ev, 3)')} AS evidence_score, {r6('round(story, 3)')} AS narrative_score,
      row_number() OVER (PARTITION BY topic ORDER BY ok DESC, CASE match_type WHEN 'explicit_origin' THEN 3 WHEN 'strong_narrative' THEN 2 ELSE 1 END DESC, link_score DESC, posts DESC, asset) AS rank
    FROM m QUALIFY rank <= 5 AND (ok OR NOT max(ok) OVER (PARTITION BY topic))""",
)
def _(spark, sf):
    part = st.table(spark, sf, "part")
    assets = part.selectExpr(*_ASSET_COLUMNS)
    topics = part.select(F.col("p_name").alias("topic")).distinct()
    posts = st.table(spark, sf, "lineitem").join(part.select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        f"{_POST} AS post", "p_name AS topic", f"{_POST_TEXT} AS text", "array(concat('K', l_partkey + l_linenumber % 3)) AS cashtags", "l_quantity").groupBy(
        "post", "topic", "text", "cashtags").agg(F.sum("l_quantity").alias("weight"))
    found = mk.topic_asset_links(topics, assets, "topic", "topic", "asset", "txt", 20).select("topic", "asset")
    named = lk.support(posts, assets, "topic", "asset")
    raw = lambda x: F.filter(F.transform(F.regexp_extract_all(F.lower(x), F.lit(fixed.WORD_PATTERN), F.lit(1)), lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", "")),
                             lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~t.isin(*fixed.STOPWORDS, *fixed.URL_DEBRIS))
    two = lambda x: F.array_distinct(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))
    pairs = found.unionByName(named, allowMissingColumns=True).groupBy("topic", "asset").agg(F.max("posts").alias("posts"), F.max("interactions").alias("interactions"))
    e = lk.barrier(pairs.join(assets.withColumn("al", raw("txt")), "asset").withColumn("tl", raw("topic")))
    e = lk.barrier(e.withColumn("tt", F.array_distinct("tl")).withColumn("at", F.array_distinct("al")).withColumn("sh", F.array_intersect("tl", "al")))
    start = lambda v, w: (v != w) & (F.length(v) >= 4) & (F.length(w) >= 4) & (F.substring(v, 1, 4) == F.substring(w, 1, 4))
    zero = F.lit(0)
    e = e.select(
        "topic", "asset", F.size(F.filter("sh", lambda w: F.length(w) >= 5)).alias("exact"), F.coalesce(F.array_max(F.transform("sh", F.length)), zero).alias("longest_exact"),
        F.size(F.filter("sh", lambda w: F.length(w) < 5)).alias("generic"), F.size(F.array_intersect(F.array_compact(two(F.col("tl"))), F.array_compact(two(F.col("al"))))).alias("phrase"),
        F.contains(lk.compact("txt"), lk.compact("topic")).cast("int").alias("entity"), F.size(F.filter("tt", lambda w: F.exists("at", lambda v: start(v, w)))).alias("partial"),
        zero.alias("alias"), zero.alias("seed"), lk.partial_overlap("topic", "own_topic").alias("name_similarity"), F.lit(0.0).alias("symbol_similarity"),
        F.coalesce("posts", zero).alias("posts"), F.coalesce("interactions", F.lit(0.0)).alias("interactions"), (F.col("own_topic") == F.col("topic")).alias("matched"), F.col("size").alias("hours"),
        (F.col("price") / 100).alias("volume_1h"), F.col("price").alias("volume_24h"), zero.alias("culture_hits"), F.lit(False).alias("asset_political"), F.lit(False).alias("topic_political"))
    scored = lk.link_scores(e)
    order = [mk.match_type_priority("match_type").desc(), F.col("link_score").desc(), F.col("posts").desc(), F.col("asset").asc()]
    return lk.chosen_links(scored, "topic", "asset", order).select("topic", "asset", "posts", "match_type", "link_score", "evidence_score", "narrative_score", "rank")


_THEME = """concat(p_name, ' ', p_type, CASE p_partkey % 9 WHEN 0 THEN ' a viral meme dog on x.com' WHEN 1 THEN ' staking protocol, cross-chain bridge' WHEN 2 THEN ' AI agent: GPT model https://x.com/meme'
 WHEN 3 THEN ' community takeover (cto) of a fan edit' WHEN 4 THEN ' pump.fun listing' ELSE '' END)"""
_SOCIAL = "concat('https://t.me/', p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' telegram twitter' WHEN 1 THEN ' x.com' ELSE '' END)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), 'https?://\S+', ' ', 'g'), '[^a-z0-9$#\s''_-]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _theme_count(book, group: str, text: str, tok: str) -> str:
    plain = [p for p in book.groups[group] if p in book.words]
    rest = [f"CAST(contains({text}, '{p}') AS INT)" for p in book.groups[group] if p not in book.words]
    return " + ".join(([f"len(list_intersect({tok}, {arr(plain)}))"] if plain else []) + rest)


_PAT = fixed.PROFILE_WORD_PATTERN.replace("'", "''")


@query(
    "asset_thematic_fit",
    f"""WITH a AS (SELECT p_partkey AS asset, {_PLAIN.format(x=_THEME)} AS t, {_PLAIN.format(x="concat('Coin ', CASE WHEN p_partkey % 11 = 0 THEN 'doge' ELSE p_brand END)")} AS n, {_PLAIN.format(x=_SOCIAL)} AS s,
      p_partkey % 4 AS src, p_size % 3 AS tops FROM part),
    k AS (SELECT *, list_distinct(regexp_extract_all(t, '{_PAT}')) AS tok, list_distinct(regexp_extract_all(n, '{_PAT}')) AS ntok, list_distinct(regexp_extract_all(s, '{_PAT}')) AS stok FROM a),
    h AS (SELECT *, {_theme_count(lk.THEMES, 'style', 't', 'tok')} AS style, {_theme_count(lk.THEMES, 'style', 'n', 'ntok')} AS own, {_theme_count(lk.THEMES, 'utility', 't', 'tok')} AS utility,
      {' + '.join(_theme_count(lk.THEMES, f'culture_{g}', 't', 'tok') for g in fixed.ASSET_CULTURE_TERMS)} AS culture, {_theme_count(lk.SOCIAL, 'social', 's', 'stok')} AS social FROM k),
    f AS (SELECT *, style * 8.0 + own * 4.0 + least(18.0, culture * 1.8) + CASE src WHEN 0 THEN 14.0 WHEN 1 THEN 10.0 WHEN 2 THEN 6.0 ELSE 4.0 END + least(6.0, social * 1.5) + least(6.0, tops * 1.5)
      - utility * 7.5 - CASE WHEN utility >= 2 AND style = 0 AND own = 0 THEN 10.0 ELSE 0.0 END AS raw FROM h)
    SELECT asset, {big('culture')} AS culture_hits, {r6('round(greatest(0.0, least(100.0, CASE WHEN style = 0 AND own = 0 AND culture = 0 THEN least(raw, CASE WHEN src = 0 THEN 16.0 ELSE 10.0 END) ELSE raw END)), 3)')} AS fit FROM f""",
)
def _(spark, sf):
    assets = st.table(spark, sf, "part").selectExpr(
        "p_partkey AS asset", f"{_THEME} AS text", "concat('Coin ', CASE WHEN p_partkey % 11 = 0 THEN 'doge' ELSE p_brand END) AS name", f"{_SOCIAL} AS socials",
        "CASE p_partkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('dex_boosts_top') WHEN 2 THEN array('dex_boosts_latest') ELSE array('dex_profiles_latest') END AS sources",
        "p_partkey % 4 = 0 AS takeover", "slice(array('a', 'b'), 1, p_size % 3) AS topics")
    return lk.thematic_fit(assets, "text", "name", "sources", "takeover", "socials", "topics").select("asset", "culture_hits", "fit")


@query("topic_asset_names")
def _(spark, sf):
    """Longest-matching-blocks similarity of every topic and the types of its best assets."""
    part = st.table(spark, sf, "part")
    assets = part.selectExpr("p_partkey AS asset", f"{_ASSET} AS txt", "p_type AS name")
    found = mk.topic_asset_links(part.select(F.col("p_name").alias("topic")).distinct(), assets, "topic", "topic", "asset", "txt")
    return lk.name_similarity(found.join(assets.select("asset", "name"), "asset"), "topic", "name").select("topic", "asset", "name", "similarity")
