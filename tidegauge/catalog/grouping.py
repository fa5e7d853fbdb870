"""Phrases, near duplicates, components, clusters, diversified selections."""

from pyspark.sql import functions as F

from tidegauge import fixed
from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import arr, big, r6, ts
from tidegauge.catalog.texts import _LABELS_SQL, _NLABEL, _NTOK, _NWEAK, _TOK, labels_in
from tidegauge.functions import labels as lb, text as tx
from tidegauge.operators import grouping as gr
from tidegauge.plans import standins as st


def docs(spark, sf):
    return st.table(spark, sf, "documents").selectExpr(
        "doc_id", "text", "source", "doc_id % 97 AS author", "doc_id % 211 AS root", "1.0D + least(8.0D, n_chars / 1000.0D) AS weight", "lang")


_DOCS = "d AS (SELECT doc_id, text, source, doc_id % 97 AS author, doc_id % 211 AS root, 1.0 + least(8.0, n_chars / 1000.0::DOUBLE) AS weight, lang FROM documents)"
_FOLD = f"translate(lower(regexp_replace(text, '(?i)https?://\\S+', ' ', 'g')), '{lb.ACCENTED}', '{lb.PLAIN}')"
_INF = f"list_filter(tk, lambda t: (length(t) >= 3 OR list_contains({arr(fixed.NARRATIVE_ACRONYMS)}, t)) AND NOT list_contains({arr(fixed.NARRATIVE_STOP_WORDS + fixed.NARRATIVE_WEAK_WORDS)}, t))"
_SHOWN = "array_to_string(list_transform(string_split(phrase, ' '), lambda t: CASE t {} ELSE upper(t[1]) || t[2:] END), ' ')".format(" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.NARRATIVE_DISPLAY.items()))
_PH = f"""{_DOCS}, t0 AS (SELECT *, {_NTOK.format(x=_FOLD)} AS tk FROM d), t1 AS (SELECT doc_id, source, author, root, weight, {_INF} AS w FROM t0),
ph AS (SELECT DISTINCT doc_id, source, author, root, weight, array_to_string(w[i:i + n - 1], ' ') AS phrase, array_to_string(list_sort(list_distinct(w[i:i + n - 1])), ' ') AS key
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM t1, (VALUES (2), (3), (4)) v(n) WHERE len(w) >= n)),
pd AS (SELECT key, doc_id, sum(weight) AS w, any_value(root) AS root, any_value(author) AS author, any_value(source) AS source FROM ph GROUP BY 1, 2),
st AS (SELECT key, count(*) AS docs, sum(w) AS w, count(DISTINCT root) AS roots, count(DISTINCT author) AS authors, count(DISTINCT source) AS sources FROM pd GROUP BY 1 HAVING count(*) >= 2),
lab AS (SELECT key, phrase FROM ph WHERE key IN (SELECT key FROM st) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(sum(weight), 6) DESC, phrase) = 1),
stats AS (SELECT *, w + docs * 28 + roots * 10 + authors * 12 + sources * 16 + least(72, len(string_split(phrase, ' ')) * 12) AS score FROM st JOIN lab USING (key)),
named AS (SELECT key, {_SHOWN} AS label FROM stats), {_NLABEL.removeprefix(_LABELS_SQL + ', ').replace('FROM labels_in', 'FROM (SELECT DISTINCT label FROM named)')},
gated AS (SELECT s.* FROM stats s JOIN named USING (key) JOIN (SELECT label FROM n2 WHERE NOT frag AND NOT {_NWEAK}) USING (label)),
top AS (SELECT * FROM gated ORDER BY round(score, 6) DESC, key LIMIT 80)"""


_SAID = ("doc_id", "text", "weight", "root", "author", "source")


@query("phrase_statistics", f"WITH {_PH} SELECT key, docs, roots, authors, sources, {r6('score')} AS score FROM top")
def _(spark, sf):
    return gr.top_phrases(docs(spark, sf), *_SAID, 80).select("key", "docs", "roots", "authors", "sources", "score")


@query(
    "phrase_groups",
    f"""WITH {_PH}, win AS (SELECT doc_id, key FROM (SELECT DISTINCT doc_id, key FROM ph) JOIN gated USING (key) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, key) = 1)
    SELECT doc_id, coalesce(key, 'lang:' || lang) AS group_key, key IS NOT NULL AS by_phrase FROM d LEFT JOIN win USING (doc_id)""",
)
def _(spark, sf):
    return gr.phrase_groups(docs(spark, sf), *_SAID, F.concat(F.lit("lang:"), "lang"))


_TOKSETS = f"sets AS (SELECT doc_id, list_sort(list_distinct({_TOK.format(x='text')})) AS tk FROM documents)"


# .92 is the threshold of the text dedupe, .6 that of topic grouping
for _name, _t in (("near_duplicate_pairs", 0.6), ("near_duplicate_texts", 0.92)):
    query(
        _name,
        f"""WITH {_TOKSETS}, r AS (SELECT min(doc_id) AS rep, tk FROM sets WHERE len(tk) > 0 GROUP BY tk),
        w AS (SELECT rep, len(tk) AS n, unnest(tk) AS t FROM r), p AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM w x JOIN w y ON x.t = y.t AND x.rep < y.rep GROUP BY 1, 2)
        SELECT a, b, {r6('k / (na + nb - k)')} AS similarity FROM p WHERE k / (na + nb - k) >= {_t} UNION ALL SELECT rep, doc_id, 1.0 FROM sets JOIN r USING (tk) WHERE doc_id <> rep""",
    )(lambda spark, sf, t=_t: gr.near_duplicates(
        st.table(spark, sf, "documents").select("doc_id", tx.tokens("text").alias("tk")), "doc_id", "tk", t))


# an actor and the subject it acted on inside its circle of three actors; every event is an edge
_EDGES = f"{st.ACTIONS_SQL}, e AS (SELECT DISTINCT concat('u', user_id) AS u, concat('s', k // 4, ':', user_id // 3) AS v FROM actions)"


@query(
    "connected_components",
    f"""WITH RECURSIVE {_EDGES}, b AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
    cc(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION (SELECT b.u, min(r.component) FROM cc AS r JOIN b ON b.v = r.node
      JOIN recurring.cc AS mine ON mine.node = b.u GROUP BY b.u, mine.component HAVING min(r.component) < mine.component))
    SELECT node, component FROM cc""",
)
def _(spark, sf):
    return gr.components(st.actions(spark, sf).selectExpr("concat('u', user_id) AS u", "concat('s', k DIV 4, ':', user_id DIV 3) AS v"))


@query("topic_clusters")
def _(spark, sf):
    topics = labels_in(spark, sf).withColumn("weight", F.length("label"))
    return gr.topic_clusters(topics, "label", "label", "weight")


@query(
    "group_merge",
    """WITH g AS (SELECT p_name AS label, count(*) AS n, max(p_size) AS q FROM part GROUP BY 1)
    SELECT string_split(label, ' ')[1] AS merge_key, arg_max(label, {'a': q, 'b': n, 'c': label}) AS label, CAST(sum(n) AS BIGINT) AS documents, string_agg(label, '|' ORDER BY label) AS aliases FROM g GROUP BY 1""",
)
def _(spark, sf):
    g = st.table(spark, sf, "part").groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("q"))
    return gr.merge_groups(g, F.split("label", " ")[0], "label", "q", "n")


@query(
    "token_centrality",
    """WITH w AS (SELECT source, doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS t FROM documents), f AS (SELECT source, t, count(*) AS f FROM w GROUP BY 1, 2)
    SELECT source, doc_id, """ + r6("avg(f)") + """ AS centrality FROM w JOIN f USING (source, t) GROUP BY 1, 2""",
)
def _(spark, sf):
    d = st.table(spark, sf, "documents").withColumn("t", F.split(F.lower("text"), " ", -1))
    return gr.token_centrality(d, "source", "doc_id", "t")


_SIG = "['tag:' || k % 13, 'entity:' || event_type, 'url:' || k % 7]"


@query(
    "signal_support",
    f"""WITH {st.ACTIONS_SQL}, x AS (SELECT user_id % 10 AS grp, k, round(value, 2) AS value, unnest({_SIG}) AS signal FROM actions)
    SELECT grp, signal, count(DISTINCT k) AS support, {r6('sum(value)')} AS weight, arg_max(k, {{'a': value, 'b': k}}) AS best_root FROM x GROUP BY 1, 2""",
)
def _(spark, sf):
    a = st.actions(spark, sf).selectExpr(
        "user_id % 10 AS grp", "k", "round(value, 2) AS value", "array(concat('tag:', k % 13), concat('entity:', event_type), concat('url:', k % 7)) AS s")
    return gr.signal_support(a, "grp", "s", "value", "k")


@query("group_dominant", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1")
def _(spark, sf):
    return gr.dominant(st.table(spark, sf, "documents"), "source", "lang")


@query(
    "topic_ladder",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'template:' || event_type WHEN event_id % 5 = 0 THEN 'semantic:' || user_id WHEN event_id % 4 = 0 THEN 'url:' || user_id % 7 ELSE 'single:' || event_id END AS topic_key,
    CASE WHEN event_id % 9 = 0 THEN 'template' WHEN event_id % 5 = 0 THEN 'semantic' WHEN event_id % 4 = 0 THEN 'url' ELSE 'singleton' END AS rung FROM events""",
)
def _(spark, sf):
    e = st.table(spark, sf, "events").selectExpr(
        "event_id", "IF(event_id % 9 = 0, concat('template:', event_type), NULL) AS template",
        "IF(event_id % 5 = 0, concat('semantic:', user_id), NULL) AS semantic", "IF(event_id % 4 = 0, concat('url:', user_id % 7), NULL) AS url")
    return gr.assign_ladder(e, "template", "semantic", "url", own="event_id").select("event_id", "topic_key", "rung")


def greedy_sql(source: str, order: str, carry: dict[str, str], allowed: str, limit: int, out: str) -> str:
    """A walk in SQL: one recursion step per row, lists carry the picks."""
    lists = ", ".join(carry)
    grow = ", ".join(f"CASE WHEN {allowed} THEN list_append(w.{n}, {v}) ELSE w.{n} END" for n, v in carry.items())
    first = next(iter(carry))
    return f"""WITH RECURSIVE {source}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM src),
    w(n, {lists}) AS (SELECT 0::BIGINT, {', '.join(f"(SELECT list({v}) FROM o WHERE n < 0)" for v in carry.values())}
      UNION ALL SELECT o.n, {grow} FROM w JOIN o ON o.n = w.n + 1 WHERE coalesce(len(w.{first}), 0) < {limit}),
    p AS (SELECT {first} AS ids FROM w ORDER BY n DESC LIMIT 1), q AS (SELECT unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM p)
    SELECT {out} FROM q JOIN o ON o.id = q.id"""


_count = lambda name, value: f"coalesce(len(list_filter(w.{name}, lambda t: t = {value})), 0)"


@query("capped_selection", greedy_sql(
    f"{st.ACTIONS_SQL}, src AS (SELECT event_id AS id, event_id, k, user_id, value, ts FROM actions)", "value DESC, ts DESC, event_id",
    {"ids": "id", "ks": "k", "us": "user_id"}, f"{_count('ks', 'o.k')} < 2 AND {_count('us', 'o.user_id')} < 6", 520,
    "event_id, k, user_id, " + r6("value") + " AS value, place"))
def _(spark, sf):
    a = st.actions(spark, sf).select("event_id", "k", "user_id", "value", "ts")
    return gr.capped_selection(a, [F.col("value").desc(), F.col("ts").desc(), F.col("event_id").asc()], "event_id", "k", "user_id", 2, 6, 520).drop("ts")


@query("channel_selection", greedy_sql(
    "src AS (SELECT doc_id AS id, doc_id, source, left(sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 24) AS text_key FROM documents)", "doc_id DESC",
    {"ids": "id", "cs": "source", "ts": "text_key"}, f"{_count('cs', 'o.source')} < 12 AND {_count('ts', 'o.text_key')} < 1", 200, "doc_id, source, text_key, place"))
def _(spark, sf):
    d = st.table(spark, sf, "documents").select("doc_id", "source", tx.short_sha1(F.lower(tx.collapse_ws("text")), 24).alias("text_key"))
    return gr.channel_selection(d, [F.col("doc_id").desc()], "doc_id", "source", "text_key", 12, 200)


@query("representative_posts")
def _(spark, sf):
    d = st.table(spark, sf, "documents").select(
        F.col("source").alias("topic"), F.col("doc_id").alias("post_id"), (F.col("doc_id") % 97).alias("author"),
        (F.col("n_chars") % 500).cast("double").alias("engagement"), (F.col("doc_id") % 10 / 10.0).cast("double").alias("quality"),
        (F.col("doc_id") * 60).alias("event_s"), tx.short_sha1(tx.collapse_ws("text"), 24).alias("fingerprint"), tx.tokens("text").alias("tokens"))
    return gr.representative_posts(d, "topic")


@query("diversified_board", greedy_sql(
    "src AS (SELECT l_partkey AS id, l_partkey, round(sum(l_extendedprice), 2) AS score, list_sort(list(DISTINCT strftime(l_shipdate, '%Y-%m'))) AS evidence FROM lineitem GROUP BY l_partkey)",
    "score DESC, l_partkey", {"ids": "id", "es": "evidence"},
    "coalesce(len(list_filter(w.es, lambda e: len(list_intersect(e, o.evidence)) / greatest(len(e), len(o.evidence)) >= 0.34)), 0) = 0", 40, "l_partkey, " + r6("score") + " AS score, place"))
def _(spark, sf):
    rows = st.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("score"), F.sort_array(F.collect_set(F.date_format("l_shipdate", "yyyy-MM"))).alias("evidence"))
    return gr.overlap_board(rows, "l_partkey", [F.col("score").desc(), F.col("l_partkey").asc()], {"evidence": 0.34}, 40).drop("evidence")


@query("curated_board")
def _(spark, sf):
    rows = st.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_discount") * 1000, 2).alias("quality"), F.max("l_linenumber").alias("lines"),
        F.sort_array(F.collect_set(F.date_format("l_shipdate", "yyyy-MM"))).alias("months"))
    rows = rows.selectExpr("l_partkey", "quality", "concat('a', l_partkey % 6) AS archetype", "l_partkey % 3 = 0 AS dry", "l_partkey % 5 = 0 AS watch", "lines < 7 AS low_visual", "months")
    return gr.curated_board(rows, "l_partkey", [F.col("quality").desc(), F.col("l_partkey").asc()], "quality", "archetype", "dry", "watch", "low_visual", "months", 25).drop("months")
