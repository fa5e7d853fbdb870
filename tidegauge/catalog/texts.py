"""Text features, labels, titles, names, URLs, phrase statistics."""

from pyspark.sql import functions as F

from tidegauge import fixed
from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import SPELL_STORED, arr, big, count_in, r6
from tidegauge.functions import labels as lb, text as tx
from tidegauge.operators import topics as tp
from tidegauge.plans import standins as st

_STOP = arr(fixed.STOPWORDS + fixed.URL_DEBRIS)
_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_TOK = (
    "list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_''-]{{1,63}}'), "
    "lambda t: regexp_replace(regexp_replace(t, '^[._-]+', ''), '[._-]+$', '')), "
    f"lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({_STOP}, t))"
)


def _ordered_distinct(x):
    # first-seen order: keep an element when its first position is its own
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


_TEXT = f"""{st.RAW_POSTS_SQL}, cleaned AS (SELECT *, {_CLEAN} AS t FROM raw_posts),
parts AS (SELECT *, {_TOK.format(x='t')} AS tk0,
  list_transform(regexp_extract_all(t, 'https?://[^\\s<>"]+'), lambda u: regexp_replace(u, '[.,)]+$', '')) AS us,
  list_transform(regexp_extract_all(t, '(?:^|\\s)#([A-Za-z0-9_]{{1,100}})', 1), lambda x: lower(x)) AS tg,
  list_transform(regexp_extract_all(t, '(?:^|\\s)@([A-Za-z0-9_.-]{{1,100}})', 1), lambda x: lower(x)) AS mt,
  list_transform(regexp_extract_all(t, '\\$([A-Za-z][A-Za-z0-9]{{1,15}})', 1), lambda x: lower(x)) AS ct,
  regexp_extract_all(lower(t), '[a-z'']+') AS words FROM cleaned),
tok AS (SELECT doc_id, u.e AS tok, min(u.i) AS i FROM (SELECT doc_id, unnest(list_zip(tk0, range(1, len(tk0) + 1))) AS z FROM parts) s,
  LATERAL (SELECT z[1] AS e, z[2] AS i) u GROUP BY 1, 2),
toks AS (SELECT doc_id, list(tok ORDER BY i) AS tokens FROM tok GROUP BY 1)"""


def _lex(lexicon):
    return "CAST(list_sum(list_transform(words, lambda w: CASE w " + " ".join(
        f"WHEN '{w}' THEN {v}" for w, v in lexicon.items()) + " ELSE 0 END)) AS BIGINT)"


_SENT = f"""mood AS (SELECT doc_id, coalesce({_lex(fixed.POSITIVE_WORDS)}, 0) AS positive, coalesce({_lex(fixed.NEGATIVE_WORDS)}, 0) AS negative,
  coalesce({_lex(fixed.NEUTRAL_WORDS)}, 0) AS neutral FROM parts)"""


@query(
    "post_features",
    f"""WITH {_TEXT}, {_SENT} SELECT p.doc_id, len(tokens) AS token_count, md5(array_to_string(tokens, ' ')) AS tokens_md5,
    array_to_string(tokens[1:3], '|') AS key_phrases, array_to_string(list_distinct(tg), '|') AS hashtags, array_to_string(list_distinct(ct), '|') AS cashtags,
    array_to_string(list_distinct(mt), '|') AS mentions, array_to_string(list_distinct(us), '|') AS urls,
    array_to_string(list_distinct(list_transform(us, lambda u: regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''))), '|') AS domains,
    array_to_string(list_filter([
      CASE WHEN list_has_any(tokens, {arr(fixed.CRYPTO_TERMS)}) OR len(ct) > 0 OR regexp_matches(lower(t), 'meme[ -]?coin') THEN 'crypto' END,
      CASE WHEN list_has_any(tokens, {arr(fixed.MEMECOIN_TERMS)}) OR regexp_matches(lower(t), 'meme[ -]?coin') THEN 'memecoin' END,
      CASE WHEN list_has_any(tokens, {arr(fixed.ECOMMERCE_TERMS)}) OR contains(lower(t), 'e-commerce') OR contains(lower(t), 'drop shipping') THEN 'ecommerce' END,
      CASE WHEN list_has_any(tokens, {arr(fixed.DROPSHIP_TERMS)}) OR contains(lower(t), 'drop shipping') THEN 'dropshipping' END,
      CASE WHEN list_has_any(tokens, {arr(fixed.PRODUCT_TERMS)}) THEN 'product' END,
      CASE WHEN len(us) > 0 THEN 'link' END, CASE WHEN len(tg) > 0 THEN 'hashtagged' END], lambda x: x IS NOT NULL), '|') AS tags,
    {r6('round(least(1, 0.25::DOUBLE + least(1, len(tokens) / 20.0::DOUBLE) * 0.35::DOUBLE + least(0.35::DOUBLE, ln(1 + doc_id % 50) / 12) + CASE WHEN len(us) > 0 THEN 0.05 ELSE 0 END::DOUBLE), 4)')} AS quality_score,
    sha1(t)[1:24] AS fingerprint, CASE WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    positive, negative, neutral FROM parts p JOIN toks USING (doc_id) JOIN mood USING (doc_id)""",
)
def _(spark, sf):
    df = tp.post_features(st.raw_posts(spark, sf), "text", F.col("doc_id") % 50)
    return df.withColumn("tokens_md5", F.md5(F.concat_ws(" ", "tokens"))).drop("source", "lang", "text", "n_chars", "tokens")


@query("post_topic_candidates")
def _(spark, sf):
    return tp.topic_candidates(st.raw_posts(spark, sf), "doc_id", "text", F.lit(0.5))


@query(
    "topic_key_spelling",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), '’', ''''),
      '([\p{{L}}\p{{N}}_])''([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '([\p{{L}}\p{{N}}_])''([\p{{L}}\p{{N}}_])', '\1\2', 'g'),
      '[^a-z0-9$#\s-]+', ' ', 'g'), '\s+', ' ', 'g'), ' -') AS topic_key FROM (SELECT doc_id,
      regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}_])[?�]([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '([\p{{L}}\p{{N}}_])[?�]([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS text
      FROM (SELECT doc_id, text FROM documents UNION ALL SELECT page_id, url FROM pages))""",
)
def _(spark, sf):
    # addresses have question marks between letters, so the rule for damaged apostrophes shows
    docs = st.table(spark, sf, "documents").select("doc_id", "text").unionByName(st.table(spark, sf, "pages").selectExpr("page_id AS doc_id", "url AS text"))
    return docs.select("doc_id", tx.topic_key("text").alias("topic_key"))


_DROP = arr(fixed.URL_DROP_KEYS)
_ALL_URLS = "urls AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT doc_id, concat('https://WWW.Site', doc_id % 9, '.example/a/b//?utm_source=x&id=', doc_id, '&Ref=z#frag') FROM documents UNION ALL SELECT doc_id, 'https://bsky.app/profile/' || doc_id FROM documents)"


@query(
    "canonical_urls",
    f"""WITH {_ALL_URLS}, p AS (SELECT id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
      lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
      list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND NOT list_contains({_DROP}, lower(string_split(kv, '=')[1]))) AS q FROM urls)
    SELECT id, url, CASE WHEN NOT list_contains({arr(fixed.URL_INTERNAL_HOSTS)}, host) THEN concat(scheme, '://', host, CASE WHEN path = '' THEN '/' ELSE path END,
      CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) END AS canonical, regexp_replace(host, '^www\\.', '') AS domain FROM p""",
)
def _(spark, sf):
    docs = st.table(spark, sf, "documents")
    urls = st.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url").unionByName(
        docs.selectExpr("doc_id AS id", "concat('https://WWW.Site', doc_id % 9, '.example/a/b//?utm_source=x&id=', doc_id, '&Ref=z#frag') AS url")
    ).unionByName(docs.selectExpr("doc_id AS id", "concat('https://bsky.app/profile/', doc_id) AS url"))
    return urls.select("id", "url", lb.canonical_url("url").alias("canonical"), tx.domain("url").alias("domain"))


_COUNT_TEXT = "CASE p_partkey % 5 WHEN 0 THEN concat(p_size, 'K') WHEN 1 THEN concat(p_size / 10, 'M') WHEN 2 THEN concat(p_size, 'b') WHEN 3 THEN concat('1,', 100 + p_size) ELSE p_name END"


@query(
    "compact_counts",
    f"""WITH t AS (SELECT p_partkey, {_COUNT_TEXT.replace("p_size / 10", "CAST(p_size // 10 AS VARCHAR) || '.' || CAST(p_size % 10 AS VARCHAR)")} AS label FROM part),
    m AS (SELECT *, upper(replace(trim(label), ',', '')) AS s FROM t),
    n AS (SELECT p_partkey, label, CASE WHEN regexp_matches(s, '^[0-9]+(\\.[0-9]+)?[KMB]?$') THEN CAST(floor(CAST(regexp_extract(s, '^[0-9.]+') AS DOUBLE)
      * CASE right(s, 1) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'B' THEN 1000000000 ELSE 1 END + 0.5) AS BIGINT) END AS n FROM m)
    SELECT p_partkey, label, n AS count, {big('CASE WHEN n IS NULL THEN 0 ELSE greatest(1, least(100, floor(log10(n + 1) * 20 + 0.5))) END')} AS traffic_score FROM n""",
)
def _(spark, sf):
    label = _COUNT_TEXT.replace("p_size / 10", "CAST(p_size DIV 10 AS STRING), '.', CAST(p_size % 10 AS STRING)")
    df = st.table(spark, sf, "part").selectExpr("p_partkey", f"{label} AS label")
    n = lb.compact_count("label")
    return df.select("p_partkey", "label", n.alias("count"), lb.traffic_score(n).alias("traffic_score"))


# labels: topic wording of events plus part names, so every rule meets real rows
_LABELS_SQL = """labels_in AS (SELECT DISTINCT label FROM (
 SELECT concat_ws(' ', p_type, p_name) AS label FROM part UNION ALL SELECT p_name FROM part UNION ALL
 SELECT concat('official trailer ', p_brand) FROM part UNION ALL SELECT concat('hey ', p_name) FROM part UNION ALL
 SELECT concat('www ', p_name, ' com') FROM part UNION ALL SELECT CASE p_size % 4 WHEN 0 THEN 'March' WHEN 1 THEN 'current affairs' WHEN 2 THEN 'the update' ELSE 'Elections' END FROM part UNION ALL
 SELECT c_mktsegment || ' stories ' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def labels_in(spark, sf):
    part = st.table(spark, sf, "part")
    cust = st.table(spark, sf, "customer").join(st.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    exprs = [
        "concat_ws(' ', p_type, p_name)", "p_name", "concat('official trailer ', p_brand)", "concat('hey ', p_name)",
        "concat('www ', p_name, ' com')",
        "CASE p_size % 4 WHEN 0 THEN 'March' WHEN 1 THEN 'current affairs' WHEN 2 THEN 'the update' ELSE 'Elections' END",
    ]
    out = cust.selectExpr("concat(c_mktsegment, ' stories ', n_name) AS label")
    for e in exprs:
        out = out.unionByName(part.selectExpr(f"{e} AS label"))
    return out.distinct()


_LT = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9\\s-]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"
_SING = """CASE WHEN length(t) <= 4 THEN t WHEN t LIKE '%ies' AND length(t) > 5 THEN left(t, length(t) - 3) || 'y'
 WHEN t LIKE '%es' AND t NOT LIKE '%ses' AND t NOT LIKE '%xes' THEN left(t, length(t) - 2)
 WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND t NOT LIKE '%us' AND t NOT LIKE '%is' THEN left(t, length(t) - 1) ELSE t END"""
_LDROP = arr(fixed.LABEL_STOP_WORDS + fixed.LABEL_GENERIC_WORDS + fixed.LABEL_TEMPORAL_WORDS)
_re_any = lambda x, ps: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in ps) + ")"
_CLABEL = f"""{_LABELS_SQL}, l0 AS (SELECT label, {_LT} AS toks FROM labels_in),
l1 AS (SELECT *, array_to_string(toks, ' ') AS ident, list_distinct(list_filter(list_transform(toks, lambda t: {_SING}), lambda t: length(t) >= 2 AND NOT list_contains({_LDROP}, t))) AS inf FROM l0),
l2 AS (SELECT *, (ident = '' OR {_re_any('ident', fixed.LABEL_FRAGMENT_PATTERNS)} OR {_re_any('ident', fixed.LABEL_GENERIC_PATTERNS)}
   OR (len(toks) = 1 AND list_contains({arr(fixed.LABEL_GENERIC_WORDS + fixed.LABEL_TEMPORAL_WORDS)}, toks[1]))
   OR (len(inf) = 0 AND length(replace(replace(ident, ' ', ''), '-', '')) <= 12)) AS frag,
  (ident = '' OR {_re_any('ident', fixed.LABEL_GENERIC_PATTERNS)} OR len(inf) = 0) AS gen,
  (len(toks) > 0 AND len(list_filter(toks, lambda t: NOT list_contains({arr(fixed.LABEL_TEMPORAL_WORDS)}, t))) = 0) AS temp FROM l1)"""


@query(
    "cluster_label_quality",
    f"""WITH {_CLABEL} SELECT label, array_to_string(list_sort(inf)[1:4], ' ') AS merge_key, frag AS is_fragment, gen AS is_generic, temp AS is_temporal,
    {big("len(inf) * 18 + CASE WHEN contains(trim(label), ' ') THEN 8 ELSE 0 END + CASE WHEN frag THEN -20 ELSE 14 END + CASE WHEN gen THEN -18 ELSE 10 END + CASE WHEN temp THEN -24 ELSE 6 END + CASE WHEN len(inf) = 1 THEN 6 ELSE 0 END")} AS score FROM l2""",
)
def _(spark, sf):
    return labels_in(spark, sf).select(
        "label", lb.merge_key("label").alias("merge_key"), lb.is_fragment_topic("label").alias("is_fragment"),
        lb.is_generic_topic("label").alias("is_generic"), lb.is_temporal_topic("label").alias("is_temporal"),
        lb.cluster_label_score("label").cast("long").alias("score"),
    )


_NSTOP = arr(fixed.NARRATIVE_STOP_WORDS + fixed.NARRATIVE_WEAK_WORDS)
_ALIAS_CASE = "CASE s {} ELSE s END".format(" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.NARRATIVE_TOKEN_ALIASES.items()))
_NTOK = (
    "list_transform(list_transform(list_filter(string_split(trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''), "
    "lambda t: CASE WHEN t LIKE '%s' AND length(t) > 4 AND NOT regexp_matches(t, '(ss|us|is|as)$') THEN left(t, length(t) - 1) ELSE t END), "
    f"lambda s: {_ALIAS_CASE})"
)
_NLABEL = f"""{_LABELS_SQL}, n0 AS (SELECT label, trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS phrase,
  {_NTOK.format(x='lower(label)')} AS toks FROM labels_in),
n1 AS (SELECT *, list_filter(toks, lambda t: NOT list_contains({_NSTOP}, t)) AS inf FROM n0),
n2 AS (SELECT *, (len(inf) >= 2 OR len(list_filter(inf, lambda t: length(t) >= 4 OR list_contains({arr(fixed.NARRATIVE_ACRONYMS)}, t) OR regexp_matches(t, '[0-9]'))) > 0) AS anchor,
 (phrase = '' OR {_re_any('phrase', fixed.FRAGMENT_LABEL_PATTERNS)} OR len(toks) = 0 OR (len(toks) <= 3 AND len(inf) = 0)
  OR (len(toks) <= 3 AND (list_contains({arr(fixed.FRAGMENT_LEADS)}, toks[1]) OR list_contains({arr(fixed.FRAGMENT_TAILS)}, toks[-1])) AND len(inf) < 2)
  OR (len(toks) <= 3 AND list_contains({arr(fixed.FRAGMENT_LEADS)}, toks[1]) AND list_contains({arr(fixed.FRAGMENT_TAILS)}, toks[-1]))
  OR (len(toks) >= 3 AND len(list_distinct(inf)) <= 1 AND len(inf) > 0 AND len(toks) > len(inf))) AS frag,
 (len(toks) = 0 OR ({count_in('toks', fixed.URL_LABEL_WORDS)} > 0 AND (list_has_any(toks, ['com','www','http','https'])
   OR (len(inf) <= 3 AND {count_in('toks', fixed.URL_LABEL_WORDS)} >= greatest(1, len(inf) - 1))))) AS urlish,
 (phrase = '' OR list_contains({arr(fixed.PLATFORM_LABEL_PHRASES)}, phrase) OR len(inf) = 0 OR {count_in('inf', fixed.PLATFORM_LABEL_WORDS)} = len(inf)) AS plat,
 (phrase = '' OR (len(inf) BETWEEN 1 AND 3 AND {count_in('inf', fixed.TEMPORAL_LABEL_WORDS)} = len(inf))) AS temp FROM n1)"""


_NWEAK = f"""(phrase = '' OR regexp_matches(lower(label), '{fixed.QUESTION_LABEL_PATTERN}') OR list_contains({arr(fixed.NARRATIVE_WEAK_PHRASES)}, phrase) OR plat OR urlish OR temp
     OR len(toks) = 0 OR len(inf) = 0 OR (len(list_distinct(inf)) <= 1 AND len(inf) >= 2)
     OR (len(inf) <= 2 AND len(list_filter(inf, lambda t: length(t) >= 4 OR regexp_matches(t, '[0-9]'))) = 0
         AND NOT (len(inf) > 0 AND {count_in('inf', fixed.NARRATIVE_ACRONYMS)} = len(inf)))
     OR (frag AND len(inf) < 2) OR (len(toks) <= 3 AND len(toks) - len(inf) >= len(toks) - 1 AND len(inf) < 2)
     OR ((list_contains({_NSTOP}, toks[1]) OR list_contains({_NSTOP}, toks[-1])) AND NOT anchor) OR (len(toks) = 1 AND NOT anchor))"""


@query(
    "narrative_label_quality",
    f"""WITH {_NLABEL} SELECT label, frag AS is_fragment, urlish AS is_url_like, plat AS is_platform, temp AS is_temporal,
    {_NWEAK} AS is_weak FROM n2""",
)
def _(spark, sf):
    df = labels_in(spark, sf).withColumn("p", lb.label_profile("label"))
    p = F.col("p")
    return df.select(
        "label", lb.is_fragment_label(p).alias("is_fragment"), lb.is_url_label(p).alias("is_url_like"),
        lb.is_platform_label(p).alias("is_platform"), lb.is_temporal_label(p).alias("is_temporal"), lb.is_weak_label(p).alias("is_weak"),
    )


_NAME_ID = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_NAME_C = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
_name_generic = lambda x: f"({_NAME_ID.format(x=x)} = '' OR list_contains({arr(fixed.NAME_GENERIC_PHRASES)}, {_NAME_ID.format(x=x)}) OR {count_in(f'string_split({_NAME_ID.format(x=x)}, chr(32))', fixed.NAME_GENERIC_WORDS)} >= greatest(2, len(string_split({_NAME_ID.format(x=x)}, ' '))))"
_name_frag = lambda x: f"(length({_NAME_C.format(x=x)}) = 0 OR (length({_NAME_C.format(x=x)}) < 3 AND {_NAME_C.format(x=x)} NOT IN ('ai','uk','us','eu')) OR regexp_matches({_NAME_C.format(x=x)}, '{fixed.NAME_FRAGMENT_PATTERN}'))"


@query(
    "stored_name_shapes",
    f"""WITH {_LABELS_SQL}, v AS (SELECT label, label[2:] AS cut FROM labels_in), s AS (SELECT *, {_NAME_C.format(x='cut')} AS a, {_NAME_C.format(x='label')} AS b FROM v)
    SELECT label, {_name_generic('label')} AS is_generic, {_name_frag('label')} AS is_fragment,
      len(string_split({_NAME_ID.format(x='label')}, ' ')) >= 2 OR list_contains({arr(fixed.NAME_NARRATIVE_WORDS)}, {_NAME_ID.format(x='label')}) AS has_shape,
      CASE WHEN NOT ({_name_generic('cut')} OR {_name_frag('cut')} OR (length(b) > length(a) AND a <> '' AND length(a) >= 4 AND length(b) >= 5
         AND ((contains(b, a) AND length(b) - length(a) <= 2) OR (length(b) - length(a) <= 1 AND levenshtein(a, b) <= 1)))) THEN nullif(trim(cut), '')
       WHEN NOT ({_name_generic('label')} OR {_name_frag('label')}) THEN nullif(trim(label), '') END AS safe_name FROM s""",
)
def _(spark, sf):
    cut = F.expr("substring(label, 2)")
    return labels_in(spark, sf).select(
        "label", lb.is_generic_name("label").alias("is_generic"), lb.is_fragment_name("label").alias("is_fragment"),
        lb.has_narrative_shape("label").alias("has_shape"), lb.safe_name(cut, "label").alias("safe_name"),
    )


@query(
    "title_validation",
    f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title FROM documents),
    k AS (SELECT *, list_filter(list_transform(string_split(title, ' '), lambda w: lower(regexp_replace(regexp_replace(w, '^[^A-Za-z0-9$#]+', ''), '[^A-Za-z0-9$#]+$', ''))), lambda w: w <> '') AS w FROM t),
    n AS (SELECT *, len(w) AS nw, len(list_filter(w, lambda x: NOT list_contains({arr(fixed.TITLE_GENERIC_WORDS)}, x))) AS ni FROM k)
    SELECT doc_id, nw AS word_count, ni AS informative_count, array_to_string(list_filter([CASE WHEN title = '' THEN 'empty' END, CASE WHEN nw < 4 THEN 'too few words' END,
      CASE WHEN nw > 14 THEN 'too many words' END, CASE WHEN length(title) > 140 THEN 'too long' END, CASE WHEN regexp_matches(title, '[:;?!]|\\.{{2,}}|…|["“”]') THEN 'punctuation' END,
      CASE WHEN regexp_matches(title, '{fixed.TITLE_HEADLINE_WORDS}') THEN 'headline style' END, CASE WHEN ni < 3 THEN 'too generic' END], lambda x: x IS NOT NULL), '|') AS errors FROM n""",
)
def _(spark, sf):
    df = st.table(spark, sf, "documents")
    return df.select("doc_id", lb.title_check("text").alias("r")).select("doc_id", "r.*")
