"""Building blocks of the oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from tidegauge import fixed
from tidegauge.functions.text import alias_lookup
from tidegauge.plans import standins as st


def arr(items) -> str:
    return "[" + ",".join("'" + str(i).replace("'", "''") + "'" for i in sorted(set(items))) + "]"


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0.0"


def r1(expr: str) -> str:
    """Half-up rounding to one digit, ties decided on nine digits."""
    return f"(floor(round(CAST(({expr}) * 10 AS DOUBLE), 9) + 0.5) / 10)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def count_in(toks: str, items) -> str:
    return f"len(list_filter({toks}, lambda t: list_contains({arr(items)}, t)))"


def initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '([a-z0-9]+|[^a-z0-9]+)'), "
        "lambda p: concat(upper(p[1:1]), p[2:])), '')"
    )


LISTED = fixed.WEAK_WORDS + fixed.TOPIC_NOISE + fixed.NUMBER_WORDS + fixed.URL_DEBRIS

ALIASES = "aliases(alias_key, canonical_key, canonical_label, confidence) AS (VALUES " + ",".join(
    f"('{a}', '{k}', '{l}', {c}::DOUBLE)" for a, (k, l, c) in sorted(alias_lookup().items())
) + ")"

SPELL_STORED = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({x}), 'â€™', ''''), '’', ''''), "
    r"'([a-z0-9])''([a-z0-9])', '\1\2', 'g'), '[^a-z0-9$#\s-]+', ' ', 'g'), '\s+', ' ', 'g'))"
)
SPELL_PLAIN = r"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9$#\s]+', ' ', 'g'), '\s+', ' ', 'g'))"

_toks = "string_split(topic_key, ' ')"
INFORMATIVE = (
    f"len(list_filter({_toks}, lambda t: t <> '' AND NOT list_contains({arr(LISTED)}, t) "
    f"AND (length(t) >= 4 OR list_contains({arr(fixed.ACRONYMS)}, t))))"
)

CANDIDATES = f"""{st.ACTIONS_SQL}, {st.PROCESSED_SQL}, {st.POST_TOPICS_SQL}, {ALIASES},
spelled AS (SELECT pt.*, pp.author_id, pp.processed_at, pp.quality_score, pp.is_repost, pp.is_reply, pp.has_link,
  CASE WHEN pp.sentiment_label IN ('positive','negative','neutral') THEN pp.sentiment_label ELSE 'neutral' END AS sentiment_label,
  {SPELL_STORED.format(x='pt.topic_text')} AS base
  FROM post_topics pt LEFT JOIN processed pp USING (processed_post_id)),
keyed AS (SELECT s.*, coalesce(a.canonical_key, base) AS topic_key,
  coalesce(a.canonical_label, CASE WHEN list_contains({arr(fixed.ACRONYMS)}, base) THEN upper(base)
    ELSE coalesce(nullif(trim(topic_text), ''), {initcap('base')}) END) AS topic_label,
  coalesce(a.confidence, 0.0::DOUBLE) AS alias_confidence
  FROM spelled s LEFT JOIN aliases a ON a.alias_key = s.base),
profiled AS (SELECT *, len({_toks}) AS n, {count_in(_toks, fixed.WEAK_WORDS)} AS weak,
  {count_in(_toks, fixed.TOPIC_NOISE)} AS noise, {count_in(_toks, fixed.NUMBER_WORDS)} AS number_n,
  {count_in(_toks, fixed.URL_DEBRIS)} AS url_n, {INFORMATIVE} AS informative FROM keyed),
scored AS (SELECT *, least(1.0, greatest(0.0,
   CASE topic_type WHEN 'cashtag' THEN 0.74 WHEN 'hashtag' THEN 0.67 WHEN 'entity' THEN 0.56 ELSE 0.40 END::DOUBLE
   + quality_score * 0.20::DOUBLE + alias_confidence * 0.18::DOUBLE
   + CASE WHEN n >= 2 THEN 0.12 ELSE 0 END::DOUBLE
   + CASE WHEN list_contains({arr(fixed.ACRONYMS)}, topic_key) THEN 0.12 ELSE 0 END::DOUBLE
   - weak::DOUBLE / n * 0.48::DOUBLE - noise::DOUBLE / n * 0.70::DOUBLE - url_n::DOUBLE / n
   - CASE WHEN n = 1 AND NOT list_contains({arr(fixed.ACRONYMS)}, topic_key) AND length(topic_key) < 4
       THEN 0.32 ELSE 0 END::DOUBLE)) AS topic_confidence FROM profiled)"""

MENTIONS = f"""{CANDIDATES},
gated AS (SELECT * FROM scored WHERE topic_key <> '' AND topic_key NOT IN ('all','general','digit')
  AND NOT (lower(topic_text) LIKE 'digit:%in words:%') AND length(replace(topic_key, ' ', '')) >= 2
  AND NOT regexp_matches(topic_key, '^[0-9]+$')
  AND NOT regexp_matches(topic_key, '(^| )(https?|www|com|co|t|ly|amp)( |$)')
  AND NOT regexp_matches(topic_key, '(^| )([a-z0-9]+bot)( |$)')
  AND NOT regexp_matches(topic_key, '(area|forecast|discussion).*(afd|airnow|aqi)')
  AND NOT regexp_matches(topic_key, '(additional|details) here')
  AND number_n < n AND informative >= 1 AND url_n = 0
  AND topic_confidence >= CASE topic_type WHEN 'cashtag' THEN 0.34 WHEN 'hashtag' THEN 0.38 WHEN 'entity' THEN 0.45 ELSE 0.62 END),
mentions AS (SELECT raw_post_id, processed_post_id, platform, topic_key, topic_label, source_created_at AS event_timestamp,
  processed_at AS ingested_at, author_id, sentiment_label, quality_score, topic_confidence, is_repost, is_reply, has_link
  FROM gated QUALIFY row_number() OVER (PARTITION BY raw_post_id, platform, topic_key
   ORDER BY topic_confidence DESC, quality_score DESC, source_created_at DESC, topic_label) = 1)"""

SENTIMENT_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE sentiment_label = '{s}') AS BIGINT) AS {s}_count" for s in ("positive", "neutral", "negative")
)

MINUTES = f"""{MENTIONS},
minutes AS (SELECT date_trunc('minute', event_timestamp) AS bucket_minute, platform, topic_key,
  count(*) AS mention_count, count(DISTINCT raw_post_id) AS unique_posts, count(DISTINCT nullif(author_id, '')) AS unique_authors,
  {SENTIMENT_COUNTS}, avg(topic_confidence) AS avg_topic_confidence
  FROM mentions WHERE topic_confidence >= 0.34 GROUP BY 1, 2, 3)"""

DAY_TOTALS = f"""{MINUTES},
day_labels AS (SELECT CAST(event_timestamp AS DATE) AS day, topic_key, topic_label AS modal FROM mentions
  WHERE topic_confidence >= 0.34 GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY CAST(event_timestamp AS DATE), topic_key
    ORDER BY count(*) DESC, length(topic_label) DESC, topic_label) = 1),
day_totals AS (SELECT CAST(bucket_minute AS DATE) AS day, m.topic_key, any_value(modal) AS topic_label,
  count(DISTINCT platform) AS platform_count, {big('sum(mention_count)')} AS total_mentions,
  {big('sum(unique_posts)')} AS unique_posts, {big('sum(unique_authors)')} AS unique_authors,
  {big('sum(positive_count)')} AS positive_count, {big('sum(neutral_count)')} AS neutral_count,
  {big('sum(negative_count)')} AS negative_count,
  sum(avg_topic_confidence * mention_count) / sum(mention_count) AS avg_topic_confidence,
  min(bucket_minute) AS first_seen_at, max(bucket_minute) AS last_seen_at
  FROM minutes m LEFT JOIN day_labels l ON l.day = CAST(bucket_minute AS DATE) AND l.topic_key = m.topic_key
  GROUP BY 1, 2 HAVING sum(mention_count) >= 2)"""


def plain_minute_mentions() -> str:
    noise = arr(w for w in fixed.TOPIC_NOISE if w != "digit")
    weak = arr(fixed.WEAK_WORDS)
    ok = (
        f"normalized_topic <> '' AND normalized_topic NOT IN ('all','general') AND NOT list_contains({weak}, normalized_topic) "
        f"AND length(replace(normalized_topic, ' ', '')) >= 2 AND NOT list_has_any(string_split(normalized_topic, ' '), {noise})"
    )
    fold = "CASE WHEN {x} IN ('nokings','no king','no kings','no kings s','no kingss') THEN 'no kings' ELSE {x} END"
    weak_noise = arr(fixed.WEAK_WORDS + [w for w in fixed.TOPIC_NOISE if w != "digit"])
    return f"""{st.ACTIONS_SQL}, {st.PROCESSED_SQL}, {st.POST_TOPICS_SQL},
direct0 AS (SELECT pt.bucket_minute, pt.platform, {fold.format(x=SPELL_PLAIN.format(x='pt.topic_text'))} AS normalized_topic,
  pt.raw_post_id, author_id, quality_score, is_repost, is_reply, has_link, sentiment_label,
  CASE topic_type WHEN 'cashtag' THEN 1 WHEN 'hashtag' THEN 2 WHEN 'entity' THEN 3 WHEN 'keyword' THEN 4 ELSE 9 END AS topic_priority
  FROM post_topics pt LEFT JOIN processed pp USING (processed_post_id)),
direct AS (SELECT * FROM direct0 WHERE {ok} QUALIFY row_number() OVER (PARTITION BY raw_post_id, platform, normalized_topic
  ORDER BY topic_priority, quality_score DESC) = 1),
fallback AS (SELECT bucket_minute, platform, {fold.format(x=SPELL_PLAIN.format(x='topic_key_candidate'))} AS normalized_topic,
  raw_post_id, author_id, quality_score, is_repost, is_reply, has_link, sentiment_label, 9 AS topic_priority
  FROM processed pp WHERE NOT EXISTS (SELECT 1 FROM post_topics pt WHERE pt.raw_post_id = pp.raw_post_id)),
all_mentions AS (SELECT * FROM (SELECT * FROM direct UNION ALL SELECT * FROM fallback) WHERE {ok}
  AND NOT regexp_matches(normalized_topic, '(^| )([a-z0-9]+bot)( |$)')
  AND NOT regexp_matches(normalized_topic, '(area|forecast|discussion).*(afd|airnow|aqi)')
  AND NOT regexp_matches(normalized_topic, '(additional|details) here')
  AND len(list_filter(string_split(normalized_topic, ' '), lambda t: list_contains({weak_noise}, t)))
     <= greatest(1, len(string_split(normalized_topic, ' ')) - 1)
  AND len(list_filter(string_split(normalized_topic, ' '), lambda t: NOT list_contains({weak_noise}, t) AND length(t) >= 4)) > 0),
counted AS (SELECT *, CASE WHEN sentiment_label IN ('positive','negative','neutral') THEN sentiment_label ELSE 'neutral' END AS mood
  FROM all_mentions)"""


def split_list(text):
    """Top-level comma split of a SQL select list."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]
