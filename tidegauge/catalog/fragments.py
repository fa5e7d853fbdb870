"""Cut-off names: words of the documents as names, line-item comments and parts as board rows."""

from pyspark.sql import functions as F

from tidegauge import fixed
from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import arr, big
from tidegauge.catalog.texts import _LDROP, _SING, _re_any
from tidegauge.functions import text as tx
from tidegauge.operators import fragments as fr, merges
from tidegauge.plans import standins as st

_WORDS = "SELECT w AS name, count(*) AS support FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1"


def words(spark, sf):
    docs = st.table(spark, sf, "documents")
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(tx.spelled_out("[a-z]+")), F.lit(0))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("support"))


@query(
    "contained_names",
    f"WITH n AS ({_WORDS}) SELECT s.name AS short, {big('count(*)')} AS holders, min(l.name) AS first_holder FROM n s JOIN n l ON length(l.name) > length(s.name) AND contains(l.name, s.name) WHERE length(s.name) >= 4 GROUP BY 1",
)
def _(spark, sf):
    return fr.contained_names(words(spark, sf), "name").groupBy("short").agg(F.count(F.lit(1)).alias("holders"), F.min("long").alias("first_holder"))


@query(
    "fragment_names_dropped",
    f"""WITH n AS ({_WORDS}) SELECT name, support FROM n s WHERE length(name) < 4 OR NOT EXISTS (SELECT 1 FROM n l WHERE length(l.name) > length(s.name) AND contains(l.name, s.name) AND l.support >= s.support)""",
)
def _(spark, sf):
    return fr.drop_fragments(words(spark, sf), "name", "support")


# one row per part: its name, a single word, a cut word, a story word or a blank, with states that go round
_ROW = """p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN concat('q', replace(p_name, ' ', '')) WHEN 3 THEN 'backlash'
  WHEN 4 THEN concat('today ', p_type) ELSE concat(' ', split_part(p_type, ' ', 1)) END AS label,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_name END AS key,
  CASE p_partkey % 5 WHEN 0 THEN 'junk' WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'ok' WHEN 3 THEN 'mixed' END AS status,
  CASE p_partkey % 7 WHEN 0 THEN 'ready' WHEN 1 THEN 'ready' WHEN 2 THEN 'pending' WHEN 3 THEN 'failed' END AS name_status,
  CASE p_partkey % 3 WHEN 0 THEN 'ai_exact' WHEN 1 THEN 'fallback_cleaned' END AS name_source, p_size % 9 AS support,
  CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' is what many people talk about') WHEN 1 THEN concat(p_name, ' Discussion trend detected from recent social posts.') WHEN 2 THEN p_type END AS summary"""
_IDENT = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_SQUASH = lambda x: f"regexp_replace({x}, '[\\s-]+', '', 'g')"
_FACTS = f"""r AS (SELECT {_ROW} FROM part), a AS (SELECT *, {_IDENT('label')} AS ident, {_SQUASH(_IDENT("coalesce(key, '')"))} AS k FROM r),
  b AS (SELECT *, list_filter(string_split(ident, ' '), lambda t: t <> '') AS toks, {_SQUASH('ident')} AS whole FROM a),
  d AS (SELECT *, list_distinct(list_filter(list_transform(toks, lambda t: {_SING}), lambda t: length(t) >= 2 AND NOT list_contains({_LDROP}, t))) AS inf,
    coalesce(summary, '') <> '' AND NOT regexp_matches(summary, '(?i)discussion trend detected from recent social posts\\.?$') AND len(regexp_split_to_array(trim(summary), '\\s+')) >= 6 AS told,
    coalesce(name_status = 'ready', false) AS ready, length(k) >= 4 AND length(whole) = length(k) + 1 AND substr(whole, 2) = k AS lost FROM b),
  e AS (SELECT *, ident = '' OR {_re_any('ident', fixed.LABEL_FRAGMENT_PATTERNS)} OR {_re_any('ident', fixed.LABEL_GENERIC_PATTERNS)} OR len(inf) = 0
    OR (len(toks) = 1 AND list_contains({arr(fixed.LABEL_GENERIC_WORDS + fixed.LABEL_TEMPORAL_WORDS)}, toks[1]))
    OR len(list_filter(toks, lambda t: NOT list_contains({arr(fixed.LABEL_TEMPORAL_WORDS)}, t))) = 0 AS bad FROM d)"""


def rows(spark, sf):
    return st.table(spark, sf, "part").select(F.expr(f"struct({_ROW})").alias("r")).select("r.*")


@query(
    "board_row_filter",
    f"""WITH {_FACTS} SELECT id, coalesce(NOT bad AND coalesce(status, '') <> 'junk' AND NOT lost
      AND NOT (support < 5 AND (coalesce(status, '') = 'insufficient_evidence' OR (NOT ready AND len(toks) = 1)))
      AND (len(toks) >= 2 OR list_has_any(toks, {arr(fixed.STORY_WORDS)}) OR told OR (ready AND name_source IN {merges.TRUSTED_NAME_SOURCES}) OR whole = k), false) AS shown,
      coalesce(len(toks) = 1 AND length(k) >= 2 AND length(whole) = length(k) + 1 AND substr(whole, 2) = k AND NOT (ready OR told), false) AS is_cut_alias FROM e""",
)
def _(spark, sf):
    supported = F.coalesce(F.col("name_status") == "ready", F.lit(False)) | fr.specific_text("summary")
    return rows(spark, sf).select(
        "id", fr.board_row_ok("label", "key", "status", "name_status", "name_source", "support", ["summary"]).alias("shown"),
        fr.cut_alias("label", F.array("key"), supported).alias("is_cut_alias"))
