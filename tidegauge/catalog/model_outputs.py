"""Model outputs in the shape they land in: parts as runs, some payloads cut off or without a list."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import big, r6, ts
from tidegauge.operators import model_outputs as mo
from tidegauge.plans import standins as st
from tidegauge.session import spread

_E1 = """'{"url":"https://www.Shop', p_size, '.example/', p_partkey, '","title":"t","snippet":"', p_brand, '","published_at":"2024-01-0', 1 + p_partkey % 9, 'T00:00:00Z"}'"""
_E2 = """'{"url":"no url","title":" t2 ","snippet":"s","source_domain":"B.org"}'"""
_CANDIDATES = f"""concat('[{{"provisional_name":"', p_name, '","summary":" ', p_type, '   x","confidence":', p_size, ',"meme_score":"', p_size, '","meme_archetype":"pun","evidence":[', {_E1}, ',', {_E2}, ',7]}},',
  '{{"provisional_name":"', p_name, '!","summary":"y","meme_score":null,"evidence":[', {_E1}, CASE WHEN p_partkey % 2 = 0 THEN concat(',', {_E2}) ELSE ',{{"url":"x"}}' END, ']}},',
  '{{"summary":"', CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE 'z' END, '","visual_score":true,"evidence":[', {_E1}, ',', {_E1}, ']}}]')"""
_PAYLOAD = f"""concat('{{"candidates":', CASE p_partkey % 9 WHEN 0 THEN '{{}}' WHEN 1 THEN '[]' ELSE {_CANDIDATES} END, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '}}' END)""".replace("{{", "{").replace("}}", "}")
_LABEL = "trim(regexp_replace(regexp_replace(p_name, '[,:;?!()-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SLUG = f"regexp_replace(regexp_replace(lower({_LABEL}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "model_candidates",
    f"""WITH p AS (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'not_json' WHEN p_partkey % 9 = 0 THEN 'no_list' WHEN p_partkey % 9 = 1 THEN 'empty_list' END AS none, {_LABEL} AS label, {_SLUG} AS slug,
      TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (p_partkey % 9) AS seen FROM part),
    c AS (SELECT p_partkey AS id, NULL AS place, none AS reason, NULL AS name, NULL AS candidate_key, 0.5 AS confidence, 50.0 AS meme_score, 60.0 AS visual_score, 'joke' AS meme_archetype, 0 AS evidence_count, 0 AS source_count, NULL::TIMESTAMP AS seen FROM p WHERE none IS NOT NULL
      UNION ALL SELECT p_partkey, 0, NULL, label, slug, CASE WHEN p_size > 1 THEN p_size / 100.0 ELSE p_size END, CASE WHEN p_size = 1 THEN 100 ELSE p_size END, 60, 'pun', 2, 2, seen FROM p WHERE none IS NULL
      UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 2 = 1 THEN 'thin_evidence' END, label, CASE WHEN p_partkey % 2 = 0 THEN slug || '-2' END, 0.5, 0, 60, 'joke', 2 - p_partkey % 2, 2 - p_partkey % 2, seen FROM p WHERE none IS NULL
      UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 3 = 0 THEN 'no_summary' END, 'Narrative 3', CASE WHEN p_partkey % 3 > 0 THEN 'narrative-3' END, 0.5, 50, 100, 'joke', 2, 1, seen FROM p WHERE none IS NULL)
    SELECT id, {big('place')} AS place, reason, name, candidate_key, {r6('confidence')} AS confidence, {r6('meme_score')} AS meme_score, {r6('visual_score')} AS visual_score, meme_archetype,
      {big('evidence_count')} AS evidence_count, {big('source_count')} AS source_count, {ts('seen')} AS first_seen_at FROM c""",
)
def _(spark, sf):
    landed = spread(st.table(spark, sf, "part")).select(F.col("p_partkey").alias("id"), F.expr(_PAYLOAD).alias("payload"))
    return mo.candidates(landed, "id", "payload", ["joke", "pun"]).select(
        "id", "place", "reason", "name", "candidate_key", "confidence", "meme_score", "visual_score", "meme_archetype", "evidence_count", "source_count", "first_seen_at")
