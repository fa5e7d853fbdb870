"""Attention profiles of texts by phrase dictionaries."""

from pyspark.sql import functions as F

from tidegauge import fixed
from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import arr, big
from tidegauge.functions import phrases as ph
from tidegauge.plans import standins as st

# documents as posts with a remark that follows the row, and the category that some of them state
_REMARK = """concat(coalesce(text, ''), CASE doc_id % 12 WHEN 0 THEN ' Viral clip of a frog' WHEN 1 THEN ' rate  cut and tariffs, a Quote Tweet War' WHEN 2 THEN ' meme coin on pump.fun'
 WHEN 3 THEN ' dubai agents at x.com' WHEN 4 THEN ' court filing after the attack' WHEN 5 THEN ' board meeting on quarterly earnings' WHEN 6 THEN ' one-liner k-pop fan edits'
 WHEN 7 THEN ' spot bitcoin etf inflows' WHEN 8 THEN ' Patch Notes nerf the boss fight' ELSE '' END)"""
_CATEGORY = "CASE doc_id % 7 WHEN 0 THEN 'AI_Tech' WHEN 1 THEN 'unknown' WHEN 2 THEN ' gaming ' END"
_ALL = {g: ph.PROFILE.groups[g] for g in ph.PROFILE.groups}


def _hits(group: str) -> str:
    words, others = [p for p in _ALL[group] if p in ph.PROFILE.words], [p for p in _ALL[group] if p not in ph.PROFILE.words]
    return f"len(list_intersect(tok, {arr(words)}))" + "".join(f" + CAST(contains(t, '{p}') AS INT)" for p in others) if words else " + ".join(f"CAST(contains(t, '{p}') AS INT)" for p in others)


_PREFERRED, _TOKEN = list(fixed.PROFILE_PREFERRED), " OR ".join(f"{g} > 0" for g in fixed.PROFILE_TOKENIZABLE)
_BUCKET = "CASE cat " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PROFILE_BUCKETS.items()) + " END"


@query(
    "text_attention_profile",
    f"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(trim({_CATEGORY})), '_', ' ', 'g')) AS stated, trim(regexp_replace(lower({_REMARK}), '\\s+', ' ', 'g')) AS t FROM documents),
    k AS (SELECT *, list_distinct(regexp_extract_all(t, '{fixed.PROFILE_WORD_PATTERN.replace("'", "''")}')) AS tok FROM n),
    h AS (SELECT doc_id, stated, {', '.join(f'{_hits(g)} AS {g}' for g in _ALL)} FROM k),
    p AS (SELECT *, ({_TOKEN}) AS token, memeified_politics > 0 OR (geopolitics_macro > 0 AND meme_distribution > 0) AS politics,
      list_max([{', '.join(f"{{'n': {g}, 'g': '{g}'}}" for g in _PREFERRED)}]) AS top FROM h),
    q AS (SELECT *, CASE WHEN stated IN ({', '.join(f"'{x}'" for x in fixed.PROFILE_BUCKETS)}) THEN stated WHEN top.n > 0 THEN replace(top.g, '_', ' ') END AS cat FROM p)
    SELECT doc_id, {big(' + '.join(_ALL))} AS n_hits, cat AS inferred_category, {_BUCKET} AS bucket, token AS tokenizable_narrative, politics AS memeified_politics,
      CAST({' + '.join(f'{g} * ({w})' for g, w in fixed.PROFILE_WEIGHTS.items())} + CASE WHEN token THEN 10 ELSE -12 END - CASE WHEN meme_distribution = 0 AND crypto_spillover = 0 THEN 8 ELSE 0 END
        - CASE WHEN geopolitics_macro > 0 AND NOT politics THEN 18 ELSE 0 END AS DOUBLE) AS attention_score FROM q""".replace("\\\\", "\\"),
)
def _(spark, sf):
    posts = st.table(spark, sf, "documents").selectExpr("doc_id", f"{_REMARK} AS text", f"{_CATEGORY} AS category")
    out = ph.attention_profile(posts, ["text"], "category")
    return out.select("doc_id", sum((F.col(f"hits.{g}") for g in _ALL), F.lit(0)).alias("n_hits"), "inferred_category", "bucket", "tokenizable_narrative", "memeified_politics", "attention_score")
