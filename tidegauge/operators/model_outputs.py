"""Landed model outputs whose rows change shape: parsed as VARIANT, every field checked on its own, bad entries kept with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.basic import Col, c
from tidegauge.session import materialise

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def squeezed(x: Col) -> Column:
    return F.trim(F.regexp_replace(c(x), r"\s+", " "))


def field(v: Column, name: str) -> Column:
    """The field as VARIANT; NULL where ``v`` is no object or has no such field."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def text(v: Column, name: str) -> Column:
    """Text of a field, blanks collapsed; NULL for any other kind of value and for blank texts."""
    f = field(v, name)
    return F.when(kind(f) == "STRING", F.nullif(squeezed(F.try_variant_get(f, "$", "string")), F.lit("")))


def number(v: Column, name: str) -> Column:
    """Number of a field: numbers, numeric texts and truth values; a null or blank is 0; NULL where the field is missing or anything else."""
    f = field(v, name)
    said = F.trim(F.try_variant_get(f, "$", "string"))
    found = F.when(f.isNull(), None).when(kind(f) == "VOID", 0.0).when(kind(f) == "STRING", F.when(said == "", 0.0).when(said.rlike(_NUMBER), said.try_cast("double"))).when(
        kind(f) == "BOOLEAN", F.when(said == "true", 1.0).otherwise(0.0)).when(kind(f).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(f, "$", "double"))
    return F.when(F.abs(found) < float("inf"), found)  # neither infinite nor NaN


def unit(x: Column, default: float) -> Column:
    """0 to 1; values above 1 are percentages."""
    return F.when(x.isNull(), default).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x))))


def hundred(x: Column, default: float) -> Column:
    """0 to 100; values up to 1 are shares."""
    return F.when(x.isNull(), default).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when((x > 0) & (x <= 1), x * 100).otherwise(x))))


def slug(x: Col) -> Column:
    """Letters and digits joined by hyphens; a text without any gets the start of its hash, the same in every run."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(plain == "", F.substring(F.sha2(c(x), 256), 1, 8)).otherwise(plain)


def unique_slugs(bases: Column) -> Column:
    """The bases in order, each taken again as ``base-2``, ``base-3`` and so on, also beside bases that look so themselves."""
    def add(seen, base):
        tried = F.transform(F.sequence(F.lit(2), F.size(seen) + 2), lambda i: F.concat(base, F.lit("-"), i.cast("string")))
        fresh = F.element_at(F.filter(tried, lambda s: ~F.array_contains(seen, s)), 1)
        return F.concat(seen, F.array(F.when(F.array_contains(seen, base), fresh).otherwise(base)))

    return F.aggregate(bases, F.array().cast("array<string>"), add)


def label(x: Column) -> Column:
    """A name without quotes, punctuation and dashes."""
    return squeezed(F.regexp_replace(F.regexp_replace(x, "[‘’“”\"']", ""), "[,:;?!–—…()-]", " "))


def _evidence(candidate: Column) -> Column:
    """Entries with url, title and snippet; others are no evidence."""
    def entry(e):
        url, title, snippet = text(e, "url"), text(e, "title"), text(e, "snippet")
        host = F.nullif(F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")), F.lit(""))
        return F.when(url.isNotNull() & title.isNotNull() & snippet.isNotNull(), F.struct(
            F.substring(F.sha1(F.concat_ws("\n", url, title, snippet)), 1, 16).alias("evidence_key"), url.alias("url"), title.alias("title"), snippet.alias("snippet"),
            F.coalesce(F.lower(text(e, "source_domain")), host, F.lit("unknown")).alias("domain"), text(e, "published_at").try_cast("timestamp").alias("published_at"),
            text(e, "note").alias("note")))

    entries = F.coalesce(F.try_variant_get(candidate, "$.evidence", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(entries, entry), lambda e: e.isNotNull())


def candidates(payloads: DataFrame, key: str, payload: str, archetypes: list[str], limit: int = 24, least_evidence: int = 2) -> DataFrame:
    """One row per candidate of a payload, accepted (``reason`` NULL) or refused, and one row without ``place`` for a payload that holds none.

    Reasons: ``not_json`` (also NULL and empty), ``no_list``, ``empty_list``, ``no_name``, ``no_summary``, ``thin_evidence``.  ``limit`` is the contract
    of the payload: entries beyond it were not asked for.  A missing name is ``Narrative`` and its place.  Keys are unique among the accepted ones of a payload.
    ``archetypes``: allowed ones, the first for any other."""
    v, at = F.col("__v"), F.col("__c")
    parsed = payloads.select(key, F.try_parse_json(F.col(payload)).alias("__v"))
    listed = F.when(kind(field(v, "candidates")).startswith("ARRAY"), F.try_variant_get(v, "$.candidates", "array<variant>"))
    parsed = parsed.withColumn("__list", F.slice(listed, 1, limit)).withColumn(
        "__none", F.when(v.isNull(), "not_json").when(F.col("__list").isNull(), "no_list").when(F.size("__list") == 0, "empty_list"))
    rows = parsed.select(key, "__none", F.posexplode_outer("__list").alias("place", "__c"))
    given = F.when(F.col("__none").isNull(), label(F.coalesce(text(at, "provisional_name"), F.concat(F.lit("Narrative "), (F.col("place") + 1).cast("string")))))
    rows = rows.withColumns({"name": given, "summary": text(at, "summary"), "evidence": _evidence(at), "__key": text(at, "candidate_key")})
    rows = rows.withColumn("reason", F.coalesce("__none", F.when(F.col("name") == "", "no_name").when(F.col("summary").isNull(), "no_summary").when(
        F.size("evidence") < least_evidence, "thin_evidence")))
    said = text(at, "meme_archetype")
    times = F.filter(F.transform("evidence", lambda e: e["published_at"]), lambda t: t.isNotNull())
    domains = F.array_distinct(F.transform("evidence", lambda e: e["domain"]))
    out = rows.select(
        key, "place", "reason", "name", "summary", slug(F.coalesce("__key", "name")).alias("__base"), unit(number(at, "confidence"), 0.5).alias("confidence"),
        hundred(number(at, "meme_score"), 50.0).alias("meme_score"), F.coalesce(text(at, "meme_reason"), F.lit("Model did not explain meme potential.")).alias("meme_reason"),
        F.when(said.isin(*archetypes), said).otherwise(archetypes[0]).alias("meme_archetype"), hundred(number(at, "visual_score"), 60.0).alias("visual_score"),
        hundred(number(at, "dryness_score"), 30.0).alias("dryness_score"), F.size("evidence").alias("evidence_count"), F.size(domains).alias("source_count"),
        F.array_min(times).alias("first_seen_at"), F.array_max(times).alias("last_seen_at"), domains.alias("domains"), "evidence")
    out = materialise(out, "model-outputs")  # read twice below, parsed once
    # at most ``limit`` keys of a payload meet in one row
    named = out.where("reason IS NULL").groupBy(F.col(key).alias("__id")).agg(F.sort_array(F.collect_list(F.struct("place", "__base"))).alias("k"))
    named = named.select("__id", F.inline(F.arrays_zip(F.col("k.place").alias("__place"), unique_slugs(F.col("k.__base")).alias("candidate_key"))))
    return out.join(named, (F.col(key) == F.col("__id")) & (F.col("place") == F.col("__place")), "left").drop("__id", "__place", "__base")
