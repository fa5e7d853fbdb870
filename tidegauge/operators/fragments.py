"""Cut-off names: board rows that are only fragments, aliases without their first letter, and names contained in other names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import fixed
from tidegauge.functions import labels as lb
from tidegauge.functions.basic import Col, c, one_of
from tidegauge.operators.merges import TRUSTED_NAME_SOURCES
from tidegauge.session import materialise

LOW_SUPPORT = 5


def specific_text(x: Col) -> Column:
    """Six words or more that are not one of the stock summaries; null is no text."""
    text = F.trim(F.coalesce(c(x), F.lit("")))
    stock = F.lit(False)
    for pattern in fixed.EMPTY_SUMMARY_PATTERNS:
        stock = stock | text.rlike(f"(?i){pattern}")
    return (text != "") & ~stock & (F.size(F.split(text, r"\s+")) >= 6)


def lost_first_letter(whole: Col, cut: Col, least: int) -> Column:
    """``cut`` (of at least so many characters) is ``whole`` without its first letter; both compact, null never."""
    return F.coalesce((F.length(c(cut)) >= least) & (F.length(c(whole)) == F.length(c(cut)) + 1) & (F.substring(c(whole), 2, 1 << 30) == c(cut)), F.lit(False))


def board_row_ok(label: Col, key: Col, status: Col, name_status: Col, name_source: Col, support: Col, summaries: list[Col]) -> Column:
    """Rows that a narrative board shows: a label that says something, and enough behind it.  Nulls count as unknown and as no support."""
    toks, whole = lb.label_tokens(label), lb.compact_identity(label)
    state = F.coalesce(c(status), F.lit(""))
    ready = F.coalesce(c(name_status) == "ready", F.lit(False))
    thin = F.coalesce(c(support), F.lit(0)) < LOW_SUPPORT
    trusted = ready & F.coalesce(c(name_source).isin(*TRUSTED_NAME_SOURCES), F.lit(False))
    bad = lb.is_fragment_topic(label) | lb.is_generic_topic(label) | lb.is_temporal_topic(label) | (state == "junk") | lost_first_letter(
        whole, lb.compact_identity(F.coalesce(c(key), F.lit(""))), 4)
    weak = thin & ((state == "insufficient_evidence") | (~ready & (F.size(toks) == 1)))
    told = F.lit(False)
    for text in summaries:
        told = told | specific_text(text)
    says = (F.size(toks) >= 2) | F.exists(toks, lambda t: one_of(t, fixed.STORY_WORDS)) | told | trusted | (whole == lb.compact_identity(F.coalesce(c(key), F.lit(""))))
    return F.coalesce(~bad & ~weak & says, F.lit(False))


def cut_alias(label: Col, raw_keys: Col, supported: Column) -> Column:
    """A one-word label that some raw key of its topic shows to be that key with a stray first letter; narrative support keeps it."""
    whole = lb.compact_identity(label)
    alias = F.exists(F.coalesce(c(raw_keys), F.array().cast("array<string>")), lambda k: lost_first_letter(whole, lb.compact_identity(F.coalesce(k, F.lit(""))), 2))
    return F.coalesce((F.size(lb.label_tokens(label)) == 1) & alias & ~supported, F.lit(False))


def pieces(names: DataFrame, name: str, shorts: DataFrame, short: str, least: int = 4) -> DataFrame:
    """names with ``piece``: the parts of a name, shorter than it, that have the first ``least`` characters and the length of one of the shorts.

    What a name gives depends on its own length and on how many lengths there are, never on how many names share its letters."""
    sizes = shorts.where(F.length(short) >= least).groupBy(F.substring(short, 1, least).alias("__gram")).agg(F.collect_set(F.length(short)).alias("__sizes"))
    ends = F.transform(F.sequence(F.lit(1), F.length(name) - least + 1), lambda i: F.substr(F.col(name), i, F.length(name)))
    places = names.where(F.length(name) > least).withColumn("__rest", F.explode(ends)).withColumn("__gram", F.substring("__rest", 1, least))
    fits = F.filter("__sizes", lambda n: (n <= F.length("__rest")) & (n < F.length(name)))
    return places.join(sizes, "__gram").select(*names.columns, F.explode(F.transform(fits, lambda n: F.substr(F.col("__rest"), F.lit(1), n))).alias("piece"))


def contained_names(names: DataFrame, name: str, least: int = 4) -> DataFrame:
    """Exact pairs ``(short, long)`` of different names, the first of at least ``least`` characters and contained in the second.

    A name meets others as the equal of one of their parts, so the pairs that are found are the only ones made.  Null and shorter names take no
    part; equal names are one."""
    every = materialise(names.select(F.col(name).alias("long")).where(F.length("long") >= least).distinct(), "names")
    shorts = every.withColumnRenamed("long", "short")
    found = pieces(every, "long", shorts, "short", least)
    return found.join(shorts, F.col("piece") == F.col("short")).select("short", "long").distinct()


def drop_fragments(rows: DataFrame, label: str, support: str, least: int = 4) -> DataFrame:
    """Rows whose one-word label is no part of a longer label with at least its support.

    Rows without a label stay; a null support is 0; rows of one compact label stand and fall together, by their largest support.  Of all labels that
    hold a part only the largest support counts, so parts are summed up before they meet the labels.  The rows are written once and read three times."""
    one = F.size(lb.label_tokens(label)) == 1
    keyed = materialise(rows.withColumns({"__k": lb.compact_identity(label), "__one": one}), "labels")
    weight = keyed.where(F.col("__k") != "").groupBy("__k").agg(
        F.max(F.coalesce(F.col(support), F.lit(0))).alias("__w"), F.max("__one").alias("__one"))
    single = weight.where("__one").select(F.col("__k").alias("short"), F.col("__w").alias("ws"))
    holders = pieces(weight.select("__k", "__w"), "__k", single, "short", least).groupBy("piece").agg(F.max("__w").alias("wl"))
    gone = single.join(holders, F.col("short") == F.col("piece")).where("wl >= ws").select(F.col("short").alias("__gone"))
    return keyed.join(gone, F.col("__one") & (F.col("__k") == F.col("__gone")), "left_anti").drop("__k", "__one")
