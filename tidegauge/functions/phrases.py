"""Phrase dictionaries: which of many phrases a text holds, in one pass over its words, and the attention profile built on them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import fixed
from tidegauge.functions.basic import Col, barrier, c, one_of
from tidegauge.functions.text import collapse_ws


class PhraseDictionary:
    """Groups of phrases.  A phrase that is one word (``pattern``) counts where it is a word of the text; any other, and those named ``anywhere``, wherever
    its characters stand.

    Words are looked up in one hash set.  Phrases with a space are found by the characters around their first space: every pair of
    neighbouring words of the text gives one key, and only phrases whose key occurs are searched in the text.  So the cost per text grows with its words,
    not with the number of phrases."""

    def __init__(self, groups: dict[str, Iterable[str]], pattern: str = fixed.PROFILE_WORD_PATTERN, anywhere: Iterable[str] = ()):
        self.groups = {g: sorted({" ".join(p.lower().split()) for p in phrases} - {""}) for g, phrases in groups.items()}
        self.pattern = pattern
        every = sorted({p for phrases in self.groups.values() for p in phrases})
        self.words = [p for p in every if re.fullmatch(pattern, p) and p not in set(anywhere)]
        longer = [p for p in every if p not in set(self.words)]
        self.spaced, self.solid = [p for p in longer if " " in p], [p for p in longer if " " not in p]
        # characters of a key on either side of the space: as many as every phrase has
        self.left = min([2, *(len(p.split(" ")[0]) for p in self.spaced)])
        self.right = min([2, *(len(p.split(" ")[1]) for p in self.spaced)])

    def _key(self, phrase: str) -> str:
        first, second = phrase.split(" ")[:2]
        return f"{first[-self.left:]} {second[:self.right]}"

    def staged(self, df: DataFrame, text: Col, out: str = "found") -> DataFrame:
        """df with ``out``: the distinct phrases of the dictionary that the text holds."""
        has = lambda p: F.contains("__normal", p)
        df = barrier(df.withColumn("__normal", F.lower(collapse_ws(F.coalesce(c(text), F.lit(""))))))
        tokens = F.regexp_extract_all("__normal", F.lit(self.pattern), F.lit(0))
        found = [F.array_distinct(F.filter(tokens, lambda t: one_of(t, self.words)))] if self.words else []
        if self.solid:
            found.append(F.filter(F.array(*map(F.lit, self.solid)), has))
        if self.spaced:
            parts = F.split("__normal", " ")
            keys = F.zip_with(parts, F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.concat(F.substring(a, -self.left, self.left), F.lit(" "), F.substring(b, 1, self.right)))
            df = barrier(df.withColumn("__keys", F.array_distinct(F.filter(keys, lambda k: one_of(k, [self._key(p) for p in self.spaced])))))
            table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(self._key(p)).alias("k")) for p in self.spaced])
            near = F.transform(F.filter(table, lambda x: F.array_contains("__keys", x["k"]) & has(x["p"])), lambda x: x["p"])
            found.append(F.when(F.size("__keys") > 0, near).otherwise(F.array().cast("array<string>")))
        return df.withColumn(out, F.concat(*found)).drop("__normal", "__keys")

    def count(self, group: str, found: Col = "found") -> Column:
        """How many phrases of a group were found."""
        return F.size(F.filter(c(found), lambda p: one_of(p, self.groups[group]))) if self.groups[group] else F.lit(0)


def _split(groups: dict[str, str]) -> dict[str, list[str]]:
    return {g: phrases.split(", ") for g, phrases in groups.items()}


PROFILE = PhraseDictionary(_split(fixed.PROFILE_PREFERRED) | _split(fixed.PROFILE_DEPRIORITISED))


def attention_profile(df: DataFrame, texts: list[str], raw_category: Col | None = None) -> DataFrame:
    """df with hits (map of bucket to number of its phrases), attention_score, inferred_category, bucket, tokenizable_narrative, memeified_politics.

    The texts are read as one.  A stated category that is known wins over the one inferred, which is the preferred bucket with most hits, the last
    one by name among equals; without hits there is none."""
    whole = F.concat_ws(" ", *[F.nullif(collapse_ws(t), F.lit("")) for t in texts])
    staged = barrier(PROFILE.staged(df.withColumn("__text", whole), "__text", "__found").drop("__text"))
    hits = barrier(staged.withColumn("hits", F.struct(*[PROFILE.count(g, "__found").alias(g) for g in PROFILE.groups])).drop("__found"))
    n = lambda g: F.col(f"hits.{g}")
    token = F.greatest(*[n(g) for g in fixed.PROFILE_TOKENIZABLE]) > 0
    politics = (n("memeified_politics") > 0) | (n("geopolitics_macro") > 0) & (n("meme_distribution") > 0)
    score = sum((n(g) * w for g, w in fixed.PROFILE_WEIGHTS.items()), F.lit(0.0))
    score += F.when(token, 10.0).otherwise(-12.0)
    score -= F.when((n("meme_distribution") == 0) & (n("crypto_spillover") == 0), 8.0).otherwise(0.0)
    score -= F.when((n("geopolitics_macro") > 0) & ~politics, 18.0).otherwise(0.0)
    top = F.array_max(F.array(*[F.struct(n(g).alias("n"), F.lit(g).alias("g")) for g in fixed.PROFILE_PREFERRED]))
    inferred = F.when(top["n"] > 0, F.translate(top["g"], "_", " "))
    if raw_category is not None:
        stated = F.regexp_replace(F.lower(collapse_ws(c(raw_category))), "_", " ")
        inferred = F.when(one_of(stated, fixed.PROFILE_BUCKETS), stated).otherwise(inferred)
    out = barrier(hits.withColumn("inferred_category", inferred).withColumn("attention_score", score).withColumn("tokenizable_narrative", token).withColumn("memeified_politics", politics))
    by_category = F.create_map(*[F.lit(x) for pair in fixed.PROFILE_BUCKETS.items() for x in pair])
    return out.withColumn("bucket", by_category[F.col("inferred_category")])


__all__ = ["PROFILE", "PhraseDictionary", "attention_profile"]
