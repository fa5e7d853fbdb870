"""Evidence between topics and assets: bounded search for shared words, supporting posts, name similarity, thematic fit, link scores and choice."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge import fixed
from tidegauge.functions.basic import Col, barrier, c, clamp
from tidegauge.functions.phrases import PhraseDictionary
from tidegauge.operators.windows import top_n
from tidegauge.session import materialise


# -- shared words -------------------------------------------------------------------------------


def lexical(shared: Column, na: Column, nb: Column) -> Column:
    """Overlap with the smaller set (0.6) and Jaccard similarity (0.4), in six digits."""
    return F.round(shared / F.least(na, nb) * 0.6 + shared / (na + nb - shared) * 0.4, 6)


def top_overlaps(topics: DataFrame, assets: DataFrame, topic: str, topic_words: Col, asset: str, asset_words: Col, k: int = 5, floor: float = 0.25) -> DataFrame:
    """(topic, asset, shared, lexical, place): the k assets of highest lexical score of every topic, exactly, without forming all pairs that share a word.

    A topic's words are taken from the rarest among assets to the most frequent, 1, 1, 2, 4 ... at a time.  After p of its n words any asset not yet met shares at most
    n - p, which bounds its score; a topic stops when k of its assets reach that bound, or when the bound is below the floor.  Of the last word
    alone, only the k smallest assets that hold it can be among the best (equal scores go to the smaller set, then to the smaller id), so a topic's most frequent word costs
    k rows, however many assets hold it.  Assets of equal words have equal scores, so the k smallest of every set of words stand for all."""
    t = materialise(topics.select(c(topic).alias("t"), F.array_distinct(c(topic_words)).alias("tw")).where(F.size("tw") > 0), "topic-words")
    words = assets.repartition(F.col(asset)).select(c(asset).alias("a"), F.array_sort(F.array_distinct(c(asset_words))).alias("aw"))
    a = materialise(top_n(words.where(F.size("aw") > 0), ["aw"], [F.col("a").asc()], k), "asset-words")
    postings = a.select("a", F.size("aw").alias("nb"), F.explode("aw").alias("w"))
    frequency = postings.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    least = a.agg(F.min(F.size("aw"))).first()[0]
    words = t.select("t", F.explode("tw").alias("w")).join(frequency, "w")  # words that no asset holds cannot be shared
    order = words.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    active = materialise(t.join(order, "t").select("t", "tw", "o"), "topic-order")
    shortlist = top_n(postings, ["w"], [F.col("nb").asc(), F.col("a").asc()], k).select("w", "a")
    best = [F.col("lexical").desc(), F.col("shared").desc(), F.col("nb").asc(), F.col("a").asc()]
    top, done, step = None, 0, 1
    while True:
        last = F.size("o")
        here = active.select("t", "tw", last.alias("n"), F.posexplode(F.slice("o", done + 1, step)).alias("i", "x")).select(
            "t", "tw", (F.col("i") + done + 1 == F.col("n")).alias("final"), F.col("x.w").alias("w"))
        pairs = here.where("NOT final").join(postings.select("w", "a"), "w").select("t", "a").unionByName(here.where("final").join(shortlist, "w").select("t", "a")).distinct()
        met = pairs.join(active.select("t", "tw"), "t").join(a, "a")
        na, nb, shared = F.size("tw"), F.size("aw"), F.size(F.array_intersect("tw", "aw"))
        scored = met.select("t", "a", nb.alias("nb"), shared.cast("long").alias("shared"), lexical(shared, na, nb).alias("lexical"))
        if top is not None:
            scored = scored.unionByName(top).distinct()
        top = materialise(top_n(scored, ["t"], best, k), "overlaps")
        done, step = done + step, max(1, done)
        weakest = top.groupBy("t").agg(F.when(F.count(F.lit(1)) >= k, F.min("lexical")).alias("weakest"))
        rest = F.size("o") - done
        size = F.greatest(F.lit(least), rest)
        bound = lexical(rest, F.size("tw"), size)
        active = materialise(active.join(weakest, "t", "left").where((rest > 0) & (bound >= floor) & (F.col("weakest").isNull() | (bound >= F.col("weakest")))).drop("weakest"), "topic-order")
        if active.isEmpty():
            break
    kept = top.where(F.col("lexical") >= floor)
    out = top_n(kept, ["t"], best, k, "place")
    return out.select(F.col("t").alias(topic), F.col("a").alias(asset), "shared", "lexical", "place")


# -- supporting posts ---------------------------------------------------------------------------


def compact(x: Col) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", "")


def containments(texts: DataFrame, terms: DataFrame, text_id: str, text: str, term_id: str, term: str, gram: int = 3) -> DataFrame:
    """(text_id, term_id) of every text that holds a term as a run of characters.

    A place of a text counts when some term begins like it (with its first ``gram`` characters, or as a whole if it is shorter).  Such places are cut to the
    lengths of the terms of that beginning, and cuts meet terms as equals: a text costs rows by its own length, however many texts share its runs."""
    t = materialise(terms.select(c(term_id).alias("b"), c(term).alias("term")).where(F.length("term") > 0), "terms")
    heads = materialise(t.groupBy(F.substring("term", 1, gram).alias("g")).agg(F.array_sort(F.collect_set(F.length("term"))).alias("sizes")), "term-heads")
    shapes = heads.select(F.length("g").alias("n"), F.array_max("sizes").alias("most")).groupBy("n").agg(F.max("most")).collect()  # at most one row for each length up to gram
    if not shapes:
        return texts.select(c(text_id)).crossJoin(t.select(F.col("b").alias(term_id))).limit(0)
    longest = max(most for _, most in shapes)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.lit(longest))))
    places = texts.select(c(text_id).alias("a"), c(text).alias("text")).where(F.length("text") > 0).select("a", F.explode(runs).alias("run"))
    begun = places.select("a", "run", F.explode(F.array(*[F.substring("run", 1, n) for n, _ in shapes])).alias("g")).join(heads, "g")
    cuts = begun.select("a", "run", F.explode("sizes").alias("n")).where(F.length("run") >= F.col("n")).select("a", F.expr("substring(run, 1, n)").alias("term"))
    return cuts.join(t, "term").select(F.col("a").alias(text_id), F.col("b").alias(term_id)).distinct()


def support(posts: DataFrame, assets: DataFrame, topic: str, asset: str) -> DataFrame:
    """(topic, asset, posts, interactions): how many of a topic's posts name an asset, and the weight of those posts.

    posts: post (one row each), topic, text, cashtags (upper case), weight.  assets: symbol, name.  A post names an asset by its cashtag, or when the letters and digits
    of its text hold those of the symbol or of the name.  Posts of one topic with the same letters and tags count as one class, read once."""
    classes = posts.groupBy(c(topic).alias("t"), compact("text").alias("text"), "cashtags").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "post-classes")
    by_tag = classes.select("class", F.explode("cashtags").alias("symbol")).join(assets.select(c(asset).alias("asset"), F.upper("symbol").alias("symbol")), "symbol").select("class", "asset")
    terms = assets.select(c(asset).alias("asset"), F.explode(F.array_distinct(F.array(compact("symbol"), compact("name")))).alias("term")).where("term <> ''")
    different = terms.select("term").distinct()
    held = containments(classes, different.withColumn("term_key", F.col("term")), "class", "text", "term_key", "term")
    by_text = held.join(terms, held.term_key == terms.term).select("class", "asset")
    named = by_tag.unionByName(by_text).distinct().join(classes.select("class", "t", "n", "w"), "class")
    return named.groupBy("t", "asset").agg(F.sum("n").alias("posts"), F.sum("w").alias("interactions")).select(
        F.col("t").alias(topic), F.col("asset").alias(asset), "posts", "interactions")


# -- names ----------------------------------------------------------------------------------------


def partial_overlap(a: Col, b: Col) -> Column:
    """How far one compact name is part of the other: the share it covers, or a common beginning of four characters; equal names and names under four: 0."""
    a, b = compact(a), compact(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = F.length(short) / F.greatest(F.length(long), F.lit(1))
    same_start = F.substring(short, 1, 4) == F.substring(long, 1, 4)
    return F.when((a == b) | (F.length(short) < 4), 0.0).when(F.contains(long, short), inside).when(same_start, 0.55 + 4 * 0.08).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def _matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def name_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity", least: float = 0.0) -> DataFrame:
    """pairs with the similarity of two names: twice the characters in longest matching blocks over all characters, or ``partial_overlap`` if higher.

    The shares of lengths and of common characters bound the ratio, so pairs that cannot reach ``least`` are settled (0, or their partial overlap) without
    blocks, and each different pair of names is compared once."""
    names = barrier(pairs.select(compact(a).alias("x"), compact(b).alias("y")).distinct().where("x <> '' AND y <> ''"))
    total = F.length("x") + F.length("y")
    chars = F.array_distinct(F.split("x", ""))
    times = lambda text, ch: F.length(text) - F.length(F.replace(text, ch, F.lit("")))
    common = F.aggregate(chars, F.lit(0), lambda n, ch: n + F.least(times(F.col("x"), ch), times(F.col("y"), ch)))
    bound = F.least(2.0 * F.least(F.length("x"), F.length("y")) / total, 2.0 * common / total)
    bounded = barrier(names.withColumn("bound", bound))
    near = bounded.where(F.col("bound") >= least).select("x", "y", _matching_blocks("x", "y").alias("ratio"))
    scored = near.select("x", "y", F.greatest("ratio", partial_overlap("x", "y")).alias("s")).unionByName(
        bounded.where(F.col("bound") < least).select("x", "y", partial_overlap("x", "y").alias("s")))
    keyed = pairs.withColumn("__x", compact(a)).withColumn("__y", compact(b))
    joined = keyed.join(scored, (keyed["__x"] == scored["x"]) & (keyed["__y"] == scored["y"]), "left")
    return joined.select(*pairs.columns, F.coalesce("s", F.lit(0.0)).alias(out))


# -- thematic fit -----------------------------------------------------------------------------------


def plain_text(x: Col) -> Column:
    """Lower case without URLs and marks."""
    bare = F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9$#\s'_-]+", " "), r"\s+", " "))


def _terms(phrases: str) -> tuple[list[str], list[str]]:
    """Keywords as their words; and those among them that are searched anywhere, as the keyword is not one word."""
    pairs = [(p, " ".join(re.findall(fixed.PROFILE_WORD_PATTERN, re.sub(r"[^a-z0-9$#\s'_-]+", " ", p)))) for p in phrases.split(", ")]
    return [w for _, w in pairs if w], [w for p, w in pairs if w and w != p]


_LISTS = {"style": fixed.ASSET_STYLE_TERMS, "utility": fixed.ASSET_UTILITY_TERMS, **{f"culture_{g}": p for g, p in fixed.ASSET_CULTURE_TERMS.items()}}
THEMES = PhraseDictionary({g: _terms(p)[0] for g, p in _LISTS.items()}, anywhere=[x for p in _LISTS.values() for x in _terms(p)[1]])
SOCIAL = PhraseDictionary({"social": _terms(fixed.ASSET_SOCIAL_TERMS)[0]}, anywhere=_terms(fixed.ASSET_SOCIAL_TERMS)[1])


def thematic_fit(assets: DataFrame, text: str, name: str, sources: str, takeover: str, socials: str, topics: str) -> DataFrame:
    """assets with ``culture_hits`` and ``fit`` (0 to 100): style, culture and source of an asset, less what speaks of a utility.

    ``sources`` and ``topics`` are arrays (where it was found, topics it matched), ``socials`` the text of its links, ``takeover`` a flag."""
    df = assets.withColumn("__t", plain_text(text)).withColumn("__n", plain_text(name)).withColumn("__s", plain_text(socials))
    for dictionary, column, out in ((THEMES, "__t", "__ft"), (THEMES, "__n", "__fn"), (SOCIAL, "__s", "__fs")):
        df = barrier(dictionary.staged(df, column, out))
    culture = sum((THEMES.count(f"culture_{g}", "__ft") for g in fixed.ASSET_CULTURE_TERMS), F.lit(0))
    df = barrier(df.withColumn("culture_hits", culture).withColumn("__style", THEMES.count("style", "__ft")).withColumn("__own", THEMES.count("style", "__fn"))
                 .withColumn("__utility", THEMES.count("utility", "__ft")).withColumn("__social", SOCIAL.count("social", "__fs")))
    from_source = lambda s: F.array_contains(sources, s)
    bonus = sum((F.when(from_source(s) | c(takeover) if s.startswith("dex_community") else from_source(s), v).otherwise(0.0) for s, v in fixed.ASSET_SOURCE_BONUS.items()), F.lit(0.0))
    bonus += F.least(F.lit(6.0), F.col("__social") * 1.5) + F.least(F.lit(6.0), F.size(topics) * 1.5)
    no_style = (F.col("__style") == 0) & (F.col("__own") == 0)
    penalty = F.col("__utility") * 7.5 + F.when((F.col("__utility") >= 2) & no_style, 10.0).otherwise(0.0)
    fit = F.col("__style") * 8.0 + F.col("__own") * 4.0 + F.least(F.lit(18.0), F.col("culture_hits") * 1.8) + bonus - penalty
    fit = F.when(no_style & (F.col("culture_hits") == 0), F.least(fit, F.when(c(takeover), 16.0).otherwise(10.0))).otherwise(fit)
    return df.withColumn("fit", F.round(clamp(fit, 0.0, 100.0), 3)).drop("__t", "__n", "__s", "__ft", "__fn", "__fs", "__style", "__own", "__utility", "__social")


# -- scores and choice ------------------------------------------------------------------------------


def link_scores(df: DataFrame) -> DataFrame:
    """Evidence counts of a topic and an asset to lexical, mention, timing, culture, evidence and narrative score, match type and link score.

    Counts: exact, phrase, entity, alias, partial, seed, generic (shared terms of each kind); longest_exact (characters); name_similarity, symbol_similarity; posts,
    interactions; matched (the asset was found through this topic); hours (since the topic was seen, null: unknown); volume_1h, volume_24h; culture_hits of the
    topic's category; asset_political, topic_political."""
    n = {x: F.least(F.col(x), F.lit(most)) for x, most in (("exact", 5), ("phrase", 4), ("entity", 4), ("alias", 3), ("partial", 5), ("seed", 4), ("generic", 5))}
    broad = (F.col("exact") == 0) & (F.col("phrase") == 0) & (F.col("entity") == 0) & (F.col("alias") == 0)
    matched = F.col("matched") & ~broad
    nearest = F.greatest("name_similarity", "symbol_similarity")
    weight = F.log1p(F.greatest(F.lit(0.0), F.col("interactions")))
    named = F.col("posts") > 0
    penalty = F.least(F.lit(14.0), n["generic"] * 2.6) + F.when(broad & (n["generic"] > 0), F.least(F.lit(10.0), n["generic"] * 1.4)).otherwise(0.0)
    words = F.least(F.lit(68.0), n["exact"] * 11.0 + n["phrase"] * 13.0 + n["entity"] * 16.0 + n["alias"] * 10.0 + n["partial"] * 4.0 + n["seed"] * 2.0 + nearest * 16.0)
    words += F.when(matched, 8.0).otherwise(0.0) + F.when(F.col("name_similarity") >= 0.82, 8.0).otherwise(0.0) + F.when(F.col("symbol_similarity") >= 0.86, 6.0).otherwise(0.0)
    mention = F.least(F.lit(34.0), F.col("posts") * 6.5 + weight * 4.5)
    activity = F.when(F.col("volume_24h") > 0, F.col("volume_1h") / F.col("volume_24h")).otherwise(0.0)
    timing = F.when(F.col("hours") <= 6, 8.0).when(F.col("hours") <= 24, 4.0).otherwise(0.0) + F.least(F.lit(12.0), F.greatest(F.lit(0.0), activity * 90.0))
    culture = F.least(F.lit(6.0), F.col("culture_hits") * 1.4) + F.when(matched, 6.0).otherwise(0.0) - F.when(F.col("asset_political") & ~F.col("topic_political"), 6.0).otherwise(0.0)
    evidence = F.when(matched, 18.0).otherwise(0.0) + F.least(F.lit(30.0), n["phrase"] * 16.0) + F.least(F.lit(30.0), n["entity"] * 18.0) + F.least(F.lit(18.0), n["alias"] * 11.0)
    evidence += F.least(F.lit(20.0), n["exact"] * 8.0) + F.when(named & ~broad, F.least(F.lit(10.0), F.col("posts") * 3.0)).otherwise(0.0)
    evidence = clamp(F.when(broad, F.least(evidence, F.lit(22.0))).otherwise(evidence), 0.0, 100.0)
    story = n["alias"] * 12.0 + n["exact"] * 8.0 + n["partial"] * 5.0 + n["seed"] * 3.5 + F.least(F.lit(10.0), F.col("posts") * 3.5) + F.least(F.lit(8.0), weight * 2.2) + F.least(F.lit(8.0), nearest * 8.0)
    story += F.when(matched, 8.0).otherwise(0.0)
    story = clamp(F.when(broad, F.least(story, F.lit(34.0))).otherwise(story), 0.0, 100.0)
    df = barrier(df.withColumn("lexical_score", words).withColumn("mention_score", mention).withColumn("timing_score", timing).withColumn("culture_score", culture)
                 .withColumn("evidence_score", evidence).withColumn("narrative_score", story).withColumn("__penalty", penalty).withColumn("__broad", broad))
    explicit = (F.col("phrase") > 0) | (F.col("entity") > 0) | (F.col("alias") > 0) | (F.col("exact") >= 2) | (F.col("exact") > 0) & (F.col("longest_exact") >= 5)
    strong = (F.col("alias") > 0) | (F.col("exact") > 0) | (F.col("partial") > 0) | (F.col("seed") > 0) | named | F.col("matched")
    kind = F.when(explicit & (F.col("evidence_score") >= 58.0), "explicit_origin").when(strong & (F.col("narrative_score") >= 42.0) & ~F.col("__broad"), "strong_narrative").otherwise("fallback")
    df = barrier(df.withColumn("match_type", kind))
    base = F.when(F.col("match_type") == "explicit_origin", F.col("evidence_score")).when(F.col("match_type") == "strong_narrative", F.col("narrative_score")).otherwise(
        F.least(F.lit(34.0), F.col("narrative_score") * 0.55 + F.col("posts") * 2.0))
    link = clamp(base * 0.72 + F.col("mention_score") * 0.18 + F.col("timing_score") * 0.1 + F.col("culture_score") * 0.06 - F.col("__penalty"), 0.0, 100.0)
    link = F.when(F.col("__broad"), F.least(link, F.lit(36.0))).otherwise(link)
    scores = ["lexical_score", "mention_score", "timing_score", "culture_score", "evidence_score", "narrative_score"]
    return df.withColumn("link_score", F.round(link, 3)).withColumns({s: F.round(s, 3) for s in scores}).drop("__penalty", "__broad")


def plausible() -> Column:
    """Whether a scored link may be shown while others of its topic may not."""
    some = (F.col("exact") > 0) | (F.col("phrase") > 0) | (F.col("entity") > 0) | (F.col("alias") > 0) | (F.col("posts") > 0)
    return (F.col("match_type") == "explicit_origin") | some | (F.col("partial") > 0) | (F.col("seed") > 0) | (F.greatest("name_similarity", "symbol_similarity") >= 0.46) | (F.col("link_score") >= 16.0)


def chosen_links(links: DataFrame, topic: str, asset: str, order: list[Column], limit: int = 5) -> DataFrame:
    """The best links of every topic, one per asset: the plausible ones, or, of a topic that has none, any.  Adds ``rank``.

    Every topic is cut to so many rows before the shuffle, plausible ones first; what else is left of a topic with a plausible link goes afterwards."""
    ready = barrier(links.withColumn("__ok", plausible()))
    one = top_n(ready, [topic, asset], [F.col("__ok").desc(), *order], 1)
    first = materialise(top_n(one, [topic], [F.col("__ok").desc(), *order], limit, "rank"), "first-links")
    any_ok = first.groupBy(F.col(topic).alias("__t")).agg(F.max("__ok").alias("__any"))
    return first.join(any_ok, F.col(topic).eqNullSafe(F.col("__t"))).where("__ok OR NOT __any").drop("__ok", "__any", "__t")


__all__ = ["chosen_links", "compact", "containments", "lexical", "link_scores", "name_similarity", "partial_overlap", "plain_text", "plausible", "support", "thematic_fit", "top_overlaps"]
