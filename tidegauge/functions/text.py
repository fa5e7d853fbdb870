"""Text columns: cleaning, entity extraction, tokens, topic keys, sentiment, tags."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, functions as F

from tidegauge import fixed
from tidegauge.functions.basic import Col, bind, c, clamp, count_in, words, one_of

# apostrophe look-alikes folded to a plain one
_APOSTROPHES = "[`’‘´ʼʹ]"
_MOJIBAKE = "â€™"


def collapse_ws(x: Col) -> Column:
    return F.trim(F.regexp_replace(c(x), r"\s+", " "))


def spelled_out(pattern: str) -> str:
    """The pattern with the ranges of its character classes as single characters, which Java looks up in one table instead of range by range."""
    for whole, chars in (("a-z", string.ascii_lowercase), ("A-Z", string.ascii_uppercase), ("0-9", string.digits)):
        pattern = pattern.replace(whole, chars)
    return pattern


def _all(x: Col, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(c(x), F.lit(spelled_out(pattern)), F.lit(group)), F.array().cast("array<string>"))


def urls(x: Col) -> Column:
    cut = F.transform(_all(x, fixed.URL_PATTERN), lambda u: F.regexp_replace(u, r"[.,)]+$", ""))
    return F.array_distinct(F.filter(cut, lambda u: u != ""))


def hashtags(x: Col) -> Column:
    return F.array_distinct(F.transform(_all(x, fixed.HASHTAG_PATTERN), F.lower))


def handles(x: Col) -> Column:
    return F.array_distinct(F.transform(_all(x, fixed.HANDLE_PATTERN), F.lower))


def cashtags(x: Col) -> Column:
    return F.array_distinct(F.transform(_all(x, fixed.CASHTAG_PATTERN), F.lower))


def tokens(x: Col, stop=None) -> Column:
    """Distinct lower-case words of two characters or more, in first-seen order."""
    dropped = words(list(stop if stop is not None else fixed.STOPWORDS) + list(fixed.URL_DEBRIS))
    raw = F.transform(
        F.array_distinct(_all(F.lower(c(x)), fixed.WORD_PATTERN)), lambda t: F.trim(t, F.lit("._-"))
    )
    return F.array_distinct(
        F.filter(raw, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~one_of(t, dropped))
    )


def domain(u: Col) -> Column:
    host = F.lower(F.regexp_extract(F.trim(c(u)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def domains(us: Col) -> Column:
    return F.array_distinct(F.filter(F.transform(c(us), domain), lambda d: d.isNotNull()))


def topic_key(x: Col) -> Column:
    """Canonical spelling of a topic: lower case, apostrophes dropped inside words, only ``a-z0-9$#-`` kept."""
    s = F.lower(F.coalesce(c(x), F.lit("")))
    s = F.replace(s, F.lit(_MOJIBAKE), F.lit("'"))
    s = F.regexp_replace(s, _APOSTROPHES, "'")
    s = F.regexp_replace(s, "(?<=[\\p{L}\\p{N}_])[?�](?=[\\p{L}\\p{N}_])", "")
    s = F.regexp_replace(s, r"(?<=[\p{L}\p{N}_])'(?=[\p{L}\p{N}_])", "")
    s = F.regexp_replace(s, spelled_out(r"[^a-z0-9$#\s-]+"), " ")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s, F.lit(" -"))


def word_key(x: Col) -> Column:
    """``topic_key`` of one word, without its patterns where the word has nothing to clean but hyphens at its ends."""
    plain = ~c(x).rlike(spelled_out("[^A-Za-z0-9-]"))
    return F.when(plain, F.trim(F.lower(c(x)), F.lit("-"))).otherwise(topic_key(x))


def topic_key_stored(x: Col) -> Column:
    """Spelling used on stored mentions: as ``topic_key`` but hyphens at the ends stay and only ASCII pairs fuse."""
    s = F.replace(F.replace(F.lower(F.coalesce(c(x), F.lit(""))), F.lit(_MOJIBAKE), F.lit("'")), F.lit("’"), F.lit("'"))
    s = F.regexp_replace(s, r"([a-z0-9])'([a-z0-9])", "$1$2")
    s = F.regexp_replace(s, r"[^a-z0-9$#\s-]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def topic_tokens(x: Col) -> Column:
    return _all(topic_key(x), fixed.TOPIC_TOKEN_PATTERN)


def sentiment(x: Col) -> Column:
    """struct(positive, negative, neutral, label): weighted lexicon sums over ``[a-z']+`` words.

    The text is split once; words outside the three lexicons drop out before the sums."""
    lexicons = (fixed.POSITIVE_WORDS, fixed.NEGATIVE_WORDS, fixed.NEUTRAL_WORDS)
    known = words([w for lexicon in lexicons for w in lexicon])
    hits = F.filter(_all(F.lower(c(x)), "([a-z']+)"), lambda t: one_of(t, known))

    def totals(found: Column) -> Column:
        def total(lexicon: dict[str, int]) -> Column:
            weights = F.create_map(*[F.lit(v) for kv in lexicon.items() for v in kv])
            return F.aggregate(found, F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.try_element_at(weights, t), F.lit(0)))

        return F.struct(*[total(lex).alias(n) for lex, n in zip(lexicons, ("positive", "negative", "neutral"))])

    sums = F.get(F.transform(F.array(hits), totals), F.lit(0))
    label = lambda s: F.when(s["positive"] > s["negative"], "positive").when(s["negative"] > s["positive"], "negative").otherwise("neutral")
    return F.get(F.transform(F.array(sums), lambda s: s.withField("label", label(s))), F.lit(0))


def rule_tags(text: Col, toks: Col, tags: Col, cash: Col, doms: Col) -> Column:
    low = F.lower(c(text))

    def hits(items) -> Column:
        return F.exists(c(toks), lambda t: one_of(t, items))

    meme_text = low.contains("meme coin") | low.contains("meme-coin") | low.contains("memecoin")
    drop_text = low.contains("drop shipping")
    rules = [
        ("crypto", hits(fixed.CRYPTO_TERMS) | (F.size(c(cash)) > 0) | meme_text),
        ("memecoin", hits(fixed.MEMECOIN_TERMS) | meme_text),
        ("ecommerce", hits(fixed.ECOMMERCE_TERMS) | low.contains("e-commerce") | drop_text),
        ("dropshipping", hits(fixed.DROPSHIP_TERMS) | drop_text),
        ("product", hits(fixed.PRODUCT_TERMS)),
        ("link", F.size(c(doms)) > 0),
        ("hashtagged", F.size(c(tags)) > 0),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for tag, cond in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def quality_score(text: Col, token_count: Col, has_link: Column, engagement: Col) -> Column:
    """Text .25, token density .35, log engagement up to .35, link .05; four digits."""
    base = F.when(F.length(c(text)) > 0, 0.25).otherwise(0.0)
    dense = F.least(F.lit(1.0), c(token_count) / 20.0) * 0.35
    engaged = F.least(F.lit(0.35), F.log1p(F.greatest(F.lit(0), c(engagement))) / 12.0)
    return F.round(clamp(base + dense + engaged + F.when(has_link, 0.05).otherwise(0.0), 0.0, 1.0), 4)


def token_profile(key: Col) -> Column:
    """Counts of token classes in a space-separated topic key (no lateral join: array lambdas)."""
    toks = F.split(c(key), " ")
    listed = words(fixed.WEAK_WORDS + fixed.TOPIC_NOISE + fixed.NUMBER_WORDS + fixed.URL_DEBRIS)
    acr = words(fixed.ACRONYMS)
    informative = F.size(
        F.filter(toks, lambda t: (t != "") & ~one_of(t, listed) & ((F.length(t) >= 4) | one_of(t, acr)))
    )
    return F.struct(
        F.when(c(key) == "", 0).otherwise(F.size(toks)).alias("n"),
        count_in(toks, fixed.WEAK_WORDS).alias("weak"),
        count_in(toks, fixed.TOPIC_NOISE).alias("noise"),
        count_in(toks, fixed.NUMBER_WORDS).alias("number"),
        count_in(toks, fixed.URL_DEBRIS).alias("url"),
        informative.alias("informative"),
    )


def _by_type(kind: Col, table: dict[str, float], default: float) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for name, value in table.items():
        out = out.when(c(kind) == name, F.lit(value))
    return out.otherwise(F.lit(default))


def type_floor(kind: Col) -> Column:
    return _by_type(kind, fixed.TYPE_FLOOR, 0.62)


def stored_confidence(key: Col, kind: Col, quality: Col, alias_confidence: Col, profile: Col) -> Column:
    """Confidence of a stored mention (acronym bonus .12, no entity or informative bonus)."""
    p = c(profile)
    n = F.nullif(p["n"], F.lit(0)).cast("double")
    is_acr = one_of(c(key), fixed.ACRONYMS)
    score = (
        _by_type(kind, fixed.TYPE_BASE, 0.40)
        + c(quality) * 0.20
        + c(alias_confidence) * 0.18
        + F.when(p["n"] >= 2, 0.12).otherwise(0.0)
        + F.when(is_acr, 0.12).otherwise(0.0)
        - p["weak"] / n * 0.48
        - p["noise"] / n * 0.70
        - p["url"] / n * 1.00
        - F.when((p["n"] == 1) & ~is_acr & (F.length(c(key)) < 4), 0.32).otherwise(0.0)
    )
    return clamp(score, 0.0, 1.0)


def candidate_scores(toks: Col, kind: Col, qualities: list, alias_confidence: Col) -> Column:
    """struct(s0, s1, ..): ``candidate_score`` of the tokens of a key for each of several qualities; the tokens are looked through once."""
    listed = words(fixed.WEAK_WORDS + fixed.TOPIC_NOISE + fixed.NUMBER_WORDS + fixed.URL_DEBRIS)
    acr = words(fixed.ACRONYMS)
    known = words(list(fixed.ENTITIES) + fixed.ACRONYMS)

    def facts(toks: Column) -> Column:
        n, one = F.size(toks), F.get(toks, F.lit(0))
        strong = F.size(F.filter(toks, lambda t: ~one_of(t, listed) & ((F.length(t) >= 4) | one_of(t, acr))))
        share = lambda items: count_in(toks, items) / F.greatest(F.lit(1), n)
        return F.struct(
            F.when(n >= 2, 0.12).otherwise(0.0).alias("pair"), F.when(F.exists(toks, lambda t: one_of(t, known)), 0.14).otherwise(0.0).alias("known"),
            F.when(strong >= 2, 0.08).otherwise(0.0).alias("strong"), (share(fixed.WEAK_WORDS) * 0.48).alias("weak"),
            (share(fixed.TOPIC_NOISE) * 0.70).alias("noise"), (share(fixed.URL_DEBRIS) * 1.00).alias("debris"),
            F.when((n == 1) & one_of(one, fixed.WEAK_WORDS), 0.40).otherwise(0.0).alias("weak_one"),
            F.when((n == 1) & one_of(one, fixed.URL_DEBRIS), 0.60).otherwise(0.0).alias("debris_one"),
            F.when((n == 1) & (F.length(one) < 4) & ~one_of(one, acr), 0.32).otherwise(0.0).alias("short"),
            ((n == 0) | (n > 5) | (count_in(toks, fixed.NUMBER_WORDS) == n)).alias("dead"))

    def total(f: Column, quality) -> Column:
        sum_ = (
            _by_type(F.lower(c(kind)), fixed.TYPE_BASE, 0.40)
            + clamp(c(quality), 0.0, 1.0) * 0.20
            + clamp(c(alias_confidence), 0.0, 1.0) * 0.18
            + f["pair"] + f["known"] + f["strong"] - f["weak"] - f["noise"] - f["debris"] - f["weak_one"] - f["debris_one"] - f["short"]
        )
        return F.when(f["dead"], 0.0).otherwise(clamp(sum_, 0.0, 1.0))

    return bind(bind(toks, facts), lambda f: F.struct(*[total(f, q).alias(f"s{i}") for i, q in enumerate(qualities)]))


def candidate_score(key: Col, kind: Col, quality: Col, alias_confidence: Col) -> Column:
    """Score of a topic candidate found in a text (entity bonus .14, informative bonus .08, single-token penalties)."""
    return candidate_scores(topic_tokens(key), kind, [quality], alias_confidence)["s0"]


def alias_lookup() -> dict[str, tuple[str, str, float]]:
    """alias spelling -> (key, label, confidence), spelled as ``topic_key`` spells it."""
    import re

    def spell(s: str) -> str:
        s = re.sub(r"(?<=\w)'(?=\w)", "", s.lower())
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9$#\s-]+", " ", s)).strip(" -")

    out = {}
    for key, label, _kind, confidence, aliases in fixed.ALIAS_RULES:
        for alias in (key, *aliases):
            out[spell(alias)] = (key, label, confidence)
    return out


def initcap(x: Col) -> Column:
    """Capitalises after every non-alphanumeric character, not only after blanks."""
    parts = F.regexp_extract_all(F.lower(c(x)), F.lit(r"([a-z0-9]+|[^a-z0-9]+)"), F.lit(1))
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))


def short_sha1(x: Col, n: int) -> Column:
    return F.substring(F.sha1(c(x)), 1, n)


def ngrams(toks: Col, sizes=(2, 3, 4), head: int | None = None) -> Column:
    """All contiguous phrases of the given sizes; ``head`` limits them to the first words of a list."""
    first = c(toks) if head is None else F.slice(c(toks), 1, head)

    def runs(words_: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words_) - (n - 1), F.lit(1)))
        phrases = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words_, i, n)))
        return F.when(F.size(words_) >= n, phrases).otherwise(F.array().cast("array<string>"))

    def build(words_: Column) -> Column:
        return F.flatten(F.array(*[runs(words_, n) for n in sizes]))

    return bind(first, build)


def jaccard(a: Col, b: Col) -> Column:
    union = F.size(F.array_union(c(a), c(b)))
    return F.when(union > 0, F.size(F.array_intersect(c(a), c(b))) / union).otherwise(0.0)


def overlap_coefficient(a: Col, b: Col) -> Column:
    low = F.least(F.size(F.array_distinct(c(a))), F.size(F.array_distinct(c(b))))
    return F.when(low > 0, F.size(F.array_intersect(c(a), c(b))) / low).otherwise(0.0)


LN2 = math.log(2.0)
