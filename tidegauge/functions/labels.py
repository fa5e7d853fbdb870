"""Label and phrase columns: narrative tokens, merge keys, label quality tests, name shapes, title checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegauge import fixed
from tidegauge.functions.basic import Col, bind, blank_to_null, c, count_in, words, one_of
from tidegauge.functions.text import spelled_out

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(x: Col) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(c(x)), ACCENTED, PLAIN)


def drop_urls(x: Col) -> Column:
    return F.regexp_replace(c(x), r"(?i)https?://\S+", " ")


def cluster_token(t: Column) -> Column:
    one = F.when(
        t.endswith("s") & (F.length(t) > 4) & ~t.rlike("(ss|us|is|as)$"), F.regexp_replace(t, "s$", "")
    ).otherwise(t)
    out = one
    aliases = fixed.NARRATIVE_TOKEN_ALIASES
    lookup = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(F.try_element_at(lookup, out), out)


def narrative_tokens(x: Col) -> Column:
    raw = F.split(F.trim(F.regexp_replace(fold(drop_urls(x)), r"[^a-z0-9]+", " ")), " ")
    return F.transform(F.filter(raw, lambda t: t != ""), cluster_token)


def is_informative(t: Column) -> Column:
    listed = words(fixed.NARRATIVE_STOP_WORDS + fixed.NARRATIVE_WEAK_WORDS)
    return ((F.length(t) >= 3) | one_of(t, fixed.NARRATIVE_ACRONYMS)) & ~one_of(t, listed)


def informative_tokens(toks: Col) -> Column:
    return F.filter(c(toks), is_informative)


def phrase_key(phrase: Col) -> Column:
    """Distinct informative tokens in order, four at most; single tokens need an anchor."""
    toks = F.filter(F.split(c(phrase), r"\s+"), is_informative)
    one = F.element_at(toks, 1)
    single_ok = ~one_of(one, fixed.PLATFORM_LABEL_WORDS + fixed.URL_LABEL_WORDS) & (
        one_of(one, fixed.NARRATIVE_ACRONYMS) | (F.length(one) >= 4) | one.rlike("[0-9]")
    )
    many = F.concat_ws(" ", F.slice(F.array_sort(F.array_distinct(toks)), 1, 4))
    return F.when(F.size(toks) >= 2, many).when((F.size(toks) == 1) & single_ok, one).otherwise("")


def phrase_label(phrase: Col) -> Column:
    display = F.create_map(*[F.lit(v) for kv in fixed.NARRATIVE_DISPLAY.items() for v in kv])
    return F.concat_ws(" ", F.transform(
        F.split(c(phrase), " "),
        lambda t: F.coalesce(
            F.try_element_at(display, t),
            F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))),
        ),
    ))


def hashtag_label(tag: Col) -> Column:
    toks = narrative_tokens(F.regexp_replace(c(tag), "^#", ""))
    return F.when(F.size(toks) > 0, F.concat(F.lit("#"), phrase_label(F.concat_ws("", toks)))).otherwise("")


def named_phrases(x: Col) -> Column:
    """Runs of up to five capitalised words (or acronyms, numbers), as folded token phrases."""
    word = r"(?:[A-Z][a-z]+(?:[A-Z][a-z]+)*|[A-Z]{2,}|[A-Z]|[A-Z][a-z]+[0-9]+|[0-9]+[A-Za-z]+|[0-9]+(?:\.[0-9]+)*)"
    plain = F.translate(drop_urls(x), ACCENTED + ACCENTED.upper().replace("Ÿ", ""), PLAIN + PLAIN.upper()[:-1])
    found = F.regexp_extract_all(plain, F.lit(rf"\b({word}(?:\s+{word}){{0,4}})\b"), F.lit(1))
    phrases = F.transform(found, lambda p: F.concat_ws(" ", informative_tokens(narrative_tokens(p))))
    return F.array_distinct(F.filter(phrases, lambda p: p.contains(" ")))


def label_profile(label: Col) -> Column:
    """struct with everything the label tests need, computed once per label."""
    text = F.trim(F.regexp_replace(c(label), r"\s+", " "))
    phrase = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))
    toks = narrative_tokens(text)
    inf = F.filter(toks, lambda t: ~one_of(t, fixed.NARRATIVE_STOP_WORDS + fixed.NARRATIVE_WEAK_WORDS))
    return F.struct(text.alias("text"), phrase.alias("phrase"), toks.alias("toks"), inf.alias("inf"))


def _any_match(x: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def has_anchor(p: Column) -> Column:
    acr = words(fixed.NARRATIVE_ACRONYMS)
    return (F.size(p["inf"]) >= 2) | F.exists(p["inf"], lambda t: (F.length(t) >= 4) | one_of(t, acr) | t.rlike("[0-9]"))


def is_fragment_label(p: Column) -> Column:
    n, k = F.size(p["toks"]), F.size(p["inf"])
    lead = one_of(F.element_at(p["toks"], 1), fixed.FRAGMENT_LEADS)
    tail = one_of(F.element_at(p["toks"], -1), fixed.FRAGMENT_TAILS)
    listed = words(fixed.NARRATIVE_STOP_WORDS + fixed.NARRATIVE_WEAK_WORDS)
    return (
        (p["phrase"] == "") | _any_match(p["phrase"], fixed.FRAGMENT_LABEL_PATTERNS) | (n == 0)
        | ((n <= 3) & (k == 0)) | F.coalesce((n <= 3) & (lead | tail) & (k < 2), F.lit(False))
        | F.coalesce((n <= 3) & lead & tail, F.lit(False))
        | ((n >= 3) & (F.size(F.array_distinct(p["inf"])) <= 1) & (k > 0) & F.exists(p["toks"], lambda t: one_of(t, listed)))
    )


def is_url_label(p: Column) -> Column:
    urlish = count_in(p["toks"], fixed.URL_LABEL_WORDS)
    k = F.size(p["inf"])
    return (F.size(p["toks"]) == 0) | ((urlish > 0) & (
        F.exists(p["toks"], lambda t: t.isin("com", "www", "http", "https"))
        | ((k <= 3) & (urlish >= F.greatest(F.lit(1), k - 1)))
    ))


def is_platform_label(p: Column) -> Column:
    return (
        (p["phrase"] == "") | p["phrase"].isin(*fixed.PLATFORM_LABEL_PHRASES) | (F.size(p["inf"]) == 0)
        | F.forall(p["inf"], lambda t: one_of(t, fixed.PLATFORM_LABEL_WORDS))
    )


def is_temporal_label(p: Column) -> Column:
    clock = r"^([0-9]{1,2}(:[0-9]{2})?|[0-9]{3,4})(am|pm)$"
    whole = F.trim(F.regexp_replace(F.regexp_replace(F.lower(p["text"]), r"[^a-z0-9:\s]", " "), r"\s+", " "))
    timed = whole.rlike(r"^([0-9]{1,2}(:[0-9]{2})?|[0-9]{3,4})(am|pm)\s+[a-z]{2,5}$") | whole.rlike(
        r"^([a-z]{2,5}\s+)?([0-9]{1,2}(:[0-9]{2})?|[0-9]{3,4})(am|pm)$"
    )
    k = F.size(p["inf"])
    return (whole == "") | timed | ((k > 0) & (k <= 3) & F.forall(
        p["inf"], lambda t: one_of(t, fixed.TEMPORAL_LABEL_WORDS) | t.rlike(clock)
    ))


def is_weak_label(p: Column) -> Column:
    listed = words(fixed.NARRATIVE_STOP_WORDS + fixed.NARRATIVE_WEAK_WORDS)
    acr = words(fixed.NARRATIVE_ACRONYMS)
    n, k = F.size(p["toks"]), F.size(p["inf"])
    weak = count_in(p["toks"], listed)
    distinct = F.size(F.array_distinct(p["inf"]))
    long_one = F.exists(p["inf"], lambda t: (F.length(t) >= 4) | t.rlike("[0-9]"))
    all_acr = (k > 0) & F.forall(p["inf"], lambda t: one_of(t, acr))
    edge = one_of(F.element_at(p["toks"], 1), listed) | one_of(F.element_at(p["toks"], -1), listed)
    return (
        (p["phrase"] == "") | F.lower(p["text"]).rlike(fixed.QUESTION_LABEL_PATTERN)
        | p["phrase"].isin(*fixed.NARRATIVE_WEAK_PHRASES) | is_platform_label(p) | is_url_label(p) | is_temporal_label(p)
        | (n == 0) | (k == 0) | ((distinct <= 1) & (k >= 2)) | ((k <= 2) & ~long_one & ~all_acr)
        | (is_fragment_label(p) & (k < 2)) | ((n <= 3) & (weak >= n - 1) & (k < 2))
        | (F.coalesce(edge, F.lit(False)) & ~has_anchor(p)) | ((n == 1) & ~has_anchor(p))
    )


# -- cluster labels ---------------------------------------------------------------------------------


def topic_identity(x: Col) -> Column:
    """Folded label without sigils: letters, digits, blanks and hyphens."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(x), r"[^a-z0-9\s-]+", " "), r"\s+", " "))


def compact_identity(x: Col) -> Column:
    return F.regexp_replace(topic_identity(x), r"[\s-]+", "")


def singular(t: Column) -> Column:
    return (
        F.when(F.length(t) <= 4, t)
        .when(t.endswith("ies") & (F.length(t) > 5), F.concat(F.regexp_replace(t, "ies$", ""), F.lit("y")))
        .when(t.endswith("es") & ~t.endswith("ses") & ~t.endswith("xes"), F.regexp_replace(t, "es$", ""))
        .when(t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us") & ~t.endswith("is"), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def label_tokens(x: Col) -> Column:
    return F.filter(F.split(topic_identity(x), " "), lambda t: t != "")


def label_informative(x: Col) -> Column:
    dropped = words(fixed.LABEL_STOP_WORDS + fixed.LABEL_GENERIC_WORDS + fixed.LABEL_TEMPORAL_WORDS)
    return F.array_distinct(F.filter(
        F.transform(label_tokens(x), singular), lambda t: (F.length(t) >= 2) & ~one_of(t, dropped)
    ))


def merge_key(x: Col) -> Column:
    return F.concat_ws(" ", F.slice(F.array_sort(label_informative(x)), 1, 4))


def is_fragment_topic(x: Col) -> Column:
    ident = topic_identity(x)
    toks = label_tokens(x)
    listed = words(fixed.LABEL_GENERIC_WORDS + fixed.LABEL_TEMPORAL_WORDS)
    return (
        (ident == "") | _any_match(ident, fixed.LABEL_FRAGMENT_PATTERNS) | _any_match(ident, fixed.LABEL_GENERIC_PATTERNS)
        | ((F.size(toks) == 1) & one_of(F.element_at(toks, 1), listed))
        | ((F.size(label_informative(x)) == 0) & (F.length(compact_identity(x)) <= 12))
    )


def is_generic_topic(x: Col) -> Column:
    ident = topic_identity(x)
    return (ident == "") | _any_match(ident, fixed.LABEL_GENERIC_PATTERNS) | (F.size(label_informative(x)) == 0)


def is_temporal_topic(x: Col) -> Column:
    toks = label_tokens(x)
    return (F.size(toks) > 0) & F.forall(toks, lambda t: one_of(t, fixed.LABEL_TEMPORAL_WORDS))


def cluster_label_score(x: Col) -> Column:
    n = F.size(label_informative(x))
    flag = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    return (
        n * 18 + flag(F.trim(c(x)).contains(" "), 8, 0) + flag(is_fragment_topic(x), -20, 14)
        + flag(is_generic_topic(x), -18, 10) + flag(is_temporal_topic(x), -24, 6) + flag(n == 1, 6, 0)
    )


def fragment_variant(a: Col, b: Col) -> Column:
    """Compact spellings that differ by a lost edge letter, a short extension or one edit."""
    x, y = c(a), c(b)
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    gap = F.length(long) - F.length(short)
    return (x != "") & (y != "") & (x != y) & (F.length(short) >= 4) & (F.length(long) >= 5) & (
        (F.contains(long, short) & (gap <= 2)) | ((gap <= 1) & (F.levenshtein(x, y) <= 1))
    )


# -- stored names --------------------------------------------------------------------------------------


def name_identity(x: Col) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), r"[^a-z0-9]+", " "))


def name_compact(x: Col) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), r"[^a-z0-9]+", "")


def is_generic_name(x: Col) -> Column:
    ident = name_identity(x)
    toks = F.split(ident, " ")
    return (ident == "") | ident.isin(*fixed.NAME_GENERIC_PHRASES) | (
        count_in(toks, fixed.NAME_GENERIC_WORDS) >= F.greatest(F.lit(2), F.size(toks))
    )


def is_fragment_name(x: Col) -> Column:
    k = name_compact(x)
    return (k == "") | ((F.length(k) < 3) & ~k.isin(*fixed.NAME_SHORT_OK)) | k.rlike(fixed.NAME_FRAGMENT_PATTERN)


def has_narrative_shape(x: Col) -> Column:
    ident = name_identity(x)
    toks = F.split(ident, " ")
    return (ident != "") & ((F.size(toks) >= 2) | F.exists(toks, lambda t: one_of(t, fixed.NAME_NARRATIVE_WORDS)))


def safe_name(*names: Col) -> Column:
    """First name that is neither generic nor a fragment, nor a shorter variant of a later one."""
    picks = []
    for i, name in enumerate(names):
        bad = is_generic_name(name) | is_fragment_name(name)
        for later in names[i + 1:]:
            bad = bad | (
                F.coalesce(F.length(name_compact(later)) > F.length(name_compact(name)), F.lit(False))
                & fragment_variant(name_compact(name), name_compact(later))
            )
        picks.append(F.when(~bad, blank_to_null(name)))
    return F.coalesce(*picks)


# -- titles ---------------------------------------------------------------------------------------------


# what stands around the letters and digits of a word; the words of a text are parted by single spaces
_WORD_EDGE = spelled_out(r"(?:^|(?<= ))[^ A-Za-z0-9$#]++|[^ A-Za-z0-9$#]++(?= |$)")


def title_check(x: Col) -> Column:
    """struct(word_count, informative_count, errors); the text is cleaned and cut into words once, as a whole."""

    def checked(z: Column) -> Column:
        text, n = z["text"], F.size(z["toks"])
        inf = F.size(F.filter(z["toks"], lambda t: ~one_of(t, fixed.TITLE_GENERIC_WORDS)))
        rules = [
            ("empty", text == ""), ("too few words", n < 4), ("too many words", n > 14), ("too long", F.length(text) > 140),
            ("punctuation", text.rlike(fixed.TITLE_PUNCTUATION)), ("headline style", text.rlike(fixed.TITLE_HEADLINE_WORDS)),
        ]
        return bind(inf, lambda k: F.struct(
            n.alias("word_count"), k.alias("informative_count"),
            F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in [*rules, ("too generic", k < 3)]])).alias("errors")))

    def cut(text: Column) -> Column:
        toks = F.filter(F.split(F.lower(F.regexp_replace(text, _WORD_EDGE, "")), " "), lambda t: t != "")
        return F.struct(text.alias("text"), toks.alias("toks"))

    return bind(bind(F.trim(F.regexp_replace(c(x), r"\s+", " ")), cut), checked)


# -- urls and numbers -------------------------------------------------------------------------------------


def canonical_url(u: Col, drop=tuple(fixed.URL_DROP_KEYS), internal=tuple(fixed.URL_INTERNAL_HOSTS)) -> Column:
    """Scheme, lower-case host, path without trailing slashes, query without tracking keys; NULL for internal hosts."""
    x = c(u)
    scheme = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(x, r"^[^?#]*\?([^#]*)", 1)
    key = lambda kv: F.lower(F.split(kv, "=")[0])
    kept = F.filter(
        F.split(query, "&"), lambda kv: (kv != "") & ~key(kv).isin(*drop)
    )
    return F.when(
        (scheme != "") & ~host.isin(*internal),
        F.concat(
            scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path),
            F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(""),
        ),
    )


def compact_count(x: Col) -> Column:
    """1.2K, 3M, 4B -> whole number."""
    s = F.upper(F.regexp_replace(F.trim(c(x)), ",", ""))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)([KMB])?$"
    unit = F.regexp_extract(s, pattern, 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(s.rlike(pattern), F.floor(F.regexp_extract(s, pattern, 1).cast("double") * scale + 0.5).cast("long"))


def traffic_score(count: Col) -> Column:
    """1..100 on a log scale; 0 for an unreadable count."""
    scaled = F.floor(F.log10(F.greatest(c(count), F.lit(0)) + 1) * 20 + 0.5)
    return F.when(c(count).isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), scaled))).cast("long")
