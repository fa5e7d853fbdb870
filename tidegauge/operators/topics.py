"""Topic candidates of a text and the feature row built from them.

Candidates are found with array expressions (cashtags, hashtags, capitalised runs folded token by token), then each
candidate becomes a row: reduction to two keywords, validity and confidence are plain columns, and one aggregation
per post keeps the first of every topic.  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge import fixed
from tidegauge.functions import text as tx
from tidegauge.functions.basic import Col, barrier, bind, c, count_in, words, one_of

NUMBERS = fixed.NUMBER_WORDS + fixed.ORDINAL_WORDS
NOISE = [w for w in fixed.TOPIC_NOISE if w != "digit"] + fixed.URL_DEBRIS
ACR, ENT = words(fixed.ACRONYMS), words(fixed.ENTITIES)
CANDIDATE_FLOOR = {"cashtag": 0.34, "hashtag": 0.40, "entity": 0.48, "keyword": 0.62}


def _weak(extra) -> list[str]:
    return words(fixed.WEAK_WORDS + list(extra or ()))


def _alias(key: Col, part: int) -> Column:
    table = tx.alias_lookup()
    lookup = F.create_map(*[F.lit(v) for a, rule in sorted(table.items()) for v in (a, rule[part])])
    return F.try_element_at(lookup, c(key))


def is_proper(t: Column, key: Column, weak: list[str]) -> Column:
    """A capitalised or mixed-case token that can carry a name."""
    upper_only = t == F.upper(t)
    rest = F.substring(t, F.lit(2), F.length(t))
    return (
        (key != "") & ~one_of(key, fixed.STOPWORDS + fixed.TOPIC_BLOCKLIST) & ~one_of(key, NOISE)
        & (~one_of(key, weak) | one_of(key, ENT)) & ((F.length(key) >= 3) | one_of(key, ACR))
        & (
            (upper_only & (F.length(t) >= 2))
            | (((F.length(key) >= 4) | one_of(key, ACR) | one_of(key, ENT))
               & ((t.rlike("^[A-Z]") & rest.rlike("[a-z]")) | (rest.rlike("[A-Z]") & t.rlike("[a-z]"))))
        )
    )


# one word, and what stands before it; a flat pattern: repeated groups would recurse once per word
_WORD = tx.spelled_out(r"([^A-Za-z]*)([A-Za-z][A-Za-z0-9&'-]*)")
_LINKS = [w for w in fixed.CONNECTORS if w != "&"]
# a whole word without a capital letter that only ends what stands before it: no connector, or one in front of such a word
_LOWER = "[a-z][a-z0-9&'-]*+(?![A-Z])"
_PLAIN = tx.spelled_out(
    rf"(?=[a-z])(?<![A-Za-z0-9&'-])(?!(?:{'|'.join(_LINKS)})(?![A-Za-z0-9&'-])(?![^A-Za-z]*+{_LOWER})){_LOWER} ?")
_CUT = "\x01"


def name_runs(text: Col, weak: list[str]) -> Column:
    """array<string>: adjacent proper words of a whole text joined into names.

    A stretch is a series of words with a capital letter, parted by gaps without sentence marks or by one connector word.
    Inside a stretch a name has at most five words, weak or noise words end it, and a plain capitalised first word of a sentence
    starts one only when the text repeats it.  Words are taken and flagged once, then folded once, so a text of any length is fine.

    Most words are plain; each becomes one character of the gap in front of the next word, so that only the others are looked at one by one."""
    marked = F.concat(F.lit("#"), F.ltrim(c(text)))  # '#': start of text counts as a sentence start
    marked = F.regexp_replace(F.replace(marked, F.lit(_CUT), F.lit("\x02")), _PLAIN, _CUT)
    zipped = bind(marked, lambda m: F.arrays_zip(
        F.regexp_extract_all(m, F.lit(_WORD), F.lit(1)).alias("gap"), F.regexp_extract_all(m, F.lit(_WORD), F.lit(2)).alias("tok")))
    lower = F.sort_array(F.regexp_extract_all(F.lower(c(text)), F.lit(tx.spelled_out(r"([a-z][a-z0-9&'-]*)")), F.lit(1)))
    repeated = bind(lower, lambda ks: F.array_distinct(F.filter(ks, lambda k, i: (i > 0) & (F.get(ks, i - 1) == k))))

    def flags(z: Column, rep: Column) -> Column:
        t, gap = z["tok"], z["gap"]
        cut = gap.contains(_CUT)

        def with_key(k: Column) -> Column:
            plain = t.rlike("^[A-Z]") & t.rlike("^.[^A-Z]*[a-z]") & ~t.rlike("^.+[A-Z]")
            proper = is_proper(t, k, weak)
            lead = gap.rlike(r"(^#|[.!?;:])\s*$")
            skip = lead & plain & ~F.array_contains(rep, F.lower(t)) & ~one_of(k, ENT) & ~one_of(k, ACR)
            return F.struct(
                t.alias("tok"), cut.alias("cut"), F.lit(True).alias("name"), F.lit(False).alias("joins"), (~gap.rlike(r"[.!?;:]")).alias("near"),
                (~gap.rlike("[0-9&'-]$")).alias("opens"), proper.alias("proper"), (proper & ~skip).alias("first"),
                one_of(k, NOISE).alias("noise"), k.isin(*fixed.CONNECTORS).alias("link"))

        other = F.struct(
            t.alias("tok"), cut.alias("cut"), F.lit(False).alias("name"), t.isin(*_LINKS).alias("joins"), (~gap.rlike(r"[.!?;:]")).alias("near"), F.lit(False).alias("opens"),
            F.lit(False).alias("proper"), F.lit(False).alias("first"), F.lit(False).alias("noise"), F.lit(True).alias("link"))
        return F.when(t.rlike("[A-Z]"), bind(tx.word_key(t), with_key)).otherwise(other)

    def fold(fl: Column) -> Column:
        def ahead(z: Column, i: Column) -> Column:
            n = F.get(fl, i + 1)
            return z.withField("next_name", F.coalesce(n["name"] & ~n["cut"], F.lit(False))).withField(
                "next_proper", F.coalesce(n["proper"] & ~n["cut"] & (z["joins"] | n["near"]), F.lit(False)))

        empty = F.array().cast("array<string>")
        # at: 0 outside of stretches, 1 after a word of one, 2 after a connector inside one
        zero = F.struct(empty.alias("done"), empty.alias("cur"), F.lit(False).alias("force"), F.lit(0).alias("at"))
        closed = lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(F.concat_ws(" ", a["cur"])))).otherwise(a["done"])

        def step(a: Column, z: Column) -> Column:
            goes_on = ~z["cut"] & ((z["name"] & (((a["at"] == 1) & z["near"]) | (a["at"] == 2))) | (z["joins"] & (a["at"] == 1) & z["near"] & z["next_name"]))
            begins = ~goes_on & z["name"] & z["opens"]
            room = goes_on & (F.size(a["cur"]) > 0) & (F.size(a["cur"]) < 5) & z["near"] & ~z["noise"]
            grow = goes_on & (F.size(a["cur"]) > 0) & (a["force"] | (room & z["proper"]))
            link = ~grow & room & z["link"] & z["next_proper"]
            start = F.when(goes_on, z["proper"]).otherwise(begins & z["first"])
            return F.struct(
                F.when(grow | link, a["done"]).otherwise(closed(a)).alias("done"),
                F.when(grow, F.concat(a["cur"], F.array(z["tok"]))).when(link, F.concat(a["cur"], F.array(F.lower(z["tok"])))).otherwise(
                    F.when(start, F.array(z["tok"])).otherwise(empty)).alias("cur"),
                link.alias("force"), F.when(goes_on & z["joins"], 2).when(goes_on | begins, 1).otherwise(0).alias("at"))

        return F.aggregate(F.transform(fl, ahead), zero, step, closed)

    return bind(F.struct(zipped.alias("words"), repeated.alias("rep")),
                lambda s: bind(F.transform(s["words"], lambda z: flags(z, s["rep"])), fold))


def informative(t: Column, weak: list[str]) -> Column:
    known = one_of(t, ACR) | one_of(t, ENT)
    return (t != "") & ~one_of(t, NOISE + NUMBERS) & (
        one_of(t, ACR) | (~one_of(t, weak) & (known | ((F.length(t) >= 4) & ~t.rlike("^[0-9]+$"))))
    )


def strong_keyword(t: Column, weak: list[str]) -> Column:
    banned = words(fixed.URL_DEBRIS + fixed.STOPWORDS + fixed.TOPIC_BLOCKLIST + NOISE + NUMBERS) + weak
    score = tx.candidate_score(t, F.lit("keyword"), F.lit(0.0), F.lit(0.0))
    # one plain word can never reach .62, so only hyphenated words are scored
    return (t != "") & ~one_of(t, banned) & (
        one_of(t, ENT) | one_of(t, ACR) | F.when(t.contains("-") & (F.length(t) >= 5), score >= 0.62).otherwise(F.lit(False))
    )


def keyword_rank(t: Column, weak: list[str]) -> Column:
    return (
        F.when((t == "") | (one_of(t, weak) & ~one_of(t, ACR)), 0).when(one_of(t, ENT) | one_of(t, ACR), 3)
        .when(strong_keyword(t, weak), 2).when(informative(t, weak), 1).otherwise(0)
    )


def show(t: Column) -> Column:
    """Display form of one topic token."""
    cap = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
    parts = F.filter(F.split(t, "-"), lambda p: p != "")
    return F.when(one_of(t, ACR), F.upper(t)).when(t.contains("-"), F.concat_ws("-", F.transform(parts, cap))).otherwise(cap(t))


def reduce_to_pair(df: DataFrame, key: str, kind: str, weak: list[str]) -> DataFrame:
    """Adds ``topic``: the candidate as two keywords, filled up from the text's best own words when it has fewer.

    Needs the candidate's ``key``, ``toks`` (array of (key, place in the text)) and ``spare`` (best words of the text with their places)."""
    listed = words(NOISE + NUMBERS) + weak
    df = barrier(df.withColumn("__t", F.transform("toks", lambda x: x["key"])))
    key = F.col(key)
    first = F.filter("__t", lambda t: informative(t, weak))
    second = F.filter("__t", lambda t: ~one_of(t, listed))
    df = df.withColumn("__own", F.slice(F.array_distinct(F.concat(F.slice(F.array_distinct(first), 1, 2), second)), 1, 2))
    df = barrier(df)
    fill = F.transform("spare", lambda z: z["key"])
    df = df.withColumn("__pick", F.slice(F.array_distinct(F.concat("__own", fill)), 1, 2))
    places = F.map_from_entries(F.array_distinct(F.transform(
        F.concat("toks", "spare"), lambda x: F.struct(x["key"].alias("k"), F.when(x["place"] > 0, x["place"]).otherwise(10000).alias("p"))
    )))
    df = barrier(df.withColumn("__place", places))
    one, two = F.get("__pick", F.lit(0)), F.get("__pick", F.lit(1))
    ordered = F.when(
        F.try_element_at("__place", one) <= F.try_element_at("__place", two), F.array(one, two)
    ).otherwise(F.array(two, one))
    df = df.withColumn("__pair", F.when(F.size("__t") == 2, F.col("__t")).when(F.size("__pick") == 2, ordered))
    df = barrier(df)
    known = _alias(F.concat_ws(" ", "__pair"), 1)
    known = F.when(known.isNotNull() & (F.size(tx.topic_tokens(known)) == 2), known)
    alone = F.coalesce(_alias(key, 1), F.when(F.col(kind) == "cashtag", F.upper(key)).when(one_of(key, ACR), F.upper(key))
                       .when(F.col(kind) == "hashtag", key).otherwise(F.concat_ws(" ", F.transform(F.split(key, " "), show))))
    df = df.withColumn("topic", F.when(
        F.col("__pair").isNotNull(), F.coalesce(known, F.concat_ws(" ", F.transform("__pair", show)))
    ).otherwise(F.when(key == "", "").otherwise(alone)))
    return barrier(df.drop("__t", "__own", "__pick", "__place", "__pair"))


def acceptable(topic: str, kind: str, key: str, tokens: str, score: str, weak: list[str]) -> Column:
    """Topic wording is specific enough for its kind."""
    t, k, key, toks = F.col(topic), F.col(kind), F.col(key), F.col(tokens)
    n, one = F.size(toks), F.element_at(toks, 1)
    low = F.lower(t)
    noise, weak_n, numbers = count_in(toks, NOISE), count_in(toks, weak), count_in(toks, NUMBERS)
    debris = count_in(toks, fixed.URL_DEBRIS)
    loose = k.isin("entity", "keyword")
    acronym = (t == F.upper(t)) & F.length(t).between(2, 10) & t.rlike("[A-Z]")
    strong = F.size(F.filter(toks, lambda x: ~one_of(x, weak) & ~one_of(x, NOISE + NUMBERS) & (
        (F.length(x) >= 4) | one_of(x, ACR) | one_of(x, ENT))))
    named = F.size(F.filter(toks, lambda x: ~one_of(x, weak) & ~one_of(x, NOISE) & (
        (F.length(x) >= 4) | one_of(x, ACR) | one_of(x, ENT))))
    both = count_in(toks, words(NOISE) + weak)
    garbage = (
        low.rlike(r"\b(area|forecast|discussion)\b.*\b(afd|airnow|aqi)\b") | low.rlike(r"\b(additional|details)\s+here\b")
        | low.rlike(r"\b[a-z0-9]+bot\b") | ((n == 1) & one_of(one, NOISE + NUMBERS)) | (numbers == n)
        | (loose & (n >= 2) & (numbers >= n - 1)) | (debris > 0) | (noise >= F.greatest(F.lit(2), n - 1))
        | ((n >= 4) & (noise >= 2)) | ((strong == 0) & ~((n == 1) & acronym)) | ((k == "keyword") & (n > 2))
        | (loose & (weak_n >= F.greatest(F.lit(1), n - 1)))
    )
    weak_phrase = F.when(acronym, one_of(low, weak) | one_of(low, NOISE)).otherwise(
        ((n == 1) & (one_of(one, words(NOISE + NUMBERS) + weak) | ((F.length(one) < 3) & ~one_of(one, ACR))
                     | ((k == "keyword") & (F.length(one) < 4) & ~one_of(one, ACR))))
        | (both == n) | (named == 0) | ((k == "keyword") & (both >= F.greatest(F.lit(1), n - 1))) | ((n >= 4) & (both >= 2))
    )
    floor = tx._by_type(k, fixed.TYPE_FLOOR, 0.50)
    floor = F.when((n == 1) & one_of(one, ENT), F.least(floor, F.lit(0.35))).otherwise(floor)
    return (
        (F.length(t) >= 2) & (n > 0) & (n <= 5) & ~key.rlike("^[0-9]+$") & ~one_of(key, fixed.TOPIC_BLOCKLIST)
        & ~one_of(key, fixed.URL_DEBRIS) & ~garbage & ~weak_phrase
        & ~((k == "keyword") & ((F.length(key) < 4) | one_of(key, fixed.STOPWORDS)))
        & ~(loose & (weak_n == n)) & (F.col(score) >= floor)
    )


def topic_candidates(posts: DataFrame, post_id: str, text: str, quality: Column | None = None, extra_weak=()) -> DataFrame:
    """(post_id, position, topic_text, topic, topic_type), at most fifteen per post, first of equal topics wins.

    ``extra_weak`` extends the built-in weak words with a caller's own stop list."""
    weak = _weak(extra_weak)
    base = posts.select(
        post_id, tx.collapse_ws(text).alias("__text"), (quality if quality is not None else F.lit(0.0)).alias("__q")
    ).where(F.col("__text") != "")
    mark = lambda xs, kind, sign: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(sign), x).alias("raw")))

    def found(keys: Column) -> Column:
        """All different candidates in order of their first places, with the places of their words, plus the four best words of the text."""
        cands = F.concat(
            mark(F.array_distinct(F.regexp_extract_all("__text", F.lit(fixed.CASHTAG_PATTERN), F.lit(1))), "cashtag", "$"),
            mark(F.array_distinct(F.regexp_extract_all("__text", F.lit(fixed.HASHTAG_PATTERN), F.lit(1))), "hashtag", "#"),
            mark(F.array_distinct(name_runs("__text", weak)), "entity", ""),
            mark(F.filter(keys, lambda t: strong_keyword(t, weak)), "keyword", ""),
        )
        placed = F.transform(cands, lambda x: bind(tx.topic_key(F.regexp_replace(x["raw"], r"^[$#]", "")), lambda k: F.struct(
            x["kind"].alias("kind"), x["raw"].alias("raw"), k.alias("key"),
            F.transform(
                F.regexp_extract_all(F.coalesce(_alias(k, 0), k), F.lit(fixed.TOPIC_TOKEN_PATTERN), F.lit(1)),
                lambda t: F.struct(t.alias("key"), F.array_position(keys, t).alias("place")),
            ).alias("toks"),
        )))
        ranked = F.sort_array(F.transform(keys, lambda t, i: F.struct(
            (-keyword_rank(t, weak)).alias("r"), (i + 1).cast("long").alias("place"), t.alias("key"))))
        spare = F.transform(F.slice(ranked, 1, 4), lambda z: F.struct(z["key"].alias("key"), z["place"].alias("place")))
        return F.struct(placed.alias("cands"), spare.alias("spare"))

    keys = F.array_distinct(F.filter(F.transform(tx.tokens("__text"), tx.word_key), lambda k: k != ""))
    rows = base.withColumn("f", bind(keys, found)).select(post_id, "__q", "f.spare", F.posexplode("f.cands").alias("pos", "c")).select(
        post_id, "__q", "spare", "pos", F.col("c.kind").alias("topic_type"), F.col("c.raw").alias("raw"), F.col("c.key").alias("raw_key"), F.col("c.toks").alias("toks")
    )
    rows = reduce_to_pair(rows, "raw_key", "topic_type", weak)
    rows = rows.withColumn("topic_key", tx.topic_key("topic"))
    rows = barrier(rows.withColumn("tokens", F.regexp_extract_all("topic_key", F.lit(fixed.TOPIC_TOKEN_PATTERN), F.lit(1))))
    rows = rows.withColumn("__alias", F.coalesce(_alias("topic_key", 2), F.lit(0.0)))
    scores = tx.candidate_scores("tokens", "topic_type", [F.lit(0.0), F.col("__q")], F.col("__alias"))
    rows = barrier(barrier(rows.withColumn("__s", scores)).withColumns({"__plain": F.col("__s.s0"), "__score": F.col("__s.s1")}).drop("__s"))
    key = F.col("topic_key")
    floor = tx._by_type(F.col("topic_type"), CANDIDATE_FLOOR, 0.50)
    floor = F.when(one_of(key, ENT), F.least(floor, F.lit(0.34))).when(F.col("__alias") > 0, F.least(floor, F.lit(0.38))).otherwise(floor)
    rows = rows.withColumn("__ok", acceptable("topic", "topic_type", "topic_key", "tokens", "__plain", weak) & (F.col("__score") >= floor))
    rows = barrier(rows).where("__ok")
    rows = rows.groupBy(post_id, "topic_key").agg(
        F.min_by(F.struct("pos", "raw", "topic", "topic_type"), "pos").alias("r")
    ).select(post_id, "topic_key", "r.*")
    per_post = Window.partitionBy(post_id)
    rows = rows.withColumn("__better", F.max((F.col("topic_type") != "keyword").cast("int")).over(per_post))
    rows = rows.where((F.col("__better") == 0) | (F.col("topic_type") != "keyword"))
    rows = rows.withColumn("position", F.row_number().over(per_post.orderBy("pos")))
    return rows.where(F.col("position") <= F.when(F.col("__better") == 0, 5).otherwise(15)).select(
        post_id, "position", F.col("raw").alias("topic_text"), "topic", "topic_type", "topic_key"
    )


def post_features(df: DataFrame, text: str, engagement: Column) -> DataFrame:
    """Feature row of a post without its topics: staged projections in one stage, no shuffle."""
    keep = [F.col(x) for x in df.columns]
    base = df.withColumn("__t", tx.collapse_ws(text))
    base = base.select(
        *keep, "__t", tx.tokens("__t").alias("tokens"), tx.urls("__t").alias("urls"), tx.hashtags("__t").alias("hashtags"),
        tx.cashtags("__t").alias("cashtags"), tx.handles("__t").alias("mentions"), tx.sentiment("__t").alias("mood"),
    ).withColumn("domains", tx.domains("urls")).withColumn("token_count", F.size("tokens"))
    return base.select(
        *keep, "token_count", "tokens", "hashtags", "cashtags", "mentions", "urls", "domains",
        tx.rule_tags("__t", "tokens", "hashtags", "cashtags", "domains").alias("tags"), F.slice("tokens", 1, 3).alias("key_phrases"),
        tx.quality_score("__t", "token_count", F.size("urls") > 0, engagement).alias("quality_score"),
        tx.short_sha1("__t", 24).alias("fingerprint"), F.col("mood.label").alias("sentiment_label"),
        F.col("mood.positive").alias("positive"), F.col("mood.negative").alias("negative"), F.col("mood.neutral").alias("neutral"),
    )
