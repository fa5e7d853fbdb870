"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import alignment, collision_ann, decontaminate, mixing, ngram_join, phrase_mining, pseudonyms, quality, secret_scan, spans, substring_dedup, tokens, warc
from tidegauge.llm.shared import file_store, given, materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shingles_sql(table: str, key: str) -> str:
    """Five-word shingles of a table in the oracle's SQL: (key, list of different ones)."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    return f"""(SELECT {key}, list_sort(list_distinct(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM (SELECT {key}, {words} AS w FROM {table}))"""


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_streams")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the Arrow stream files."""
    store = file_store(spark, "tokens")
    return tokens.read_documents(tokens.write_shards(given(spark, sf_dir, "documents"), store, tokenizer_file()), store)


@query("op3_benchmark_hits", f"""
    WITH d AS (SELECT doc_id, unnest(g) AS s FROM {shingles_sql('documents', 'doc_id')}),
    b AS (SELECT item_id, len(g) AS n, unnest(g) AS s FROM {shingles_sql('benchmark', 'item_id')})
    SELECT doc_id, item_id, count(*) / any_value(n) AS containment FROM d JOIN b USING (s) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, containment of every document and benchmark item it contains."""
    found = decontaminate.contained_items(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "containment")


@query("op4_repeated_spans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated spans, n_removed sentences, of every document."""
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spans.removed(docs, passage=spans.PASSAGE)


@query("op5_near_copies", f"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, g FROM {shingles_sql('documents', 'doc_id')}),
    r AS MATERIALIZED (SELECT g, min(doc_id) AS rep, count(*) AS m FROM t WHERE len(g) > 0 GROUP BY g),
    x AS (SELECT rep, len(g) AS n, unnest(g) AS s FROM r),
    p AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.s = b.s AND a.rep < b.rep GROUP BY ALL
      HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
    e AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
    cc(node, c) USING KEY (node) AS (SELECT DISTINCT u, u FROM e UNION (SELECT e.u, min(o.c) FROM cc AS o JOIN e ON e.v = o.node
      JOIN recurring.cc AS mine ON mine.node = e.u GROUP BY e.u, mine.c HAVING min(o.c) < mine.c)),
    l AS (SELECT u, count(*) AS n FROM e GROUP BY u)
    SELECT doc_id, coalesce(c, rep, doc_id) AS class_id, coalesce(l.n, 0) AS n_links, coalesce(m, 1) - 1 AS n_copies
    FROM t LEFT JOIN r ON len(t.g) > 0 AND r.g = t.g LEFT JOIN cc ON cc.node = r.rep LEFT JOIN l ON l.u = r.rep""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document."""
    return ngram_join.classes(given(spark, sf_dir, "documents")).withColumnRenamed("rid", "doc_id")


@query("op6_quality_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialise(quality.statistics_table(docs, ["doc_id"]), "statistics")
    model = quality.fit(quality.examples(table, given(spark, sf_dir, "labels")))
    return quality.score_table(table, model, ["doc_id"]).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    rows = materialise(mixing.prepared(docs).drop("text", "source"), "sizes")
    mixed = mixing.apply(rows, mixing.plan(rows))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


@query("op2_pseudonyms")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_values changed, of every document."""
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pseudonyms.pseudonymised(docs).select("doc_id", "text", "n_values")


@query("op8_nearest_vectors")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ten nearest vectors of every query vector."""
    vectors = collision_ann.usable(given(spark, sf_dir, "embeddings"))
    return collision_ann.search(vectors, vectors.where("vec_id % 100 = 0"))


@query("op9_secret_spans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document, through a ledger of its own."""
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = secret_scan.scan_paths(docs, secret_scan.Ledger(spark, scratch_path(spark, "ledger")), ["doc_id"])
    return found.select(
        "doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES],
        F.sha2(secret_scan.joined_spans(secret_scan.BASE_RULES).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined_spans(secret_scan.RULES).alias("spans"))


@query("op10_warc_index", """
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
    FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest,
                 max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS m FROM pages)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the merged index of its archives."""
    index = warc.capture_index(given(spark, sf_dir, "pages"), file_store(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_token_links")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    found = alignment.align(given(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"), groups=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


@query("op12_collocations", r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS ph FROM w WHERE len(ws) > 0),
    f AS MATERIALIZED (SELECT lang, ph, count(*) AS n FROM g GROUP BY ALL),
    c AS MATERIALIZED (SELECT lang, ph, n AS a FROM f WHERE n >= 30 AND len(ph) > 1),
    i AS (SELECT lang, ph, max(a) AS m FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, len(ph)), lambda k: list_transform(range(1, len(ph) - k + 2), lambda j: ph[j:j + k - 1])))) AS ph
        FROM c WHERE len(ph) > 2) GROUP BY ALL),
    q AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM c LEFT JOIN i USING (lang, ph) WHERE m IS NULL OR 100 * m < 80 * a),
    s AS (SELECT q.lang, q.ph, q.a, k, l.n AS l, r.n AS r, CAST(2000000::HUGEINT * a // (l.n + r.n) AS BIGINT) AS score FROM q
        JOIN f l ON l.lang = q.lang AND l.ph = q.ph[1:k] JOIN f r ON r.lang = q.lang AND r.ph = q.ph[k + 1:]),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
    t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE len(ph) = 1 GROUP BY lang)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, n, score
    FROM b JOIN t USING (lang) QUALIFY rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2000 phrases of every language."""
    return phrase_mining.collocations(given(spark, sf_dir, "documents"))


@query("op11_repeated_bytes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return substring_dedup.removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
