"""Corpus pipeline: quality filter, near copies, benchmark decontamination, source mix, token files.

Each stage takes (spark, docs, sf_dir), reads its side tables from sf_dir, and returns what it keeps with the columns of documents; the
last returns the documents of the token files.  ``run`` writes every stage as Parquet in the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import decontaminate, mixing, ngram_join, quality, tokens
from tidegauge.llm.queries import tokenizer_file
from tidegauge.llm.shared import file_store, given, materialise, row_key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant accepts.  It learns from the labelled ones among all documents given."""
    labels = given(spark, sf_dir, "labels")
    table = materialise(quality.statistics_table(docs, ["doc_id"]), "statistics")
    return quality.accepted(docs, quality.fit(quality.examples(table, labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    keyed = docs.withColumn("__doc", row_key())
    hits = decontaminate.contained_items(keyed, given(spark, sf_dir, "benchmark"), key="__doc").select(F.col("doc").alias("__doc")).distinct()
    return keyed.join(materialise(hits, "benchmark-hits"), "__doc", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times)."""
    rows = mixing.prepared(docs)
    sizes = materialise(rows.select("__source", "__size", "__b"), "sizes")
    mixed = mixing.apply(rows, mixing.plan(sizes))
    return mixed.where("__copies > 0").select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).drop("__copy")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the token files."""
    store = file_store(spark, "tokens")
    return tokens.read_documents(tokens.write_shards(docs, store, tokenizer_file()), store)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: Discriminant scores, MinHash candidates and byte-pair merges have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
