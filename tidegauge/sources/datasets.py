"""Reading and writing of the datasets: landed JSON, tables, run-versioned outputs, range replacement, read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.session import drop_scratch, scratch_path

# explicit schemas of the landed datasets; nothing is inferred
SCHEMAS = {
    "posts": "id string, source string, author string, createdUtc long, fetchedAt timestamp_ntz, title string, text string, score long, numComments long, urls array<string>",
    "comments": "id string, postId string, author string, createdUtc long, text string, score long",
    "runs": "runId string, mode string, status string, startedAt timestamp_ntz, completedAt timestamp_ntz, cursor long",
    "sources": "source string, lastSuccessAt timestamp_ntz, consecutiveFailures int, backfillStatus string, hasWindowCoverage boolean",
    "public_items": "id string, sourceType string, title string, summary string, url string, createdUtc long, score long, numComments long",
    "snapshots": "id string, postUri string, fetchedAt timestamp_ntz, likeCount long, replyCount long, repostCount long, quoteCount long",
    "messages": "channel_id long, channel_name string, message_id long, timestamp timestamp_ntz, text string, views long, forward_count long, reply_count long",
}


def read_landed(spark: SparkSession, path: str, dataset: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(SCHEMAS[dataset]).option("multiLine", multi_line).json(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Partitioned scan of a relational table on a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def read_feed_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def feed_items(rows: DataFrame, source: str, columns: dict[str, Column]) -> DataFrame:
    """Feed rows in the unified public-item schema."""
    names = ("id", "title", "summary", "url", "createdUtc", "score", "numComments")
    return rows.select(F.lit(source).alias("sourceType"), *[columns.get(n, F.lit(None)).alias(n) for n in names])


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def last_runs(runs: DataFrame, started: str, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc(started), F.desc("runId")).limit(n)


def resume_cursor(runs: DataFrame, source: str, cursor: str, started: str) -> DataFrame:
    """Cursor of the latest run per source."""
    return runs.groupBy(source).agg(F.max_by(cursor, F.struct(started, cursor)).alias("cursor"))


def backlog(raw: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return raw.join(processed.select(key), key, "left_anti")


def oldest(rows: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.asc(ts), F.asc(key)).limit(n)


def channel_messages(messages: DataFrame, channel: Column, n: int) -> DataFrame:
    return messages.where(channel).orderBy(F.desc("timestamp"), F.desc("message_id")).limit(n)


def normalise_messages(rows: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Chat payloads -> flat rows with media type and link."""
    schema = "id long, chat struct<id: long, title: string>, content struct<text: string, photo: string, video: string>, views long, forwards long"
    p = rows.select(*keep, F.from_json(payload, schema).alias("p"))
    media = F.when(F.col("p.content.photo").isNotNull(), "photo").when(F.col("p.content.video").isNotNull(), "video").otherwise("text")
    return p.select(
        *keep, F.col("p.chat.id").alias("channel_id"), F.col("p.chat.title").alias("channel_name"), F.col("p.id").alias("message_id"),
        F.coalesce("p.content.text", F.lit("")).alias("text"), media.alias("media_type"), F.coalesce("p.views", F.lit(0)).alias("views"),
        F.coalesce("p.forwards", F.lit(0)).alias("forward_count"), F.concat(F.lit("https://t.example/c/"), "p.chat.id", F.lit("/"), "p.id").alias("message_url"))


def surrogate_id(*columns: str) -> Column:
    """Deterministic id in place of a sequence: the same row gets the same id in every run."""
    return F.xxhash64(*columns)


def publish_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Every table of a run under its own run folder; publishing again replaces the run."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")


def replace_days(stored: DataFrame | None, fresh: DataFrame, path: str, ts: str, start: Column, end: Column) -> None:
    """DELETE [start, end) + INSERT as an overwrite of only the touched day partitions; days left without rows are removed.

    Rows of a touched day outside the range are read back and kept.  ``stored`` is None before the first write."""
    if stored is None:
        stored = fresh.limit(0)
    day = F.to_date(ts)
    kept = stored.where((day >= F.to_date(start)) & (day <= F.to_date(end)) & ((F.col(ts) < start) | (F.col(ts) >= end)))
    rows = kept.select(*fresh.columns).unionByName(fresh).withColumn("day", day)
    # staged first: the target's partitions are both read and replaced
    stage = scratch_path(fresh.sparkSession, "replace")
    rows.write.parquet(stage)
    spark = fresh.sparkSession
    out = spark.read.schema(rows.schema).parquet(stage)
    # days that had rows in the range and have none now: dynamic overwrite would leave them
    had = stored.where((F.col(ts) >= start) & (F.col(ts) < end)).select(day.alias("day")).distinct()
    emptied = [r["day"] for r in had.join(out.select("day").distinct(), "day", "left_anti").collect()]  # a few days
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for gone in emptied:
        drop_scratch(spark, f"{path}/day={gone}")
    drop_scratch(spark, stage)


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing was written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None


def health_document(posts: DataFrame, comments: DataFrame, n_posts: int = 50) -> DataFrame:
    """Newest posts with their comments nested, as one document per source (a bounded list each)."""
    from tidegauge.operators.windows import top_n

    top = top_n(posts, ["source"], [F.col("created").desc(), F.col("id").asc()], n_posts)
    nested = comments.join(top.select("id"), comments.post_id == top.id, "left_semi").groupBy("post_id").agg(
        F.count(F.lit(1)).alias("comments"), F.max("created").alias("latest_comment"))
    joined = top.join(nested, top.id == nested.post_id, "left")
    item = F.struct((-F.unix_timestamp("created")).alias("o"), F.col("id"), F.coalesce("comments", F.lit(0)).alias("comments"))
    return joined.groupBy("source").agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["comments"].alias("comments")))).alias("document"))
