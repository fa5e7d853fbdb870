"""Publication of a run that spans several tables: readers follow one log row that is written last, so they never see half a run.

Every attempt writes folders of its own.  The log gets one row (one file) per attempt when all its tables are there; until then, and for
attempts that failed, nothing points at the folders.  One publisher at a time writes a root.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.session import drop_scratch
from tidegauge.sources.datasets import stored_table

LOG = "run_log"
_LOG_SCHEMA = "seq long, run_id string, status string, reason string, paths map<string, string>, rows map<string, long>"


class PublicationError(ValueError):
    """A table of the run holds fewer rows than promised."""


def log_of(spark: SparkSession, root: str) -> DataFrame:
    """All attempts: ``seq, run_id, status`` (published, failed), ``reason, paths, rows``; empty before the first one."""
    log = stored_table(spark, f"{root}/{LOG}")
    return spark.createDataFrame([], _LOG_SCHEMA) if log is None else log


def publish(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], least: dict[str, int] | None = None) -> int:
    """Write all tables of a run, then make them visible together; returns the place in the log.

    Publishing a run again replaces it.  An error in any table, or one with fewer rows than ``least`` asks, is logged as failed and raised;
    what readers see stays as it was."""
    for name in (run_id, *tables):
        if name == LOG or not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"{name!r} is no name for a run or table")
    attempt, paths, rows = uuid.uuid4().hex, {}, {}
    last = log_of(spark, root).agg(F.max("seq")).first()[0]
    seq = 1 if last is None else last + 1

    def note(status: str, reason: str | None) -> None:
        spark.createDataFrame([(seq, run_id, status, reason, paths, rows)], _LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{LOG}")

    try:
        for name, df in tables.items():
            paths[name] = f"{name}/run_id={run_id}/attempt={attempt}"
            df.write.parquet(f"{root}/{paths[name]}")
            rows[name] = spark.read.parquet(f"{root}/{paths[name]}").count()  # from the footers
            if rows[name] < (least or {}).get(name, 0):
                raise PublicationError(f"{name} has {rows[name]} rows, {least[name]} are the least")
    except Exception as error:
        note("failed", type(error).__name__)
        raise
    note("published", None)
    return seq


def visible_runs(spark: SparkSession, root: str) -> DataFrame:
    """The attempt that counts for every published run."""
    good = log_of(spark, root).where("status = 'published'")
    return good.groupBy("run_id").agg(F.max_by(F.struct("seq", "paths", "rows"), "seq").alias("s")).select("run_id", "s.*")


def read_run(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame | None:
    """A table of a run (of the one published last, if none is named); None where no such run or table is published.

    Tables that must belong together are read through ``read_tables``: another run may be published between two calls."""
    return read_tables(spark, root, run_id).get(table)


def read_tables(spark: SparkSession, root: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """All tables of one published attempt, from one look at the log."""
    runs = visible_runs(spark, root)
    row = (runs.where(F.col("run_id") == run_id) if run_id is not None else runs).orderBy(F.desc("seq")).first()
    return {} if row is None else {name: spark.read.parquet(f"{root}/{path}") for name, path in row["paths"].items()}


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Remove the folders of failed and replaced attempts and of all but the ``keep`` runs published last; returns their paths.

    The log keeps the rows of the attempts; readers of removed runs must have finished."""
    if keep < 1:
        raise ValueError("at least the current run stays")
    held = {r["seq"] for r in visible_runs(spark, root).orderBy(F.desc("seq")).limit(keep).collect()}
    gone = [p for r in log_of(spark, root).collect() if r["seq"] not in held for p in r["paths"].values()]  # a row per attempt
    for path in gone:
        drop_scratch(spark, f"{root}/{path}")
    return sorted(gone)
