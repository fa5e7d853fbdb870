"""Files of the shared folder, as tasks see them, and other small helpers of the training-data operators."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.session import materialise, scratch_path

ARROW_BYTES = 8 << 20

__all__ = ["FileStore", "bounded", "file_store", "given", "materialise", "row_key", "scratch_path"]


class FileStore:
    """A folder of any file system that Arrow knows (local or shared mounts, hdfs, s3, gs); picklable by its address."""

    def __init__(self, uri: str):
        self.uri = uri
        self._open = None

    def __getstate__(self):
        return {"uri": self.uri, "_open": None}

    def _at(self) -> tuple[fs.FileSystem, str]:
        if self._open is None:
            self._open = fs.FileSystem.from_uri(self.uri)
        return self._open

    def write(self, name: str, attempt: str):
        """Context-free writer: call ``commit`` with the same arguments after closing the stream."""
        system, root = self._at()
        system.create_dir(root, recursive=True)
        return system.open_output_stream(f"{root}/_{attempt}-{name}", compression=None)

    def commit(self, name: str, attempt: str) -> None:
        """A finished file gets its name in one step, so a repeated task replaces a file by an equal one."""
        system, root = self._at()
        system.move(f"{root}/_{attempt}-{name}", f"{root}/{name}")

    def read(self, name: str):
        system, root = self._at()
        return system.open_input_file(f"{root}/{name}")


def file_store(spark: SparkSession, label: str) -> FileStore:
    return FileStore(scratch_path(spark, label))


def bounded(df: DataFrame, size: int = ARROW_BYTES) -> DataFrame:
    """df; from now on its session hands Python batches of at most so many bytes (a longer row comes alone).

    Batches exist on both sides of the pipe for every running task, outside of the heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """The integer id; rows without one are told apart by their text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.lit("no id"), F.col(text)))
