import os

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import publication as pb


def tables(spark, n, bad=False):
    rows = spark.range(n).withColumn("run", F.lit(n))
    second = rows.select(F.when(F.col("id") >= n // 2, F.raise_error(F.lit("lost source"))).otherwise(F.col("id")).alias("id")) if bad else rows
    return {"assets": rows, "links": second}


def seen(spark, root, run_id=None):
    return {k: v.count() for k, v in pb.read_tables(spark, root, run_id).items()}


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    assert seen(spark, root) == {} and pb.read_run(spark, root, "assets") is None
    with pytest.raises(Exception, match="lost source"):
        pb.publish(spark, root, "r0", tables(spark, 4, bad=True))
    assert seen(spark, root) == {}  # even before the first good run
    pb.publish(spark, root, "r1", tables(spark, 5))
    with pytest.raises(Exception, match="lost source"):
        pb.publish(spark, root, "r2", tables(spark, 8, bad=True))
    assert os.path.exists(f"{root}/assets/run_id=r2")  # its first table was written
    assert seen(spark, root) == {"assets": 5, "links": 5} and seen(spark, root, "r2") == {}
    with pytest.raises(pb.PublicationError):
        pb.publish(spark, root, "r1", tables(spark, 3), least={"links": 4})
    assert seen(spark, root, "r1") == {"assets": 5, "links": 5}  # a failed repeat leaves the run as it was
    log = pb.log_of(spark, root).orderBy("seq").collect()
    assert [(r.run_id, r.status) for r in log] == [("r0", "failed"), ("r1", "published"), ("r2", "failed"), ("r1", "failed")]


def test_a_repeat_replaces_and_readers_keep_their_attempt(spark, tmp_path):
    root = str(tmp_path)
    pb.publish(spark, root, "r1", tables(spark, 5))
    pb.publish(spark, root, "r2", tables(spark, 6))
    reader = pb.read_tables(spark, root)
    assert pb.publish(spark, root, "r1", tables(spark, 7)) == 3
    assert seen(spark, root, "r1") == {"assets": 7, "links": 7} == seen(spark, root)  # the one published last
    assert reader["assets"].count() == reader["links"].count() == 6
    gone = pb.prune(spark, root, keep=1)
    assert len(gone) == 4 and seen(spark, root) == {"assets": 7, "links": 7}
    with pytest.raises(ValueError):
        pb.prune(spark, root, keep=0)


@pytest.mark.parametrize("name", ["", "a/b", pb.LOG])
def test_names_that_are_no_folders(spark, tmp_path, name):
    with pytest.raises(ValueError):
        pb.publish(spark, str(tmp_path), "r1", {name: spark.range(1)})
