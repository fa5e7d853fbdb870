import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm.conftest import prose  # noqa: E402
from tidegauge.llm import ngram_join, quality  # noqa: E402
from tidegauge.llm.decontaminate import shingle_set  # noqa: E402
from tidegauge.llm.queries import ORACLES, QUERIES  # noqa: E402


def test_stages_keep_columns_and_do_their_work(spark, sf_dir, documents):
    docs = documents.unionByName(spark.createDataFrame([(None, None, None, None, None), (77_000, "", "en", "s", 0)], documents.schema))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.materialise(stage(spark, seen[-1], sf_dir), "stage"))
    good, single, clean, mixed, out = seen[1:]
    for df in (good, single, clean, mixed):
        assert df.columns == documents.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    known = [(labels[d], d in ids(good)) for d in ids(docs) & set(labels)]
    assert sum(bool(y) == k for y, k in known) / len(known) > 0.95
    classes = {r.rid: r.class_id for r in ngram_join.classes(good).collect()}
    assert ids(single) - {None} == {d for d, c in classes.items() if d == c and d in ids(good)}
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in single.collect() if any(i and len(i & shingle_set(r.text)) >= 0.8 * len(i) for i in items)}
    assert ids(clean) == ids(single) - dirty and dirty
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert words(mixed) == pytest.approx(1.5 * words(clean), rel=0.01)
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert out.count() == mixed.count() and out.agg({"start": "min"}).first()[0] == 0


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, con.execute(
        f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()))


def test_no_model_without_labels(spark, make):
    assert quality.fit(make([], "label int, x array<double>")) is None and prose(2) == "w0x0 w0x1"
