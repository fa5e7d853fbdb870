import duckdb
import pytest

from tidegauge.llm import phrase_mining
from tidegauge.llm.queries import ORACLES, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def oracle(path, least=30, first=2000):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    sql = ORACLES["op12_collocations"].replace("n >= 30", f"n >= {least}").replace("rank <= 2000", f"rank <= {first}")
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql})").fetchall())


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert rows(QUERIES["op12_collocations"](spark, folder)) == oracle(f"{folder}/documents.parquet")


@pytest.mark.parametrize("share", [0.0, 0.05, 1.0])
def test_any_sample_gives_the_same(spark, sf_dir, share):
    """Without a sample every frequent phrase is a failure of the border, level by level."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows(phrase_mining.collocations(docs, least=5, first=100, share=share)) == oracle(f"{sf_dir}/documents.parquet", 5, 100)


def test_odd_rows(make, tmp_path):
    texts = [None, "", " ", ".,;", "A b C d E", "a b c d e", "a b. c d e", "a\tb\x0bc d", "é É a b", "x " * 200, "a b c d e" * 3, "\x00 z \x00 z", "q" * 5000 + " r"]
    table = make([(None if i % 3 == 0 else i, t, (None, "und", "xx")[i % 3], "clash", 1) for i, t in enumerate(texts * 3)],
                 "doc_id long, text string, lang string, phrase string, n int").repartition(4)
    table.select("text", "lang").write.parquet(f"{tmp_path}/t")
    for least in (1, 2, 6):
        assert rows(phrase_mining.collocations(table, least=least, first=50, share=0.2)) == oracle(f"{tmp_path}/t/*.parquet", least, 50)


def test_counts_beyond_64_bits(make):
    """The score's product is taken in 38 digits."""
    table = make([("aa", "x y", 2, 5_000_000_000_000), ("aa", "x", 1, 6_000_000_000_000), ("aa", "y", 1, 7_000_000_000_000)], "lang string, phrase string, words int, n long")
    sizes = table.where("words = 1").groupBy("lang").sum("n").toDF("lang", "n")
    row = phrase_mining.ranked(table, sizes).first()
    assert row.score == 2_000_000 * 5_000_000_000_000 // 13_000_000_000_000


def test_empty_table(make):
    assert phrase_mining.collocations(make([], "doc_id long, text string, lang string")).count() == 0
