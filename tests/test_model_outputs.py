import json

from pyspark.sql import functions as F

from tidegauge.operators import model_outputs as mo

SOURCE = [{"url": "https://www.A.com/x", "title": "t", "snippet": "s", "published_at": "2024-01-02T03:04:05Z"},
          {"url": "no url", "title": "t2", "snippet": "s2", "published_at": "some day"}]


def run(spark, payloads, **options):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    out = mo.candidates(spark.createDataFrame(rows, "id long, p string"), "id", "p", ["joke", "pun"], **options)
    return sorted(out.collect(), key=lambda r: (r.id, -1 if r.place is None else r.place))


def test_payloads_without_candidates_have_a_reason(spark):
    got = run(spark, [None, "", '{"candidates":', "[1]", "7", {"candidates": {"a": 1}}, {"other": []}, {"candidates": []}])
    assert [r.reason for r in got] == ["not_json"] * 3 + ["no_list"] * 4 + ["empty_list"] and all(r.place is None and r.candidate_key is None for r in got)


def test_fields_of_any_kind(spark):
    def one(**fields):
        return {"candidates": [{"provisional_name": "a b", "summary": " x \n y ", "evidence": SOURCE, **fields}]}

    values = [0.4, "70", "  ", None, True, False, [1], {"a": 1}, "1e400", "abc", -3, 250, 10**30]
    got = run(spark, [one()] + [one(confidence=v, meme_score=v) for v in values])
    assert [r.confidence for r in got] == [0.5, 0.4, 0.7, 0.0, 0.0, 1.0, 0.0, 0.5, 0.5, 0.5, 0.5, 0.0, 1.0, 1.0]
    assert [r.meme_score for r in got] == [50.0, 40.0, 70.0, 0.0, 0.0, 100.0, 0.0, 50.0, 50.0, 50.0, 50.0, 0.0, 100.0, 100.0]
    first = got[0]
    assert (first.summary, first.evidence_count, first.domains) == ("x y", 2, ["a.com", "unknown"]) and first.first_seen_at == first.last_seen_at
    kinds = run(spark, [one(provisional_name=n, summary=s) for n, s in ((7, "s"), (None, "s"), ("“Big”—dog: run!", "s"), ("?!", "s"), ("n", 5), ("n", " "))])
    assert [(r.name, r.reason) for r in kinds] == [
        ("Narrative 1", None), ("Narrative 1", None), ("Big dog run", None), ("", "no_name"), ("n", "no_summary"), ("n", "no_summary")]


def test_keys_are_unique_beside_names_that_look_numbered(spark):
    names = ["dog run", "Dog Run", "dog run 2", "dog-run", "x", "дом", "дом"]
    rows = [{"provisional_name": n, "summary": "s", "evidence": SOURCE if n != "x" else SOURCE[:1]} for n in names]
    got = run(spark, [{"candidates": rows}, {"candidates": rows[:1]}], limit=7)
    keys = [r.candidate_key for r in got]
    assert keys[:5] == ["dog-run", "dog-run-2", "dog-run-2-2", "dog-run-3", None] and got[4].reason == "thin_evidence"
    assert keys[6] == keys[5] + "-2" and len(keys[5]) == 8 and keys[7] == "dog-run"  # another payload counts on its own
    assert len(run(spark, [{"candidates": rows}], limit=2)) == 2


def test_evidence_of_changing_shape(spark):
    entries = [None, 3, "x", [], {"url": "u"}, {"url": "u", "title": "", "snippet": "s"}, {"url": 5, "title": "t", "snippet": "s"}]
    got = run(spark, [{"candidates": [{"summary": "s", "evidence": e}, None, 4]} for e in (entries, "text", {"a": 1}, entries + SOURCE)])
    assert [(r.reason, r.evidence_count) for r in got if r.place == 0] == [("thin_evidence", 0)] * 3 + [(None, 2)]
    assert {r.reason for r in got if r.place} == {"no_summary"}
    key = [r for r in got if r.id == 3 and r.place == 0][0].evidence[0].evidence_key
    assert key == spark.range(1).select(F.substring(F.sha1(F.lit("https://www.A.com/x\nt\ns")), 1, 16)).first()[0]


def test_payloads_are_parsed_once(spark, tmp_path):
    rows = [(1, json.dumps({"candidates": [{"provisional_name": "a b", "summary": "x", "evidence": SOURCE}]}))]
    spark.createDataFrame(rows, "id long, p string").write.parquet(str(tmp_path / "landed"))
    out = mo.candidates(spark.read.parquet(str(tmp_path / "landed")), "id", "p", ["joke", "pun"])
    assert "landed" not in "".join(out.inputFiles()) and out.first().candidate_key == "a-b"
