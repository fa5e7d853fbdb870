import hashlib
import re

from tidegauge.llm import secret_scan as ss
from tidegauge.llm.queries import op9
from tidegauge.session import scratch_path

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    return spans + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def test_query_matches_patterns(spark, sf_dir, documents):
    texts = dict(documents.select("doc_id", "text").collect())
    rows = op9(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert set(joined(want).split(",")) <= set(r.spans.split(","))


TRICKY = [None, "", "password: token: abcdefghijklmnop", "TOKEN='" + "a" * 11, "Api_Key = \"" + "Z" * 12, "AKIAAKIA" + "X" * 9, "AKIA" + "0" * 14, "🙂é token=abcdefabcdef0123",
          "secret=secret=secret=abcdefabcdefabcd", "0123456789abcdef" * 2000, "x" * 300_000 + " passwd=" + "9" * 20, "password=short token=" + "q" * 30,
          "ghp_" + "A" * 36, "-----BEGIN RSA PRIVATE KEY-----", "apikey:\n" + "a" * 20, "tokenn = aaaaaaaaaaaaaaaa"]


def spans_by_text(spark, make, texts):
    docs = make([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    ledger = ss.Ledger(spark, scratch_path(spark, "ledger"))
    return ss.scan_paths(docs, ledger, ["doc_id"]), ledger, docs


def test_tricky_texts(spark, make):
    out, _, _ = spans_by_text(spark, make, TRICKY)
    for r in out.collect():
        mine = [(s["start"], k, rule.kind, s["end"]) for k, rule in enumerate(ss.BASE_RULES) for s in r[rule.kind]]
        assert joined(mine) == joined(base(TRICKY[r.doc_id])), TRICKY[r.doc_id]
    kinds = {r.doc_id: [rule.kind for rule in ss.MORE_RULES if r[rule.kind]] for r in out.collect()}
    assert kinds[12] == ["github"] and kinds[13] == ["pem"]


def test_ledger_scans_each_blob_and_rule_version_once(spark, make):
    out, ledger, docs = spans_by_text(spark, make, ["token=abcdefabcdef0123", "token=abcdefabcdef0123", "clean", None, ""])
    assert out.count() == 5
    rows = ledger.read().count()
    assert rows == 3 * len(ss.RULES)
    assert ledger.unseen(docs, "text", ss.RULES).count() == 0
    more = docs.union(make([(9, "fresh AKIA" + "B" * 20, "x")], "doc_id long, text string, blob string"))
    assert [r.todo for r in ledger.unseen(more, "text", ss.RULES).collect()] == [[r.kind for r in ss.RULES]]
    newer = tuple(ss.Rule(r.kind, r.version + (r.kind == "hex"), r.pattern, r.group, r.least) for r in ss.RULES)
    todo = ledger.unseen(docs, "text", newer).collect()
    assert len(todo) == 3 and {tuple(r.todo) for r in todo} == {("hex",)}
    ledger.update(docs, "text", newer)
    assert ledger.read().count() == rows + 3 and ledger.unseen(docs, "text", newer).count() == 0
    assert ss.scan_paths(docs.limit(0), ledger, ["doc_id"]).count() == 0
