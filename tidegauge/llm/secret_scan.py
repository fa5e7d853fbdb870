"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of the text).  The ledger holds one row per blob and rule version that
was scanned, with the spans found; a run scans only blobs with an unseen (rule, version) and, of those, only the unseen rules,
appends to the ledger, and joins findings back to all paths of a blob.

Spans count code points, end exclusive.  Null texts are empty texts (one blob), without spans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPAN = "array<struct<start:long,end:long>>"
LEDGER = f"blob string, rule string, version int, spans {SPAN}"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when its ``group`` has at least ``least`` characters.  Raise ``version`` with every change."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
# Formats of common tokens that the base rules do not name.
MORE_RULES = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE_RULES + MORE_RULES


def blob_id(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of the leftmost non-overlapping matches that are long enough.

    Splitting at the pattern gives the gaps between matches, so positions are running sums of lengths: one pass, whole text."""
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+"):  # a run that is long enough is the same run; short ones never become matches
        head = pattern[:pattern.rindex("[")]
        pattern = f"{pattern[:-1]}{{{rule.least - len(head)},}}"
    gaps = F.transform(F.split(text, pattern), lambda s: F.length(s))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    steps = F.zip_with(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"))),
                       groups, lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.coalesce(F.length(g), F.lit(0)).alias("g")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["n"]).alias("end"))
        kept = F.when(x["g"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + x["n"]).alias("at"), kept.alias("spans"))

    found = F.aggregate(steps, zero, step, lambda acc: acc["spans"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text, and ``todo``: rule names to run)."""
    spans = [F.when(F.array_contains("todo", r.kind), F.struct(
        F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans"))) for r in rules]
    return blobs.select("blob", F.inline(F.filter(F.array(*spans), lambda x: x.isNotNull())))


class Ledger:
    """Blob ledger in a folder of Parquet; rows are only ever added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            none = self.spark.range(0)  # an empty ledger that needs no Python worker
            return none.selectExpr("CAST(NULL AS STRING) AS blob", "CAST(NULL AS STRING) AS rule", "CAST(NULL AS INT) AS version", f"CAST(NULL AS {SPAN}) AS spans")

    def unseen(self, docs: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
        """(blob, text, todo): blobs of docs with rule versions that the ledger does not have; one row per blob."""
        seen = self.read().where(F.struct("rule", "version").isin(*[F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules])).groupBy(
            "blob").agg(F.collect_set("rule").alias("seen"))
        blobs = docs.select(blob_id(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
        everything = F.array(*[F.lit(r.kind) for r in rules])
        todo = F.array_except(everything, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)

    def update(self, docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> None:
        """Scan what is new and append it (a failed run appends nothing; a repeated one finds nothing new)."""
        scan(self.unseen(docs, text, rules), rules).write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """blob, and per rule an array of its spans; only blobs with any span."""
        current = self.read().where((F.size("spans") > 0) & F.struct("rule", "version").isin(
            *[F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules]))
        return current.groupBy("blob").agg(*[F.first(F.when(F.col("rule") == r.kind, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules])


def scan_paths(docs: DataFrame, ledger: Ledger, paths: list[str], text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Path columns, blob, and an array of spans per rule, for every path (no findings: empty arrays)."""
    ledger.update(docs, text, rules)
    found = ledger.findings(rules)
    where = docs.select(*paths, blob_id(text).alias("__blob"))
    out = where.join(found, where["__blob"] == found["blob"], "left")
    return out.select(*[where[p] for p in paths], where["__blob"].alias("blob"), *[F.coalesce(found[r.kind], F.array().cast(SPAN)).alias(r.kind) for r in rules])


def joined_spans(rules: Sequence[Rule]) -> Column:
    """``kind:start:end`` of all spans by start, then by the order of the rules, comma-joined."""
    def tagged(k: int, rule: Rule) -> Column:
        return F.transform(F.col(rule.kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(k).alias("k"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))

    every = F.concat(*[tagged(k, r) for k, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


__all__ = ["BASE_RULES", "Ledger", "RULES", "Rule", "blob_id", "joined_spans", "scan", "scan_paths", "spans_of"]
