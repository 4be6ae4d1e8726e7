"""Secret scans with an incremental blob ledger."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.llm.common import slices
from replicalens.session import materialize

#: ``rule`` is a rule's kind and version, as ``Rule.name`` has them.
LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped.

    ``hints``: lower-case strings of which one must be in the lower-cased text for the pattern to be tried at all.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Patterns and lengths of the first three rules are fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True,
         hints=("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("hosted", r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", hints=("gh", "xox", "aiza")),
    Rule("login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/:@]++@[^\s/]+", version=2, hints=("://",)),
)
RULES = BASE + MORE


def _scan(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))) for i, r in enumerate(rules)]
        for batch in slices(batches, 1):
            found = []
            for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                low, spans = text.lower(), []
                for i, rule, pattern in compiled:
                    if rule.name in wanted and (not rule.hints or any(h in low for h in rule.hints)):
                        spans += [(m.start(), i, m.end()) for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
                found.append([{"rule": rules[i].name, "start": a, "end": b} for a, i, b in sorted(spans)])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], names=["blob", "rules", "findings"])

    return run


def scan_new(blobs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``blobs`` (blob, text; one row per blob) that ``ledger`` lacks."""
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("rules", every)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).filter("size(rules) > 0")
    return todo.select("blob", "text", "rules").mapInArrow(_scan(rules), LEDGER)


def scan_versions(docs: DataFrame, ledger_path: str | None = None, rules: Sequence[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, findings) for every row of ``docs``, each a version of its path.

    A version's blob is the SHA-256 of its text (null: empty). The ledger has what earlier scans found per blob and which rule versions they
    used; only blobs with unseen rule versions are read again, once each however many paths have them, and the new rows are appended to it
    at ``ledger_path`` (none: a ledger of this run only). Findings are joined back to all paths by blob, which adaptive execution splits
    if one blob is hot. Spans are code points, end exclusive, in order of start, then rule. A rule whose version rose is scanned anew, and only
    findings of the given rules' kinds are reported. Repeated rows come back as often as they come in; an empty table gives no rows.
    """
    spark = docs.sparkSession
    versions = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    versions = versions.withColumn("blob", F.sha2("text", 256))
    ledger = None
    if ledger_path is not None:
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    new = scan_new(versions.select("blob", "text").dropDuplicates(["blob"]), ledger, rules)
    if ledger_path is None:
        ledger = materialize(new, "ledger")
    else:
        new.write.mode("append").parquet(ledger_path)
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    order = F.array(*[F.lit(r.name) for r in rules])
    spans = F.array_distinct(F.flatten(F.collect_list("findings")))  # a repeated scan adds nothing
    spans = F.transform(spans, lambda f: F.struct(f["start"].alias("start"), F.array_position(order, f["rule"]).alias("n"), f["end"].alias("end"), f["rule"].alias("rule")))
    spans = F.array_sort(F.filter(spans, lambda f: f["n"] > 0))  # of these rules and versions only
    spans = F.transform(spans, lambda f: F.struct(F.substring_index(f["rule"], "@", 1).alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    found = ledger.groupBy("blob").agg(spans.alias("findings"))
    return versions.select("path", "blob").join(found, "blob").select("path", "blob", "findings")


def spelled(findings, kinds: Sequence[str] | None = None):
    """kind:start:end of the findings, comma-joined; ``kinds`` selects."""
    if kinds is not None:
        findings = F.filter(findings, lambda f: f["kind"].isin(list(kinds)))
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def counted(findings, kind: str):
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("bigint")
