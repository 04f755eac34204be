"""Operator 5: secrets in texts, by an incremental ledger of content-addressed blobs.

Every version of a document is a blob, named by the SHA-256 of its text. The ledger has a row for
each blob and rule version that has been scanned, with the spans found. A run scans only pairs that
the ledger does not have, each distinct text once, appends them, and joins findings back to all
documents with that text. Only built-in functions are used: matches are marked by
replacement, and the lengths of the pieces around the marks give the spans.

Defined results: a NULL text is empty and has no findings; equal texts have equal findings; rows
that repeat a document id are all returned; NULL ids are kept; other columns are ignored. Spans
count code points, the end excluded. Two runs must not append to one ledger at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import empty_text

_MARK, _OTHER = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `group` must have `least` characters or the match is dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}-v{self.version}"


# Patterns of the kinds: fixed values. Runs shorter than the bound never hold a longer one, so hex
# and access may carry it in the pattern.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULES = BASE + EXTRA

_LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def spans(text: Column, rule: Rule) -> Column:
    """All (start, end) of a rule in a text, leftmost and not overlapping."""
    plain = F.translate(text, _MARK, _OTHER)
    parts = F.split(F.regexp_replace(plain, rule.pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    # (length, whether it counts) of each piece; matches are every second one.
    pieces = F.transform(
        parts,
        lambda p, i: F.struct(
            F.char_length(p).alias("n"),
            (
                (i % 2 == 1)
                & (F.char_length(F.regexp_extract(p, rule.pattern, rule.group)) >= rule.least)
            ).alias("hit"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state, piece):
        end = state["at"] + piece["n"]
        span = F.struct(state["at"].alias("start"), end.alias("end"))
        found = F.when(piece["hit"], F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    walked = F.aggregate(pieces, start, step, lambda state: state["found"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), walked).otherwise(empty)


def read_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(path)


def create_ledger(spark, path: str) -> None:
    """An empty ledger."""
    spark.createDataFrame([], _LEDGER).write.mode("append").parquet(path)


def scan_new(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan blobs and rule versions that the ledger lacks, and append them."""
    spark = docs.sparkSession
    text = empty_text()
    rows = docs.select(blob_of(text).alias("blob"), text.alias("text"))
    names = F.array(*(F.lit(r.name) for r in rules))
    known = read_ledger(spark, ledger).where(F.col("rule").isin([r.name for r in rules]))
    if known.isEmpty():
        rows = rows.withColumn("todo", names)
    else:
        seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        rows = rows.join(seen, "blob", "left").withColumn("todo", todo).drop("seen")
        rows = rows.where(F.size("todo") > 0)
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    found = [
        F.when(
            F.array_contains("todo", r.name),
            F.struct(F.lit(r.name).alias("rule"), spans(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    scanned = blobs.select("blob", F.explode(F.array(*found)).alias("f")).where("f is not null")
    scanned.select("blob", "f.rule", "f.spans").write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind>, spans per kind) of every document, from the ledger."""
    current = read_ledger(docs.sparkSession, ledger).where(
        F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0)
    )
    by_blob = current.groupBy("blob").agg(
        *(F.max(F.when(F.col("rule") == r.name, F.col("spans"))).alias(r.kind) for r in rules)
    )
    paths = docs.select("doc_id", blob_of(empty_text()).alias("blob"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return paths.join(by_blob, "blob", "left").select(
        "doc_id", *(F.coalesce(r.kind, empty).alias(r.kind) for r in rules)
    )


def listed(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans of the rules, by start, then in the order of the rules."""
    def labelled(place: int, kind: str) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(place).alias("place"),
                F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("label"),
            ),
        )

    parts = [labelled(place, r.kind) for place, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["label"]), ",")


def secret_report(docs: DataFrame, ledger: str) -> DataFrame:
    """Scan what is new, then one row per document with counts, digest and spans."""
    scan_new(docs, ledger)
    counts = [F.size(r.kind).cast("bigint").alias(f"n_{r.kind}") for r in RULES]
    return findings(docs, ledger).select(
        "doc_id",
        *counts,
        F.sha2(F.encode(listed(BASE), "UTF-8"), 256).alias("base_sha256"),
        listed(RULES).alias("spans"),
    )
