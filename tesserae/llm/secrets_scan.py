"""Secret scans over content-addressed versions, with a ledger of what has been scanned.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The base patterns, then those that the method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = 1
SALTS = 16
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Code-point spans of one rule: matches and the text between them, added up."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPAN)
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, first, step, lambda acc: acc["out"])).otherwise(none)


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Every rule's spans, by start, then by the rules' order."""
    return F.array_sort(F.concat(*(_spans(text, r, k) for k, r in enumerate(rules))))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every span (overlapping ones as one) replaced by the mask."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, end)).otherwise(text)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: int = RULE_VERSION) -> DataFrame:
    """The ledger (blob, rule_version, spans) after scanning the blobs it lacks under this version.

    docs: doc_id (the path) and text; a null text is the empty blob.  A blob is named by
    the SHA-256 of its text, so copies and unchanged versions are scanned once, through
    the path with the smallest doc_id; only hashes and ids are gathered to choose it.
    What is found is written to the shared folder as a further part of the ledger, which
    is only ever appended to.  An empty table adds nothing.  Texts are scanned whole; the
    time for one grows with the square of its number of findings.
    """
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    first = named.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    first = first.withColumnRenamed("blob", "first_blob")
    unseen = named.join(first, (named.blob == first.first_blob) & named.doc_id.eqNullSafe(first.first_id))
    found = unseen.select("blob", F.lit(version).alias("rule_version"), all_spans(F.col("text"), rules).alias("spans")).dropDuplicates(["blob"])
    part = saved(found, "secret-ledger")
    return part if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(part)


def scan_increments(docs: DataFrame, increments: list[Column], rules: tuple[Rule, ...] = RULES, version: int = RULE_VERSION) -> DataFrame:
    """The ledger after scanning the rows of docs for which each condition holds, one after another.

    Blobs that an earlier increment holds aren't scanned again.
    """
    ledger = None
    for chosen in increments:
        ledger = scan(docs.where(chosen), ledger, rules, version)
    return ledger


def findings(docs: DataFrame, ledger: DataFrame, version: int = RULE_VERSION) -> DataFrame:
    """docs with its blob and spans, from the ledger; every row of docs, repeated ones too.

    Columns named blob and spans are replaced.  The rows of one blob are dealt over SALTS
    tasks by their doc_id, so that a text of very many rows doesn't meet in one.
    """
    docs = docs.drop("blob", "spans", "hit_salt")
    named = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    hits = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("hit_blob"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("hit_salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    return named.join(hits, (named.blob == hits.hit_blob) & (salt == F.col("hit_salt")), "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN))).drop("hit_blob", "hit_salt")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans, and all spans."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
