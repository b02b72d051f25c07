"""Secret scans over an incremental, content-addressed ledger. DataFrame functions only.

Every version of every path is a blob, named by the SHA-256 of its bytes. A ledger remembers which (blob, rule
version) pairs were scanned and what was found; a run scans the unseen pairs only, one text for each blob, and joins
the findings back to every path and version that holds the blob.

Positions come without a user function: ``split`` gives what lies between a pattern's matches and
``regexp_extract_all`` the matches, so running sums of both lengths are the matches' places in code points.

Defined cases: a null text is the empty blob, which holds nothing; repeated rows share a blob and each gets its
findings; an empty table gives no rows; other columns are ignored; null ids stay rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_small, fresh_path, materialise

RULE_VERSION = "2026-1"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # its fewest characters
    base: bool = False
    gate: str | None = None  # a cheaper pattern without which no match of the rule can be in a text; the rule's own if None
    fast: str | None = None  # a cheaper pattern with the same matches of the asked length


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, gate=r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True, gate="AKIA"),
    # runs are maximal, so no shorter run hides one of 24
    Rule("hex", r"[0-9a-f]+", 0, 24, True, gate=r"[0-9a-f]{24}", fast=r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", gate=r"gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", gate="eyJ"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", gate=r"xox[abprs]-"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", gate="-----BEGIN"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", gate="://"),
)


def gate_of(rules: tuple[Rule, ...]) -> str:
    """One cheap look at a text: without a match of this none of the rules can match."""
    return "|".join(f"(?:{r.gate or r.pattern})" for r in rules)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, kind, kind_no, base, start, end) of the texts of (blob, text). ``end`` is exclusive."""
    hits = blobs.filter(F.col("text").rlike(gate_of(rules)))
    parts = []
    for no, rule in enumerate(rules):
        pattern = rule.fast or rule.pattern
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        size = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)) if rule.group else found
        parts.append(F.when(F.col("text").rlike(pattern), F.struct(
            F.lit(no).alias("kind_no"),
            F.arrays_zip(
                F.transform(F.split("text", pattern, -1), lambda x: F.length(x)).alias("gap"),
                F.transform(found, lambda x: F.length(x)).alias("len"),
                F.transform(size, lambda x: F.length(x)).alias("size"),
            ).alias("pieces"),
        )))
    kinds = hits.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("k"))
    flat = kinds.select("blob", "k.kind_no", F.posexplode("k.pieces").alias("pos", "p"))
    upto = Window.partitionBy("blob", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # the gap after the last match has no match of its own: its len is null and it is dropped below
    end = F.sum(F.col("p.gap").cast("long") + F.coalesce(F.col("p.len"), F.lit(0))).over(upto)
    spans = flat.select("blob", "kind_no", F.col("p.len").alias("len"), F.col("p.size").alias("size"), end.alias("end"))
    table = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.base).alias("base"), F.lit(r.least).alias("least")) for r in rules])
    spans = spans.filter("len is not null").withColumn("rule", F.element_at(table, F.col("kind_no") + 1)).filter("size >= rule.least")
    return spans.select("blob", F.col("rule.kind").alias("kind"), "kind_no", F.col("rule.base").alias("base"), (F.col("end") - F.col("len")).alias("start"), "end")


class BlobLedger:
    """A folder of batches. A batch lists the pairs that it scanned and their findings; both are written before
    the batch's marker, and batches without a marker are not read. A batch with a marker is never written again."""

    SEEN = "blob string, rule_version string"
    FOUND = "blob string, rule_version string, spans array<struct<start:bigint,kind_no:int,end:bigint,kind:string,base:boolean>>"

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        p, fs = self._fs("done")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, what: str) -> DataFrame:
        schema = self.SEEN if what == "seen" else self.FOUND
        paths = [f"{self.path}/{what}/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, seen: DataFrame, found: DataFrame) -> str | None:
        """Add a batch, and its name. A batch of that name that is committed already stays as it is: a repeated run
        finds nothing unseen and adds nothing (None), and other pairs under the same name are a batch of their own."""
        done = set(self.batches())
        if batch in done:
            if seen.isEmpty():
                return None
            batch = next(name for k in count(2) if (name := f"{batch}.{k}") not in done)
        seen.write.mode("overwrite").parquet(f"{self.path}/seen/{batch}")
        found.write.mode("overwrite").parquet(f"{self.path}/found/{batch}")
        marker, fs = self._fs(f"done/{batch}")
        fs.create(marker, False).close()
        return batch


def scan_versions(versions: DataFrame, ledger: BlobLedger, batch: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger hasn't seen of (row, path, text), then join all its findings back: path, blob and spans,
    an array in the order of start and kind (empty: none). A row is a version of a path. Other rules need another
    ``rule_version``, because the ledger remembers blobs by it.

    One text for each unseen blob is read: the first by (path, row). Its key list is broadcast if it is small
    (a steady state), else the join shuffles."""
    rows = versions.select("path", blob_of(F.col("text")).alias("blob"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = materialise(rows, "paths")
    seen = ledger.read("seen").filter(F.col("rule_version") == rule_version).select("blob")
    first = rows.groupBy("blob").agg(F.min(F.struct("path", "h")).alias("at"))
    unseen = materialise(first.join(seen, "blob", "left_anti").select("blob", F.col("at.path").alias("u_path"), F.col("at.h").alias("u_h")), "unseen")
    keys = checked_small(unseen.select("u_path", "u_h"))
    # path and hash find the text again; rows that agree in both hold one blob, whose spans are a set below
    texts = versions.select(F.col("path").alias("t_path"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t_h"))
    texts = texts.filter(F.col("text").rlike(gate_of(rules))).join(keys, F.col("t_path").eqNullSafe(F.col("u_path")) & (F.col("t_h") == F.col("u_h")))
    span = F.struct("start", "kind_no", "end", "kind", "base")
    found = scan(texts.select(blob_of(F.col("text")).alias("blob"), "text"), rules).groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    version = F.lit(rule_version).alias("rule_version")
    ledger.commit(batch, unseen.select("blob", version), found.select("blob", version, "spans"))
    known = ledger.read("found").filter(F.col("rule_version") == rule_version).select("blob", "spans")
    return rows.join(known, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,base:boolean>>")).alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order of start and kind."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, ledger: BlobLedger | None = None, batch: str = "batch-0") -> DataFrame:
    """Findings of every document: path (its doc_id), blob and spans. A call that is repeated on the same ledger scans
    nothing and returns the same."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    return scan_versions(docs.select(F.col("doc_id").alias("path"), F.col("text")), ledger, batch)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark. Spans are ordered by start."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        cut = F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(cut).alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), F.length(text))))
