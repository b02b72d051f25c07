"""Mail addresses: the strict shape, and addresses with injected blanks or spelled-out signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .phones import scan_phones
from .spans import bind, spans

SPANS = "array<struct<start:int,end:int>>"
TYPED = "array<struct<start:int,end:int,kind:string>>"


def find_emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.EMAIL), F.lit(0))


def normalize_email(raw: Column) -> Column:
    """The canonical address, or null. An address with blanks in it needs a well-known top-level domain."""

    def decide(v: Column) -> Column:
        parts, labels, tld = v["parts"], v["labels"], v["tld"]
        bad = (
            (F.size(parts) != 2) | (F.get(parts, F.lit(0)) == "") | (F.size(labels) < 2) | F.exists(labels, lambda x: x == "")
            | ~tld.rlike(r"^\p{L}{2,24}\z") | tld.isin(fixed.FILE_EXTENSIONS) | (raw.rlike(r"\s") & ~tld.isin(fixed.KNOWN_TLDS))
        )
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(None).cast("string")).otherwise(v["s"])

    def taken_apart(s: Column) -> Column:
        parts = F.split(s, "@", -1)
        labels = F.split(F.get(parts, F.lit(1)), r"\.", -1)
        return F.struct(s.alias("s"), parts.alias("parts"), labels.alias("labels"), F.lower(F.element_at(labels, -1)).alias("tld"))

    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, fixed.AT_TOKEN, "@"), fixed.DOT_TOKEN, "."), r"[ \t]+", "")
    return bind(s, lambda x: bind(taken_apart(x), decide))


def disjoint(found: Column) -> Column:
    """Greedy: by start, then by length; what overlaps an earlier choice goes."""
    ordered = F.array_sort(F.array_distinct(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, zero, step, lambda a: a["out"])


def scan_emails(text: Column) -> Column:
    """Second-pass spans of both shapes. The gate spares texts without any sign of an address the costly pattern."""
    both = F.concat(spans(text, fixed.EMAIL), F.when(text.rlike(r"(?i)[@(\[]"), spans(text, fixed.LOOSE_EMAIL)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")))
    return disjoint(F.filter(both, lambda s: normalize_email(s["value"]).isNotNull()))


def scan_residual(text: Column) -> Column:
    """Every span that the second pass wants gone, typed and ordered. Addresses win over numbers."""

    def typed(found: Column, kind: str) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def both(emails: Column) -> Column:
        free = F.filter(scan_phones(text), lambda p: ~F.exists(emails, lambda e: (e["start"] < p["end"]) & (p["start"] < e["end"])))
        return F.array_sort(F.concat(typed(emails, "email"), typed(free, "phone")))

    return bind(scan_emails(text), both)
