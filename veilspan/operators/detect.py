"""Detection over tables: typed spans, masked texts, page boxes of spans, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails, fixed, phones
from ..functions.spans import bind, blank_out, lines_with, ordered_distinct, spans

#: A text without two digits close by, an @ or a spelled-out at holds nothing for either pass.
GATE = r"(?i)@|[(\[]\s*at\s*[)\]]|\p{Nd}[\p{Nd} \t()+.\-–—]{3,}\p{Nd}"


def detected(text: Column) -> Column:
    """First-pass values, addresses first, each once in the order of first sight."""
    return ordered_distinct(F.concat(F.coalesce(emails.find_emails(text), F.array().cast("array<string>")), phones.find_phones(text)))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, ord, value, kind of every first-pass value."""
    rows = docs.filter(F.col("text").rlike(GATE)).select("doc_id", F.posexplode(detected(F.col("text"))).alias("ord", "value"))
    return rows.withColumn("kind", F.when(F.col("value").contains("@"), "email").otherwise("phone"))


def residual_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, kind of every second-pass span. One row in, its spans out: no shuffle."""
    rows = docs.filter(F.col("text").rlike(GATE)).select("doc_id", F.explode(emails.scan_residual(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.kind")


def residual_windows(docs: DataFrame) -> DataFrame:
    def of(r: Column) -> Column:
        found = phones.windows_of(r["run"], r["before"], r["after"])
        return F.transform(found, lambda w: F.struct(r["start"].alias("base"), w["i"].alias("i"), w["j"].alias("j"), (r["start"] + w["start"]).alias("start"), (r["start"] + w["end"]).alias("end"), w["ok"].alias("ok")))

    return docs.select("doc_id", F.explode(F.flatten(F.transform(phones.runs_of(F.col("text")), of))).alias("w")).select("doc_id", "w.*")


def _located(text: Column, values: Column) -> Column:
    """Places of known values: numbers in any layout that has the same digits, addresses in any case."""
    kinds = F.transform(values, lambda v: F.struct(v.alias("v"), phones.classify(v).alias("kind")))

    def of(known: Column) -> Column:
        def numbers(held: Column) -> Column:
            line = held["line"]
            runs = F.filter(spans(line, fixed.RESIDUAL_RUN), lambda r: bind(phones.digits(r["value"]), lambda d: F.exists(known["numbers"], lambda n: phones.equivalent(d, n))))
            return F.transform(
                F.filter(runs, lambda r: ~phones.is_id_context(line.substr(F.lit(1), r["start"]))),
                lambda r: F.struct((held["at"] + r["start"]).alias("start"), (held["at"] + r["end"]).alias("end")),
            )

        mails = F.filter(spans(text, fixed.EMAIL), lambda e: F.array_contains(known["mails"], F.lower(e["value"])))
        found = F.when(F.size(known["numbers"]) > 0, F.flatten(F.transform(lines_with(text, fixed.RESIDUAL_RUN), numbers))).otherwise(F.array().cast(emails.SPANS))
        places = F.when(F.size(known["mails"]) > 0, F.transform(mails, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array().cast(emails.SPANS))
        return F.concat(found, places)

    def split(kinds: Column) -> Column:
        numbers = F.transform(F.filter(kinds, lambda k: k["kind"] == "phone"), lambda k: phones.digits(k["v"]))
        mails = F.transform(F.filter(kinds, lambda k: k["kind"] == "email"), lambda k: F.lower(k["v"]))
        return bind(F.struct(numbers.alias("numbers"), mails.alias("mails")), of)

    return bind(kinds, split)


def mask(docs: DataFrame, known: str | None = None, mark: str = "") -> DataFrame:
    """doc_id, masked and regions of every document. ``known`` names an array column of values to look for; without it
    they are what the first pass detects. The second pass then sweeps the text for the rest. Texts that the gate
    turns away go through unchanged, unread by the costly patterns."""
    rows = _with_spans(docs, phones.expand(F.col(known)) if known else phones.expand(detected(F.col("text"))))
    return rows.select("doc_id", _cut(F.col("text"), F.col("_spans"), mark).alias("masked"), F.size("_spans").alias("regions"))


def _with_spans(docs: DataFrame, values: Column) -> DataFrame:
    """The rows with ``_spans`` of both passes and ``_located`` of the first alone."""
    text = F.col("text")
    look, none = text.rlike(GATE), F.array().cast(emails.SPANS)
    # columns of their own, because both are read more than once
    rows = docs.withColumn("_values", F.when(look, values)).withColumn("_residual", F.when(look, emails.scan_residual(text)))
    swept = F.transform("_residual", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    located = _located(text, F.col("_values"))
    both, first = emails.disjoint(merged(F.concat(located, swept))), emails.disjoint(merged(located))
    return rows.withColumn("_spans", F.when(look, both).otherwise(none)).withColumn("_located", F.when(look, first).otherwise(none))


def _cut(text: Column, found: Column, mark: str = "") -> Column:
    return F.when(F.size(found) > 0, blank_out(text, found, mark)).otherwise(text)


def merged(found: Column) -> Column:
    """Overlapping spans as one."""
    ordered = F.array_sort(found)
    zero = F.array().cast(emails.SPANS)

    def step(out: Column, s: Column) -> Column:
        last = F.when(F.size(out) > 0, F.element_at(out, -1))
        joins = F.coalesce(s["start"] < last["end"], F.lit(False))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(wider))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(ordered, zero, step)


def has_contact_scheme(uri: Column) -> Column:
    return F.lower(F.trim(uri)).rlike("^(?:" + "|".join(fixed.CONTACT_SCHEMES) + "):")


def is_contact_link(uri: Column) -> Column:
    return F.coalesce(has_contact_scheme(uri) | (F.size(emails.scan_residual(uri)) > 0), F.lit(False))


def scrub_metadata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata fields that hold a number or an address become empty; others, names too, stay."""
    for c in columns:
        found = F.col(c).rlike(GATE) & (F.size(emails.scan_residual(F.col(c))) > 0)
        rows = rows.withColumn(c, F.when(F.coalesce(found, F.lit(False)), F.lit("")).otherwise(F.col(c)))
    return rows


def lines(words: DataFrame) -> DataFrame:
    """Lines from words: text, and the words with their boxes in reading order. A group is one line of a page."""
    word = F.struct("x0", "word_no", "word", "y0", "x1", "y1")
    rows = words.groupBy("conv_id", "block", "line_no").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return rows.withColumn("text", F.array_join(F.transform("words", lambda w: w["word"]), " "))


def residual_boxes(words: DataFrame) -> DataFrame:
    """The bounding box, over the words it touches, of every second-pass span of every line."""
    rows = lines(words).filter(F.col("text").rlike(GATE)).select("conv_id", "block", "line_no", "words", F.explode(emails.scan_residual(F.col("text"))).alias("s"))
    placed = F.aggregate(
        "words", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,x0:double,y0:double,x1:double,y1:double>>").alias("out")),
        lambda acc, w: F.struct(
            (acc["at"] + F.length(w["word"]) + 1).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + F.length(w["word"])).alias("b"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    touched = F.filter(placed, lambda w: (w["a"] < F.col("s.end")) & (F.col("s.start") < w["b"]))
    rows = rows.withColumn("t", touched)
    edges = [f(F.col(f"t.{name}")).alias(name) for name, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))]
    return rows.select("conv_id", "block", "line_no", "s.kind", *edges)


def score(docs: DataFrame) -> DataFrame:
    """By ``grp`` and ``passes`` (``both``, or the ``first`` alone), against the given truth of each text: leaks (a value of
    ``must_mask`` that is still there), over-masked values (one of ``must_survive`` that is gone), accuracy, recall and
    specificity."""
    rows = _with_spans(docs, phones.expand(detected(F.col("text"))))
    kinds = [F.struct(F.lit(name).alias("passes"), F.size(c).alias("regions"), _cut(F.col("text"), F.col(c)).alias("masked")) for name, c in (("both", "_spans"), ("first", "_located"))]
    rows = rows.select("grp", "must_mask", "must_survive", F.inline(F.array(*kinds)))
    leaks = F.size(F.filter("must_mask", lambda v: F.col("masked").contains(v)))
    over = F.size(F.filter("must_survive", lambda v: ~F.col("masked").contains(v)))
    sums = rows.groupBy("grp", "passes").agg(F.sum(F.size("must_mask")).alias("positives"), F.sum(F.size("must_survive")).alias("negatives"), F.sum(leaks).alias("leaks"), F.sum(over).alias("over_masked"))
    wrong = F.col("leaks") + F.col("over_masked")
    total = F.col("positives") + F.col("negatives")
    return sums.select(
        "grp", "passes", "positives", "negatives", "leaks", "over_masked",
        F.when(total > 0, 1 - wrong / total).alias("accuracy"), F.when(F.col("positives") > 0, 1 - F.col("leaks") / F.col("positives")).alias("recall"),
        F.when(F.col("negatives") > 0, 1 - F.col("over_masked") / F.col("negatives")).alias("specificity"),
    ).orderBy("grp", "passes")
