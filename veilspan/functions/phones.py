"""Phone numbers: evidence rules of both passes, the national numbering plan, and digit equivalence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .spans import bind, left_context, lines_with, ordered_distinct, spans


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{Nd}]", "")


def digit_groups(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\p{Nd}+"), F.lit(0))


def valid_length(s: Column) -> Column:
    return F.length(digits(s)).between(fixed.MIN_PHONE_DIGITS, fixed.MAX_PHONE_DIGITS)


def _full(patterns: tuple[str, ...]) -> str:
    return r"^(?:" + "|".join(patterns) + r")\z"


def _years(groups: Column) -> Column:
    return F.size(F.filter(groups, lambda g: g.rlike(r"^(?:19|20)\p{Nd}\p{Nd}\z")))


def _is_identifier(groups: Column) -> Column:
    return (F.size(groups) >= 3) & F.forall(groups, lambda g: F.length(g) == 4)


def trimmed(candidate: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(candidate, r"^[\s.\-–—]+|[\s.\-–—]+\z", ""), r"^\s+|\s+\z", "")


def is_id_context(before: Column) -> Column:
    return before.rlike(fixed.ID_LABEL)


def is_phone_context(before: Column) -> Column:
    return before.rlike(fixed.PHONE_LABEL)


def is_phone(candidate: Column, before: Column) -> Column:
    """First pass: rejected unless something says that it is a number. Rejections come before acceptances."""

    def decide(v: Column) -> Column:
        c, groups = v["c"], v["groups"]
        return (
            F.when(~valid_length(c), False)
            .when(_years(groups) >= 2, False)
            .when(_is_identifier(groups), False)
            .when(is_id_context(v["before"]), False)
            .when(c.startswith("+"), True)
            .when(is_phone_context(v["before"]), True)
            .otherwise(c.rlike(_full(fixed.PHONE_SHAPES)))
        )

    return bind(trimmed(candidate), lambda c: bind(F.struct(c.alias("c"), digit_groups(c).alias("groups"), before.alias("before")), decide))


def find_phones(text: Column) -> Column:
    """First-pass numbers as they stand in the text, in order."""
    found = F.filter(spans(text, fixed.PHONE_CANDIDATE), lambda s: is_phone(s["value"], left_context(text, s["start"], fixed.LEFT_CONTEXT)))
    return F.transform(found, lambda s: F.trim(s["value"]))


def national_number(d: Column) -> Column:
    """The ten-digit national number in a digit string, else null."""
    out = F.when(F.length(d) == fixed.NATIONAL_DIGITS, d)
    for p in fixed.NATIONAL_PREFIXES:
        out = F.when((F.length(d) == fixed.NATIONAL_DIGITS + len(p)) & d.startswith(p), d.substr(len(p) + 1, fixed.NATIONAL_DIGITS)).otherwise(out)
    return out


def is_mobile(d: Column) -> Column:
    return F.coalesce(national_number(d).substr(1, 1).isin(list(fixed.MOBILE_FIRST)), F.lit(False))


def residual_ok(candidate: Column, label: Column, letter: Column, after: Column) -> Column:
    """Second pass, for a window of a run: whether a phone label, or any letter, is flush against it, and the next character."""

    def decide(v: Column) -> Column:
        d, groups, c, n, nsn = v["d"], v["groups"], v["c"], F.length(v["d"]), v["nsn"]
        decimal = c.contains(".") & ~F.forall(groups, lambda g: F.length(g).isin(3, 4))
        round_sum = (F.size(groups) == 1) & (n == fixed.NATIONAL_DIGITS) & d.endswith("000000") & ~label
        abroad = c.startswith("+") | c.startswith("(+") | d.startswith("00")
        with_code = nsn.isNotNull() & (n > fixed.NATIONAL_DIGITS) & (nsn.substr(1, 1) != "0") & (F.size(groups) >= 2)
        return (
            F.when(_years(groups) >= 2, False)
            .when(_is_identifier(groups), False)
            .when(decimal, False)
            .when(c.rlike(fixed.DATE_RUN), False)
            .when(round_sum, False)
            .when(after.rlike(r"^\p{L}"), False)
            .when(letter & ~label, False)
            .when(F.coalesce(nsn.substr(1, 1).isin(list(fixed.MOBILE_FIRST)), F.lit(False)), True)
            .when(abroad, n >= 8)
            .when(label, True)
            .when(with_code, True)
            .otherwise(c.rlike(_full(fixed.RESIDUAL_SHAPES)))
        )

    def look(v: Column) -> Column:
        whole = F.struct(v["d"].alias("d"), national_number(v["d"]).alias("nsn"), digit_groups(v["c"]).alias("groups"), v["c"].alias("c"))
        return F.when(F.length(v["d"]).between(fixed.MIN_PHONE_DIGITS, fixed.MAX_PHONE_DIGITS), bind(whole, decide)).otherwise(False)

    return bind(F.struct(digits(candidate).alias("d"), F.trim(candidate).alias("c")), look)


def windows_of(run: Column, before: Column, after: Column) -> Column:
    """Every window of a run's digit groups with at most 15 digits: array<struct<i,j,start,end,ok>>, ordered by first
    group and, within it, longest first. The first window starts with the run, so that a sign belongs to it; only that one
    can have a label or a letter flush against it, since the others follow a digit."""
    most = fixed.MAX_PHONE_DIGITS

    def of(r: Column) -> Column:
        g = r["groups"]
        last = F.size(g) - 1

        def first(i: Column) -> Column:
            top = F.least(last, i + most - 1)
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(g, i)["start"])
            end = F.get(g, top)["end"]
            return bind(F.struct(i.alias("i"), top.alias("top"), start.alias("start"), r["run"].substr(start + 1, end - start + 1).alias("tail")), from_there)

        def from_there(f: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), f["top"] - f["i"]), lambda back: window(f, f["top"] - back))

        def window(f: Column, j: Column) -> Column:
            end, flush = F.get(g, j)["end"], f["i"] == 0
            size = end - f["start"]
            ok = residual_ok(f["tail"].substr(F.lit(1), size), flush & r["label"], flush & r["letter"], f["tail"].substr(size + 1, F.lit(1)))
            return F.struct(f["i"].alias("i"), j.alias("j"), f["start"].alias("start"), end.alias("end"), (ok & ~(flush & r["vetoed"])).alias("ok"))

        return F.flatten(F.transform(F.sequence(F.lit(0), last), first))

    known = F.struct(
        spans(run, r"\p{Nd}+").alias("groups"), F.concat(run, F.coalesce(after, F.lit(""))).alias("run"), is_phone_context(before).alias("label"),
        before.rlike(r"\p{L}\z").alias("letter"), is_id_context(before).alias("vetoed"),
    )
    return bind(known, of)


def choose_windows(windows: Column) -> Column:
    """From each group on, the longest valid window; the next starts after its last group."""
    good = F.filter(windows, lambda w: w["ok"])
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        take = w["i"] > acc["last"]
        out = F.concat(acc["out"], F.array(F.struct(w["start"].alias("start"), w["end"].alias("end"))))
        return F.struct(F.when(take, w["j"]).otherwise(acc["last"]).alias("last"), F.when(take, out).otherwise(acc["out"]).alias("out"))

    return F.aggregate(good, zero, step, lambda a: a["out"])


def runs_of(text: Column) -> Column:
    """Runs that may hold numbers: array<struct<start,run,before,after>>. No run crosses a line; an id label before one rules
    out all of it."""

    def of_line(held: Column) -> Column:
        line = held["line"]
        found = F.filter(spans(line, fixed.RESIDUAL_RUN), lambda r: F.length(digits(r["value"])) >= fixed.MIN_PHONE_DIGITS)
        known = F.transform(found, lambda r: F.struct(
            (held["at"] + r["start"]).alias("start"), r["value"].alias("run"), line.substr(F.lit(1), r["start"]).alias("before"), line.substr(r["end"] + 1, F.lit(1)).alias("after")))
        return F.filter(known, lambda r: ~is_id_context(r["before"]))

    return F.flatten(F.transform(lines_with(text, fixed.RESIDUAL_RUN), of_line))


def scan_phones(text: Column) -> Column:
    """Second-pass spans: array<struct<start,end>>, ordered and disjoint."""

    def of(r: Column) -> Column:
        chosen = choose_windows(windows_of(r["run"], r["before"], r["after"]))
        return F.transform(chosen, lambda w: F.struct((w["start"] + r["start"]).alias("start"), (w["end"] + r["start"]).alias("end")))

    return F.flatten(F.transform(runs_of(text), of))


def classify(s: Column) -> Column:
    """``email``, ``phone`` or ``name`` for a value that is known to be a contact detail."""
    t = F.regexp_replace(s, r"^\s+|\s+\z", "")
    phone = t.rlike(fixed.PHONE_STRING) & valid_length(t)
    return F.when(t.rlike("^" + fixed.EMAIL + r"\z"), "email").when(phone, "phone").otherwise("name")


def regroup(part: Column) -> Column:
    """Numbers in an oversized value: tokens gather while they stay within 15 digits."""
    tokens = F.filter(F.split(part, r"\s+"), lambda t: t != "")
    zero = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def flush(acc: Column) -> Column:
        return F.when(valid_length(acc["held"]), F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])

    def step(acc: Column, t: Column) -> Column:
        joined = F.when(acc["held"] == "", t).otherwise(F.concat(acc["held"], F.lit(" "), t))
        over = F.length(digits(joined)) > fixed.MAX_PHONE_DIGITS
        return F.struct(F.when(over, t).otherwise(joined).alias("held"), F.when(over, flush(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, zero, step, flush)


def split_phone_list(value: Column) -> Column:
    """Each number in a field that may hold several; the field itself if it holds none, or one."""
    v = F.regexp_replace(value, r"^\s+|\s+\z", "")
    one = (F.length(digits(v)) <= fixed.MAX_PHONE_DIGITS) & v.rlike(fixed.PHONE_STRING)
    parts = F.filter(F.transform(F.split(v, fixed.LIST_SPLIT), lambda p: F.regexp_replace(p, r"^\s+|\s+\z", "")), lambda p: p != "")

    def numbers(p: Column) -> Column:
        runs = F.filter(F.regexp_extract_all(p, F.lit(fixed.PHONE_RUN), F.lit(0)), lambda r: valid_length(r))
        return (
            F.when(valid_length(p) & p.rlike(fixed.PHONE_STRING), F.array(p))
            .when(F.length(digits(p)) > fixed.MAX_PHONE_DIGITS, regroup(p))
            .otherwise(runs)
        )

    found = F.flatten(F.transform(parts, numbers))
    return F.when(one, F.array(v)).when(F.size(found) > 0, found).otherwise(F.array(v))


def expand(values: Column) -> Column:
    """Every value to look for: lists split, blanks dropped, each once, in the order of first sight."""
    filled = F.filter(values, lambda v: v.isNotNull() & v.rlike(r"\S"))
    return ordered_distinct(F.flatten(F.transform(filled, split_phone_list)))


def equivalent(a: Column, b: Column) -> Column:
    """Whether two digit strings are one number: the same end, and at most a country code or trunk digit more."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    more = F.length(long) - F.length(short)
    ruled_out = (F.length(short) < fixed.MIN_PHONE_DIGITS) | (F.length(long) > fixed.MAX_PHONE_DIGITS) | (more > 3) | ~long.endswith(short)
    return F.when(ruled_out, False).when(more == 0, True).when(long.startswith("0"), True).otherwise(F.length(short) >= fixed.NATIONAL_DIGITS)
