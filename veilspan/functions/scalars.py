"""Small string, date, number and json helpers, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def clean_text(v: Column) -> Column:
    """Display text: runs of white space as one blank, trimmed; blank for null."""
    return F.trim(F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), r"\s+", " "))


def number_text(v: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    return F.when(v.isNull(), "").when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(clean_text(v), F.lit("")) for v in values], F.lit(""))


def _first_casing(parts: Column) -> Column:
    """Each value once, whatever its case; the first casing stays."""
    none = F.array().cast("array<string>")
    return F.aggregate(parts, none, lambda out, p: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(p)), out).otherwise(F.concat(out, F.array(p))))


def split_list(v: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), "[;,|\n\r•]+"), clean_text), lambda p: p != "")
    return _first_casing(parts)


def other_than(values: Column, primary: Column) -> Column:
    """The values without those of ``primary``, whatever the case."""
    return _first_casing(F.filter(values, lambda v: ~F.exists(primary, lambda p: F.lower(p) == F.lower(v))))


def years(v: Column) -> Column:
    n = F.when(v.rlike(r"^\s*[+-]?[0-9]+(?:\.[0-9]*)?\s*$"), F.trim(v).try_cast("double"))
    shown = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.when(n.isNull(), v).when(n == 1, F.concat(shown, F.lit(" year"))).otherwise(F.concat(shown, F.lit(" years")))


def long_date(v: Column) -> Column:
    day = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return F.coalesce(F.when(day, F.date_format(F.try_to_timestamp(v.substr(1, 10), F.lit("yyyy-MM-dd")), "dd MMMM yyyy")), v)


def has_enough(*values: Column) -> Column:
    return reduce(lambda a, b: a | b, [clean_text(v) != "" for v in values])


def summary(designation: Column, company: Column, experience: Column, skills: Column, qualification: Column) -> Column:
    """A sentence for each field that is filled; eight skills at most."""
    stop = lambda c: F.regexp_replace(c, r"\.+$", "")
    lead = F.concat(
        F.when(designation != "", designation).otherwise("Professional"),
        F.when(experience != "", F.concat(F.lit(" with "), years(experience), F.lit(" of experience"))).otherwise(""),
        F.when(company != "", F.concat(F.lit(", currently working at "), company)).otherwise(""),
    )
    parts = [
        F.concat(stop(lead), F.lit(".")),
        F.when(F.size(skills) > 0, F.concat(F.lit("Core skills include "), stop(F.array_join(F.slice(skills, 1, 8), ", ")), F.lit("."))),
        F.when(qualification != "", F.concat(F.lit("Holds "), stop(qualification), F.lit("."))),
    ]
    some = (designation != "") | (experience != "") | (company != "") | (F.size(skills) > 0) | (qualification != "")
    return F.when(some, F.concat_ws(" ", *parts)).otherwise("")


def escape_html(v: Column) -> Column:
    return F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def details_line(pairs: list[tuple[str, Column]]) -> Column:
    """``key: value`` of the filled fields, joined by bars."""
    return F.concat_ws(" | ", *[F.when(v != "", F.concat(F.lit(f"{k}: "), escape_html(v))) for k, v in pairs])


def login_domain(v: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(v, F.lit(""))))
    return F.when(low.isin("live", "prod", "production", "login", ""), "login").when(low.isin("test", "sandbox"), "test").otherwise(F.trim(v))


def is_masked_output(name: Column) -> Column:
    return F.lower(name).startswith(fixed.MASKED_PREFIX)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def display_name(name: Column, key: Column) -> Column:
    return F.when(name.startswith("JA-"), name).otherwise(F.concat(F.lit("JA-"), F.right(key.cast("string"), F.lit(6))))


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.slice(F.filter(F.split(name, r"\s+"), lambda w: w != ""), 1, 2), lambda w: F.upper(w.substr(1, 1))), "")


def deep_link(host: Column, document: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/lightning/r/ContentDocument/"), document, F.lit("/view"))


#: Parts of messages that mean "try again".
def is_transient(message: Column, kind: Column | None = None) -> Column:
    """Whether a failure may pass by itself. A ``kind`` that is final is never tried again."""
    low = F.lower(F.coalesce(message, F.lit("")))
    never = reduce(lambda a, b: a | b, [low.contains(x) for x in fixed.TRANSIENT_NEVER])
    if kind is not None:
        never = never | F.coalesce(kind.isin(list(fixed.FINAL_KINDS)), F.lit(False))
    return ~never & reduce(lambda a, b: a | b, [low.contains(x) for x in fixed.TRANSIENT])


def backoff_seconds(attempt: Column) -> Column:
    return F.lit(1.5) * attempt


def seal(secret: Column, key: Column) -> Column:
    """AES-GCM, as text."""
    return F.base64(F.aes_encrypt(secret.cast("binary"), key.cast("binary"), F.lit("GCM")))


def unseal(sealed: Column, key: Column) -> Column:
    """The secret, or null where the key or the text is wrong."""
    return F.try_aes_decrypt(F.try_to_binary(sealed, F.lit("base64")), key.cast("binary"), F.lit("GCM")).cast("string")


def truncated(detail: Column, most: int = 300) -> Column:
    return F.substring(detail, 1, most)


def opacity(tone: Column) -> Column:
    """Of a watermark over a page of this grey tone (0 black, 1 white)."""
    return F.when(tone >= 0.85, 0.16).otherwise(F.least(F.lit(0.34), 0.16 / F.greatest(F.lit(0.30), tone)))


def watermark_box(page_w: Column, page_h: Column, image_w: Column, image_h: Column) -> Column:
    """Centred, 28 % of the page's width, at most a third of its height, in the image's proportions."""
    w = page_w * 0.28
    h = w * image_h / image_w
    shrink = F.least(F.lit(1.0), (page_h / 3) / h)
    w, h = w * shrink, h * shrink
    return F.struct(((page_w - w) / 2).alias("x0"), ((page_h - h) / 2).alias("y0"), ((page_w + w) / 2).alias("x1"), ((page_h + h) / 2).alias("y1"))


def fitted_font(width_per_point: Column, page_w: Column) -> Column:
    """The largest of 36, 34, ... 8 at which a text is at most 60 % of the page wide; else 8."""
    sizes = F.filter(F.sequence(F.lit(36), F.lit(8), F.lit(-2)), lambda s: s * width_per_point <= 0.6 * page_w)
    return F.coalesce(F.get(sizes, F.lit(0)), F.lit(8))


def latin1(v: Column) -> Column:
    """Characters outside Latin-1 as question marks."""
    return F.regexp_replace(v, r"[^\x{00}-\x{FF}]", "?")


def item_override(own: Column, batch: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), batch)


def build_revision(*values: Column) -> Column:
    return F.coalesce(*[F.left(F.nullif(v, F.lit("")), F.lit(12)) for v in values], F.lit("unknown"))


def auth_mode(client_key: Column, has_registry: Column, override: Column, env_key: Column, env_user: Column) -> Column:
    """Which way to sign in: the registry for a client key, a stored override, then the environment; else an error."""
    return (
        F.when((F.coalesce(client_key, F.lit("")) != "") & has_registry, "client_credentials")
        .when(override.isNotNull(), F.concat(F.lit("override_"), override))
        .when(F.coalesce(env_key, F.lit("")) != "", "env_client_credentials")
        .when(F.coalesce(env_user, F.lit("")) != "", "env_password")
        .otherwise("error:not_configured")
    )


def host_choice(url: Column, known: dict[str, str]) -> Column:
    """The short name of a known host, other hosts as they are."""
    host = F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    out = host
    for name, short in known.items():
        out = F.when(host == name, F.lit(short)).otherwise(out)
    return out


def pii_shape(v: Column) -> Column:
    """Letters and digits as A, a and 9: what a value looks like, never the value."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")


def is_safe_id(v: Column) -> Column:
    return v.rlike(r"^[A-Za-z0-9]{15,18}\z")


def harvest_ids(v: Column) -> Column:
    """Record ids (15 or 18 letters and digits) in a parameter, each once, joined by semicolons."""
    parts = F.filter(F.split(v, r"[\s,;]+"), lambda p: p.rlike(r"^(?:[A-Za-z0-9]{15}|[A-Za-z0-9]{18})\z"))
    return F.array_join(F.array_distinct(parts), ";")


def ids_of_parameters(parameters: Column) -> Column:
    """Record ids in the values of those parameters (array<struct<name,value>>) whose names say that they hold some, each
    once, joined by semicolons."""

    def holds(p: Column) -> Column:
        name = F.lower(p["name"])
        return ~name.isin(list(fixed.NOT_ID_PARAMETERS)) & reduce(lambda a, b: a | b, [name.contains(x) for x in fixed.ID_PARAMETERS])

    return harvest_ids(F.array_join(F.transform(F.filter(parameters, holds), lambda p: F.coalesce(p["value"], F.lit(""))), " "))


def image_kind(body: Column) -> Column:
    """``png`` or ``jpeg`` by the first bytes, else null."""
    return F.when(F.substring(body, 1, 8) == F.lit(bytearray(b"\x89PNG\r\n\x1a\n")), "png").when(F.substring(body, 1, 3) == F.lit(bytearray(b"\xff\xd8\xff")), "jpeg")
