"""A document made from a profile where there is none on file: sections of the filled fields, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def section(title: str, body: Column) -> Column:
    return F.when(body != "", F.concat(F.lit(title + "\n"), body))


def render(profiles: DataFrame) -> DataFrame:
    """contact_id and document from (contact_id, designation, company, experience, skills, other_skills, qualification, born,
    languages); a profile without any substance gives null."""
    c = {n: scalars.clean_text(F.col(n)) for n in ("designation", "company", "experience", "qualification", "languages")}
    primary = scalars.split_list(F.col("skills"))
    other = scalars.other_than(scalars.split_list(F.col("other_skills")), primary)
    details = scalars.details_line([("Date of birth", scalars.long_date(scalars.clean_text(F.col("born")))), ("Languages", c["languages"])])
    text = F.concat_ws(
        "\n\n",
        section("Summary", scalars.summary(c["designation"], c["company"], c["experience"], primary, c["qualification"])),
        section("Skills", F.array_join(primary, ", ")), section("Other skills", F.array_join(other, ", ")),
        section("Education", c["qualification"]), section("Details", details),
    )
    enough = scalars.has_enough(F.col("designation"), F.col("company"), F.col("experience"), F.col("skills"), F.col("qualification"))
    return profiles.select("contact_id", F.when(enough, text).alias("document"))
