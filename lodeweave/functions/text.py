"""Expressions that clean delimited and decorated text. Input that doesn't fit gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*(\d+\.?\d*|\.\d+)\s*$"


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def tokens(c: Column, separator: str = "|") -> Column:
    """The parts of a delimited value; an empty or null value has none."""
    return F.when(present(c), F.split(c, "[" + separator + "]")).otherwise(F.array().cast("array<string>"))


def code_and_name(c: Column) -> Column:
    """'CC-Name' as a struct; name is null where there is no dash, and keeps any further dashes."""
    parts = F.split(c, "-", 2)
    return F.struct(parts[0].alias("code"), F.try_element_at(parts, F.lit(2)).alias("name"))


def first_and_last(c: Column) -> Column:
    """A name at its first blank; last is empty where there is none."""
    parts = F.split(c, " ", 2)
    return F.struct(parts[0].alias("first_name"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("last_name"))


def minutes(c: Column) -> Column:
    """'142 min' as 142."""
    return F.replace(c, F.lit(" min"), F.lit("")).try_cast("int")


def amount(c: Column) -> Column:
    """'28,341,469' as 28341469; empty is null."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("bigint")


def numeric(c: Column) -> Column:
    """Whether a text is digits with at most one dot, blanks around allowed: no sign, no exponent."""
    return F.coalesce(c.rlike(NUMBER), F.lit(False))


def year(c: Column) -> Column:
    return F.date_format(c, "yyyy")


def normalized(c: Column) -> Column:
    """Trimmed lower case with single blanks; empty is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
