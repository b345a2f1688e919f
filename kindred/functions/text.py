"""Text, list and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a rating, and the leading part of a text that counts as its
# number ("12 cm" is 12).
PLAIN_NUMBER = r"^[+-]?(\d{1,15}(\.\d{0,15})?|\.\d{1,15})$"
LEADING_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def fields(line: Column | str) -> Column:
    """Comma-separated fields without quoting, empty ones kept."""
    return F.split(line, ",", -1)


def field(parts: Column, index: int) -> Column:
    return F.try_element_at(parts, F.lit(index + 1))


def action_list(text: Column | str) -> Column:
    """``' view , buy'`` to ``['view', 'buy']``."""
    return F.transform(F.split(text, ","), lambda action: F.trim(action))


def actions_text(actions: Column | str) -> Column:
    return F.array_join(actions, ",")


def actions_from_json(cell: Column | str) -> Column:
    return F.from_json(cell, "array<string>")


def actions_to_json(actions: Column | str) -> Column:
    return F.to_json(actions)


def name_matches(name: Column | str, search: str) -> Column:
    """Case-insensitive regular-expression search inside a name."""
    return F.lower(name).rlike(search.lower())


def leading_number(text: Column | str) -> Column:
    """The number a text starts with, NULL when it starts with none."""
    found = F.regexp_extract(F.trim(text), LEADING_NUMBER, 0)
    return F.when(found != "", found).cast("double")


def number(text: Column) -> Column:
    """A finite number written out with digits and at most one point; NULL for anything else."""
    return F.when(F.trim(text).rlike(PLAIN_NUMBER), F.trim(text)).try_cast("double")


def plain_number(value: Column) -> Column:
    """A double as text, without the fraction when it is whole."""
    whole = value.try_cast("bigint")
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))
