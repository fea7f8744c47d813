"""Designations and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: identifier patterns ----------------------------------------
LEADING_NUMBER = r"^(\d+)\s"
PROVISIONAL = r"\((\d{4}\s[A-Z]{2}\d*)\)"
PARENTHESES = r"\(.*?\)"
# --- end of fixed values --------------------------------------------------------


def strip(value: Column) -> Column:
    """Remove any white space at both ends (SQL `trim` removes blanks only)."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def non_empty(value: Column) -> Column:
    """Empty text becomes NULL."""
    return F.nullif(value, F.lit(""))


def first_non_empty(*values: Column) -> Column:
    """The first value that is neither NULL nor empty text."""
    return F.coalesce(*[non_empty(value) for value in values])


def normalise_designation(value: Column, strip_chars: str = "()'") -> Column:
    """Lower-case form for matching: no `strip_chars`, single blanks, no outer blanks."""
    bare = F.translate(value, strip_chars, "") if strip_chars else value
    return strip(F.lower(F.regexp_replace(bare, r"\s+", " ")))


def without_blanks(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def leading_number(value: Column) -> Column:
    """The digits a text starts with, NULL when it starts with none."""
    return non_empty(F.regexp_extract(strip(value), r"^(\d+)", 1))


def designation_candidates(asteroid_id: Column, name: Column) -> Column:
    """Identifiers to try for an object, best first: its leading number, the
    provisional designation in parentheses, the name without parentheses, the id."""
    label = strip(F.coalesce(name, F.lit("")))
    tries = F.array(
        non_empty(F.regexp_extract(label, LEADING_NUMBER, 1)),
        non_empty(F.regexp_extract(label, PROVISIONAL, 1)),
        non_empty(strip(F.regexp_replace(label, PARENTHESES, ""))),
        non_empty(strip(asteroid_id)),
    )
    return F.array_distinct(F.array_compact(tries))


def like_pattern(query: Column, escape: bool = False) -> Column:
    """Substring pattern for ILIKE.  `%` and `_` inside the query stay wild
    unless `escape` is set; a backslash that escapes neither of them is left
    out, as LIKE would reject it."""
    if escape:
        body = F.regexp_replace(query, r"([\\%_])", r"\\$1")
    else:
        body = F.regexp_replace(query, r"(\\[%_\\])|\\", "$1")
    return F.concat(F.lit("%"), body, F.lit("%"))
