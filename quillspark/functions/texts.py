"""Small text expressions: case, folding, set overlap, numbers, slugs, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrites import DIGITS, MONTHS, SUBSCRIPTS

SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def array_lost(before: Column, after: Column) -> Column:
    """SO-3: what the first array has and the second lacks, once each."""
    return F.array_except(before, after)


def overlap(a: Column, b: Column) -> Column:
    """SO-6: the share of a's distinct items that b has; 0 for an empty array."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    """SO-6: twice the shared items over all items of two sets; 0 for two empty ones."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def fold(text: Column) -> Column:
    """Lower case, white space single and trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def snippet(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def sanctioned(text: Column) -> Column:
    """G-15: the text without what house rules delete on purpose: access notes, days and months, redundant citations, caption numbers."""
    out = F.regexp_replace(text, r"(?i)\[[^\]]*\bcited\b[^\]]*\]|\[Internet\]", " ")
    out = F.regexp_replace(out, rf"(?i)\b(?:{MONTHS})\b\.?\s*\d{{1,2}}\b(?!\s*\d)|\b\d{{1,2}}\s+(?:{MONTHS})\b\.?", " ")
    out = F.regexp_replace(out, r'["“]?\([^()]{0,160}?\b(?:19|20)\d{2}\b[^()]{0,60}?\)["”]?[\s.,;:]{0,3}(?=\[\d)', " ")
    return F.regexp_replace(out, r"(?i)^\s*(?:Figure|Fig\.?|Table|Tab\.?|Scheme|Equation|Eq\.?)\s*\d+(?:[.\-]\d+)*", " ")


def numbers(text: Column) -> Column:
    """G-15: the numbers of a text, script digits read as plain ones and thousands joined; a leading section or entry number is no number."""
    plain = F.regexp_replace(F.translate(text, SUBSCRIPTS + SUPERSCRIPTS, DIGITS + DIGITS), r"^\s*(?:\[\d+\]\.?|\d+(?:\.\d+)*\.?)\s+", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


def resets_on(day: Column) -> Column:
    """The first day of the next month."""
    return F.trunc(F.add_months(day, 1), "month")
