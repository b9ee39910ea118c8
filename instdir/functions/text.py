"""Column builders over names and urls; Spark's \\s is ASCII white space."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_name(c: Column) -> Column:
    """A name, missing as empty, stripped."""
    return strip(F.coalesce(c, F.lit("")))


def pick_url(*choices: Column) -> Column:
    """The first choice that isn't empty, stripped after the choice: blanks win and become empty."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit("")))


def scenario(name: Column, url: Column) -> Column:
    """both, name_only, url_only, or null if both are empty."""
    has_name, has_url = name != "", url != ""
    return F.when(has_name & has_url, "both").when(has_name, "name_only").when(has_url, "url_only")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms is a substring."""
    if not terms:
        return F.lit(False)
    return c.rlike("|".join(re.escape(t) for t in terms))


def contains_word_of(c: Column, words: Column) -> Column:
    """Whether one of an array's words is a substring.

    The lambda sees its arguments alone: filters whose lambdas name other columns get lost in outer joins.
    """
    return F.array_contains(F.zip_with(words, F.array_repeat(c, F.size(words)), lambda w, x: x.contains(w)), True)


def classify_by_name(name: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule's label one of whose words the name contains; case counts."""
    out = F.lit(default)
    for label, terms in reversed(list(rules)):
        out = F.when(contains_any(name, terms), label).otherwise(out)
    return out


def url_root(url: Column) -> Column:
    """Lower-cased, without schemes and www. anywhere, up to the first slash; port and query stay."""
    low = F.lower(url)
    for part in ("https://", "http://", "www."):
        low = F.replace(low, F.lit(part), F.lit(""))
    return F.split(low, "/")[0]


def name_words(name: Column) -> Column:
    """The lower-cased words of a name."""
    return F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(name_words(name), lambda w: F.substring(w, 1, 1)), "")


def hq_label(city: Column, state: Column) -> Column:
    """``city, state`` without commas and spaces at its ends."""
    return F.btrim(F.concat(F.coalesce(city, F.lit("")), F.lit(", "), F.coalesce(state, F.lit(""))), F.lit(", "))


def strip_fences(text: Column) -> Column:
    """If there is a triple backtick, without the lines that begin with one; stripped."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: ~strip(line).startswith("```"))
    return strip(F.when(text.contains("```"), F.array_join(lines, "\n")).otherwise(text))
