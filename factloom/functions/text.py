"""Column functions over text. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of markup and how they are written.
ESCAPES = {
    "&": "&amp;",
    "<": "&lt;",
    ">": "&gt;",
    '"': "&#34;",
    "'": "&#39;",
}


def escape(text: Column) -> Column:
    """Text with the characters of markup written out, & first. Null stays null."""
    for raw, written in ESCAPES.items():
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def folded(text: Column) -> Column:
    """Lower case, with one blank for each run of anything but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether each part of a quotation (parts are joined by ...) is found in text after folding."""
    parts = F.filter(F.transform(F.split(quote, r"\.\.\."), folded), lambda part: F.length(part) > 0)
    return F.forall(parts, lambda part: F.contains(folded(text), part))


def colour(types: Column, red: str) -> Column:
    """red for entities that have that type among others, else green."""
    return F.when(F.array_contains(types, red), "red").otherwise("green")


def qualifiers(*columns: Column) -> Column:
    """The qualifiers that are there, joined by a middle dot."""
    return F.concat_ws(" · ", *columns)
