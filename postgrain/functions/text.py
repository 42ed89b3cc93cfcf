"""String and JSON column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code fence that may wrap a response, and the word rule of the term counter.
FENCE = "```"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip_space(col: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes only blanks)."""
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def truncate(col: Column, chars: int) -> Column:
    return F.substring(col, 1, chars)


def strip_fence(col: Column) -> Column:
    """Body of a fenced block without its ``json`` tag; unfenced text stays as it is."""
    raw = strip_space(col)
    body = F.try_element_at(F.split(raw, FENCE), F.lit(2))
    body = F.regexp_replace(body, r"\Ajson", "")
    return strip_space(F.when(raw.startswith(FENCE), body).otherwise(raw))


def words(col: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_PATTERN), F.lit(0))


def spaced(col: Column) -> Column:
    return F.replace(col, F.lit("_"), F.lit(" "))


def run_number(name: Column) -> Column:
    """Trailing ``_N`` of a name as an int; null when it is no number."""
    return F.element_at(F.split(name, "_"), -1).try_cast("int")


def two_decimals(col: Column) -> Column:
    """``%.2f``; null stays null."""
    return F.when(col.isNotNull(), F.format_string("%.2f", col))


def escape_html(col: Column) -> Column:
    # The five escaped characters; the ampersand goes first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def is_object(json_text: Column) -> Column:
    return F.ltrim(json_text).startswith("{")


def unwrapped(json_text: Column) -> Column:
    """The text inside, where a JSON value is a string; other values as they are."""
    wrapped = F.concat(F.lit('{"v":'), json_text, F.lit("}"))
    inner = F.when(F.ltrim(json_text).startswith('"'), F.get_json_object(wrapped, "$.v"))
    return F.coalesce(inner, json_text)
