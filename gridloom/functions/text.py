"""Names, paths, lines and flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what ends a line of text, the two-character ending first.
LINE_END = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name(path), r"(?<=.)(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def components(path: Column) -> Column:
    """By these, paths sort component by component."""
    return F.split(path, "/")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; a last line end begins no further line."""
    whole = lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    # a text is cut once: in a generator each mention of an expression is work of its own
    return F.get(F.transform(F.array(F.split(text, LINE_END, -1)), whole), F.lit(0))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, with what isn't replaced."""
    return F.make_valid_utf8(content.cast("string"))


def safe_name(value: Column) -> Column:
    """Runs of other characters than letters, digits and ``._-`` become one ``_``; none of ``._-`` stays at the ends. May be empty."""
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")


def flag(value: Column) -> Column:
    """true/1/yes or false/0/no, whatever case and space around; null for anything else."""
    said = F.lower(stripped(value))
    return F.when(said.isin("true", "1", "yes"), F.lit(True)).when(said.isin("false", "0", "no"), F.lit(False))


def numbered(prefix: Column, kind: str, index: Column) -> Column:
    """``prefix_kind_0007``: never cut when the number outgrows four digits."""
    return F.format_string(f"%s_{kind}_%04d", prefix.cast("string"), index)


def kind_of(is_background: Column) -> Column:
    return F.when(is_background, "background").otherwise("positive")


def integer(text: Column) -> Column:
    """A whole number; null for anything else, or beyond 64 bits."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def number(text: Column) -> Column:
    """A decimal number, nan or inf; null for anything else."""
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    word = F.lower(F.regexp_replace(text, "^[+-]", ""))
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(plain, text.try_cast("double")).when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), sign * F.lit(float("inf")))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
