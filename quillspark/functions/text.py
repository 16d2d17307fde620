"""Text expressions: ids, numbers in cells, types of values, token estimates, truncation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of numbers and dates in cells.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE_CELL = r"^\d{4}-\d{2}-\d{2}(\s\d{2}:\d{2}:\d{2})?$"
IN_BRACKETS = r"^\(([0-9,.]+)\)$"
BLANK = r"^\s+|\s+$"
SPACE = " \t\n\x0b\f\r"
# Section titles that carry no content of their own.
BOILERPLATE = ("references", "bibliography", "works cited", "acknowledgements", "acknowledgments", "abstract", "table of contents", "list of figures", "list of tables", "appendix")


def stripped(text: Column) -> Column:
    """Without white space at both ends, tabs and line ends too."""
    return F.regexp_replace(text, BLANK, "")


def trimmed(text: Column) -> Column:
    """stripped() of short texts, without a regular expression."""
    return F.btrim(text, F.lit(SPACE))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use names it: Catalyst puts a column's whole expression wherever a filter or a later column names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by two bars; a null part counts as an empty one."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def numeric(text: Column) -> Column:
    """A cell's number: brackets negate; $, commas and % are dropped; null for anything else."""
    bare = stripped(text)
    inner = F.regexp_extract(bare, IN_BRACKETS, 1)
    signed = F.when(inner != "", F.concat(F.lit("-"), inner)).otherwise(bare)
    plain = F.regexp_replace(signed, r"[$,%]", "")
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def value_type(text: Column) -> Column:
    """null, boolean, date, numeric or text."""
    bare = stripped(text)
    return (
        F.when(text.isNull() | (bare == ""), "null")
        .when(F.upper(bare).isin("TRUE", "FALSE"), "boolean")
        .when(bare.rlike(DATE_CELL), "date")
        .when(numeric(text).isNotNull(), "numeric")
        .otherwise("text")
    )


def value_shape(text: Column) -> Column:
    """Runs of letters, digits and white space become A, 0 and a space; other runs collapse to one character."""
    shape = F.regexp_replace(stripped(text), r"\p{L}+", "A")
    shape = F.regexp_replace(F.regexp_replace(shape, r"\p{Nd}+", "0"), r"\s+", " ")
    return F.regexp_replace(shape, r"(.)\1+", "$1")


def label_like(text: Column) -> Column:
    """Whether a value reads like a heading: an underscore, all capitals, or a colon at its end."""
    bare = stripped(text)
    return bare.contains("_") | ((F.upper(bare) == bare) & bare.rlike(r"\p{L}")) | bare.endswith(":")


def word_tokens(text: Column) -> Column:
    """Words times 1.3, at least 1."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * F.lit(1.3))).cast("long")


def char_tokens(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def truncated(text: Column, limit: int) -> Column:
    """Cut to limit characters with three dots at the end."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 3))), F.lit("..."))).otherwise(text)


def tail(text: Column, limit: int) -> Column:
    """The last limit characters, from the first line that starts in them if one does."""
    last = F.right(text, F.lit(limit))
    at = F.locate("\n", last)
    return F.when(F.length(text) <= limit, text).when(at > 0, F.substring(last, at + 1, F.length(last))).otherwise(last)


def head_and_tail(text: Column, limit: int) -> Column:
    """The first and the last half of limit characters with a mark between; the text itself if it isn't longer."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(limit - half)))).otherwise(text)


def breadcrumb(section: Column, subsection: Column) -> Column:
    """section > subsection, or whichever there is."""
    return F.concat_ws(" > ", F.nullif(section, F.lit("")), F.nullif(subsection, F.lit("")))


def is_boilerplate(title: Column) -> Column:
    """Whether a title, without numbering and a colon at its end, names boilerplate."""
    return bare_title(title).isin(*BOILERPLATE)


def bare_title(title: Column) -> Column:
    """In small letters, without numbering before it and colons after it, with single spaces."""
    plain = F.lower(stripped(F.regexp_replace(title, r"^[\d.\sIVXivx-]+", "")))
    return stripped(F.regexp_replace(F.regexp_replace(plain, r":+$", ""), r"\s+", " "))


def template(text: Column, values: dict[str, str]) -> Column:
    """Replaces {{key}} and {key} by their values."""
    for key, value in values.items():
        text = F.replace(F.replace(text, F.lit("{{" + key + "}}"), F.lit(value)), F.lit("{" + key + "}"), F.lit(value))
    return text


def xml_escaped(text: Column) -> Column:
    """Safe in XML content and attributes."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def column_letters(number: Column) -> Column:
    """A spreadsheet's name of a column from 1 on (A, ..., Z, AA, ..., ZZZ)."""
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(n, F.lit(26)).cast("int") + 1, F.lit(1))
    n = number.cast("long")
    first, second, third = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, letter(third)).otherwise(""), F.when(n > 26, letter(second)).otherwise(""), letter(first))
