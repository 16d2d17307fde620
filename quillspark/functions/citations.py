"""Citation markers `[REF:1,3-5]`: their numbers, and the links that replace them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a marker in a text.
MARKER = r"(?i)\[REF:([\d,\s\-]+)\]"


def marker_numbers(inside: Column) -> Column:
    """The numbers of `1,3-5`, ranges spelled out in ascending order, whichever way they are written."""
    parts = F.filter(F.transform(F.split(inside, ","), lambda p: F.regexp_replace(p, r"\s", "")), lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def numbers(part: Column) -> Column:
        ends = F.split(part, "-")
        first, last = F.get(ends, 0).cast("int"), F.coalesce(F.get(ends, 1), F.get(ends, 0)).cast("int")
        return F.sequence(F.least(first, last), F.greatest(first, last))

    return F.flatten(F.transform(parts, numbers))


def cited(text: Column) -> Column:
    """All numbers that a text cites, marker by marker."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MARKER), 1), marker_numbers))


def page_link(name: Column, link: Column, page: Column) -> Column:
    """[name, Pg. n](link#page=n), or without the page where there is none."""
    paged = F.format_string("[%s, Pg. %d](%s#page=%d)", name, page, link, page)
    return F.when(page.isNotNull(), paged).otherwise(F.format_string("[%s](%s)", name, link))


def replaced(text: Column, links: Column) -> Column:
    """text with each marker replaced by its links (a map from number to link), joined by a space; numbers without a link are dropped."""
    pieces = F.split(text, MARKER, -1)
    markers = F.regexp_extract_all(text, F.lit(MARKER), 1)

    def link(inside: Column) -> Column:
        found = F.array_distinct(F.filter(F.transform(marker_numbers(inside), lambda n: F.try_element_at(links, n)), lambda x: x.isNotNull()))
        return F.array_join(found, " ")

    rebuilt = F.zip_with(pieces, F.transform(markers, link), lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.array_join(rebuilt, "")
