"""Expressions over nested values: XML documents, JSON and nested lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _named(key: str) -> str:
    # name() and not a prefixed step: prefixes are not bound inside xpath()
    return f"*[name()='{key}']"


def is_wellformed(xml) -> Column:
    """xpath() raises on broken XML, so rows are screened by a permissive parse."""
    parsed = F.from_xml(_col(xml), "_broken STRING",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return _col(xml).isNotNull() & parsed.isNotNull() & parsed["_broken"].isNull()


def texts_under(xml, inside: str, key: str | None, outside: str | None = None) -> Column:
    """Own texts of the ``key`` elements (any element when None) at any depth
    below ``inside`` and not below ``outside``."""
    step = _named(key) if key else "*"
    keep = f"[not(ancestor-or-self::{_named(outside)})]" if outside else ""
    return F.xpath(_col(xml), F.lit(f"//{_named(inside)}//{step}{keep}/text()"))


def search_key(xml, key: str) -> Column:
    """Texts of every element of that name, at any depth."""
    return F.xpath(_col(xml), F.lit(f"//{_named(key)}/text()"))


def texts_without(xml, key: str) -> Column:
    """All texts left after removing every element of that name."""
    return F.xpath(_col(xml), F.lit(f"//text()[not(ancestor::{_named(key)})]"))


# a JSON list item that is no list: a text in quotes, or a bare number, truth value or null
_ITEM = r'''("(?:[^"\\]|\\.)*+"|[^\s\[\],"]++)'''


def flatten_all(json) -> Column:
    """The items of a JSON list of lists of any depth, uneven or not, as texts in their order.

    Items stand in a list's text in the order in which flattening visits them, so one scan for whatever is no
    bracket and no comma flattens all levels at once; the items alone are then read as one plain list. Empty
    lists leave nothing, null items stay null, numbers and truth values become their text; a single item that is
    no list becomes a list of one. Items are texts, numbers, truth values and nulls; an object is broken up and
    yields null, as does every text that is no such list.
    """
    items = F.regexp_extract_all(_col(json), F.lit(_ITEM), 1)
    return F.from_json(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), "array<string>")


def flatten_levels(c, levels: int) -> Column:
    """Flatten ``levels`` known levels of nesting."""
    out = _col(c)
    for _ in range(levels):
        out = F.flatten(out)
    return out
