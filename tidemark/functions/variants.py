"""Spellings under which a name or title of a list may be known, as native expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What lists append to names (countries, numbers), to titles (years, nicknames), and the signs that trip up a search.
COUNTRY = r"\s*\((?:[A-Z]{2,3}|\d+)\)$"
YEAR = r"\s*\((?:19|20)\d\d\)$"
NICKNAME = r"\s*\([^()]*\)\s*$"
TWO_SCRIPTS = r"^(.*?)\s*\[([^\]]+)\]\s*$"
SIGNS = r'[/\\:;!?.,"()\[\]]+'
YEAR_MARK = " #"


def decoded(c: Column) -> Column:
    """Text without the common entities, and without blanks around it."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&nbsp;|&#160;", " "), ("&amp;", "&")):
        c = F.regexp_replace(c, entity, sign)
    return F.trim(c)


def _forms(*forms: Column) -> Column:
    """Different forms that hold something, in order."""
    return F.array_distinct(F.filter(F.transform(F.array(*forms), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def _scripts(c: Column) -> list[Column]:
    """A name, and both halves of "native [romanised]"."""
    return [c, F.regexp_extract(c, TWO_SCRIPTS, 1), F.regexp_extract(c, TWO_SCRIPTS, 2)]


def artist_variants(name: Column) -> Column:
    """The list's spelling, without a country or number behind it, and each half of a name in two scripts."""
    whole = decoded(name)
    return _forms(*_scripts(whole), *_scripts(F.regexp_replace(whole, COUNTRY, "")))


def title_variants(title: Column, subtitle: bool = True) -> Column:
    """The same for a title: without a year, each half of two scripts, without a nickname; with subtitle also what is before a colon."""
    whole = decoded(title)
    before = [F.when(F.contains(whole, F.lit(":")), F.trim(F.split(whole, ":")[0]))] if subtitle else []
    return _forms(*_scripts(whole), *_scripts(F.regexp_replace(whole, YEAR, "")), F.regexp_replace(whole, NICKNAME, ""), *before)


def plain_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, SIGNS, " "), r"\s+", " "))


def base_album_key(key: Column) -> Column:
    """An album's key without the year that tells namesakes of one list apart."""
    return F.split(key, YEAR_MARK, 2)[0]
