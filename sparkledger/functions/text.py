"""Text expressions shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's white space. Trimming it off ends costs far less than a pattern.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(x: Column) -> Column:
    """White space off both ends, by Unicode's idea of it."""
    return F.btrim(x, F.lit(SPACE))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out only once however often f uses it: the planner would write it out at every use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


#: Everything up to the end of a line, as Python's splitlines() sees it.
LINE = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*"


def first_line(x: Column) -> Column:
    """First line of the stripped text; '' for null and blank text."""
    return F.coalesce(F.rtrim(F.regexp_extract(F.ltrim(x, F.lit(SPACE)), f"^({LINE})", 1), F.lit(SPACE)), F.lit(""))


def last_line(x: Column, limit: int = 300) -> Column:
    """Last line of an error text, at most `limit` characters."""
    return F.substring(F.element_at(F.split(strip(F.coalesce(x, F.lit(""))), "\n"), -1), 1, limit)


def plain(x: Column) -> Column:
    """Lower case, single spaces, no spaces or full stops at the ends; null reads as 'none'."""
    s = squeeze(F.lower(F.coalesce(x, F.lit("none"))))
    return F.btrim(s, F.lit(" ."))
