"""Numbers in answers and how answers are compared.

An answer is a number or a text; an Answer says which it can be, and a struct <num double, text string> keeps it in a column.
Both null is a missing answer. Nothing here is a UDF.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain, strip

# Scale words in the order in which they are looked for.
SCALES = [
    ("thousand", 1e3), ("thousands", 1e3), ("k", 1e3), ("million", 1e6), ("millions", 1e6), ("mm", 1e6), ("mn", 1e6),
    ("billion", 1e9), ("billions", 1e9), ("bn", 1e9), ("trillion", 1e12), ("trillions", 1e12),
]
# Tolerances of the strict and of the primary rule.
STRICT_REL, STRICT_ABS, PRIMARY_REL, PRIMARY_ABS = 1e-3, 1e-4, 0.01, 1e-4
_NUMBER = r"(-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[-+]?[0-9]+)?)"
_FLOAT = r"(?U)^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
_SCALE = r"(?U)\b(" + "|".join(sorted((w for w, _ in SCALES), key=len, reverse=True)) + r")\b"


@dataclass(frozen=True)
class Answer:
    """An answer as expressions: a number, a text, or one of them per row. What it can't be is None, so that plans only have what they need."""

    num: Column | None = None
    text: Column | None = None

    @property
    def value(self) -> Column:
        """Its number, or the one in its text."""
        if self.text is None:
            return self.num
        found = normalize_number(self.text)
        return found if self.num is None else F.coalesce(self.num, found)

    @property
    def shown(self) -> Column:
        if self.text is None:
            return self.num.cast("string")
        return self.text if self.num is None else F.coalesce(self.text, self.num.cast("string"))

    @property
    def missing(self) -> Column:
        return reduce(Column.__and__, (c.isNull() for c in (self.num, self.text) if c is not None))

    def struct(self) -> Column:
        """struct<num double, text string>, to keep in a column."""
        num = F.lit(None).cast("double") if self.num is None else self.num
        return F.struct(num.alias("num"), (F.lit(None).cast("string") if self.text is None else self.text).alias("text"))


def number(x: Column) -> Answer:
    return Answer(num=x.cast("double"))


def text(x: Column) -> Answer:
    return Answer(text=x)


def either(num: Column, txt: Column) -> Answer:
    """A number where there is one, else a text."""
    return Answer(num.cast("double"), F.when(num.isNull(), txt))


def of(answer: str | Column) -> Answer:
    """A column of structs, read as answers."""
    c = F.col(answer) if isinstance(answer, str) else answer
    return Answer(c["num"], c["text"])


def _found(x: Column, pattern: str) -> Column:
    """The pattern's first group as a double. Casting '' is slow (it fails by an exception), so it becomes null before."""
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("double")


def normalize_number(x: Column) -> Column:
    """The number that a text holds, or null: the first one anywhere, '$', ',' and '%' dropped; the first scale word of SCALES multiplies it, parentheses around the whole text negate it."""
    low = F.lower(x)
    num = _found(F.translate(low, "−$,%", "-"), _NUMBER)
    # most answers are digits and signs alone; the patterns for words and brackets only run on the rest
    has_words, has_bracket = F.translate(low, "0123456789.,$%−- ", "") != "", F.contains(x, F.lit("("))
    words = F.regexp_extract_all(low, F.lit(_SCALE), F.lit(1))
    place = F.array_min(F.transform(words, lambda w: F.array_position(F.array(*(F.lit(w_) for w_, _ in SCALES)), w)))
    by = F.when(has_words & low.rlike(_SCALE), F.element_at(F.array(*(F.lit(m) for _, m in SCALES)), place.cast("int"))).otherwise(F.lit(1.0))
    return num * by * F.when(has_bracket & x.rlike(r"(?sU)^\s*\(.*\)\s*$"), F.lit(-1.0)).otherwise(F.lit(1.0))


def close(p: Column, g: Column, rel: float = STRICT_REL, absolute: float = STRICT_ABS) -> Column:
    """The strict numeric rule: within rel of the gold, its magnitude counted as 1 at least."""
    return F.abs(p - g) <= F.greatest(F.lit(absolute), F.lit(rel) * F.greatest(F.abs(g), F.lit(1.0)))


def near(p: Column, g: Column, rel: float = PRIMARY_REL) -> Column:
    return F.abs(p - g) <= F.greatest(F.lit(PRIMARY_ABS), F.lit(rel) * F.abs(g))


def _same_text(pred: Answer, gold: Answer) -> Column:
    """Equality where not both sides have numbers."""
    if pred.text is None and gold.text is None:
        return pred.num.isNull() & gold.num.isNull()
    return plain(pred.shown) == plain(gold.shown)


def answers_match(pred: Answer, gold: Answer, rel: float = STRICT_REL, absolute: float = STRICT_ABS) -> Column:
    """Numbers within the tolerance, or else equal plain texts. Never null."""
    return F.coalesce(close(pred.value, gold.value, rel, absolute), _same_text(pred, gold))


def primary_match(pred: Answer, gold: Answer, percent_form: Column | None = None) -> Column:
    """What the strict rule accepts, and numbers within 1 %; an answer written with a percent sign may also mean a hundredth. Never null."""
    p, g = pred.value, gold.value
    fits = close(p, g) | near(p, g)
    if percent_form is not None:
        fits = fits | (F.coalesce(percent_form, F.lit(False)) & (near(p / 100, g) | close(p / 100, g)))
    return F.coalesce(fits, _same_text(pred, gold))


def within(value: Column, gold: Column, rel: float = PRIMARY_REL) -> Column:
    """Closeness of two numbers; false if either is missing."""
    return F.coalesce(near(value, gold, rel), F.lit(False))


def human_match(value: Column, written: Column) -> Column:
    """Equal to the annotator's written number at the precision it was written with."""
    num = F.regexp_extract(F.replace(F.coalesce(written, F.lit("")), F.lit(","), F.lit("")), r"(-?[0-9]+(?:\.[0-9]+)?)", 1)
    point = F.instr(num, ".")
    decimals = F.when(point > 0, F.length(num) - point).otherwise(F.lit(0))
    unit = F.when(F.contains(written, F.lit("%")), F.lit(100.0)).otherwise(F.lit(1.0))
    half = F.lit(0.5) * F.pow(F.lit(10.0), -decimals) / unit
    return F.coalesce(F.abs(value - num.try_cast("double") / unit) <= half + F.lit(1e-12), F.lit(False))


def power_of_ten_off(value: Column, gold: Column) -> Column:
    """The ratio is within 1 % of a power of ten other than 1. Neither side may be 0."""
    ratio = F.abs(F.try_divide(value, gold))
    k = F.rint(F.log10(ratio))
    return F.coalesce((k != 0) & (F.abs(ratio / F.pow(F.lit(10.0), k) - 1) <= 0.01), F.lit(False))


def gold_matches(value: Answer, gold: Answer, two_decimals: bool = False) -> Column:
    """The strict rule; with two_decimals also within half a hundredth, if both are numbers."""
    strict = answers_match(value, gold)
    if not two_decimals:
        return strict
    if value.num is None or gold.num is None:
        return strict
    return strict | F.coalesce(F.abs(value.num - gold.num) <= F.lit(0.005) + F.lit(1e-9) * F.abs(gold.num), F.lit(False))


def plain_float(x: Column) -> Column:
    """A text that is a number and nothing else, as a double."""
    return _found(x, _FLOAT)


def argument_number(x: Column) -> Column:
    """A program's argument: commas dropped, 'x%' is a hundredth, const_N is N and const_m1 is -1; else null."""
    t = F.translate(x, ",", "")
    percent = F.when(F.contains(t, F.lit("%")), plain_float(F.translate(t, "%", "")) / 100)
    c = F.trim(t)
    const = F.when(F.startswith(c, F.lit("const_")), F.when(c == "const_m1", F.lit(-1.0)).otherwise(plain_float(F.substring(c, 7, 1000))))
    return F.coalesce(plain_float(t), percent, const)


def cell_number(x: Column) -> Column:
    """The first plain number in a table cell; parentheses don't negate."""
    return _found(F.translate(x.cast("string"), ",$", ""), r"(-?[0-9]+(?:\.[0-9]+)?)")


def fixed(v: Column, digits: int) -> Column:
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f", v))


def format_number(v: Column) -> Column:
    """Integers without a point, other numbers with at most 5 decimals."""
    whole = (F.floor(v) == v) & (F.abs(v) < 1e15)
    trimmed = F.regexp_replace(F.regexp_replace(fixed(v, 5), "0+$", ""), r"\.$", "")
    return F.when(whole, v.cast("long").cast("string")).otherwise(trimmed)


def format_answer(answer: Answer) -> Column:
    shown = [answer.text] if answer.text is not None else []
    return F.coalesce(*shown, *([format_number(answer.num)] if answer.num is not None else []))


def literal(v: Column) -> Column:
    """A compact literal, in parentheses if negative."""
    whole = (F.floor(v) == v) & (F.abs(v) < 1e15)
    s = F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))
    return F.when(F.startswith(s, F.lit("-")), F.concat(F.lit("("), s, F.lit(")"))).otherwise(s)


def si(v: Column, digits: int = 2) -> Column:
    """A number with the prefix E, P, T, G or M; '-' for null."""
    out = fixed(v, digits)
    for size, name in ((1e6, "M"), (1e9, "G"), (1e12, "T"), (1e15, "P"), (1e18, "E")):
        out = F.when(F.abs(v) >= size, F.concat(fixed(v / size, digits), F.lit(" " + name))).otherwise(out)
    return F.coalesce(out, F.lit("-"))


def percent_text(v: Column, digits: int = 1) -> Column:
    """A share as a percentage; '-' for null."""
    return F.coalesce(F.concat(fixed(v * 100, digits), F.lit("%")), F.lit("-"))


def minutes_text(seconds: Column) -> Column:
    """Minutes from a minute on, else seconds; '-' for null."""
    return F.coalesce(F.when(seconds >= 60, F.concat(fixed(seconds / 60, 1), F.lit(" min"))).otherwise(F.concat(fixed(seconds, 0), F.lit(" s"))), F.lit("-"))
