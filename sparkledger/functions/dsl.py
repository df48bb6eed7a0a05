"""The arithmetic program language (D1-D9, J14, J15, W11): values by a parser over Arrow batches, all else inside Catalyst.

A program is 'op(a, b), op(#0, c)'; '#k' is the result of step k. Programs are never executed as text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers as N
from .tables import normalize_numbers
from .text import SPACE, once, strip

# The operations.
SYMBOLS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "exp": "**"}
TABLE_OPS = ["table_max", "table_min", "table_sum", "table_average"]


_STEP = r"([^()]*)\(([^()]+), ([^()]+)\)(?:, |$)"
_BLANK = " \t\n\r\f\x0b"


def steps(program: Column) -> Column:
    """array<struct<n, op, a, b>>; null if the program is malformed. Each step has two arguments without brackets or ', '.

    A program is well-formed if the steps found in it, written out again, are all of it, and it has no other ', ' than theirs."""
    op, a, b = (F.regexp_extract_all(program, F.lit(_STEP), F.lit(i)) for i in (1, 2, 3))
    found = F.arrays_zip(op.alias("op"), a.alias("a"), b.alias("b"))
    again = F.array_join(F.transform(found, lambda z: F.concat(z["op"], F.lit("("), z["a"], F.lit(", "), z["b"], F.lit(")"))), ", ")
    bare = lambda x: F.btrim(x, F.lit(_BLANK))
    made = F.transform(found, lambda z, i: F.struct(i.alias("n"), bare(z["op"]).alias("op"), bare(z["a"]).alias("a"), bare(z["b"]).alias("b")))
    return F.when((again == program) & (program != "") & (F.size(F.split(program, ", ")) == F.size(found) * 2), made)


def row_values(table: Column, name: Column) -> Column:
    """Numbers of the last row whose first cell is the name; null if there is none, it's empty or a cell is no number."""
    rows = F.filter(table, lambda r: strip(F.get(r, F.lit(0))) == name)
    row = F.try_element_at(rows, F.lit(-1))
    cells = F.transform(F.slice(row, F.lit(2), F.greatest(F.size(row), F.lit(1))), lambda c: N.argument_number(strip(F.element_at(F.split(strip(F.replace(c, F.lit("$"), F.lit(""))), r"\("), 1))))
    return F.when((F.size(cells) > 0) & F.forall(cells, lambda v: v.isNotNull()), cells)


# --- values of programs: an Arrow UDF per batch, as a fold over steps inside lambda functions runs uncompiled and costs some ten times as much ---

_STEPS = re.compile(_STEP)
_FLOAT = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_BEFORE_BRACKET = re.compile(r"[^(]*")


def _float(t: str) -> float | None:
    t = t.strip(SPACE)
    return float(t) if _FLOAT.fullmatch(t) else None


def argument_value(a: str) -> float | None:
    """N16 for one argument, as numbers.argument_number has it."""
    t = a.replace(",", "")
    found = _float(t)
    if found is None and "%" in t:
        found = _float(t.replace("%", ""))
        found = None if found is None else found / 100
    c = t.strip(" ")
    if found is None and c.startswith("const_"):
        found = -1.0 if c == "const_m1" else _float(c[6:])
    return found


def _row(table: list | None, name: str) -> list[float] | None:
    """D4 for one table, as row_values has it."""
    rows = [r for r in table if r is not None and len(r) and r[0] is not None and r[0].strip(SPACE) == name] if table is not None else []
    cells = [argument_value(_BEFORE_BRACKET.match(c.replace("$", "").strip(SPACE))[0].strip(SPACE)) if c is not None else None for c in rows[-1][1:]] if rows else []
    return cells if cells and None not in cells else None


def _power(a: float, b: float) -> float:
    try:
        return math.pow(a, b)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan


_BINARY = {"add": float.__add__, "subtract": float.__sub__, "multiply": float.__mul__, "divide": lambda a, b: a / b if b else None, "exp": _power}
_WHOLE_ROW = {"table_max": max, "table_min": min, "table_sum": sum, "table_average": lambda row: sum(row) / len(row)}


def program_value(program: str | None, table: list | None = None) -> tuple[float | None, str | None, str | None]:
    """Number, word and error of a program: a number, or yes/no for a last step `greater`; error says why there is none."""
    source = (program or "").strip(SPACE)
    if not source:
        return None, None, "empty program"
    if "(" not in source:
        bare = None if source.startswith("#") else argument_value(source)
        return (bare, None, None) if bare is not None else (None, None, "no argument")
    found = _STEPS.findall(source)
    if ", ".join(f"{op}({a}, {b})" for op, a, b in found) != source or len(source.split(", ")) != 2 * len(found):
        return None, None, "malformed program"
    done: list[float | None] = []
    error = word = None
    for n, (op, *arguments) in enumerate(found):
        op, value, word, why = op.strip(_BLANK), None, None, None
        arguments = [a.strip(_BLANK) for a in arguments]
        if op in _WHOLE_ROW:
            row = _row(table, arguments[0])
            value, why = (None, "no numeric row of that name") if row is None else (_WHOLE_ROW[op](row), None)
        elif op in _BINARY or op == "greater":
            refs = [(int(a[1:]) if re.fullmatch("[0-9]{1,8}", a[1:]) else n) if a.startswith("#") else None for a in arguments]
            if any(r is not None and r >= n for r in refs):
                why = "reference to a later step"
            else:
                a, b = (argument_value(x) if r is None else done[r] for x, r in zip(arguments, refs))
                if any(r is None and v is None for r, v in zip(refs, (a, b))):
                    why = "argument is no number"
                elif a is not None and b is not None:
                    if op == "greater":
                        word = "yes" if a > b else "no"
                    else:
                        value = _BINARY[op](a, b)
        else:
            why = f"unknown operation {op}"
        done.append(value)
        error = error or why
    num = done[-1] if done[-1] is not None and math.isfinite(done[-1]) else None
    error = error or ("no value" if num is None and word is None else None)
    return (None, None, error) if error else (num, word, None)


def _values(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for programs, grids in batches:
        plain = grids.isna().all()
        known = {p: program_value(p) for p in programs.unique()} if plain else {}
        rows = [known[p] for p in programs] if plain else [program_value(p, g) for p, g in zip(programs, grids)]
        yield pd.DataFrame(rows, columns=["num", "text", "error"]).astype({"num": "float64"})


def evaluate(df: DataFrame, program: Column, table: Column | None = None, name: str = "value") -> DataFrame:
    """Adds `name`: the value of each row's program, as struct<num, text, error>."""
    table = F.lit(None).cast("array<array<string>>") if table is None else table
    return df.withColumn(name, F.pandas_udf(_values, "num double, text string, error string")(program, table))


def _argument_text(a: Column) -> Column:
    """D3: an argument as source text, with its own digits where it is a plain number."""
    t = F.replace(a, F.lit(","), F.lit(""))
    plain, percent = r"^-?[0-9]+(\.[0-9]+)?$", r"^(-?[0-9]+(?:\.[0-9]+)?)\s*%$"
    wrap = lambda x: F.when(F.startswith(x, F.lit("-")), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)
    return (
        F.when(F.startswith(a, F.lit("#")), F.concat(F.lit("step_"), F.substring(a, 2, 9)))
        .when(t.rlike(plain), wrap(t))
        .when(t.rlike(percent), F.concat(F.lit("("), F.regexp_extract(t, percent, 1), F.lit(" / 100)")))
        .otherwise(N.literal(N.argument_number(a)))
    )


def to_python(df: DataFrame, program: Column, table: Column | None = None, name: str = "python", value: str | None = None) -> DataFrame:
    """Adds `name`: the program as Python source that assigns `answer`; null where its form is wrong. value: the column of `evaluate`, if there is one."""
    table = F.lit(None).cast("array<array<string>>") if table is None else table
    symbol = F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))

    def line(s: Column) -> Column:
        a, b, row = s["a"], s["b"], s["row"]
        listed = F.concat(F.lit("["), F.array_join(row, ", "), F.lit("]"))
        call = lambda f: F.concat(F.lit(f"{f}("), listed, F.lit(")"))
        expression = (
            F.when(s["op"] == "greater", F.concat(F.lit('"yes" if '), a, F.lit(" > "), b, F.lit(' else "no"')))
            .when(s["op"] == "table_max", call("max"))
            .when(s["op"] == "table_min", call("min"))
            .when(s["op"] == "table_sum", call("sum"))
            .when(s["op"] == "table_average", F.concat(call("sum"), F.lit(" / "), F.size(row).cast("string")))
            .otherwise(F.concat(a, F.lit(" "), F.try_element_at(symbol, s["op"]), F.lit(" "), b))
        )
        return F.concat(F.lit("step_"), s["n"].cast("string"), F.lit(" = "), expression)

    source = strip(F.coalesce(program, F.lit("")))
    made = df.withColumn("_value", F.col(value)) if value else evaluate(df, program, table, "_value")
    made = made.withColumn("_source", source).withColumn("_parsed", steps(F.col("_source")))
    texts = F.transform("_parsed", lambda s: F.struct(s["n"].alias("n"), s["op"].alias("op"), _argument_text(s["a"]).alias("a"), _argument_text(s["b"]).alias("b"), F.when(s["op"].isin(TABLE_OPS), F.transform(row_values(table, s["a"]), N.literal)).alias("row")))
    made = made.withColumn("_lines", F.transform(texts, line))
    last = F.concat(F.lit("answer = step_"), (F.size("_lines") - 1).cast("string"))
    whole = F.when(F.contains("_source", F.lit("(")), F.array_join(F.concat("_lines", F.array(last)), "\n")).otherwise(F.concat(F.lit("answer = "), _argument_text(F.col("_source"))))
    formed = F.coalesce(F.col("_value.error") == "no value", F.lit(True))
    return made.withColumn(name, F.when(formed, whole)).drop("_value", "_source", "_parsed", "_lines")


def verified(value: Column, gold: N.Answer) -> Column:
    """Whether a program's value (of `evaluate`) is the gold answer by the strict rule."""
    return value["error"].isNull() & N.answers_match(N.of(value), gold)


def _cells(table: Column, operands: Column, rows: Column) -> Column:
    """Cells right of the first column whose number is an operand, or whose row is used whole."""

    def found(used_numbers: Column, used_rows: Column) -> Column:
        def of_row(row: Column, r: Column) -> Column:
            whole = F.coalesce(F.array_contains(used_rows, strip(F.get(row, F.lit(0)))), F.lit(False))
            cells = F.transform(row, lambda c, i: F.struct(r.alias("row"), i.alias("col"), c.alias("text"), N.cell_number(c).alias("num")))
            kept = F.filter(cells, lambda c: (c["col"] > 0) & c["num"].isNotNull() & (F.array_contains(used_numbers, c["num"]) | whole))
            return F.transform(kept, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["text"].alias("text")))

        return F.flatten(F.transform(table, of_row))

    return once(operands, lambda numbers: once(rows, lambda names: found(numbers, names)))


def grounding_cells(table: Column, program: Column) -> Column:
    """The table cells a program reads, as array<struct<row, col, text>>."""
    source = F.coalesce(program, F.lit(""))
    parsed = F.coalesce(steps(source), F.array().cast("array<struct<n:int,op:string,a:string,b:string>>"))
    arguments = F.flatten(F.transform(F.filter(parsed, lambda s: ~s["op"].isin(TABLE_OPS)), lambda s: F.array(s["a"], s["b"])))
    literals = F.filter(arguments, lambda a: ~F.startswith(a, F.lit("#")) & ~F.startswith(a, F.lit("const_")))
    numbers = F.when(F.contains(source, F.lit("(")), F.transform(literals, N.cell_number)).otherwise(F.array(N.cell_number(source)))
    rows = F.transform(F.filter(parsed, lambda s: s["op"].isin(TABLE_OPS)), lambda s: s["a"])
    return _cells(table, F.filter(numbers, lambda v: v.isNotNull()), rows)


def derivation_expression(derivation: Column) -> Column:
    """A written derivation as an expression of + - * / and parentheses; null if it has anything else."""
    e = F.translate(strip(F.coalesce(derivation, F.lit(""))), "[]×÷−$", "()*/-")
    e = F.regexp_replace(normalize_numbers(e), r"([0-9]+(?:\.[0-9]+)?)\s*%", "($1/100)")
    e = strip(F.regexp_replace(e, r"\s+", " "))
    return F.when(e.rlike(r"^[0-9.+\-*/() ]+$"), e)


def derivation_cells(table: Column, expression: Column) -> Column:
    """Cells whose number is a literal of the expression other than 100."""
    found = F.transform(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return _cells(table, F.filter(found, lambda v: v != 100), F.array().cast("array<string>"))
