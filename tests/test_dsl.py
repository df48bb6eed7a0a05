import pytest
from pyspark.sql import functions as F

from sparkledger.functions import dsl
from sparkledger.functions import numbers as N
from sparkledger.functions import tables as T

TABLE = [["item", "2009", "2008"], ["revenue", "$ 5829", "5735"], ["share", "22% ( 22 % )", "20%"], ["revenue", "1,000", "( 41317 )"]]
PROGRAMS = [
    ("subtract(5829, 5735)", 94.0, None), ("subtract(5829, 5735), divide(#0, 5735)", 94 / 5735, None), ("multiply(22%, const_100)", 22.0, None), ("exp(2, const_m1)", 0.5, None), ("greater(3, 2)", None, "yes"), ("greater(2, 2)", None, "no"),
    ("table_max(share, none)", 0.22, None), ("table_average(share, none), multiply(#0, 2)", 0.42, None), ("206588", 206588.0, None), ("15%", 0.15, None), ("add(1,234, 1)", 1235.0, None),
]
BAD = ["", None, "add(1, 2", "modulo(1, 2)", "add(#0, 2)", "add(1, 2), add(#5, 1)", "table_sum(nothing, none)", "table_sum(item (x), none)", "divide(1, 0)", "add(a, 1)", "words", "table_sum(revenue, none)"]


@pytest.fixture(scope="module")
def ran(spark):
    rows = [(i, p, TABLE) for i, p in enumerate([p for p, *_ in PROGRAMS] + BAD)]
    df = spark.createDataFrame(rows, "i int, p string, t array<array<string>>")
    return dsl.to_python(dsl.evaluate(df, F.col("p"), F.col("t")), F.col("p"), F.col("t")).orderBy("i").collect()


def test_values(ran):
    for r, (p, num, text) in zip(ran, PROGRAMS):
        assert r.value.error is None and r.value.text == text, p
        assert r.value.num == pytest.approx(num) if num is not None else r.value.num is None


def test_errors(ran):
    for r in ran[len(PROGRAMS) :]:
        assert r.value.error and r.value.num is None and r.value.text is None, r.p


def test_python_agrees(ran):
    for r, (p, num, text) in zip(ran, PROGRAMS):
        scope: dict = {}
        exec(r.python, scope)
        assert scope["answer"] == (text if num is None else pytest.approx(num)), p
    assert ran[1].python == "step_0 = 5829 - 5735\nstep_1 = step_0 / 5735\nanswer = step_1"


def test_grounding(spark):
    df = spark.createDataFrame([(TABLE, "subtract(5829, 5735), table_max(share, none)"), (TABLE, "41317"), (TABLE, None)], "t array<array<string>>, p string")
    got = [[(c.row, c.col) for c in r.c] for r in df.select(dsl.grounding_cells(F.col("t"), F.col("p")).alias("c")).collect()]
    assert got == [[(1, 1), (1, 2), (2, 1), (2, 2)], [(3, 2)], []]


def test_derivations(evaluate):
    rows = [("(1,617-1,434)/1,434", "(1617-1434)/1434"), ("[3] − [2]", "(3) - (2)"), ("12.5% × 4", "(12.5/100) * 4"), ("a - b", None), ("", None)]
    got = evaluate([(r[0],) for r in rows], "d string", e=dsl.derivation_expression(F.col("d")))
    assert [r["e"] for r in got] == [r[1] for r in rows]


def test_tables(evaluate):
    rows = [([["a", " b|c "], ["1"], None],), ([],), (None,)]
    got = evaluate(rows, "t array<array<string>>", m=T.linearize_table(F.col("t")))
    assert [r["m"] for r in got] == ["| a | b\\|c |\n|---|---|\n| 1 |  |", "", ""]


def test_thousands(evaluate):
    rows = [("1,234,567", "1234567"), ("1,23", "1,23"), ("12,3456", "12,3456"), ("a, 100", "a, 100"), ("$ 5,735 and 1,000", "$ 5735 and 1000")]
    got = evaluate([(r[0],) for r in rows], "t string", n=T.normalize_numbers(F.col("t")))
    assert [r["n"] for r in got] == [r[1] for r in rows]


def test_targets(evaluate):
    a = F.struct(F.col("n").alias("num"), F.col("s").alias("text"))
    got = evaluate([(94.0, None, "answer = 94"), (None, "yes", "answer = 'yes'")], "n double, s string, p string", t=T.format_target(a, F.col("p"), "answer"), c=T.format_target(a, F.col("p"), "pot_gold"))
    assert [r["t"] for r in got] == ["94", "yes"] and got[0]["c"] == "```python\nanswer = 94\n```"
    with pytest.raises(NotImplementedError):
        T.format_target(a, F.col("p"), "cot")
    with pytest.raises(Exception, match="verified gold program"):
        evaluate([(1.0, None, None)], "n double, s string, p string", c=T.format_target(a, F.col("p"), "pot_gold"))
    assert N.of(a) is not None
