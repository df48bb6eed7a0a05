from pyspark.sql import functions as F

from sparkledger.functions import numbers as N

PARSED = [
    ("12", 12.0), ("$1,234.50", 1234.5), ("15%", 15.0), ("(1,200)", -1200.0), ("1.2 million", 1.2e6), ("3 bn", 3e9), ("−5", -5.0), ("abc", None), ("", None), (None, None), (".5", 0.5), ("1e-3", 0.001),
    ("5k", 5.0), ("5 k", 5000.0), ("10-k", 10000.0), ("(-5)", 5.0), ("301/2575", 301.0), ("fy 2019 rev 10", 2019.0), ("( 5 )%", 5.0), ("2 thousand million", 2000.0), ("  7 Trillion ", 7e12), ("(", None),
]


def test_normalize_number(evaluate):
    got = evaluate([(t,) for t, _ in PARSED], "t string", v=N.normalize_number(F.col("t")))
    assert [r["v"] for r in got] == [v for _, v in PARSED]


STRICT = [
    (10.0, None, 10.0, None, True), (0.1, None, 0.1009, None, True), (0.1, None, 0.1011, None, False), (1000.0, None, 1000.9, None, True), (1002.0, None, 1000.0, None, False), (None, "Yes.", None, "yes", True),
    (None, "no", None, "yes", False), (None, None, 5.0, None, False), (None, "Level 3", None, "3.000", True), (None, None, None, "none", True), (None, "A  b", None, "a b", True), (None, "94", 94.0, None, True),
]


def test_answers_match(evaluate):
    p, g = N.Answer(F.col("pn"), F.col("pt")), N.Answer(F.col("gn"), F.col("gt"))
    got = evaluate([r[:4] for r in STRICT], "pn double, pt string, gn double, gt string", v=N.answers_match(p, g))
    assert [r["v"] for r in got] == [r[4] for r in STRICT]


PRIMARY = [(94.9, 94.0, False, True), (95.0, 94.0, False, False), (14.5, 0.145, True, True), (14.5, 0.145, False, False), (0.01, 0.0, False, False), (0.0, 0.00005, False, True), (None, 1.0, False, False), (None, None, False, True)]


def test_primary_match(evaluate):
    got = evaluate([r[:3] for r in PRIMARY], "p double, g double, f boolean", v=N.primary_match(N.number(F.col("p")), N.number(F.col("g")), F.col("f")))
    assert [r["v"] for r in got] == [r[3] for r in PRIMARY]


def test_argument_and_cell_numbers(evaluate):
    rows = [("1,234", 1234.0, 1234.0), ("15%", 0.15, 15.0), ("const_100", 100.0, 100.0), ("const_m1", -1.0, 1.0), ("1d", None, 1.0), ("( 41317 )", None, 41317.0), ("x", None, None)]
    got = evaluate([(r[0],) for r in rows], "t string", a=N.argument_number(F.col("t")), c=N.cell_number(F.col("t")))
    assert [(r["a"], r["c"]) for r in got] == [(a, c) for _, a, c in rows]


def test_written_answers(evaluate):
    rows = [(0.144, "14%", True), (0.146, "14%", False), (94.4, "94", True), (94.6, "94", False), (9.94, "9.9", True), (1.0, "", False), (None, "1", False)]
    got = evaluate([r[:2] for r in rows], "v double, w string", h=N.human_match(F.col("v"), F.col("w")))
    assert [r["h"] for r in got] == [r[2] for r in rows]


def test_formats(evaluate):
    rows = [(3.0, "3"), (0.145, "0.145"), (-2.5, "-2.5"), (0.1234567, "0.12346"), (None, None)]
    got = evaluate([(r[0],) for r in rows], "v double", f=N.format_answer(N.number(F.col("v"))), s=N.si(F.col("v") * 1e9), p=N.percent_text(F.col("v")))
    assert [r["f"] for r in got] == [r[1] for r in rows]
    assert got[0]["s"] == "3.00 G" and got[4]["p"] == "-"


def test_power_of_ten(evaluate):
    got = evaluate([(1000.0, 1.0), (3.0, 1.0), (1.0, 1.0), (1.0, 0.0)], "v double, g double", o=N.power_of_ten_off(F.col("v"), F.col("g")))
    assert [r["o"] for r in got] == [True, False, False, False]
