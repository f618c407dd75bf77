"""Formulas over columns, groups and grids: what a spreadsheet of the model gives."""

import math
import random
import struct
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from gridloom.functions.numberformat import format_value
from gridloom.operators import grid
from gridloom.plans.compiler import calculated, evaluate, summary
from gridloom.plans.recalc import evaluate_in, numbered, recalculated

GOLDENS = {
    "HARMEAN(1,0)": 0, 'TEXT(1.005,"0.00")': "1.00", 'TEXT(2.675,"0.00")': "2.67", 'TEXT(0.125,"0.00")': "0.12", 'TEXT(-1234.5,"#,##0")': "-1,234", "FIXED(2.675,2,TRUE)": "2.67", "FIXED(2.675,2)": "2.68", "DOLLAR(-1.5)": "-$1.50", 'TEXT(1234567.891,"#,##0.0")': "1,234,567.9",
    'TEXT(0.285,"0%")': "28%", 'TEXT(1234,"0.0E+00")': "1.2E+003", "AVERAGEA(1,TRUE)": 1, "MINA(2,FALSE)": 0, "CBRT(27)": 3, "ACOS(1)": 0, "ASIN(0)": 0, "ATAN(0)": 0, "COS(0)": 1, "SIN(0)": 0, "TAN(0)": 0, "SINH(0)": 0, "COSH(0)": 1, "TANH(0)": 0, "ASINH(0)": 0, "ACOSH(1)": 0, "ATANH(0)": 0,
    "COT(1)": 1 / math.tan(1), "CSC(1)": 1 / math.sin(1), "EXP(0)": 1, "LOG10(1000)": 3, "POWER(2,10)": 1024, "RADIANS(180)": math.pi, "SIGN(-3)": -1, "ABS(-3)": 3, "CEILING.MATH(4.1)": 5, "FLOOR.MATH(-4.1)": -5, 'CONCAT("a",1,TRUE)': "a1TRUE", 'CONCATENATE("a","b")': "ab", 'NUMBERVALUE("12.5")': 12.5,
    "MINUTE(0.5+1/1440+40000)": 1, "SECOND(40000.5)": 0, "MODE.SNGL(1,2,2)": 2, "MODE.MULT(3,3,1)": 3, "PERCENTILE.INC(1,2,3,0.5)": 2, "PERCENTRANK.INC(1,2,3,4,5,3)": 0.625, "QUARTILE.INC(1,2,3,2)": 2, "RANK.EQ(2,1,2,3)": 2, "RANK.AVG(3,1,2,3)": 1, "STDEV.S(1,3)": math.sqrt(2), "STDEVP(1,3)": 1, "VAR.P(1,3)": 1,
    "ISFORMULA(1)": False, "FALSE": False, '"b">"A"': True, '"_">"a"': True, 'IF(TRUE,1,"x")+1': 2, 'IFERROR(MOD(IFERROR(MOD(IFERROR(MOD(7,4),0),0),5),2),9)': 1,
}


@pytest.mark.parametrize("part", [dict(list(GOLDENS.items())[i : i + 16]) for i in range(0, len(GOLDENS), 16)], ids=lambda p: next(iter(p)))
def test_goldens(spark, part):
    row = evaluate(spark, {f"c{i}": f"={f}" for i, f in enumerate(part)}).first()
    for (formula, wanted), got in zip(part.items(), row, strict=True):
        assert got == (pytest.approx(wanted) if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) else wanted), formula


def test_harmonic_errors(spark):
    row = evaluate(spark, {"a": "=HARMEAN(1,-1)", "b": '=HARMEAN("x")'}, errors=True).first()
    assert (row["a_error"], row["b_error"]) == ("#DIV/0!", "#NUM!")
    df = spark.createDataFrame([(1.0, 1.0), (0.0, -1.0)], "a double, b double")
    row = summary(df, {"a": "=HARMEAN(a)", "b": "=HARMEAN(b)"}, errors=True).first()
    assert row["a"] == 0 and row["b_error"] == "#DIV/0!"


def test_fixed_formats_round_the_binary_value(spark):
    rnd = random.Random(21)
    values = [rnd.choice([1, -1]) * round(rnd.random() * 10 ** rnd.randint(0, 9), rnd.randint(0, 6)) for _ in range(1500)] + [0.125, 0.375, 2.5, 3.5, 1.005, 1e15, 123456789012.345, 0.0, -0.004]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for code, d in (("0", 0), ("0.00", 2), ("0.000", 3)):
        for r in df.select("x", format_value(F.col("x"), code).alias("t")).collect():
            want = str(abs(Decimal(r["x"])).quantize(Decimal(1).scaleb(-d), ROUND_HALF_EVEN))
            assert r["t"].lstrip("-") == want and (r["t"][0] == "-") == (r["x"] < 0), (r["x"], code)


def test_plans_grow_in_proportion(spark):
    """Formulas inside formulas that carry errors: the plan has a projection for each, not an expression for each path."""
    df, sizes = spark.createDataFrame([(4.0,)], "v double"), []
    for depth in (4, 8, 16):
        f = "v"
        for _ in range(depth):
            f = f"IFERROR(MOD({f},3)+1,7)"
        got = calculated(df, {"a": "=" + f})
        sizes.append(len(got._jdf.queryExecution().analyzed().toString()))
        assert got.first()["a"] is not None
    assert sizes[2] < 5 * sizes[0]


def test_column_aggregates(spark):
    df = spark.createDataFrame([(1, 5.0, "b", True, 6), (2, 5.0, None, True, 4), (3, 2.0, "a", False, 10), (4, 2.0, "", None, 2), (5, None, "c", True, 8)], "pos int, v double, s string, t boolean, k int")
    f = {
        "mode": "=MODE(v)", "join": '=TEXTJOIN("-",TRUE,s)', "all": '=TEXTJOIN("-",FALSE,s)', "cat": "=CONCAT(s,k)", "and": "=AND(t)", "or": "=OR(t)", "xor": "=XOR(t)", "npv": "=NPV(0.1,v)", "lcm": "=LCM(k)", "gcd": "=GCD(k)", "max": "=MAX(v,k)", "avg": "=AVERAGE(v,k)", "var": "=VAR(v,k)",
        "large": "=LARGE(k,1+1)", "median": "=MEDIAN(v,k)", "sumif": '=SUMIF(k,">"&AVERAGE(k))', "both": "=SUM(v:k)", "rank": "=RANK(MAX(k),k)", "bad": '=SUMIF(k,">"&(1/0))',
    }
    row = summary(df, f, pos="pos", errors=True).first()
    want = {"mode": 5, "join": "b-a--c", "all": "b--a--c", "cat": "bac641028", "and": False, "or": True, "xor": True, "npv": 5 / 1.1, "lcm": 120, "gcd": 2, "max": 10, "avg": 44 / 9, "large": 8, "median": 5, "sumif": 18, "rank": 1}
    for name, value in want.items():
        assert row[name] == (pytest.approx(value) if not isinstance(value, (str, bool)) else value), name
    assert row["bad_error"] == "#DIV/0!" and row["both"] == 14 + 30 + 3


def test_order_statistics_by_group(spark):
    rnd = random.Random(22)
    rows = [(rnd.choice(["a", "b", None]), float(rnd.randint(0, 20)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, pos int")
    f = {"large": "=LARGE(v,3)", "small": "=SMALL(v,2)", "median": "=MEDIAN(v)", "p": "=PERCENTILE(v,0.3)", "dev": "=AVEDEV(v)", "mode": "=MODE(v)", "gcd": "=GCD(v)", "n": "=COUNT(v)"}
    for r in summary(df, f, by=["g"], pos="pos").collect():
        own = [v for g, v, _ in rows if g == r["g"]]
        s, counts = sorted(own), Counter(own)
        at = lambda p: s[int(p * (len(s) - 1))] + (p * (len(s) - 1) % 1) * (s[min(int(p * (len(s) - 1)) + 1, len(s) - 1)] - s[int(p * (len(s) - 1))])  # noqa: E731, B023
        assert (r["large"], r["small"], r["n"]) == (s[-3], s[1], len(s)) and r["median"] == at(0.5) and r["p"] == pytest.approx(at(0.3))
        assert r["dev"] == pytest.approx(sum(abs(v - sum(s) / len(s)) for v in s) / len(s)) and r["mode"] == max(own, key=lambda v: (counts[v], -own.index(v))) and r["gcd"] == math.gcd(*map(int, s))


def sheet(spark, cells, name="S", book=""):
    rows = []
    for ref, v in cells.items():
        row, col = grid.cell_position(ref)
        formula = v[1:] if isinstance(v, str) and v.startswith("=") else None
        own = ("blank", None, None, None) if formula else ("boolean", None, None, v) if isinstance(v, bool) else ("text", None, v, None) if isinstance(v, str) else ("number", float(v), None, None)
        rows.append((book, name, row, col, *own, None, formula, None))
    return spark.createDataFrame(rows, grid.CELLS)


def test_recalculation(spark):
    cells = {"A1": 10, "A2": 20, "A3": 30, "A4": 5, "B1": "X", "B2": "Y", "B3": "Z", "B5": True}
    want = {
        "=SUM(A1:A3)": 60, '=SUMIF(A1:A4,">"&15)': 50, '=VLOOKUP("y",B1:B3,1,FALSE)': "Y", '=VLOOKUP("q",B1:B3,1,FALSE)': "#N/A", "=VLOOKUP(1,A1:B3,9)": "#N/A", '=IF(A1>5,"big",B1)': "big", "=IF(A1>50,1,B1)": "X", '=AVERAGE(A1:A9)&""': "16.25", "=COUNTBLANK(A1:A9)": 5, "=COUNTA(A1:B5)": 8,
        "=INDEX(A1:B3,2,2)": "Y", "=INDEX(A1:B3,9,1)": "#REF!", "=MATCH(25,A1:A3,1)": 2, "=MATCH(5,A1:A4,0)": 4, "=Other!A1+1": 101, "=rate*2": 20, "=MEDIAN(A1:A4)": 15, '=TEXTJOIN("-",TRUE,B1:B4)': "X-Y-Z", '=B1="x"': True, "=ISTEXT(B1)": True, "=ISBLANK(Z9)": True, "=AND(A1:A2)": True, "=XOR(B5:B5)": True,
        "=SUMPRODUCT(A1:A2,A3:A4)": 400, "=1+": "#NAME?", "=Z9": 0, "=LARGE(A1:A4,2)": 20, '=COUNTIFS(A1:A4,">=10",B1:B4,"<>Z")': 2, '=AVERAGEIF(A1:A4,"<15")': 7.5, '=MAXIFS(A1:A3,B1:B3,"<>z")': 20, "=HLOOKUP(10,A1:B2,2)": 20, "=nothing": "#NAME?", "=A1:A3": 10, "=TYPE(A1:A2)": 64, '=SUM(A1,A2:A3,"4")': 60,
        "=SUM(Other!A1:A1)": 100, "=Missing!A1": 10, '="A1"&A1': "A110", "=$A$1+A$2": 30, "=RANK(20,A1:A4)": 2, "=C1*2": 120, "=IFERROR(A1/Z9,7)": 7, "=T(B1)&N(B5)": "X1", "=CHOOSE(2,A1,A2)": 20, "=NPV(0.1,A1:A3)": 10 / 1.1,
    }
    formulas = {f"C{i}": f for i, f in enumerate(want, 1)}
    all_cells = sheet(spark, cells | formulas).unionByName(sheet(spark, {"A1": 100}, "Other")).unionByName(sheet(spark, {"A1": 1, "A2": "=A1+1", "A3": "=A2+A1"}, "S", "second"))
    got = {(r["workbook"], r["row"], r["col"]): next((r[k] for k in ("num", "txt", "bool", "err") if r[k] is not None), None) for r in recalculated(all_cells, {"rate": "=A1"}).collect() if r["sheet"] == "S"}
    for i, (formula, value) in enumerate(want.items(), 1):
        assert got["", i, 3] == (pytest.approx(value) if isinstance(value, float) else value), formula
    assert got["second", 2, 1] == 2 and got["second", 3, 1] == 3
    assert evaluate_in(all_cells, "=SUM(A1:A4)/2", "S").first()["num"] == 32.5


def test_cycles(spark):
    got = recalculated(sheet(spark, {"A1": "=B1+1", "B1": "=A1+1", "C1": "=IFERROR(A1,5)", "D1": "=C1+1", "E1": "=E1"})).collect()
    assert {(r["col"], r["err"] or r["num"]) for r in got} == {(1, "#REF!"), (2, "#REF!"), (3, 5.0), (4, 6.0), (5, "#REF!")}


def test_references_are_numbered():
    assert numbered('SUM(A1:$B$2,"A1")+LOG10(C3)+\'My S\'!A1+A1', "S", {}) == ('SUM(__range0,"A1")+LOG10(__cell1)+__cell2+__cell3', [("S", 1, 1, 2, 2), ("S", 3, 3, 3, 3), ("My S", 1, 1, 1, 1), ("S", 1, 1, 1, 1)])
    assert numbered("total+1", "S", {"total": "=SUM(A1:A2)"})[0] == "SUM(__range0)+1"


def test_two_workbooks_stay_apart(spark):
    a, b = sheet(spark, {"A1": 1, "B2": "=A1+$A$1"}, "Sheet1", "x"), sheet(spark, {"C3": 5, "D4": 6}, "Sheet1", "y")
    both = a.unionByName(b)
    area = {(r["workbook"], r["first_row"], r["first_col"], r["last_row"], r["last_col"]) for r in grid.used_range(both).collect()}
    assert area == {("x", 1, 1, 2, 2), ("y", 3, 3, 4, 4)}
    assert grid.set_cells(both, sheet(spark, {"C3": 9}, "Sheet1", "x")).count() == 5 and grid.set_cells(both, sheet(spark, {"C3": 9}, "Sheet1", "y")).count() == 4
    assert grid.cleared(both, "A1:D4", "sheet1", "y").count() == 2 and grid.read_range(both, "A1:B2", blanks=True).count() == 8
    moved = grid.shift(both, "row", 1, 2, workbook="x")
    assert {(r["workbook"], r["row"], r["formula"]) for r in moved.collect()} == {("x", 3, None), ("x", 4, "A3+$A$1"), ("y", 3, None), ("y", 4, None)}
    assert [r["formula"] for r in grid.shift(a, "col", 1, -1).collect()] == ["#REF!+$A$1"]
    assert {r["line"] for r in grid.plain_text(both).collect()} == {"1.0\t", "\t", "5.0\t", "\t6.0"}


def test_sheets_merges_and_ranges(spark):
    books = spark.createDataFrame([("", "A", 0), ("", "B", 1)], "workbook string, sheet string, place int")
    names = lambda df: [r["sheet"] for r in df.orderBy("place").collect()]
    more = grid.sheet_added(books, "C", 1)
    assert names(more) == ["A", "C", "B"] and names(grid.sheet_moved(more, "a", 2)) == ["C", "B", "A"] and names(grid.sheet_removed(more, "c")) == ["A", "B"]
    for bad in (lambda: grid.sheet_added(books, "a"), lambda: grid.sheet_removed(grid.sheet_removed(books, "A"), "B"), lambda: grid.sheet_added(books, "x/y")):
        with pytest.raises(ValueError):
            bad()
    merges = grid.merged_cells(spark.createDataFrame([], grid.MERGES), "A1:B2", "S")
    with pytest.raises(ValueError):
        grid.merged_cells(merges, "B2:C3", "S")
    cells = sheet(spark, {"A1": 1, "B1": 2, "C1": 3, "A2": 4})
    assert grid.visible(cells, merges).count() == 2 and grid.unmerged_cells(merges, "A1", "S").count() == 0
    assert grid.holds("A1:C3", "B2") and not grid.holds("A1:C3", "C3:D4") and grid.overlap("A1:C3", "C3:D4") and not grid.overlap("A1", "B2") and grid.bounding("B2", "A5:C5") == "A2:C5"
    two = spark.createDataFrame([(1, 1, 3, 3, 3, 3, 4, 4)], "a_first_row int, a_first_col int, a_last_row int, a_last_col int, b_first_row int, b_first_col int, b_last_row int, b_last_col int")
    assert tuple(two.select(grid.area_holds("a_", "b_"), grid.areas_overlap("a_", "b_"), *grid.bounding_area("a_", "b_")).first()) == (False, True, 1, 1, 4, 4)
    new = grid.set_cells(cells, grid.value_cell(spark, "A1", "#N/A", sheet="S").unionByName(grid.value_cell(spark, "Z1", formula="=A1", sheet="S")))
    assert {(r["col"], r["kind"], r["err"], r["formula"]) for r in new.filter("col in (1, 26) and row = 1").collect()} == {(1, "error", "#N/A", None), (26, "blank", None, "A1")}
    assert grid.without_formulas(new, "A1:Z9").filter("formula is not null").count() == 0 and grid.cell(cells, "C1").first()["num"] == 3


def test_filters_and_display(spark):
    cells = sheet(spark, {"A1": "name", "B1": "n", "A2": "x", "B2": 1, "A3": "y", "B3": 20, "A4": "x", "B4": 30, "C9": True})
    assert {(r["row"], r["col"]) for r in grid.auto_filtered(cells, "A1:B4", {1: "X", 2: ">5"}).collect()} == {(1, 1), (1, 2), (4, 1), (4, 2), (9, 3)}
    styled = cells.withColumn("style", F.when(F.col("row") == 3, 1))
    assert {r["shown"] for r in grid.shown(styled, {1: "0.00"}).collect()} == {"name", "n", "x", "1", "y", "20.00", "30", "TRUE"}
    series = {(r["series"], r["category"], r["value"]) for r in grid.chart_series(cells, "A1:B4").collect()}
    assert series == {("n", "x", 1.0), ("n", "y", 20.0), ("n", "x", 30.0)} and {r["series"] for r in grid.chart_series(cells, "B2:B4").collect()} == {"B"}
