"""Goldens of the formula language: literals in, one row out."""

import math

import pytest

from gridloom.functions.registry import load
from gridloom.plans.compiler import calculated, evaluate, summary
from gridloom.plans.lookups import Table
from gridloom.plans.parser import FormulaError, parse

GOLDENS = {
    "2+3*4": 14, "2^3^2": 512, "-2^2": 4, "10%": 0.1, "MOD(10,3)": 1, "MOD(-3,2)": 1, '"a"&1': "a1", '"A"="a"': True, "1<>2": True,
    "CEILING(4.3,1)": 5, "FLOOR(4.7,1)": 4, "LOG(8,2)": 3, "EVEN(3)": 4, "ODD(4)": 5, "ODD(0)": 1, "ROUND(2.5,0)": 3, "ROUND(-2.5,0)": -3, "ROUNDUP(1.21,1)": 1.3, "ROUNDDOWN(-1.29,1)": -1.2,
    "TRUNC(-1.9)": -1, "INT(-1.1)": -2, "QUOTIENT(-7,2)": -3, "MROUND(7,3)": 6, "FACT(5)": 120, "FACTDOUBLE(7)": 105, "FACTDOUBLE(6)": 48, "COMBIN(5,2)": 10, "PERMUT(5,2)": 20, "GCD(12,18)": 6, "LCM(4,6)": 12,
    "ROMAN(1994)": "MCMXCIV", 'ARABIC("MCMXCIV")': 1994, "BASE(255,16)": "FF", "BASE(5,2,8)": "00000101", 'DECIMAL("FF",16)': 255, 'DECIMAL("9",8)': 0, "SUM(1,2,TRUE)": 4, "AVERAGE(1,2,3)": 2, "PRODUCT(2,3)": 6, "SUMSQ(3,4)": 25,
    "MEDIAN(1,2,3,4)": 2.5, "MODE(1,2,2,3,3)": 2, "STDEV(2,4,4,4,5,5,7,9)": 2.138089935299395, "VARP(1,2,3)": 2 / 3, "LARGE(3,1,2,2)": 2, "SMALL(3,1,2,1)": 1, "AVEDEV(1,2,3)": 2 / 3, "DEVSQ(1,2,3)": 2, "GEOMEAN(1,4)": 2, "HARMEAN(1,2)": 4 / 3,
    "SKEW(1,2,9)": 3, "MAXA(1,TRUE)": 1, 'COUNTA(1,"a")': 2, 'COUNT(1,"a",TRUE)': 2, "ATAN2(1,1)": math.pi / 4, "SQRTPI(1)": math.sqrt(math.pi), "SEC(0)": 1, "DEGREES(PI())": 180,
    'TRIM("  a   b  ")': "a b", 'SUBSTITUTE("a-b-c","-","+")': "a+b+c", 'SUBSTITUTE("a-b-c","-","+",2)': "a-b+c", 'SUBSTITUTE("a.b","x","y")': "a.b", 'REPLACE("abcdef",2,3,"X")': "aXef", 'MID("abcdef",2,3)': "bcd", 'MID("abc",9,1)': "",
    'LEFT("abc")': "a", 'RIGHT("abc",2)': "bc", 'PROPER("hello wORLD-wide")': "Hello World-Wide", 'FIND("b","abc")': 2, 'SEARCH("B","abc")': 2, 'TEXTJOIN("-",TRUE,"a","","b")': "a--b", 'REPT("ab",2)': "abab", 'EXACT("a","A")': False, 'CODE("A")': 65, "CHAR(65)": "A",
    "UNICHAR(128512)": "😀", 'UNICODE("😀")': 128512, 'VALUE("1,234.5")': 1234.5, 'VALUE("x")': 0, 'TEXTBEFORE("a-b-c","-",2)': "b", 'TEXTAFTER("a-b-c","-",1)': "b-c", 'TEXTAFTER("abc","-")': "abc", "DOLLAR(1234.567)": "$1,234.57", "FIXED(1234.567,1)": "1,234.6", 'CLEAN("a"&CHAR(7)&"b")': "ab",
    'TEXT(1234.5,"#,##0.00")': "1,234.50", 'TEXT(-5,"0;(0)")': "(5)", 'TEXT(0.125,"0.0%")': "12.5%", 'TEXT(0,"0;-0;zero")': "zero0", 'T("x")': "x", "N(TRUE)": 1, "1/4&\"\"": "0.25", "1E+20&\"\"": "1E+20", "0.0001&\"\"": "0.0001", "0.00001&\"\"": "1E-05", "0.00009999&\"\"": "9.999E-05", "999999999999999.6&\"\"": "1E+15", "100.50&\"\"": "100.5", "123456789012345678&\"\"": "1.23456789012346E+17",
    "DATE(2020,1,15)": 43845, "DATE(2020,14,1)": 44228, "DATE(1900,1,1)": 1, "YEAR(43845)": 2020, "MONTH(43845)": 1, "DAY(43845)": 15, "WEEKDAY(43845)": 4, "WEEKDAY(43845,2)": 3, "WEEKDAY(43845,3)": 2, "EOMONTH(43845,1)": 43890, "EDATE(DATE(2020,1,31),1)": 43890, "DAYS(10,4)": 6,
    'DATEDIF(DATE(2020,1,15),DATE(2020,2,10),"MD")': 26, 'DATEDIF(DATE(2020,1,15),DATE(2021,3,10),"M")': 14, "DAYS360(DATE(2020,1,31),DATE(2020,3,31))": 60, "ISOWEEKNUM(DATE(2021,1,3))": 53, "WEEKNUM(DATE(2020,1,5))": 2, "YEARFRAC(DATE(2020,1,1),DATE(2021,1,1),1)": 1, "TIME(12,0,0)": 0.5, 'DATEVALUE("2020-01-15")': 43845, 'TIMEVALUE("06:00")': 0.25, "HOUR(43845.75)": 18,
    "PMT(0,10,100)": -10, "FV(0,10,-5)": 50, "PV(0,10,-5)": 50, "NPER(0,-10,100)": 10, "NPV(0.1,110)": 100, "SLN(100,10,9)": 10, "EFFECT(0.1,1)": 0.1,
    "IF(1>2,1)": False, 'IFS(FALSE,1,TRUE,"b")': "b", "IFERROR(1/0,7)": 7, "IFNA(NA(),8)": 8, 'SWITCH("B","a",1,"b",2)': 2, "CHOOSE(2,10,20)": 20, "AND(TRUE,1)": True, "OR(FALSE,0)": False, "XOR(TRUE,TRUE,TRUE)": True, "NOT(1)": False,
    "ISERROR(1/0)": True, "ISERR(NA())": False, "ISNA(NA())": True, "ISNUMBER(1)": True, 'ISTEXT("a")': True, "ISNONTEXT(1)": True, "ISLOGICAL(TRUE)": True, "ISEVEN(3)": False, "ISODD(-3)": True, 'TYPE("a")': 4, "TYPE(TRUE)": 16, "ERROR.TYPE(NA())": 7, "ERROR.TYPE(1/0)": 2, "ISREF(1)": False,
}
ERRORS = {
    "1/0": "#DIV/0!", "SQRT(-1)": "#NUM!", "MOD(1,0)": "#DIV/0!", "UNKNOWN(1)": "#NAME?", "1+": "#NAME?", "SUM(1,NA())": "#N/A", 'FIND("z","abc")': "#VALUE!", "CHOOSE(5,1)": "#VALUE!", "IFS(FALSE,1)": "#N/A", "MODE(1,2,3)": "#N/A",
    "LARGE(1,2,5)": "#NUM!", "YEAR(60)": "#NUM!", 'DATEDIF(DATE(2020,1,15),DATE(2020,2,10),"Q")': "#VALUE!", "AVERAGE()": "#DIV/0!", "#REF!+1": "#REF!", "VAR(1)": "#DIV/0!",
}


def in_parts(d, n=12):
    items = list(d.items())
    return [dict(items[i : i + n]) for i in range(0, len(items), n)]


@pytest.mark.parametrize("part", in_parts(GOLDENS), ids=lambda p: next(iter(p)))
def test_goldens(spark, part):
    row = evaluate(spark, {f"c{i}": f"={f}" for i, f in enumerate(part)}).first()
    for (formula, wanted), got in zip(part.items(), row, strict=True):
        assert got == (pytest.approx(wanted) if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) else wanted), formula


def test_errors(spark):
    row = evaluate(spark, {f"c{i}": f"={f}" for i, f in enumerate(ERRORS)}, errors=True).first()
    assert {f: row[f"c{i}_error"] for i, f in enumerate(ERRORS)} == ERRORS
    assert all(row[f"c{i}"] is None for i in range(len(ERRORS)))


def test_all_names_are_there():
    assert len(load()) == 195


def test_parser_refuses():
    for bad in ("1+", "(1", "SUM(1", "1 2"):
        with pytest.raises(FormulaError):
            parse(bad)


def test_columns_blanks_and_kinds(spark):
    df = spark.createDataFrame([(1, 10.0, "x"), (2, None, "20"), (3, 5.0, None)], "pos int, v double, s string")
    got = calculated(df, {"a": "=v*2", "b": "=ISBLANK(v)", "c": "=s&v", "d": "=s+1", "e": "=a+1", "f": "=SUM(pos:v)"}).orderBy("pos").collect()
    assert [r["a"] for r in got] == [20, 0, 10] and [r["b"] for r in got] == [False, True, False]
    assert [r["c"] for r in got] == ["x10", "20", "5"] and [r["d"] for r in got] == [1, 21, 1]
    assert [r["e"] for r in got] == [21, 1, 11] and [r["f"] for r in got] == [11, 2, 8]


def test_criteria_over_cells(spark):
    df = spark.createDataFrame([(10.0, "B"), (20.0, "a"), (30.0, "A"), (5.0, None), (None, "c")], "v double, g string")
    f = {"s": '=SUMIF(v,">15")', "c": '=COUNTIF(v,">15")', "ne": '=COUNTIF(v,"<>5")', "eq": '=COUNTIF(g,"A")', "zero": "=COUNTIF(v,0)", "m": '=MAXIFS(v,g,"a")', "none": '=MINIFS(v,g,"q")', "n": "=COUNTBLANK(v)", "r": "=RANK(20,v)", "k": "=LARGE(v,9)", "p": "=PERCENTRANK(v,10)"}
    row = summary(df, f, errors=True).first()
    assert (row["s"], row["c"], row["ne"], row["eq"], row["zero"], row["m"], row["n"], row["r"]) == (50, 2, 4, 2, 1, 30, 1, 2)
    assert row["none_error"] == "#DIV/0!" and row["k_error"] == "#NUM!" and row["p"] == 0.5


def test_statistics_of_columns(spark):
    df = spark.range(1, 11).selectExpr("cast(id as double) v")
    row = summary(df, {"t": "=TRIMMEAN(v,0.2)", "a": "=AVEDEV(v)", "g": "=GCD(v)", "m": "=MODE(v)", "k": "=SKEW(v)"}, errors=True).first()
    assert row["t"] == 5.5 and row["a"] == 2.5 and row["g"] == 1 and row["m_error"] == "#N/A" and row["k"] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double")
    row = summary(df, {"s": "=SUM(v)", "a": "=AVERAGE(v)", "n": "=COUNT(v)", "m": "=MEDIAN(v)", "t": "=TRIMMEAN(v,0.2)"}, errors=True).first()
    assert (row["s"], row["n"], row["a_error"], row["m_error"], row["t_error"]) == (0, 0, "#DIV/0!", "#NUM!", "#NUM!")


def test_lookup_formulas(spark):
    t = spark.createDataFrame([(1, "X", 10.0, None), (2, "y", 20.0, "b"), (3, "Y", 15.0, "c"), (4, "5", 40.0, "d")], "pos int, key string, low double, label string")
    df = spark.createDataFrame([(1, "Y", 16.0), (2, "z", 5.0), (3, "x", 50.0), (4, None, None)], "id int, k string, n double")
    f = {
        "exact": "=VLOOKUP(k,t,3,FALSE)", "number": "=VLOOKUP(2+3,t,2,FALSE)", "bad": "=VLOOKUP(k,t,9,FALSE)", "near": "=VLOOKUP(n,t!low:label,1)", "at": "=MATCH(n,t!low,1)", "down": "=MATCH(n,t!low,-1)",
        "both": '=IFNA(INDEX(t!low,MATCH(k,t!key,0)),-1)', "out": "=INDEX(t,7,1)", "side": '=HLOOKUP("LOW",t,3,FALSE)', "none": '=HLOOKUP("nothing",t,2,FALSE)', "far": '=HLOOKUP("low",t,9,FALSE)', "head": '=HLOOKUP("LOW",t,1,FALSE)', "of": '=HLOOKUP(IF(id=1,"low","key"),t,3,FALSE)', "what": "=VLOOKUP(k,unknown,1)",
    }
    got = {r["id"]: r for r in calculated(df, f, errors=True, tables={"t": Table(t, "pos")}).collect()}
    assert set(got) == {1, 2, 3, 4}
    see = lambda c: [got[i][c] if got[i][f"{c}_error"] is None else got[i][f"{c}_error"] for i in (1, 2, 3, 4)]
    assert see("exact") == ["b", "#N/A", None, "#N/A"]
    assert see("number") == [40.0] * 4
    assert see("bad") == ["#REF!", "#N/A", "#REF!", "#N/A"]
    assert see("near") == [10.0, "#N/A", 40.0, "#N/A"]  # for 16 the search ends at 20
    assert see("at") == [3, "#N/A", 4, "#N/A"]
    assert see("down") == [4, 4, "#N/A", 4]
    assert see("both") == [20.0, -1, 10.0, -1]
    assert see("out") == ["#REF!"] * 4 and see("far") == ["#REF!"] * 4
    assert see("side") == [20.0] * 4 and see("none") == ["#N/A"] * 4 and see("head") == ["low"] * 4
    assert see("of") == ["20", "y", "y", "y"]
    assert see("what") == ["#NAME?"] * 4
