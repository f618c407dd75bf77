"""Compiled values: a Column with a static kind and an error code beside it.

An expression is never evaluated in Python. Each one is a Column of its natural type plus, where it can fail, a Column
with the error's literal (null: no error). A null value without an error is a blank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER, TEXT, BOOLEAN, ERROR, BLANK = "number", "text", "boolean", "error", "blank"
#: A rectangle of cells, row by row: an array of CELL.
RANGE = "range"
CELL = "struct<kind:string,num:double,txt:string,bool:boolean,err:string>"
#: A value whose kind is known only where it is evaluated: a CELL.
ANY = "any"

# Error literals in the order of their numbers, 1 to 7.
ERRORS = ["#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"]
NULL, DIV0, VALUE, REF, NAME, NUM, NA = ERRORS

#: Day 0 of serial dates from 1 March 1900 on; the days before it count from one later, since day 60 is no date.
EPOCH = "1899-12-30"


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column
    err: Column | None = None

    def value(self) -> Column:
        """The column, null where there is an error."""
        return self.col if self.err is None else F.when(self.err.isNull(), self.col)


def number(col: Column, err: Column | None = None) -> Val:
    return Val(NUMBER, col.cast("double"), err)


def text(col: Column, err: Column | None = None) -> Val:
    return Val(TEXT, col, err)


def boolean(col: Column, err: Column | None = None) -> Val:
    return Val(BOOLEAN, col, err)


def error(code: str) -> Val:
    return Val(ERROR, F.lit(None).cast("double"), F.lit(code))


def lit(v) -> Val:
    if isinstance(v, bool):
        return boolean(F.lit(v))
    return number(F.lit(float(v))) if isinstance(v, (int, float)) else text(F.lit(v))


def errors_of(args: Sequence[Val]) -> Column | None:
    """The first argument's error, from left to right."""
    found = [a.err for a in args if a.err is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def merged(*errs: Column | None) -> Column | None:
    found = [e for e in errs if e is not None]
    return None if not found else F.coalesce(*found) if len(found) > 1 else found[0]


def fails(when: Column, code: str) -> Column:
    return F.when(when, F.lit(code))


def parse_number(s: Column) -> Column:
    """Invariant parse of a number with blanks around it and grouping commas; null if it is none."""
    return F.regexp_replace(F.trim(s), r"(?<=\d),(?=\d)", "").try_cast("double")


def cell_num(s: Column) -> Column:
    """A cell's number, null if it has none."""
    return F.when(s["kind"] == NUMBER, s["num"]).when(s["kind"] == BOOLEAN, s["bool"].cast("double")).when(s["kind"] == TEXT, parse_number(s["txt"]))


def cell_text(s: Column) -> Column:
    return F.when(s["kind"] == TEXT, s["txt"]).when(s["kind"] == NUMBER, general(s["num"])).when(s["kind"] == BOOLEAN, F.when(s["bool"], "TRUE").otherwise("FALSE")).otherwise(F.lit(""))


def countable_cell(s: Column) -> Column:
    """Whether a cell counts as a number."""
    return F.coalesce(s["kind"].isin(NUMBER, BOOLEAN), F.lit(False))


def cell_of(v: Val) -> Column:
    """Any value as a CELL; null is a blank, an error keeps its code."""
    if v.kind == ANY:
        return v.col
    if v.kind == RANGE:
        return first_cell(v.col)
    none = {"num": "double", "txt": "string", "bool": "boolean"}
    own = {NUMBER: "num", TEXT: "txt", BOOLEAN: "bool"}.get(v.kind)
    fields = [(v.col if k == own else F.lit(None)).cast(t).alias(k) for k, t in none.items()]
    err = F.lit(None).cast("string") if v.err is None else v.err
    kind = F.when(err.isNotNull(), ERROR).when(v.col.isNull() if own else F.lit(True), BLANK).otherwise(F.lit(v.kind))
    return F.struct(kind.alias("kind"), *fields, err.alias("err"))


def first_cell(cells: Column) -> Column:
    blank = F.struct(F.lit(BLANK).alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("txt"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("string").alias("err"))
    return F.coalesce(F.get(cells, F.lit(0)), blank)


def of_cell(s: Column) -> Val:
    return Val(ANY, s, s["err"])


def is_blank(v: Val) -> Column:
    """Whether a value holds nothing."""
    if v.kind == ANY:
        return F.coalesce(v.col["kind"] == BLANK, v.err.isNull() if v.err is not None else F.lit(True))
    return F.lit(True) if v.kind == BLANK else F.lit(False) if v.kind == ERROR else v.col.isNull()


def is_textual(v: Val) -> Column | None:
    """Whether a value is a text: None if that is known to be so or not."""
    return F.coalesce(v.col["kind"] == TEXT, F.lit(False)) if v.kind == ANY else None


def by_kind(a: Val, b: Val, compare) -> Column:
    """A comparison of two values: as numbers, or as texts without regard to case if either is one."""
    texts, nums = compare(F.upper(to_text(a)), F.upper(to_text(b))), compare(to_num(a), to_num(b))
    if TEXT in (a.kind, b.kind):
        return texts
    some = [t for t in (is_textual(a), is_textual(b)) if t is not None]
    return F.when(reduce(lambda x, y: x | y, some), texts).otherwise(nums) if some else nums


def to_num(v: Val) -> Column:
    """Booleans as 1 and 0, blanks and texts that are no number as 0; a range is its first cell."""
    if v.kind in (ANY, RANGE):
        return F.coalesce(cell_num(v.col if v.kind == ANY else first_cell(v.col)), F.lit(0.0))
    if v.kind == NUMBER:
        c = v.col
    elif v.kind == BOOLEAN:
        c = v.col.cast("int").cast("double")
    elif v.kind == TEXT:
        c = parse_number(v.col)
    else:
        return F.lit(0.0)
    return F.coalesce(c, F.lit(0.0))


def general(x: Column) -> Column:
    """A number with up to 15 significant digits; scientific below 0.0001 and from 1E+15 on.

    What is rounded is the shortest decimal that names the number, so a 16th digit of 5 is raised even where the binary value
    is below the tie. The rounded number has at most 20 decimals where it is plain, so its decimal is exact.
    """
    digits = F.format_string("%.14e", F.abs(x))
    rounded = digits.try_cast("double")
    plain = F.regexp_replace(rounded.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    scientific = F.regexp_replace(F.upper(digits), r"\.?0*E", "E")
    body = F.when(rounded.between(1e-4, 999999999999999.0), plain).otherwise(scientific)
    return F.when(x.isNull(), None).when(x == 0, "0").when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), body))


def to_text(v: Val) -> Column:
    if v.kind in (ANY, RANGE):
        return cell_text(v.col if v.kind == ANY else first_cell(v.col))
    if v.kind == TEXT:
        c = v.col
    elif v.kind == NUMBER:
        c = general(v.col)
    elif v.kind == BOOLEAN:
        c = F.when(v.col, "TRUE").when(~v.col, "FALSE")
    else:
        return F.lit("")
    return F.coalesce(c, F.lit(""))


def to_bool(v: Val) -> Column:
    """Numbers other than 0, and the texts true and false; all else is false."""
    if v.kind in (ANY, RANGE):
        s = v.col if v.kind == ANY else first_cell(v.col)
        return F.coalesce(F.when(s["kind"] == NUMBER, s["num"] != 0).when(s["kind"] == BOOLEAN, s["bool"]).when(s["kind"] == TEXT, F.lower(F.trim(s["txt"])) == "true"), F.lit(False))
    if v.kind == BOOLEAN:
        c = v.col
    elif v.kind == NUMBER:
        c = v.col != 0
    elif v.kind == TEXT:
        c = F.lower(F.trim(v.col)) == "true"
    else:
        return F.lit(False)
    return F.coalesce(c, F.lit(False))


def from_serial(serial: Column) -> Column:
    """The timestamp of a serial date; null for day 60 and for days before 1."""
    day = F.floor(serial)
    base = F.when(day >= 61, F.date_add(F.lit(EPOCH).cast("date"), day.cast("int"))).when((day >= 1) & (day < 60), F.date_add(F.lit("1899-12-31").cast("date"), day.cast("int")))
    micros = F.round((serial - day) * 86400.0).cast("long")
    return F.timestamp_add("SECOND", micros.cast("int"), base.cast("timestamp_ntz"))


def to_serial(ts: Column) -> Column:
    """The serial date of a date or timestamp, with the day's fraction."""
    t = ts.cast("timestamp_ntz")
    days = F.datediff(t.cast("date"), F.lit(EPOCH).cast("date"))
    secs = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    days = F.when(t.cast("date") < F.lit("1900-03-01").cast("date"), days - 1).otherwise(days)
    return days.cast("double") + secs / F.lit(86400.0)


def column_value(name: str, dtype: str) -> Val:
    """A table's column as a value: dates become serials, all numbers doubles."""
    c = F.col(f"`{name}`")
    if dtype == "string":
        return text(c)
    if dtype == "boolean":
        return boolean(c)
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return number(to_serial(c))
    return number(c)


def all_of(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)

