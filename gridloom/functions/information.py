"""Information functions: they look at kinds and errors and never pass an error on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import num, whole
from .registry import INFO, function
from .values import ANY, BLANK, BOOLEAN, ERROR, ERRORS, NA, NUMBER, RANGE, TEXT, VALUE, Val, boolean, error, errors_of, is_blank, number


def failed(v: Val) -> Column:
    return F.lit(False) if v.err is None else v.err.isNotNull()


def is_kind(v: Val, *kinds: str) -> Column:
    """Whether a value is of a kind: the column's kind, where it is neither blank nor an error."""
    if v.kind == ANY:
        return ~failed(v) & F.coalesce(v.col["kind"].isin(*kinds), F.lit(False))
    return ~failed(v) & v.col.isNotNull() if v.kind in kinds else F.lit(False)


def test(name: str, fn) -> None:
    @function(name, "information", INFO, "(value)")
    def build(args: list[Val]) -> Val:
        return boolean(fn(args[0]) if args else F.lit(False))


test("ISERROR", failed)
test("ISERR", lambda v: failed(v) & (v.err != NA) if v.err is not None else F.lit(False))
test("ISNA", lambda v: failed(v) & (v.err == NA) if v.err is not None else F.lit(False))
test("ISNUMBER", lambda v: is_kind(v, NUMBER))
test("ISTEXT", lambda v: is_kind(v, TEXT))
test("ISNONTEXT", lambda v: ~is_kind(v, TEXT))
test("ISLOGICAL", lambda v: is_kind(v, BOOLEAN))
test("ISBLANK", lambda v: F.lit(True) if v.kind == BLANK else ~failed(v) & is_blank(v) if v.kind != RANGE else F.lit(False))
test("ISREF", lambda v: F.lit(False))
test("ISFORMULA", lambda v: F.lit(False))


@function("ISEVEN", "information", signature="(number)")
def is_even(args: list[Val]) -> Val:
    return boolean(whole(num(args, 0)) % 2 == 0, errors_of(args))


@function("ISODD", "information", signature="(number)")
def is_odd(args: list[Val]) -> Val:
    return boolean(whole(num(args, 0)) % 2 != 0, errors_of(args))


@function("NA", "information", INFO, "()")
def na(args: list[Val]) -> Val:
    return error(NA)


@function("TYPE", "information", INFO, "(value)")
def kind_number(args: list[Val]) -> Val:
    """1 blank, 2 number, 4 text, 16 boolean or error, 64 a range."""
    if not args:
        return number(F.lit(1))
    v = args[0]
    if v.kind == RANGE:
        return number(F.lit(64))
    own = F.lit({NUMBER: 2, TEXT: 4, BOOLEAN: 16, ERROR: 16}.get(v.kind, 1))
    if v.kind == ANY:
        own = F.when(is_kind(v, NUMBER), 2).when(is_kind(v, TEXT), 4).when(is_kind(v, BOOLEAN), 16).otherwise(1)
    return number(F.when(failed(v), 16).when(is_blank(v), 1).otherwise(own))


@function("ERROR.TYPE", "information", INFO, "(error_val)")
def error_number(args: list[Val]) -> Val:
    if not args or args[0].err is None:
        return error(VALUE)
    e = args[0].err
    return number(F.array_position(F.array(*map(F.lit, ERRORS)), F.coalesce(e, F.lit(""))), F.when(e.isNull(), VALUE))
