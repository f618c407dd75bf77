"""Financial functions in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import num, over, whole
from .registry import function
from .values import NUM, VALUE, Val, error, errors_of, fails, merged, number


def growth(rate: Column, periods: Column) -> Column:
    return F.pow(1 + rate, periods)


def due(rate: Column, kind: Column) -> Column:
    """What payment at a period's start is worth over payment at its end."""
    return 1 + rate * kind


@function("PMT", "financial", signature="(rate, nper, pv, [fv], [type])")
def pmt(args: list[Val]) -> Val:
    r, n, pv, fv, kind = (num(args, i) for i in range(5))
    owed = pv * growth(r, n) + fv
    return number(F.when(r == 0, -over(pv + fv, n)).otherwise(over(owed * r, due(r, whole(kind)) * (1 - growth(r, n)))), errors_of(args))


@function("FV", "financial", signature="(rate, nper, pmt, [pv], [type])")
def fv(args: list[Val]) -> Val:
    r, n, pay, pv, kind = (num(args, i) for i in range(5))
    paid = pay * due(r, whole(kind)) * over(growth(r, n) - 1, r)
    return number(-F.when(r == 0, pv + pay * n).otherwise(pv * growth(r, n) + paid), errors_of(args))


@function("PV", "financial", signature="(rate, nper, pmt, [fv], [type])")
def pv(args: list[Val]) -> Val:
    """The future value is added as it is, without discount."""
    r, n, pay, future, kind = (num(args, i) for i in range(5))
    paid = pay * due(r, whole(kind)) * over(growth(r, n) - 1, r * growth(r, n))
    return number(-(future + F.when(r == 0, pay * n).otherwise(paid)), errors_of(args))


@function("NPER", "financial", signature="(rate, pmt, pv, [fv], [type])")
def nper(args: list[Val]) -> Val:
    """Payments count as at a period's start above the line, whatever the type."""
    r, pay, value, future = (num(args, i) for i in range(4))
    ratio = over(pay * (1 + r) - future * r, value * r + pay)
    return number(F.when(r == 0, -over(value + future, pay)).otherwise(over(F.log(ratio), F.log(1 + r))), errors_of(args))


@function("NPV", "financial", signature="(rate, value1, [value2], ...)")
def npv(args: list[Val]) -> Val:
    if len(args) < 2:
        return error(VALUE)
    r = num(args, 0)
    total = sum((num(args, i) / growth(r, F.lit(float(i))) for i in range(1, len(args))), F.lit(0.0))
    return number(F.when(r >= 0, total), merged(errors_of(args), fails(r < 0, NUM)))


@function("SLN", "financial", signature="(cost, salvage, life)")
def sln(args: list[Val]) -> Val:
    return number(over(num(args, 0) - num(args, 1), num(args, 2)), errors_of(args))


@function("EFFECT", "financial", signature="(nominal_rate, npery)")
def effect(args: list[Val]) -> Val:
    return number(F.pow(1 + over(num(args, 0), num(args, 1)), num(args, 1)) - 1, errors_of(args))
