"""Mathematical functions over doubles. NULL never stands for an error: errors are codes beside the value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import function
from .values import DIV0, NUM, Val, errors_of, fails, merged, number, text, to_num, to_text


def unary(names: str, fn, bad=None, code: str = NUM) -> None:
    """fn over one number; bad(x) tells what fails."""

    @function(names, "math", signature="(number)")
    def build(args: list[Val]) -> Val:
        x = to_num(args[0]) if args else F.lit(0.0)
        return number(F.when(~bad(x), fn(x)), merged(errors_of(args), fails(bad(x), code))) if bad else number(fn(x), errors_of(args))


def binary(names: str, fn, bad=None, code: str = DIV0, signature: str = "(number, number)") -> None:
    @function(names, "math", signature=signature)
    def build(args: list[Val]) -> Val:
        x, y = num(args, 0), num(args, 1)
        return number(F.when(~bad(x, y), fn(x, y)), merged(errors_of(args), fails(bad(x, y), code))) if bad else number(fn(x, y), errors_of(args))


def num(args: list[Val], i: int, default: float = 0.0) -> Column:
    return to_num(args[i]) if i < len(args) else F.lit(float(default))


def whole(c: Column) -> Column:
    """Towards zero."""
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")


def half_away(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def over(a: Column, b: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


for name, fn in {
    "ABS": F.abs, "EXP": F.exp, "SIGN": F.signum, "INT": lambda x: F.floor(x), "CBRT": F.cbrt,
    "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan,
    "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "ACOSH": F.acosh, "ATANH": F.atanh,
    "SEC": F.sec, "CSC": F.csc, "COT": F.cot,
    "DEGREES": lambda x: x * 180.0 / math.pi, "RADIANS": lambda x: x * math.pi / 180.0,
    "SQRTPI": lambda x: F.sqrt(x * math.pi), "EVEN": lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2,
}.items():
    unary(name, fn)
unary("SQRT", F.sqrt, lambda x: x < 0)
unary("LN", F.log, lambda x: x <= 0)
unary("LOG10", F.log10, lambda x: x <= 0)
unary("FACT", lambda x: product_of(F.lit(2), F.floor(x)), lambda x: x < 0)
unary("FACTDOUBLE", lambda x: product_of(F.when(F.pmod(whole(x), F.lit(2.0)) == 0, 2).otherwise(1), whole(x), 2))


def product_of(first: Column, last: Column, step: int = 1) -> Column:
    """first * (first + step) * ... up to last; 1 if there is none."""
    lo, hi = first.cast("long"), F.least(last, F.lit(400.0)).cast("long")
    steps = F.when(hi >= lo, F.sequence(lo, F.greatest(hi, lo), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(1.0), lambda a, b: a * b)


@function("ODD", "math", signature="(number)")
def odd(args: list[Val]) -> Val:
    x = num(args, 0)
    up = F.signum(x) * F.ceil(F.abs(x))
    return number(F.when(up == 0, 1.0).when(F.abs(up) % 2 == 0, up + F.signum(x)).otherwise(up), errors_of(args))


binary("POWER", F.pow, signature="(number, power)")
binary("MOD", lambda a, b: a - b * F.floor(over(a, b)), lambda a, b: b == 0)
binary("QUOTIENT", lambda a, b: whole(over(a, b)), lambda a, b: b == 0)
binary("ATAN2", lambda x, y: F.atan2(y, x), signature="(x_num, y_num)")
binary("MROUND", lambda x, m: F.when(m == 0, 0.0).otherwise(half_away(over(x, m)) * m), signature="(number, multiple)")
binary("CEILING", lambda x, s: F.when(s == 0, 0.0).otherwise(F.ceil(over(x, s)) * s), signature="(number, significance)")
binary("FLOOR", lambda x, s: F.when(s == 0, 0.0).otherwise(F.floor(over(x, s)) * s), signature="(number, significance)")


@function("CEILING.MATH", "math", signature="(number, [significance])")
def ceiling_math(args: list[Val]) -> Val:
    s = F.abs(num(args, 1, 1))
    return number(F.when(s == 0, 0.0).otherwise(F.ceil(over(num(args, 0), s)) * s), errors_of(args))


@function("FLOOR.MATH", "math", signature="(number, [significance])")
def floor_math(args: list[Val]) -> Val:
    s = F.abs(num(args, 1, 1))
    return number(F.when(s == 0, 0.0).otherwise(F.floor(over(num(args, 0), s)) * s), errors_of(args))


@function("LOG", "math", signature="(number, [base])")
def log(args: list[Val]) -> Val:
    x, base = num(args, 0), num(args, 1, 10)
    return number(F.when(x > 0, over(F.log(x), F.log(base))), merged(errors_of(args), fails(x <= 0, NUM)))


def scaled(x: Column, digits: Column) -> tuple[Column, Column]:
    f = F.pow(F.lit(10.0), digits)
    return x * f, f


@function("ROUND", "math", signature="(number, num_digits)")
def round_half(args: list[Val]) -> Val:
    """Half away from zero on the scaled double; digits below 0 act as 0."""
    s, f = scaled(num(args, 0), F.least(F.greatest(whole(num(args, 1)), F.lit(0.0)), F.lit(15.0)))
    return number(half_away(s) / f, errors_of(args))


@function("ROUNDUP", "math", signature="(number, num_digits)")
def round_up(args: list[Val]) -> Val:
    s, f = scaled(num(args, 0), whole(num(args, 1)))
    return number(F.signum(s) * F.ceil(F.abs(s)) / f, errors_of(args))


@function("ROUNDDOWN TRUNC", "math", signature="(number, num_digits)")
def round_down(args: list[Val]) -> Val:
    s, f = scaled(num(args, 0), whole(num(args, 1)))
    return number(whole(s) / f, errors_of(args))


@function("PI", "math", signature="()")
def pi(args: list[Val]) -> Val:
    return number(F.lit(math.pi))


@function("RAND", "math", signature="()")
def rand(args: list[Val]) -> Val:
    return number(F.rand())


@function("RANDBETWEEN", "math", signature="(bottom, top)")
def rand_between(args: list[Val]) -> Val:
    a, b = whole(num(args, 0)), whole(num(args, 1))
    low, high = F.least(a, b), F.greatest(a, b)
    return number(low + F.floor(F.rand() * (high - low + 1)), errors_of(args))


@function("COMBIN", "math", signature="(number, number_chosen)")
def combin(args: list[Val]) -> Val:
    n, k = whole(num(args, 0)), whole(num(args, 1))
    some = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1.0)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ratio = F.aggregate(some, F.lit(1.0), lambda acc, i: acc * (n - i + 1) / i)
    return number(F.when((k < 0) | (k > n), 0.0).otherwise(F.rint(ratio)), errors_of(args))


@function("PERMUT", "math", signature="(number, number_chosen)")
def permut(args: list[Val]) -> Val:
    n, k = whole(num(args, 0)), whole(num(args, 1))
    return number(F.when((k < 0) | (k > n), 0.0).otherwise(product_of(n - k + 1, n)), errors_of(args))


# The Roman numerals with their subtractive pairs, largest first.
ROMAN = {"M": 1000, "CM": 900, "D": 500, "CD": 400, "C": 100, "XC": 90, "L": 50, "XL": 40, "X": 10, "IX": 9, "V": 5, "IV": 4, "I": 1}


def roman_text(n: Column) -> Column:
    """Each decimal place by its own list of ten numerals."""
    places = []
    for unit, five, ten, size in (("M", "", "", 1000), ("C", "D", "M", 100), ("X", "L", "C", 10), ("I", "V", "X", 1)):
        numerals = ["", unit, unit * 2, unit * 3, unit + five, five, five + unit, five + unit * 2, five + unit * 3, unit + ten]
        digit = (F.floor(n / size) % 10).cast("int")
        places.append(F.element_at(F.array(*map(F.lit, numerals)), digit + 1))
    return F.when((n >= 1) & (n <= 3999), F.concat(*places)).otherwise("")


@function("ROMAN", "math", signature="(number)")
def roman(args: list[Val]) -> Val:
    return text(roman_text(whole(num(args, 0))), errors_of(args))


@function("ARABIC", "math", signature="(text)")
def arabic(args: list[Val]) -> Val:
    s = F.upper(to_text(args[0]))
    worth = F.create_map(*[F.lit(x) for k, v in ROMAN.items() if len(k) == 1 for x in (k, v)])
    each = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.element_at(worth, c))
    total = F.aggregate(F.reverse(each), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("next")), lambda a, v: F.struct(F.when(v < a["next"], a["sum"] - v).otherwise(a["sum"] + v).alias("sum"), v.alias("next")))
    return number(F.when(s.rlike("^[IVXLCDM]*$"), total["sum"]).otherwise(0), errors_of(args))


@function("BASE", "math", signature="(number, radix, [min_length])")
def base(args: list[Val]) -> Val:
    n, radix, least = F.abs(whole(num(args, 0))).cast("long"), whole(num(args, 1)).cast("int"), whole(num(args, 2)).cast("int")
    digits = F.conv(n.cast("string"), 10, 36)
    by_radix = F.coalesce(*[F.when(radix == r, F.conv(n.cast("string"), 10, r)) for r in range(2, 37)])
    return text(F.when((radix < 2) | (radix > 36), "").otherwise(F.lpad(F.coalesce(by_radix, digits), F.greatest(least, F.length(F.coalesce(by_radix, digits))), F.lit("0"))), errors_of(args))


@function("DECIMAL", "math", signature="(text, radix)")
def decimal(args: list[Val]) -> Val:
    s, radix = F.upper(F.trim(to_text(args[0]))), whole(num(args, 1))
    digits = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1)
    valid = F.forall(digits, lambda d: (d >= 0) & (d < radix)) & (radix >= 2) & (radix <= 36)
    return number(F.when(valid, F.aggregate(digits, F.lit(0.0), lambda a, d: a * radix + d)).otherwise(0.0), errors_of(args))
