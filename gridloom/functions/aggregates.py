"""Aggregates: over a row's arguments (arrays) and over a table's column (Catalyst aggregates, summed map-side).

Numbers and booleans count; blanks, texts and errors in a range are left out. The A forms take texts as numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import num, whole
from .registry import AGGREGATE, LOOKUP, function
from .values import ANY, BLANK, BOOLEAN, DIV0, ERROR, NA, NUM, NUMBER, RANGE, Val, cell_num, countable_cell, errors_of, fails, is_blank, merged, number, to_num

#: name -> function of (values, extra arguments) over a column; values are null where a cell doesn't count.
VERTICAL: dict[str, Callable[..., Val]] = {}


def countable(v: Val) -> Column:
    """A cell as a number, null where it is no number or boolean."""
    if v.kind == ANY:
        return F.when(countable_cell(v.col), cell_num(v.col))
    return F.when(v.col.isNotNull(), to_num(v)) if v.kind in (NUMBER, BOOLEAN) else F.lit(None).cast("double")


def anything(v: Val) -> Column:
    """A cell as a number, null where it is blank."""
    return F.lit(None).cast("double") if v.kind in (BLANK, ERROR) else F.when(~is_blank(v), to_num(v))


def numbers(args: list[Val], cell=countable) -> Column:
    """The numbers of the arguments, those of ranges among them; cell says what a cell counts for."""
    if not args:
        return F.array().cast("array<double>")
    if all(a.kind != RANGE for a in args):
        return F.filter(F.array(*[cell(a) for a in args]), lambda x: x.isNotNull())
    # An error in a range is passed over.
    lists = [F.transform(a.col, lambda s: cell(Val(ANY, s))) if a.kind == RANGE else F.array(cell(a)) for a in args]
    return F.filter(F.concat(*[x.cast("array<double>") for x in lists]), lambda x: x.isNotNull())


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def row(names: str, fn: Callable[[Column], Column], bad: Callable[[Column], Column] | None = None, code: str = DIV0, cell=countable, signature: str = "(number1, [number2], ...)") -> None:
    """Over the arguments of a row: fn of the array of numbers; bad of it fails with the code."""

    @function(names, "statistics", AGGREGATE, signature)
    def build(args: list[Val]) -> Val:
        a = numbers(args, cell)
        err = merged(errors_of(args), fails(bad(a), code) if bad else None)
        return number(F.when(~bad(a), fn(a)) if bad else fn(a), err)


def column(names: str, fn: Callable[..., Column], bad: Callable[..., Column] | None = None, code: str = DIV0) -> None:
    """Over a column: an aggregate of its numbers, null and an error code where bad holds."""

    def build(x: Column, *extra: Column) -> Val:
        return number(fn(x, *extra), fails(F.coalesce(bad(x, *extra), F.lit(True)), code) if bad else None)

    for name in names.split():
        VERTICAL[name] = build


def empty(a: Column) -> Column:
    return F.size(a) == 0


def none(x: Column, *_: Column) -> Column:
    return F.count(x) == 0


def deviations(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean(a)) * (x - mean(a)))


for names, horizontal, vertical in (
    ("SUM", total, lambda x: F.coalesce(F.sum(x), F.lit(0.0))),
    ("SUMSQ", lambda a: total(F.transform(a, lambda x: x * x)), lambda x: F.coalesce(F.sum(x * x), F.lit(0.0))),
    ("PRODUCT", lambda a: F.aggregate(a, F.lit(1.0), lambda p, x: p * x), lambda x: F.coalesce(F.product(x), F.lit(1.0))),
    ("COUNT", F.size, F.count),
    ("MIN", lambda a: F.coalesce(F.array_min(a), F.lit(0.0)), lambda x: F.coalesce(F.min(x), F.lit(0.0))),
    ("MAX", lambda a: F.coalesce(F.array_max(a), F.lit(0.0)), lambda x: F.coalesce(F.max(x), F.lit(0.0))),
):
    row(names, horizontal)
    column(names, vertical)
row("AVERAGE", mean, empty)
column("AVERAGE", F.avg, none)
for names, horizontal, vertical in (("MINA", F.array_min, F.min), ("MAXA", F.array_max, F.max)):
    row(names, lambda a, fn=horizontal: F.coalesce(fn(a), F.lit(0.0)), cell=anything)
    column(names, lambda x, fn=vertical: F.coalesce(fn(x), F.lit(0.0)))
row("AVERAGEA", mean, empty, cell=anything)
column("AVERAGEA", F.avg, none)
row("COUNTA", F.size, cell=lambda v: F.when(~is_blank(v), F.lit(1.0)))
row("COUNTBLANK", F.size, cell=lambda v: F.when(is_blank(v), F.lit(1.0)))
column("COUNTA", F.count)
column("COUNTBLANK", lambda x: F.sum(x.isNull().cast("long")))

row("VAR VAR.S", lambda a: deviations(a) / (F.size(a) - 1), lambda a: F.size(a) < 2)
row("VARP VAR.P", lambda a: deviations(a) / F.size(a), empty)
row("STDEV STDEV.S", lambda a: F.sqrt(deviations(a) / (F.size(a) - 1)), lambda a: F.size(a) < 2)
row("STDEVP STDEV.P", lambda a: F.sqrt(deviations(a) / F.size(a)), empty)
column("VAR VAR.S", F.var_samp, lambda x: F.count(x) < 2)
column("VARP VAR.P", F.var_pop, none)
column("STDEV STDEV.S", F.stddev_samp, lambda x: F.count(x) < 2)
column("STDEVP STDEV.P", F.stddev_pop, none)
row("DEVSQ", deviations, lambda a: F.size(a) < 2)
column("DEVSQ", lambda x: F.var_pop(x) * F.count(x), lambda x: F.count(x) < 2)
row("GEOMEAN", lambda a: F.exp(mean(F.transform(a, lambda x: F.ln(x)))), lambda a: empty(a) | F.exists(a, lambda x: x <= 0), NUM)
column("GEOMEAN", lambda x: F.exp(F.avg(F.when(x > 0, F.log(x)))), lambda x: F.min(x) <= 0, NUM)


def reciprocal(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), x))


@function("HARMEAN", "statistics", AGGREGATE, "(number1, [number2], ...)")
def harmonic(args: list[Val]) -> Val:
    """A zero among the numbers gives 0; reciprocals that cancel out fail."""
    a = numbers(args)
    s = total(F.transform(a, reciprocal))
    return number(F.try_divide(F.size(a).cast("double"), s), merged(errors_of(args), fails(empty(a), NUM), fails(s == 0, DIV0)))


def harmonic_column(x: Column) -> Val:
    s = F.sum(reciprocal(x))
    return number(F.try_divide(F.count(x).cast("double"), s), F.when(F.count(x) == 0, NUM).when(s == 0, DIV0))


VERTICAL["HARMEAN"] = harmonic_column
row("AVEDEV", lambda a: mean(F.transform(a, lambda x: F.abs(x - mean(a)))), empty, NUM)


def at_share(a: Column, p: Column) -> Column:
    """Linear interpolation between the ranks around p * (n - 1)."""
    s, rank = F.array_sort(a), p * (F.size(a) - 1)
    low, high = F.get(s, F.floor(rank).cast("int")), F.get(s, F.ceil(rank).cast("int"))
    return low + (rank - F.floor(rank)) * (high - low)


row("MEDIAN", lambda a: at_share(a, F.lit(0.5)), empty, NUM)


def modal(a: Column) -> Column:
    times = lambda x: F.size(F.filter(a, lambda y: y == x))
    best = F.array_max(F.transform(a, times))
    return F.when(best > 1, F.get(F.filter(a, lambda x: times(x) == best), F.lit(0)))


row("MODE MODE.SNGL MODE.MULT", modal, lambda a: modal(a).isNull(), NA)


def third_moment(a: Column) -> Column:
    return total(F.transform(a, lambda x: F.pow(x - mean(a), 3)))


#: The plain form gives n for any sample that leans, and 0 for one that doesn't; skew_standard is the usual statistic.
row("SKEW", lambda a: F.when(third_moment(a) == 0, 0.0).otherwise(F.size(a).cast("double")), lambda a: F.size(a) < 3, NUM)
column("SKEW", lambda x: F.when(F.skewness(x) == 0, 0.0).otherwise(F.count(x).cast("double")), lambda x: F.count(x) < 3, NUM)


def common(a: Column) -> Column:
    """Greatest common divisor by remainders, at most 92 steps for two longs."""

    def gcd(x: Column, y: Column) -> Column:
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(x.alias("a"), y.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
        return pair["a"]

    return F.aggregate(F.transform(a, lambda x: F.abs(x).cast("long")), F.lit(0).cast("long"), gcd)


row("GCD", common)
row("LCM", lambda a: F.aggregate(F.transform(a, lambda x: F.abs(x).cast("long")), F.lit(1).cast("long"), lambda m, x: F.when(x == 0, F.lit(0).cast("long")).otherwise(F.abs((m / common(F.array(m.cast("double"), x.cast("double")))).cast("long") * x))))


def by_array(names: str, fn: Callable[[Column, list[Val]], Column], bad: Callable[[Column, list[Val]], Column], code: str, signature: str, last: bool = False) -> None:
    """Array arguments first or last, one parameter at the other end."""

    @function(names, "statistics", AGGREGATE, signature)
    def build(args: list[Val]) -> Val:
        own, rest = ([args[-1]], args[:-1]) if last else (args[:1], args[1:])
        a = numbers(rest)
        return number(F.when(~bad(a, own), fn(a, own)), merged(errors_of(args), fails(bad(a, own), code)))


def kth(a: Column, own: list[Val], ascending: bool) -> Column:
    k = whole(num(own, 0)).cast("int")
    return F.get(F.sort_array(a, asc=ascending), k - 1)


def out_of(a: Column, own: list[Val]) -> Column:
    k = whole(num(own, 0))
    return (k < 1) | (k > F.size(a))


by_array("LARGE", lambda a, o: kth(a, o, False), out_of, NUM, "(array, k)", last=True)
by_array("SMALL", lambda a, o: kth(a, o, True), out_of, NUM, "(array, k)", last=True)
by_array("PERCENTILE PERCENTILE.INC", lambda a, o: at_share(a, num(o, 0)), lambda a, o: empty(a), NUM, "(array, k)", last=True)
by_array("QUARTILE QUARTILE.INC", lambda a, o: at_share(a, num(o, 0) / 4), lambda a, o: empty(a) | (num(o, 0) < 0) | (num(o, 0) > 4), NUM, "(array, quart)", last=True)
by_array("RANK RANK.EQ RANK.AVG", lambda a, o: F.size(F.filter(a, lambda x: x > num(o, 0))) + 1, lambda a, o: ~F.exists(a, lambda x: x == num(o, 0)), NA, "(number, ref, [order])")


def share_below(a: Column, own: list[Val]) -> Column:
    v = num(own, 0)
    below, equal = F.size(F.filter(a, lambda x: x < v)), F.size(F.filter(a, lambda x: x == v))
    return (below + equal * 0.5) / F.greatest(F.size(a) - 1, F.lit(1))


by_array("PERCENTRANK PERCENTRANK.INC", share_below, lambda a, o: empty(a), NUM, "(array, x, [sig])", last=True)


def trimmed(a: Column, own: list[Val]) -> Column:
    c = F.rint(F.size(a) * F.least(F.greatest(num(own, 0), F.lit(0.0)), F.lit(1.0))).cast("int")
    return mean(F.slice(F.array_sort(a), c + 1, F.greatest(F.size(a) - 2 * c, F.lit(0))))


by_array("TRIMMEAN", trimmed, lambda a, o: trimmed(a, o).isNull() | (F.size(a) < 2), NUM, "(array, percent)", last=True)

# Over columns; extra arguments are literals or scalars.
column("PERCENTRANK PERCENTRANK.INC", lambda x, v: (F.count_if(x < v) + F.count_if(x == v) * F.lit(0.5)) / F.greatest(F.count(x) - 1, F.lit(1)), none, NUM)
column("RANK RANK.EQ RANK.AVG", lambda x, v, up=None: F.count_if(x > v) + 1, lambda x, v, up=None: F.count_if(x == v) == 0, NA)


@function("SUMPRODUCT", "math", AGGREGATE, "(array1, [array2], ...)")
def sum_product(args: list[Val]) -> Val:
    if any(a.kind == RANGE for a in args):
        lists = [F.transform(a.col, lambda s: F.coalesce(cell_num(s), F.lit(0.0))) if a.kind == RANGE else F.array(to_num(a)) for a in args]
        size = F.least(*[F.size(x) for x in lists]) if len(lists) > 1 else F.size(lists[0])
        products = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x * y), [F.slice(x, F.lit(1), size) for x in lists])
        return number(total(products), errors_of(args))
    out = F.lit(1.0)
    for a in args:
        out = out * to_num(a)
    return number(out, errors_of(args))


# The functions that read ranges by position or by criteria, with their signatures.
RANGED = {
    "SUMIF": "(range, criteria, [sum_range])", "AVERAGEIF": "(range, criteria, [average_range])", "COUNTIF": "(range, criteria)",
    "SUMIFS": "(sum_range, range1, criteria1, ...)", "AVERAGEIFS": "(average_range, range1, criteria1, ...)", "COUNTIFS": "(range1, criteria1, ...)",
    "MAXIFS": "(max_range, range1, criteria1, ...)", "MINIFS": "(min_range, range1, criteria1, ...)",
    "VLOOKUP": "(lookup_value, table, col_index, [range_lookup])", "HLOOKUP": "(lookup_value, table, row_index, [range_lookup])",
    "INDEX": "(array, row_num, [column_num])", "MATCH": "(lookup_value, lookup_array, [match_type])",
}


def ranged(args: list[Val]) -> Val:
    raise ValueError("takes ranges: evaluate it over a table, or use gridloom.operators")


for name, signature in RANGED.items():
    function(name, "lookup" if "LOOKUP" in name or name in ("INDEX", "MATCH") else "conditional", LOOKUP, signature)(ranged)
