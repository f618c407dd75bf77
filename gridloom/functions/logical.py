"""Logical functions. The lazy ones look only at the branch that is taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import num, whole
from .registry import LAZY, function
from .values import ANY, BLANK, BOOLEAN, ERROR, NA, NUMBER, RANGE, TEXT, VALUE, Val, boolean, by_kind, cell_of, errors_of, is_blank, number, text, to_bool, to_num, to_text


def as_kind(v: Val, kind: str) -> Column:
    if kind == ANY:
        return cell_of(v)
    if v.kind in (ERROR, BLANK):
        return F.lit(None)
    return v.col if v.kind == kind else to_text(v) if kind == TEXT else to_num(v)


def chosen(cases: list[tuple[Column, Val]], default: Val | None, first_error: Column | None = None) -> Val:
    """The value of the first case that holds, of the kind of all or, with texts among others, each of its own; without any, the default or #N/A."""
    values = [v for _, v in cases] + ([default] if default else [])
    kinds = {v.kind for v in values} - {ERROR, BLANK}
    kind = kinds.pop() if len(kinds) == 1 and not kinds & {ANY, RANGE} else ANY if kinds & {ANY, RANGE, TEXT} else NUMBER
    col = err = None
    for cond, v in cases:
        c, e = as_kind(v, kind), v.err if v.err is not None else F.lit(None).cast("string")
        col = F.when(cond, c) if col is None else col.when(cond, c)
        err = F.when(cond, e) if err is None else err.when(cond, e)
    col = col.otherwise(as_kind(default, kind)) if default else col
    err = err.otherwise(default.err if default.err is not None else F.lit(None).cast("string")) if default else err.otherwise(F.lit(NA))
    err = err if first_error is None else F.coalesce(first_error, err)
    return Val(ANY, col, err) if kind == ANY else {TEXT: text, BOOLEAN: boolean}.get(kind, number)(col, err)


@function("IF", "logical", LAZY, "(logical_test, value_if_true, value_if_false)")
def if_(args: list[Val]) -> Val:
    other = args[2] if len(args) > 2 else boolean(F.lit(False))
    return chosen([(to_bool(args[0]), args[1])], other, args[0].err)


@function("IFS", "logical", LAZY, "(test1, value1, [test2, value2], ...)")
def ifs(args: list[Val]) -> Val:
    cases = []
    for test, value in zip(args[::2], args[1::2], strict=False):
        if test.err is not None:  # a failing test ends the search with its error
            cases.append((test.err.isNotNull(), Val(ERROR, F.lit(None), test.err)))
        cases.append((to_bool(test), value))
    return chosen(cases, None)


def same(a: Val, b: Val) -> Column:
    """Equality of scalars: numbers by value, else texts without regard to case."""
    return by_kind(a, b, lambda x, y: x == y)


@function("SWITCH", "logical", LAZY, "(expr, value1, result1, ..., [default])")
def switch(args: list[Val]) -> Val:
    rest = args[1:]
    default = rest[-1] if len(rest) % 2 else None
    pairs = zip(rest[::2], rest[1::2], strict=False)
    return chosen([(same(args[0], v), r) for v, r in pairs], default, args[0].err)


@function("CHOOSE", "logical", LAZY, "(index_num, value1, [value2], ...)")
def choose(args: list[Val]) -> Val:
    k = whole(num(args, 0))
    return chosen([(k == i, v) for i, v in enumerate(args[1:], 1)], Val(ERROR, F.lit(None), F.lit(VALUE)), args[0].err)


def caught(args: list[Val], only: str | None) -> Val:
    v, other = args[0], args[1]
    if v.err is None:
        return v
    bad = v.err.isNotNull() if only is None else F.coalesce(v.err == only, F.lit(False))
    return chosen([(bad, other)], v)


@function("IFERROR", "logical", LAZY, "(value, value_if_error)")
def if_error(args: list[Val]) -> Val:
    return caught(args, None)


@function("IFNA", "logical", LAZY, "(value, value_if_na)")
def if_na(args: list[Val]) -> Val:
    return caught(args, NA)


def folded(args: list[Val], fn, over=None) -> Val:
    """Over arguments that aren't blank; with ranges among them, over the list of all truths."""
    if any(a.kind in (RANGE, ANY) for a in args):
        lists = [F.transform(a.col, truth) if a.kind == RANGE else F.array(F.when(~is_blank(a), to_bool(a))) for a in args]
        return boolean(over(F.filter(F.concat(*lists), lambda x: x.isNotNull())), errors_of(args))
    return boolean(fn([F.when(a.col.isNotNull(), to_bool(a)) if a.kind != BLANK else F.lit(None).cast("boolean") for a in args]), errors_of(args))


def truth(s: Column) -> Column:
    """A cell of a range, null where it is blank or an error."""
    return F.when(~s["kind"].isin(BLANK, ERROR), to_bool(Val(ANY, s)))


@function("AND", "logical", signature="(logical1, [logical2], ...)")
def and_(args: list[Val]) -> Val:
    """Without any value, false."""

    def fn(cols: list[Column]) -> Column:
        seen = F.coalesce(*cols).isNotNull()
        return seen & reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in cols])

    return folded(args, fn, lambda a: (F.size(a) > 0) & F.forall(a, lambda x: x))


@function("OR", "logical", signature="(logical1, [logical2], ...)")
def or_(args: list[Val]) -> Val:
    return folded(args, lambda cols: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cols]), lambda a: F.exists(a, lambda x: x))


@function("XOR", "logical", signature="(logical1, [logical2], ...)")
def xor(args: list[Val]) -> Val:
    return folded(args, lambda cols: reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in cols]) % 2 == 1, lambda a: F.size(F.filter(a, lambda x: x)) % 2 == 1)


@function("NOT", "logical", signature="(logical)")
def not_(args: list[Val]) -> Val:
    return boolean(~to_bool(args[0]) if args else F.lit(False), errors_of(args))


@function("TRUE", "logical", signature="()")
def true(args: list[Val]) -> Val:
    return boolean(F.lit(True))


@function("FALSE", "logical", signature="()")
def false(args: list[Val]) -> Val:
    return boolean(F.lit(False))
