"""Formulas to DataFrame plans.

A formula over a table is read in one of two ways. As a calculated column its names are the row's cells and it becomes
one Column. As a summary its names are ranges: every aggregate in all formulas of a call goes into one agg() over one
scan (partial sums map-side), what needs an order or a first pass becomes a plan beside it with a row for each group, and
the rest is arithmetic on the result's rows.

An argument that can fail, or is itself a call, becomes a column (two with its error) of a projection below its use, so
an expression never holds another one twice and plans grow in proportion to formulas.
"""

from __future__ import annotations

import itertools
import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import registry
from ..functions.values import ANY, BLANK, DIV0, ERROR, NA, NAME, NUM, RANGE, REF, TEXT, Val, boolean, by_kind, column_value, error, errors_of, fails, is_blank, lit, merged, number, text, to_bool, to_num, to_text
from ..operators.criteria import criterion, criterion_of
from ..operators.orderstats import folded, kth_values, mean_absolute_deviation, modal_value, quantiles, ranked, trimmed_mean
from ..shared import SMALL_ROWS, written
from .lookups import Lookups, Table
from .parser import FormulaError, Node, parse

FORMATTED = {"TEXT": 1, "DOLLAR": 1, "FIXED": 1}
#: Functions of scalars that take columns as well in a summary.
FOLDING = ("AND", "OR", "XOR", "CONCAT", "CONCATENATE", "TEXTJOIN", "NPV")
SERIAL = itertools.count(1)
COMPARISONS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def literal(node: Node) -> object:
    """A literal's value; a sign before a number belongs to it."""
    if node.kind in ("number", "text", "boolean"):
        return node.value
    if node.kind == "unary" and node.args[0].kind == "number":
        return -node.args[0].value if node.value == "-" else node.args[0].value
    raise FormulaError("a literal is needed here")


def is_literal(node: Node) -> bool:
    return node.kind in ("number", "text", "boolean") or node.kind == "unary" and node.args[0].kind == "number"


def uses_columns(node: Node) -> bool:
    return node.kind == "name" or any(uses_columns(a) for a in node.args)


class RowCompiler:
    """Compiles a tree over the cells of a row. Its steps must be applied to the table before the result is selected."""

    def __init__(self, schema: dict[str, str], names: dict[str, Val] | None = None):
        self.schema = {k.lower(): (k, t) for k, t in schema.items()}
        self.names = {k.lower(): v for k, v in (names or {}).items()}
        self.functions = registry.load()
        self.steps: list[dict[str, Column]] = []
        self.depth: dict[int, int] = {}  # projections that a node's columns need, by the node's identity

    def name(self, name: str) -> Val:
        key = name.replace("$", "").lower()
        if key in self.names:
            return self.names[key]
        if key in self.schema:
            return column_value(*self.schema[key])
        return error(NAME)

    def compile(self, node: Node) -> Val:
        self.depth[id(node)] = 0
        return self.name(node.value) if node.kind == "name" else getattr(self, node.kind)(node)

    def operand(self, node: Node) -> Val:
        """An argument's value, as columns of a projection below where that keeps the expression small."""
        v = self.compile(node)
        if not node.args and node.kind != "call" or v.kind in (ERROR, BLANK, RANGE) or v.err is None and node.kind != "call":
            return v
        level, name = self.depth[id(node)], f"__s{next(SERIAL)}"
        while len(self.steps) <= level:
            self.steps.append({})
        self.steps[level][f"{name}v"] = v.value()
        if v.err is not None:
            self.steps[level][f"{name}e"] = v.err
        self.depth[id(node)] = level + 1
        return Val(v.kind, F.col(f"{name}v"), None if v.err is None else F.col(f"{name}e"))

    def settle(self, node: Node) -> None:
        """Notes how many projections a node needs, once its arguments are compiled."""
        self.depth[id(node)] = max((self.depth.get(id(a), 0) for a in node.args), default=0)

    def applied(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.select("*", *[c.alias(n) for n, c in step.items()])
        return df

    def number(self, node: Node) -> Val:
        return lit(node.value)

    text = boolean = number

    def error(self, node: Node) -> Val:
        return error(node.value)

    def range(self, node: Node) -> Val:
        raise FormulaError("a range stands only as an argument")

    def unary(self, node: Node) -> Val:
        v = self.operand(node.args[0])
        self.settle(node)
        return number(-to_num(v) if node.value == "-" else to_num(v), v.err)

    def percent(self, node: Node) -> Val:
        v = self.operand(node.args[0])
        self.settle(node)
        return number(to_num(v) / 100.0, v.err)

    def binary(self, node: Node) -> Val:
        a, b = (self.operand(x) for x in node.args)
        self.settle(node)
        op, err = node.value, errors_of([a, b])
        if op == "&":
            return text(F.concat(to_text(a), to_text(b)), err)
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return boolean(by_kind(a, b, COMPARISONS[op]), err)
        x, y = to_num(a), to_num(b)
        if op == "/":
            return number(F.try_divide(x, y), merged(err, fails(y == 0, DIV0)))
        return number({"+": x + y, "-": x - y, "*": x * y, "^": F.pow(x, y)}[op], err)

    def call(self, node: Node) -> Val:
        f = self.functions.get(node.value)
        if f is None:
            return error(NAME)
        if f.mode == registry.LOOKUP:
            raise FormulaError(f"{node.value} needs a table")
        args = [v for a in node.args for v in self.argument(a)]
        self.settle(node)
        if node.value in FORMATTED:
            at = FORMATTED[node.value]
            return f.build(args, *([literal(node.args[at])] if at < len(node.args) else []))
        return f.build(args)

    def argument(self, node: Node) -> list[Val]:
        """A range of columns stands for its cells in the row."""
        if node.kind != "range":
            return [self.operand(node)]
        order = [k for k in self.schema]
        ends = [order.index(a.value.replace("$", "").lower()) if a.kind == "name" and a.value.replace("$", "").lower() in self.schema else -1 for a in node.args]
        if -1 in ends:
            return [error(REF)]
        return [column_value(*self.schema[k]) for k in order[min(ends) : max(ends) + 1]]


@dataclass
class Summary:
    """What the formulas of one call need: aggregates of one scan, and plans beside it with a row for each group."""

    aggregates: dict[str, Column] = field(default_factory=dict)
    frames: list[DataFrame] = field(default_factory=list)
    ranks: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, c: Column) -> Column:
        name = f"__a{len(self.aggregates)}"
        self.aggregates[name] = c
        return F.col(name)


class SummaryCompiler(RowCompiler):
    """Compiles a tree whose names are the columns of a table, as ranges: over the whole table, or by group.

    pos: the column that orders the rows, for what depends on their order.
    """

    def __init__(self, df: DataFrame, plan: Summary, by: list[str] | None = None, pos: str | None = None):
        super().__init__(dict(df.dtypes))
        self.df, self.plan, self.by, self.pos = df, plan, list(by or []), pos
        self.groups = [f"__g{i}" for i in range(len(self.by))]  # the groups' columns in plans of their own
        self.rows = RowCompiler(dict(df.dtypes))
        self.sides: list[DataFrame] = []

    def source(self) -> DataFrame:
        """The table with what its cells' expressions need."""
        df = self.df
        for side in self.sides:
            df = df.join(F.broadcast(side), F.lit(True), "left")  # one row each
        return self.rows.applied(df)

    def name(self, name: str) -> Val:
        raise FormulaError(f"{name} is a range here")

    def call(self, node: Node) -> Val:
        f = self.functions.get(node.value)
        if f is not None and (f.mode in (registry.AGGREGATE, registry.LOOKUP) or node.value in FOLDING) and uses_columns(node):
            return self.ranged(node)
        return super().call(node)

    def keep(self, v: Val) -> Val:
        """The value and its error as columns of the result's rows."""
        return Val(v.kind, self.plan.add(v.col), None if v.err is None else self.plan.add(v.err))

    def ordered(self, what: str) -> str:
        if self.pos is None:
            raise FormulaError(f"{what} over a column needs the column that orders it: pos")
        return self.pos

    def scalar(self, node: Node) -> Val:
        """A parameter: a literal, an expression of literals, or one of aggregates over the whole table, which are found first."""
        if is_literal(node):
            return lit(literal(node))
        if not uses_columns(node):
            own = RowCompiler({})
            v = own.compile(node)
            if not own.steps:
                return v
            tree = own.applied(self.df.sparkSession.range(1)).select(v.value().alias("v"), (v.err if v.err is not None else F.lit(None).cast("string")).alias("e"))
        else:
            inner = SummaryCompiler(self.df, Summary(), None, self.pos)
            v = inner.compile(node)
            tree = finished(inner, [], {"v": v}, True).select("v", F.col("v_error").alias("e"))
        side = f"__p{next(SERIAL)}"
        self.sides.append(tree.toDF(f"{side}v", f"{side}e"))
        return Val(v.kind, F.col(f"{side}v"), F.col(f"{side}e"))

    def constant(self, node: Node) -> float:
        """A number that decides on the plan: a literal, or an expression of literals."""
        if is_literal(node):
            return float(literal(node))
        if uses_columns(node):
            raise FormulaError("a number is needed here")
        own = RowCompiler({})
        v = own.compile(node)
        return float(own.applied(self.df.sparkSession.range(1)).select(to_num(v)).first()[0])

    def cells(self, name: str, v: Val) -> Column:
        """What an aggregate takes of a cell, null where it doesn't count."""
        if name == "COUNTA":
            return F.when(v.value().isNotNull(), F.lit(1.0))
        inner = Val(v.kind, v.value())
        return agg.anything(inner) if name in ("AVERAGEA", "MINA", "MAXA") else agg.countable(inner)

    def ranged(self, node: Node) -> Val:
        special = getattr(self, "do_" + node.value.replace(".", "_").lower(), None)
        if special:
            return special(node)
        name = node.value
        if name not in agg.VERTICAL:
            raise FormulaError(f"{name} isn't defined over a column")
        single = name.split(".")[0] in ("PERCENTRANK", "RANK")
        cells, extra = node.args, []
        if single:
            own = 0 if name.startswith("RANK") else 1
            cells, extra = [node.args[1 - own]], [self.scalar(node.args[own])]
        if len(cells) != 1 or cells[0].kind == "range":
            return self.several(node)
        v = self.rows.operand(cells[0])
        if name == "COUNTBLANK":
            return self.keep(number(F.count_if(v.col.isNull())))
        x = self.cells(name, v)
        if not single:
            return self.keep(agg.VERTICAL[name](x))
        sign = -1.0 if name.startswith("RANK") and len(node.args) > 2 and self.constant(node.args[2]) != 0 else 1.0
        found = agg.VERTICAL[name](x * sign, to_num(extra[0]) * sign)
        return self.keep(number(found.col, merged(F.max(extra[0].err) if extra[0].err is not None else None, found.err)))

    def parts(self, node: Node) -> list[Node]:
        """Arguments one by one: a range of columns is its columns."""
        out = []
        for a in node.args:
            if a.kind != "range":
                out.append(a)
                continue
            order = list(self.rows.schema)
            ends = [order.index(e.value.replace("$", "").lower()) for e in a.args if e.kind == "name" and e.value.replace("$", "").lower() in self.rows.schema]
            if len(ends) != 2:
                raise FormulaError("a range goes from a column to a column")
            out += [Node("name", self.rows.schema[k][0]) for k in order[min(ends) : max(ends) + 1]]
        return out

    def several(self, node: Node) -> Val:
        """Aggregates of several ranges: from the parts where they combine, else over the cells of all of them."""
        name, args = node.value, self.parts(node)
        of = lambda fn: [self.ranged(Node("call", fn, [a])) if uses_columns(a) else self.functions[fn].build([self.compile(a)]) for a in args]
        join = {"SUM": "SUM", "COUNT": "SUM", "COUNTA": "SUM", "COUNTBLANK": "SUM", "SUMSQ": "SUM", "PRODUCT": "PRODUCT"}.get(name)
        if join:
            return self.functions[join].build(of(name))
        if name == "AVERAGE":
            total, n = self.functions["SUM"].build(of("SUM")), self.functions["SUM"].build(of("COUNT"))
            return number(F.try_divide(total.col, n.col), merged(total.err, fails(n.col == 0, DIV0)))
        values = [self.rows.operand(a) if uses_columns(a) else self.scalar(a) for a in args]
        if name in ("MIN", "MAX", "MINA", "MAXA"):
            fn = F.min if name.startswith("MIN") else F.max
            return self.functions[name].build([self.keep(number(fn(self.cells(name, v)))) for v in values])
        x = F.explode(F.array(*[self.cells(name, v) for v in values]))
        found = agg.VERTICAL[name](F.col("x"))
        err = found.err if found.err is not None else F.lit(None).cast("string")
        cells = self.source().select(*self.keys(), x.alias("x"))
        return self.frame(cells.groupBy(*self.groups).agg(found.col.alias("value"), err.alias("error")), found.kind)

    def frame(self, df: DataFrame, kind: str = "number") -> Val:
        """A plan with a row for each group (one without groups), as columns of the result's rows; df: groups, value, error."""
        k = len(self.plan.frames)
        keys = [F.col(g).alias(f"__f{k}_{i}") for i, g in enumerate(self.groups)]
        self.plan.frames.append(df.select(*keys, F.col("value").alias(f"__f{k}_v"), F.col("error").alias(f"__f{k}_e")))
        return Val(kind, F.col(f"__f{k}_v"), F.col(f"__f{k}_e"))

    def keys(self) -> list[Column]:
        return [F.col(f"`{b}`").alias(g) for b, g in zip(self.by, self.groups, strict=True)]

    def beside(self, node: Node, fn, bad: str) -> Val:
        """A plan over the numbers of a range: groups, value; a null value, or a group that it lacks, fails."""
        args = self.parts(Node("call", node.value, node.args[:1])) if len(node.args) == 1 or node.value in BESIDE_FIRST else self.parts(node)
        cells = [agg.countable(Val(v.kind, v.value())) for v in (self.rows.operand(a) if uses_columns(a) else self.scalar(a) for a in args)]
        x = cells[0] if len(cells) == 1 else F.explode(F.array(*cells))
        pos = [F.col(f"`{self.pos}`").alias("__pos")] if self.pos else []
        df = self.source().select(*self.keys(), *pos, x.alias("x")).filter("x is not null")
        v = self.frame(fn(df).select(*self.groups, "value", F.lit(None).cast("string").alias("error")))
        return number(v.col, merged(v.err, fails(v.col.isNull(), bad)))

    def met(self, pairs: list[Node]) -> tuple[Column, Column | None]:
        """Whether a row meets all criteria, and a criterion's error."""
        conditions, errors = [], []
        for r, c in zip(pairs[::2], pairs[1::2], strict=True):
            cell = self.rows.operand(r)
            cell = Val(cell.kind, cell.value())
            if is_literal(c):
                conditions.append(criterion(cell, literal(c)))
                continue
            wanted = self.scalar(c)
            conditions.append(criterion_of(cell, wanted))
            errors += [F.max(wanted.err)] if wanted.err is not None else []
        return reduce(lambda a, b: a & b, conditions), merged(*errors)

    def do_sumif(self, node: Node) -> Val:
        return self.conditional("SUM", node.args[2] if len(node.args) > 2 else node.args[0], node.args[:2])

    def do_averageif(self, node: Node) -> Val:
        return self.conditional("AVERAGE", node.args[2] if len(node.args) > 2 else node.args[0], node.args[:2])

    def do_sumifs(self, node: Node) -> Val:
        return self.conditional("SUM", node.args[0], node.args[1:])

    def do_averageifs(self, node: Node) -> Val:
        return self.conditional("AVERAGE", node.args[0], node.args[1:])

    def do_countifs(self, node: Node) -> Val:
        met, err = self.met(node.args)
        return self.keep(number(F.count_if(met), err))

    do_countif = do_countifs

    def do_maxifs(self, node: Node) -> Val:
        return self.extreme(F.max, node)

    def do_minifs(self, node: Node) -> Val:
        return self.extreme(F.min, node)

    def extreme(self, fn, node: Node) -> Val:
        """Without a match it fails instead of giving 0."""
        v = self.rows.operand(node.args[0])
        met, err = self.met(node.args[1:])
        best = fn(F.when(met, self.cells("MAX", v)))
        return self.keep(number(best, merged(err, fails(best.isNull(), DIV0))))

    def conditional(self, name: str, values: Node, pairs: list[Node]) -> Val:
        v = self.rows.operand(values)
        met, err = self.met(pairs)
        found = agg.VERTICAL[name](F.when(met, self.cells(name, v)))
        return self.keep(number(found.col, merged(err, found.err)))

    def do_sumproduct(self, node: Node) -> Val:
        row = agg.sum_product([self.rows.operand(a) for a in node.args])
        return self.keep(number(F.coalesce(F.sum(row.value()), F.lit(0.0))))

    def do_large(self, node: Node) -> Val:
        return self.beside(node, lambda x: kth_values(x, int(self.constant(node.args[1])), False, by=self.groups), NUM)

    def do_small(self, node: Node) -> Val:
        return self.beside(node, lambda x: kth_values(x, int(self.constant(node.args[1])), True, by=self.groups), NUM)

    def do_avedev(self, node: Node) -> Val:
        return self.beside(node, lambda x: mean_absolute_deviation(x, by=self.groups), NUM)

    def do_trimmean(self, node: Node) -> Val:
        return self.beside(node, lambda x: trimmed_mean(x, self.constant(node.args[1]), by=self.groups), NUM)

    def do_mode(self, node: Node) -> Val:
        """The first seen of ties where the order of rows is known, else the smallest."""
        return self.beside(node, lambda x: modal_value(x, pos="__pos" if self.pos else None, by=self.groups), NA)

    do_mode_sngl = do_mode_mult = do_mode

    def do_gcd(self, node: Node) -> Val:
        return self.beside(node, lambda x: folded(x, "gcd", by=self.groups), NUM)

    def do_lcm(self, node: Node) -> Val:
        return self.beside(node, lambda x: folded(x, "lcm", by=self.groups), NUM)

    def share(self, node: Node, share: float) -> Val:
        """Quantiles of one range share its ranking."""
        key = repr(node.args[0]) if node.args[0].kind == "name" else None

        def fn(x: DataFrame) -> DataFrame:
            ranks = self.plan.ranks.get(key) if key else None
            if ranks is None:
                ranks = written(ranked(x, by=self.groups), "ranks")
            if key:
                self.plan.ranks[key] = ranks
            return quantiles(x, [share], by=self.groups, ranks=ranks)

        return self.beside(node, fn, NUM)

    def do_median(self, node: Node) -> Val:
        return self.share(node, 0.5)

    def do_percentile(self, node: Node) -> Val:
        return self.share(node, self.constant(node.args[1]))

    do_percentile_inc = do_percentile

    def do_quartile(self, node: Node) -> Val:
        q = self.constant(node.args[1])
        return self.share(node, q / 4) if 0 <= q <= 4 else error(NUM)

    do_quartile_inc = do_quartile

    def truths(self, node: Node, fn) -> Val:
        """AND, OR and XOR: each range's truth, null without any value, beside those of scalars."""
        found = []
        for a in self.parts(node):
            if not uses_columns(a):
                found.append(self.compile(a))
                continue
            v = self.rows.operand(a)
            found.append(self.keep(boolean(fn(F.when(v.value().isNotNull(), to_bool(v))))))
        return self.functions[node.value].build(found)

    def do_and(self, node: Node) -> Val:
        return self.truths(node, F.bool_and)

    def do_or(self, node: Node) -> Val:
        return self.truths(node, F.bool_or)

    def do_xor(self, node: Node) -> Val:
        return self.truths(node, lambda b: F.when(F.count(b) > 0, F.count_if(b) % 2 == 1))

    def texts_of(self, node: Node, skip: bool) -> Column:
        """The texts of a range in its order; the result is one cell, so they meet in one place."""
        v = self.rows.operand(node)
        each = F.struct(F.col(f"`{self.ordered('a text')}`").alias("p"), F.when(v.value().isNotNull(), to_text(v)).alias("t"))
        got = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"])
        return F.filter(got, lambda t: t.isNotNull()) if skip else F.transform(got, lambda t: F.coalesce(t, F.lit("")))

    def do_concat(self, node: Node) -> Val:
        found = [text(self.plan.add(F.array_join(self.texts_of(a, False), ""))) if uses_columns(a) else self.compile(a) for a in self.parts(node)]
        return self.functions["CONCAT"].build(found)

    do_concatenate = do_concat

    def do_textjoin(self, node: Node) -> Val:
        delimiter, skip = self.compile(node.args[0]), len(node.args) > 1 and bool(literal(node.args[1]))
        lists, errors = [], [delimiter.err]
        for a in self.parts(Node("call", node.value, node.args[2:])):
            if uses_columns(a):
                lists.append(self.plan.add(self.texts_of(a, skip)))
                continue
            v = self.compile(a)
            errors.append(v.err)
            one = F.array(F.when(v.col.isNull(), F.lit(None).cast("string")).otherwise(to_text(v)))
            lists.append(F.filter(one, lambda t: t.isNotNull()) if skip else F.transform(one, lambda t: F.coalesce(t, F.lit(""))))
        return text(F.call_function("array_join", F.concat(*lists), to_text(delimiter)), merged(*errors))

    def do_npv(self, node: Node) -> Val:
        """A range counts as its first cell only."""
        found = []
        for a in node.args:
            if not uses_columns(a) or a.kind == "call":
                found.append(self.compile(a))
                continue
            v = self.rows.operand(a)
            found.append(self.keep(number(F.min_by(to_num(v), F.col(f"`{self.ordered('NPV')}`")))))
        return self.functions["NPV"].build(found)

    def do_index(self, node: Node) -> Val:
        raise FormulaError(f"{node.value} belongs in a calculated column, with its table named in tables")

    do_match = do_vlookup = do_hlookup = do_index


#: Functions whose arguments after the first are parameters.
BESIDE_FIRST = ("LARGE", "SMALL", "TRIMMEAN", "PERCENTILE", "PERCENTILE.INC", "QUARTILE", "QUARTILE.INC")


def compile_tree(compiler: RowCompiler, formula: str) -> Val:
    """A formula that can't be read is the error #NAME?."""
    try:
        tree = parse(formula)
    except FormulaError:
        return error(NAME)
    return compiler.compile(tree)


def result(v: Val, name: str, errors: bool) -> list[Column]:
    """The value under its name, and its error if asked for; a blank or an error is null."""
    kind = "string" if v.kind in (TEXT, ANY) else "boolean" if v.kind == "boolean" else "double"
    value = v.value()
    if v.kind == ANY:  # a column has one type: what is sometimes a text always is
        filled = ~is_blank(v) if v.err is None else ~is_blank(v) & v.err.isNull()
        value = F.when(filled, to_text(v))
    out = [value.cast(kind).alias(name)]
    none = F.lit(None).cast("string")
    return out + ([(none if v.err is None else v.err).alias(f"{name}_error")] if errors else [])


def calculated(df: DataFrame, formulas: dict[str, str], errors: bool = False, tables: dict[str, Table] | None = None) -> DataFrame:
    """Adds calculated columns; a later formula can use an earlier one's name. One projection for each level of use.

    Lookups in a formula are joins to the tables that it names.
    """
    for name, formula in formulas.items():
        if tables:
            joined, v = located(df, formula, tables)
        else:
            compiler = RowCompiler(dict(df.dtypes))
            v = compile_tree(compiler, formula)
            joined = compiler.applied(df)
        new = result(v, name, errors)
        taken = {name, f"{name}_error"} if errors else {name}
        df = joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in taken], *new)
    return df


def located(df: DataFrame, formula: str, tables: dict[str, Table]) -> tuple[DataFrame, Val]:
    """The table with what the formula's lookups found beside its columns, and the formula over both."""
    schema = dict(df.dtypes)
    found = Lookups(df, tables, lambda names: RowCompiler(schema, names))
    try:
        tree = found.bound(parse(formula))
    except FormulaError as bad:
        if str(bad).startswith(("expected", "unexpected")):
            return df, error(NAME)
        raise
    compiler = RowCompiler(schema, found.names)
    v = compiler.compile(tree)
    return compiler.applied(found.df), v


def finished(compiler: SummaryCompiler, by: list[str], values: dict[str, Val], errors: bool) -> DataFrame:
    """The result's rows: the aggregates, the plans beside them joined by group, then what is made of both."""
    plan = compiler.plan
    aggregates, source = [c.alias(n) for n, c in plan.aggregates.items()], compiler.source()
    if by:
        base = source.groupBy(*by).agg(*(aggregates or [F.count("*").alias("__n")]))
    else:
        base = source.agg(*aggregates) if aggregates else compiler.df.sparkSession.range(1)
    for k, frame in enumerate(plan.frames):
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"__f{k}_{i}"))
        frame = written(frame, "summary-frame") if by else frame
        base = base.join(F.broadcast(frame) if not by or frame.count() <= SMALL_ROWS else frame, same, "left")
    return compiler.applied(base).select(*by, *[c for name, v in values.items() for c in result(v, name, errors)])


def summary(df: DataFrame, formulas: dict[str, str], by: list[str] | None = None, errors: bool = False, pos: str | None = None) -> DataFrame:
    """One row (or one for each group) with a column for each formula: all plain aggregates in one pass over the table.

    pos names the column that orders the rows, which TEXTJOIN, CONCAT and NPV need and MODE uses for its ties.
    """
    compiler = SummaryCompiler(df, Summary(), by, pos)
    values = {name: compile_tree(compiler, f) for name, f in formulas.items()}
    return finished(compiler, list(by or []), values, errors)


def evaluate(spark: SparkSession, formulas: dict[str, str], errors: bool = False) -> DataFrame:
    """Formulas over literals: one row."""
    compiler = RowCompiler({})
    values = {name: compile_tree(compiler, f) for name, f in formulas.items()}
    return compiler.applied(spark.range(1)).select(*[c for name, v in values.items() for c in result(v, name, errors)])
