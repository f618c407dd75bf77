"""Lookup formulas over named tables: each VLOOKUP, HLOOKUP, INDEX or MATCH call becomes a join before its formula's projection.

A table's name stands for all its cells, `table!column` for one column and `table!a:b` for the columns from a to b. Inner
calls are joined first, so INDEX(t!a, MATCH(k, t!b, 0)) is two joins. A miss is #N/A, a row or column out of range #REF!;
blank keys match nothing in an exact lookup and count as 0, or as an empty text, in an approximate one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import NA, NAME, REF, TEXT, VALUE, Val, column_value, error, fails, number, text, to_num, to_text
from ..operators import lookup
from .parser import FormulaError, Node

LOOKUPS = ("VLOOKUP", "HLOOKUP", "INDEX", "MATCH")


@dataclass(frozen=True)
class Table:
    """What formulas call by a name: rows in the order of pos, which counts from 1; its cells are all other columns.

    in_order promises that keys never fall from row to row; without it approximate lookups first raise each key to the
    greatest one so far.
    """

    df: DataFrame
    pos: str
    in_order: bool = False
    only: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return list(self.only) or [c for c in self.df.columns if c != self.pos]

    def value(self, column: str) -> Val:
        return column_value(column, dict(self.df.dtypes)[column])


class Lookups:
    """Joins the lookups of one formula to its table and puts a name in the place of each call."""

    def __init__(self, df: DataFrame, tables: dict[str, Table], compiler: Callable[[dict[str, Val]], object]):
        self.df, self.compiler = df, compiler
        self.tables = {k.lower(): t for k, t in tables.items()}
        self.names: dict[str, Val] = {}
        self.used = 0

    def fresh(self) -> str:
        """A column's name that neither the table nor an earlier lookup has."""
        while True:
            self.used += 1
            name = f"__look{self.used}"
            if not any(c.lower().startswith(name) for c in self.df.columns):
                return name

    def bound(self, node: Node) -> Node:
        if node.kind != "call" or node.value not in LOOKUPS:
            return replace(node, args=[self.bound(a) for a in node.args])
        name = self.fresh()
        self.names[name] = getattr(self, node.value.lower())(name, node.args)
        return Node("name", name)

    def cell(self, node: Node) -> Val:
        tree = self.bound(node)  # first, since it adds names
        compiler = self.compiler(self.names)
        v = compiler.compile(tree)
        self.df = compiler.applied(self.df)
        return v

    def table(self, node: Node) -> Table | None:
        """The table or the part of it that a reference names; None if there is none."""
        ends = node.args if node.kind == "range" else [node]
        if any(e.kind != "name" for e in ends):
            return None
        sheet, _, first = ends[0].value.replace("$", "").replace("'", "").lower().partition("!")
        found = self.tables.get(sheet)
        if found is None or not first:
            return found
        order = [c.lower() for c in found.columns]
        last = ends[-1].value.replace("$", "").replace("'", "").lower().rpartition("!")[2]
        if first not in order or last not in order:
            return None
        a, b = sorted((order.index(first), order.index(last)))
        return replace(found, only=tuple(found.columns[a : b + 1]))

    def whole(self, node: Node) -> float:
        """A column's number, or a match type, is a literal: it decides on the plan."""
        if node.kind == "unary" and node.args[0].kind == "number":
            return -node.args[0].value if node.value == "-" else node.args[0].value
        if node.kind not in ("number", "boolean"):
            raise FormulaError("a literal is needed here")
        return float(node.value)

    def approximate(self, args: list[Node]) -> bool:
        return len(args) < 4 or self.whole(args[3]) != 0

    def keyed(self, key: Val, name: str, ordered: bool, as_text: bool = False) -> None:
        """The wanted key as a column: in an ordered lookup a number, or a text where either side is one."""
        value = key.value() if not ordered else to_text(key) if as_text else to_num(key)
        self.df = self.df.withColumn(name, F.when(key.err.isNull(), value) if ordered and key.err is not None else value)

    def sorted_by(self, key: Val, table: Table, column: str) -> tuple[DataFrame, str, bool]:
        """The table, its key column as an ordered lookup takes it, and whether keys are compared as texts."""
        cell = table.value(column)
        if TEXT in (key.kind, cell.kind):
            return table.df, column, True
        return table.df.withColumn("__number", to_num(cell)), "__number", False

    def vlookup(self, name: str, args: list[Node]) -> Val:
        if len(args) < 3:
            return error(VALUE)
        key, table, k = self.cell(args[0]), self.table(args[1]), int(self.whole(args[2]))
        if table is None:
            return error(NAME)
        first, column = table.columns[0], table.columns[k - 1] if 1 <= k <= len(table.columns) else None
        ordered = self.approximate(args)
        rows, first, as_text = self.sorted_by(key, table, first) if ordered else (table.df, first, False)
        self.keyed(key, f"{name}_k", ordered, as_text)
        wanted = {f"{name}_v": column or table.columns[0], f"{name}_p": table.pos}
        if ordered:
            self.df = lookup.vlookup_approx(self.df, f"{name}_k", rows, first, table.pos, wanted, table.in_order)
        else:
            self.df = lookup.vlookup(self.df, f"{name}_k", rows, first, table.pos, wanted)
        missed = fails(F.col(f"{name}_p").isNull(), NA)
        return self.found(name, F.coalesce(missed, F.lit(REF)) if column is None else missed)

    def found(self, name: str, err: Column) -> Val:
        v = column_value(f"{name}_v", dict(self.df.dtypes)[f"{name}_v"])
        return Val(v.kind, v.col, err)

    def match(self, name: str, args: list[Node]) -> Val:
        if len(args) < 2:
            return error(VALUE)
        key, table, kind = self.cell(args[0]), self.table(args[1]), self.whole(args[2]) if len(args) > 2 else 1.0
        if table is None:
            return error(NAME)
        if len(table.columns) != 1:
            raise FormulaError("MATCH takes one column")
        rows, column, as_text = self.sorted_by(key, table, table.columns[0]) if kind else (table.df, table.columns[0], False)
        self.keyed(key, f"{name}_k", bool(kind), as_text)
        if kind:
            self.df = lookup.match_ordered(self.df, f"{name}_k", rows, column, table.pos, {f"{name}_p": table.pos}, kind > 0)
        else:
            self.df = lookup.match_position(self.df, f"{name}_k", rows, column, table.pos, f"{name}_p")
        return number(F.col(f"{name}_p"), fails(F.col(f"{name}_p").isNull(), NA))

    def index(self, name: str, args: list[Node]) -> Val:
        if len(args) < 2:
            return error(VALUE)
        table, row, k = self.table(args[0]), self.cell(args[1]), int(self.whole(args[2])) if len(args) > 2 else 0
        if table is None:
            return error(NAME)
        k = k or 1
        if not 1 <= k <= len(table.columns):
            return error(REF)
        self.df = self.df.withColumn(f"{name}_k", F.when(row.err.isNull(), to_num(row)).cast("long") if row.err is not None else to_num(row).cast("long"))
        self.df = lookup.index_rows(self.df, f"{name}_k", table.df, table.pos, {f"{name}_v": table.columns[k - 1], f"{name}_p": table.pos})
        missed = fails(F.col(f"{name}_p").isNull(), REF)
        return self.found(name, F.coalesce(row.err, missed) if row.err is not None else missed)

    def hlookup(self, name: str, args: list[Node]) -> Val:
        """The headers are the first row and known to the plan; of the others one row is joined, so no search is left.

        With a literal key the plan knows the column and its type. With any other, cells of several types become text.
        """
        if len(args) < 3:
            return error(VALUE)
        key, table, r = self.cell(args[0]), self.table(args[1]), int(self.whole(args[2]))
        if table is None:
            return error(NAME)
        near = self.approximate(args)
        wanted, headers = F.lower(to_text(Val(key.kind, key.value()))), [c.lower() for c in table.columns]
        at = F.when(key.value().isNull(), F.lit(0))
        for k, h in enumerate(headers):
            at = at.when(wanted < h, F.lit(k)) if near else at.when(wanted == h, F.lit(k + 1))
        at = at.otherwise(F.lit(len(headers) if near else 0))
        if r == 1:
            cells, present = [text(F.lit(c)) for c in table.columns], F.lit(True)
        else:
            own = {c: f"{name}_c{k}" for k, c in enumerate(table.columns)}
            row = table.df.filter(F.col(f"`{table.pos}`") == r - 1).limit(1).select(F.lit(True).alias(f"{name}_p"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
            types = dict(row.dtypes)
            self.df = self.df.join(F.broadcast(row), F.lit(True), "left")  # one row
            cells, present = [column_value(n, types[n]) for n in own.values()], F.col(f"{name}_p").isNotNull()
        if args[0].kind == "text":
            sought = args[0].value.lower()
            fit = next((k for k, h in enumerate(headers) if h > sought), len(headers)) if near else next((k + 1 for k, h in enumerate(headers) if h == sought), 0)
            cell = cells[fit - 1]
            return Val(cell.kind, cell.col, fails(~present, REF)) if fit else error(NA)
        kinds = {c.kind for c in cells}
        kind = kinds.pop() if len(kinds) == 1 else TEXT
        value = F.when(F.lit(False), to_text(cells[0]) if kind == TEXT else cells[0].col)
        for k, c in enumerate(cells):
            value = value.when(at == k + 1, to_text(c) if kind == TEXT and c.kind != TEXT else c.col)
        return Val(kind, value, F.when(at == 0, F.lit(NA)).when(~present, F.lit(REF)))
