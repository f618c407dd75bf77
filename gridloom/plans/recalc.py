"""Recalculation: formulas over cell grids, as joins and projections.

Each formula's references become numbered places, so formulas that differ only in what they refer to, as those filled down a
column do, are one pattern; a pattern is compiled once, over cells whose kinds are known only where it is evaluated. In each
round the formulas whose references hold no formula that is still open are ready: the cells they name are joined to them,
and one projection for each pattern gives their values. Rounds are as many as the longest chain of formulas; if none is
ready, the open ones that others wait for lie on a cycle and are #REF!.

A range is an array of its cells, blanks among them, as in the model; it is gathered once however many formulas name it.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ANY, CELL, DIV0, ERROR, NA, NAME, RANGE, REF, VALUE, Val, cell_num, cell_of, cell_text, countable_cell, error, errors_of, fails, first_cell, is_textual, merged, number, of_cell, to_bool, to_num, to_text
from ..operators.criteria import criterion_of
from ..operators.grid import SHEET, cell_range
from ..shared import written
from .compiler import SERIAL, RowCompiler
from .parser import FormulaError, Node, parse

#: Patterns of a recalculation, which the driver compiles one by one; more are an error.
MOST_PATTERNS = 5000
FIELDS = ("kind", "num", "txt", "bool", "err")
PLACE = [*SHEET, "row", "col"]
#: A reference, perhaps to another sheet, and perhaps a range; texts are passed over.
SPOT = re.compile(r"""("(?:[^"]|"")*")|(?<![\w.$!'])(?:((?:'(?:[^']|'')*'|[A-Za-z_\u0080-￿][\w.]*))!)?(\$?[A-Za-z]{1,3}\$?\d+)(?::(\$?[A-Za-z]{1,3}\$?\d+))?(?![\w(!.])""")


def numbered(formula: str, sheet: str, names: dict[str, str]) -> tuple[str, list[tuple[str, int, int, int, int]]]:
    """The formula with places for its references, and the rectangles that they name; defined names stand for what they are."""
    found: list[tuple[str, int, int, int, int]] = []

    def place(m: re.Match) -> str:
        if m[1]:
            return m[1]
        try:
            area = cell_range(f"{m[3]}:{m[4]}" if m[4] else m[3])
        except ValueError:
            return m[0]
        own = (m[2].strip("'").replace("''", "'") if m[2] else sheet, *area)
        if own not in found:
            found.append(own)
        return f"__{'range' if m[4] else 'cell'}{found.index(own)}"

    for name, target in names.items():
        formula = re.sub(rf"""("(?:[^"]|"")*")|(?<![\w.!'])(?i:{re.escape(name)})(?![\w(!.])""", lambda m, t=target: m[1] or t.removeprefix("="), formula)
    return SPOT.sub(place, formula.removeprefix("=")), found


def blank_cell() -> Column:
    return first_cell(F.array().cast(f"array<{CELL}>"))


def like(a: Column, b: Column) -> Column:
    """Whether two cells are equal as lookups see it: numbers by value, else texts without regard to case."""
    return F.when(countable_cell(a) & countable_cell(b), cell_num(a) == cell_num(b)).otherwise(F.upper(cell_text(a)) == F.upper(cell_text(b)))


def beyond(a: Column, b: Column) -> Column:
    """Whether a stands after b."""
    return F.when(countable_cell(a) & countable_cell(b), cell_num(a) > cell_num(b)).otherwise(F.upper(cell_text(a)) > F.upper(cell_text(b)))


def meets(wanted: Val):
    """Whether a cell meets a criterion."""
    if wanted.kind != ANY:
        return lambda s: criterion_of(Val(ANY, s), Val(wanted.kind, wanted.col))
    text, plain = Val("text", to_text(wanted)), number(to_num(wanted))
    return lambda s: F.when(is_textual(wanted), criterion_of(Val(ANY, s), text)).otherwise(criterion_of(Val(ANY, s), plain))


class GridCompiler(RowCompiler):
    """Compiles a pattern over columns refs (cells by place) and areas (for each place rows, columns and cells)."""

    def compile(self, node: Node) -> Val:
        """A cell is a column of the first projection, so that what is made of it stays small."""
        if node.kind == "name" and (m := re.fullmatch(r"__cell(\d+)", node.value)):
            self.depth[id(node)] = 0
            return of_cell(self.hold(first_cell(F.get("areas", F.lit(int(m[1])))["cells"]), [node], f"__k{m[1]}"))
        return super().compile(node)

    def name(self, name: str) -> Val:
        m = re.fullmatch(r"__range(\d+)", name)
        return Val(RANGE, F.get("areas", F.lit(int(m[1])))["cells"]) if m else error(NAME)

    def hold(self, c: Column, nodes: list[Node], name: str | None = None) -> Column:
        """An expression over what nodes are made of, as a column of the next projection."""
        level = max(self.depth.get(id(n), 0) for n in nodes)
        name = name or f"__h{next(SERIAL)}"
        while len(self.steps) <= level:
            self.steps.append({})
        self.steps[level][name] = c
        self.depth[id(nodes[0])] = level + 1
        return F.col(name)

    def range(self, node: Node) -> Val:
        return error(REF)

    def argument(self, node: Node) -> list[Val]:
        return [self.operand(node)]

    def area(self, node: Node) -> tuple[Column, Column, Column]:
        """Cells, rows and columns of an argument; a single value is a range of one."""
        if node.kind == "name" and (m := re.fullmatch(r"__(?:cell|range)(\d+)", node.value)):
            at = F.get("areas", F.lit(int(m[1])))
            return at["cells"], at["rows"], at["cols"]
        return F.array(cell_of(self.operand(node))), F.lit(1), F.lit(1)

    def call(self, node: Node) -> Val:
        fn = getattr(self, "on_" + node.value.lower(), None)
        if fn is None:
            return super().call(node)
        if len(node.args) < LEAST_ARGUMENTS.get(node.value, 1):
            return error(VALUE)
        v = fn(node.args)
        self.settle(node)
        return v

    def met(self, pairs: list[Node]) -> tuple[Column, Column | None]:
        """For each position whether all criteria hold there, as far as the shortest range goes."""
        lists, errors = [], []
        for r, c in zip(pairs[::2], pairs[1::2], strict=False):
            wanted = self.operand(c)
            errors.append(wanted.err)
            lists.append(F.transform(self.area(r)[0], meets(wanted)))
        both = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x & y, F.lit(False))), lists)
        return both, merged(*errors)

    def chosen(self, values: Node, pairs: list[Node]) -> tuple[Column, Column | None]:
        """The numbers of a range at the positions that meet the criteria."""
        hits, err = self.met(pairs)
        nums = F.transform(self.area(values)[0], lambda s: F.when(countable_cell(s), cell_num(s)))
        return self.hold(F.filter(F.zip_with(hits, nums, lambda h, x: F.when(h, x)), lambda x: x.isNotNull()), pairs), err

    def total(self, found: Column) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda a, x: a + x)

    def on_sumif(self, args: list[Node]) -> Val:
        found, err = self.chosen(args[2] if len(args) > 2 else args[0], args[:2])
        return number(self.total(found), err)

    def on_sumifs(self, args: list[Node]) -> Val:
        found, err = self.chosen(args[0], args[1:])
        return number(self.total(found), err)

    def averaged(self, found: Column, err: Column | None) -> Val:
        return number(F.try_divide(self.total(found), F.size(found).cast("double")), merged(err, fails(F.size(found) == 0, DIV0)))

    def on_averageif(self, args: list[Node]) -> Val:
        return self.averaged(*self.chosen(args[2] if len(args) > 2 else args[0], args[:2]))

    def on_averageifs(self, args: list[Node]) -> Val:
        return self.averaged(*self.chosen(args[0], args[1:]))

    def on_countifs(self, args: list[Node]) -> Val:
        hits, err = self.met(args)
        return number(F.size(F.filter(hits, lambda h: h)), err)

    on_countif = on_countifs

    def extreme(self, fn, args: list[Node]) -> Val:
        found, err = self.chosen(args[0], args[1:])
        return number(fn(found), merged(err, fails(F.size(found) == 0, DIV0)))

    def on_maxifs(self, args: list[Node]) -> Val:
        return self.extreme(F.array_max, args)

    def on_minifs(self, args: list[Node]) -> Val:
        return self.extreme(F.array_min, args)

    def found(self, cells: Column, at: Column, err: Column | None) -> Val:
        """The cell at a place of an array, with the error of a search or its own."""
        s = F.coalesce(F.get(cells, at.cast("int")), blank_cell())
        return Val(ANY, F.when(F.lit(True) if err is None else err.isNull(), s), s["err"] if err is None else F.coalesce(err, s["err"]))

    def line_of(self, line: Column, k: Column, near: Column) -> Column:
        """Where a key stands in a row or column of cells, from 0: the first equal one, or the last before the first that is beyond it."""
        exact = F.array_position(F.transform(line, lambda s: like(s, k)), True)
        over = F.array_position(F.transform(line, lambda s: beyond(s, k)), True)
        return F.when(near, F.when(over > 0, over - 1).otherwise(F.size(line)).cast("long")).otherwise(exact) - 1

    def looked_up(self, args: list[Node], across: bool) -> Val:
        key, n = self.operand(args[0]), self.operand(args[2])
        cells, rows, cols = self.area(args[1])
        near = to_bool(self.operand(args[3])) if len(args) > 3 else F.lit(True)
        line = F.slice(cells, F.lit(1), cols) if across else F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.get(cells, r * cols))
        wanted = self.hold(cell_of(key), args)
        at, k = self.hold(self.line_of(line, wanted, near), args), to_num(n).cast("int")
        bad = (k < 1) | (k > (rows if across else cols))
        place = (k - 1) * cols + at if across else at * cols + k - 1
        return self.found(cells, place, merged(errors_of([key, n]), fails(at < 0, NA), fails(bad, REF)))

    def on_vlookup(self, args: list[Node]) -> Val:
        return self.looked_up(args, False)

    def on_hlookup(self, args: list[Node]) -> Val:
        return self.looked_up(args, True)

    def on_match(self, args: list[Node]) -> Val:
        key, kind = self.operand(args[0]), to_num(self.operand(args[2])) if len(args) > 2 else F.lit(1.0)
        cells, k = self.area(args[1])[0], self.hold(cell_of(key), args)
        exact = F.array_position(F.transform(cells, lambda s: like(s, k)), True)
        last = lambda test: F.coalesce(F.array_max(F.transform(cells, lambda s, i: F.when(test(s), i + 1))), F.lit(0))
        at = self.hold(F.when(kind == 0, exact).when(kind > 0, last(lambda s: ~beyond(s, k))).otherwise(last(lambda s: ~beyond(k, s))), args)
        return number(at, merged(key.err, fails(at == 0, NA)))

    def on_index(self, args: list[Node]) -> Val:
        cells, rows, cols = self.area(args[0])
        r = self.operand(args[1])
        c = self.operand(args[2]) if len(args) > 2 else None
        i = to_num(r).cast("int")
        if c is None:  # one number counts along a single row or column
            row, col = F.when(rows == 1, 1).otherwise(i), F.when(rows == 1, i).otherwise(1)
        else:
            row, col = i, to_num(c).cast("int")
        bad = (row < 1) | (row > rows) | (col < 1) | (col > cols)
        return self.found(cells, (row - 1) * cols + col - 1, merged(errors_of([x for x in (r, c) if x is not None]), fails(bad, REF)))


#: Arguments that a function needs at least, else it is #VALUE!.
LEAST_ARGUMENTS = {"VLOOKUP": 3, "HLOOKUP": 3, "INDEX": 2, "MATCH": 2, "SUMIF": 2, "COUNTIF": 2, "AVERAGEIF": 2, "SUMIFS": 3, "AVERAGEIFS": 3, "MAXIFS": 3, "MINIFS": 3, "COUNTIFS": 2}


def patterned(formulas: DataFrame, names: dict[str, str]) -> DataFrame:
    """Place, pattern and rectangles of each formula."""
    schema = "workbook string, sheet string, row int, col int, pattern string, refs array<struct<sheet:string,r1:int,c1:int,r2:int,c2:int>>"
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(formulas.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            out = []
            for *place, formula in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                pattern, refs = numbered(formula, place[1], names)
                out.append((*place, pattern, [dict(zip(("sheet", "r1", "c1", "r2", "c2"), r, strict=True)) for r in refs]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return formulas.select(*PLACE, "formula").mapInArrow(run, schema)


def same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def under(df: DataFrame, keys: list[str], prefix: str, *more: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *more)


def error_cell(code: Column) -> Column:
    return F.struct(F.lit(ERROR).alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("txt"), F.lit(None).cast("boolean").alias("bool"), code.alias("err"))


def compiled(pattern: str) -> tuple[GridCompiler, Column]:
    """A pattern's projections, and its value as a cell: a blank is 0."""
    compiler = GridCompiler({})
    try:
        tree = parse(pattern)
        v = compiler.operand(tree)
    except FormulaError:
        return GridCompiler({}), error_cell(F.lit(NAME))
    c = compiler.hold(cell_of(v), [tree])
    failed = c["err"] if v.err is None else F.coalesce(v.err, c["err"])
    value = F.when(c["kind"] == "blank", F.struct(F.lit("number").alias("kind"), F.lit(0.0).alias("num"), c["txt"].alias("txt"), c["bool"].alias("bool"), c["err"].alias("err"))).otherwise(c)
    return compiler, F.when(failed.isNotNull(), error_cell(failed)).otherwise(value)


def on_cycles(at: DataFrame, inside: DataFrame, pending: DataFrame, area_keys: list[str]) -> DataFrame:
    """Of open formulas, those that are left when ones that no other waits for are taken away again and again."""
    cells = under(inside.join(under(pending, PLACE, "__"), same(PLACE, "__"), "left_semi"), area_keys, "__", F.col("row").alias("__row"), F.col("col").alias("__col"))
    of_area = reduce(lambda a, b: a & b, [F.col("workbook").eqNullSafe(F.col("__workbook")), F.col("rs").eqNullSafe(F.col("__sheet")), *[F.col(k) == F.col(f"__{k}") for k in ("r1", "c1", "r2", "c2")]])
    waits = at.join(cells, of_area).select(*PLACE, *[F.col(f"__{k}").alias(f"on_{k}") for k in PLACE]).distinct()
    waits = written(waits, "grid-edges")
    core, left = written(pending, "grid-core"), pending.count()
    while True:
        inner = waits.join(under(core, PLACE, "__"), same(PLACE, "__"), "left_semi").select(*[F.col(f"on_{k}").alias(f"__{k}") for k in PLACE]).distinct()
        core = written(core.join(inner, same(PLACE, "__"), "left_semi"), "grid-core")
        now = core.count()
        if now == left:
            return core
        left = now


def recalculated(cells: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """All cells, those with a formula with its value. names: defined names and the references or formulas that they stand for.

    A reference to a sheet that its workbook doesn't have is read on the formula's own sheet. A formula that can't be read
    is #NAME?; one without a value is 0; one whose value is a range has its first cell's.
    """
    spark = cells.sparkSession
    cells = written(cells, "grid-cells")
    sheets = written(cells.select(*SHEET).distinct(), "grid-sheets")
    formulas = patterned(cells.filter("formula is not null and formula <> ''"), names or {})
    own = formulas.select(*PLACE, "pattern", F.posexplode_outer("refs").alias("i", "r"))
    at = own.select(*PLACE, "pattern", "i", F.col("r.sheet").alias("rs"), *[F.col(f"r.{k}") for k in ("r1", "c1", "r2", "c2")])
    known = under(sheets, SHEET, "__")
    at = at.join(known, F.col("workbook").eqNullSafe(F.col("__workbook")) & (F.lower("rs") == F.lower("__sheet")), "left")
    at = at.withColumn("rs", F.coalesce("__sheet", "sheet")).drop("__workbook", "__sheet")
    at = written(at, "grid-references")
    # The cells of each rectangle, once for all formulas that name it.
    areas = at.filter("i is not null").select("workbook", F.col("rs").alias("sheet"), "r1", "c1", "r2", "c2").distinct()
    inside = areas.select("*", F.explode(F.sequence("r1", "r2")).alias("row")).select("*", F.explode(F.sequence("c1", "c2")).alias("col"))
    inside = written(inside, "grid-areas")
    value = F.struct(*[F.col(k) for k in FIELDS])
    values = written(cells.filter("formula is null or formula = ''").select(*PLACE, value.alias("v")), "grid-values")
    pending = written(at.select(*PLACE, "pattern").distinct(), "grid-pending")
    patterns = [r[0] for r in pending.select("pattern").distinct().limit(MOST_PATTERNS + 1).collect()]
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"the formulas have more than {MOST_PATTERNS} patterns")
    plans = {p: compiled(p) for p in patterns}
    area_keys = ["workbook", "sheet", "r1", "c1", "r2", "c2"]
    done = []
    while not pending.isEmpty():
        waits = written(inside.join(under(pending, PLACE, "__"), same(PLACE, "__")).select(*area_keys, "row", "col"), "grid-waits")
        blocked_areas = under(waits.select(*area_keys).distinct(), area_keys, "__")
        of_area = reduce(lambda a, b: a & b, [F.col("workbook").eqNullSafe(F.col("__workbook")), F.col("rs").eqNullSafe(F.col("__sheet")), *[F.col(k) == F.col(f"__{k}") for k in ("r1", "c1", "r2", "c2")]])
        blocked = under(at.join(blocked_areas, of_area, "left_semi").select(*PLACE).distinct(), PLACE, "__")
        ready = written(pending.join(blocked, same(PLACE, "__"), "left_anti"), "grid-ready")
        if ready.isEmpty():
            # Only cycles and what waits for them are left; those on a cycle, or between two, are #REF!.
            ready = on_cycles(at, inside, pending, area_keys)
            bad = error_cell(F.lit(REF))
            new = ready.select(*PLACE, bad.alias("v"))
        else:
            refs = at.join(under(ready, PLACE, "__"), same(PLACE, "__"), "left_semi")
            needed = under(refs.filter("i is not null").select("workbook", F.col("rs").alias("sheet"), "r1", "c1", "r2", "c2").distinct(), area_keys, "__")
            filled = inside.join(needed, same(area_keys, "__"), "left_semi").join(under(values, PLACE, "__", "v"), same(PLACE, "__"), "left")
            listed = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce("v", blank_cell()).alias("v")))), lambda x: x["v"])
            gathered = filled.groupBy(*area_keys).agg(listed.alias("cells"))
            gathered = gathered.select(*[F.col(k).alias(f"__{k}") for k in area_keys], F.struct((F.col("r2") - F.col("r1") + 1).alias("rows"), (F.col("c2") - F.col("c1") + 1).alias("cols"), "cells").alias("area"))
            each = refs.join(gathered, of_area, "left").groupBy(*PLACE, "pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "area"))), lambda x: x["area"]).alias("areas"))
            each = written(each, "grid-arguments")
            parts = []
            for p in [r[0] for r in ready.select("pattern").distinct().collect()]:
                compiler, v = plans[p]
                parts.append(compiler.applied(each.filter(F.col("pattern") == p)).select(*PLACE, v.alias("v")))
            new = reduce(lambda a, b: a.unionByName(b), parts)
        new = written(new.select(*PLACE, F.col("v").cast(CELL).alias("v")), "grid-new")
        done.append(new)
        values = values.unionByName(new)
        pending = written(pending.join(under(new, PLACE, "__"), same(PLACE, "__"), "left_anti"), "grid-pending")
    if not done:
        return cells
    results = under(reduce(lambda a, b: a.unionByName(b), done), PLACE, "__", "v")
    joined = cells.join(results, same(PLACE, "__"), "left")
    return joined.select(*[(F.when(F.col("v").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c)) for c in cells.columns])


def evaluate_in(cells: DataFrame, formula: str, sheet: str, workbook: str = "", names: dict[str, str] | None = None) -> DataFrame:
    """One row (kind, num, txt, bool, err): a formula's value as it would be on a sheet, though it stands in no cell."""
    spare = cells.sparkSession.createDataFrame([(workbook, sheet, 0, 0, "blank", formula.removeprefix("="))], "workbook string, sheet string, row int, col int, kind string, formula string")
    full = cells.unionByName(spare, allowMissingColumns=True)
    return recalculated(full, names).filter("row = 0 and col = 0").select(*FIELDS)
