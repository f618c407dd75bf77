"""Cell grids in long form: workbook, sheet, row, col and the cell's value; and the rules and data that belong to sheets.

A sheet is known by its workbook and its name: operators on one take both, and leave all others as they are. Without a
name they work on every sheet there is, each by itself.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import CELL, ERRORS, column_value, first_cell, general, of_cell
from ..shared import left_join_hot, written
from .orderstats import join_groups

#: What tells a cell's sheet.
SHEET = ["workbook", "sheet"]
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
CELLS = "workbook string, sheet string, row int, col int, kind string, num double, txt string, bool boolean, err string, formula string, style int"


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_position(ref: str) -> tuple[int, int]:
    """(row, col) of an A1 reference, both from 1."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)", ref.strip())
    col = reduce(lambda n, c: n * 26 + ord(c) - 64, m[1].upper(), 0) if m else 0
    if not m or not 1 <= int(m[2]) <= MOST_ROWS or not 1 <= col <= MOST_COLUMNS:
        raise ValueError(f"{ref} is no cell")
    return int(m[2]), col


def cell_range(ref: str) -> tuple[int, int, int, int]:
    """First row, first column, last row, last column of a rectangle."""
    a, _, b = ref.partition(":")
    (r1, c1), (r2, c2) = cell_position(a), cell_position(b or a)
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def inside(ref: str) -> Column:
    r1, c1, r2, c2 = cell_range(ref)
    return F.col("row").between(r1, r2) & F.col("col").between(c1, c2)


def on(sheet: str | None, workbook: str | None) -> Column:
    """The cells of a sheet; names are compared without regard to case."""
    own = F.lit(True) if sheet is None else F.lower("sheet") == sheet.lower()
    return own if workbook is None else own & F.col("workbook").eqNullSafe(F.lit(workbook))


def cell(cells: DataFrame, ref: str, sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """The cell at a place, no row if it is empty."""
    row, col = cell_position(ref)
    return cells.filter(on(sheet, workbook) & (F.col("row") == row) & (F.col("col") == col))


def read_range(cells: DataFrame, ref: str, blanks: bool = False, sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """A rectangle's cells on a sheet, or on each; with blanks, also those that hold nothing."""
    found = cells.filter(inside(ref) & on(sheet, workbook))
    if not blanks:
        return found
    r1, c1, r2, c2 = cell_range(ref)
    sheets = cells.filter(on(sheet, workbook)).select(*SHEET).distinct()
    grid = sheets.select(*SHEET, F.explode(F.sequence(F.lit(r1), F.lit(r2))).alias("row")).select("*", F.explode(F.sequence(F.lit(c1), F.lit(c2))).alias("col"))
    at = [F.col(k).alias(f"__{k}") for k in (*SHEET, "row", "col")]
    right = found.select(*at, *[c for c in found.columns if c not in (*SHEET, "row", "col")])
    same = F.lit(True)
    for k in (*SHEET, "row", "col"):
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return grid.join(right, same, "left").select(*cells.columns)


def used_range(cells: DataFrame) -> DataFrame:
    """Bounds of the cells that hold something, by workbook and sheet."""
    return cells.filter("kind <> 'blank' or formula is not null").groupBy(*SHEET).agg(F.min("row").alias("first_row"), F.min("col").alias("first_col"), F.max("row").alias("last_row"), F.max("col").alias("last_col"))


def cleared(cells: DataFrame, ref: str, sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """Without a rectangle's cells."""
    return cells.filter(~(inside(ref) & on(sheet, workbook)))


def without_formulas(cells: DataFrame, ref: str, sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """A rectangle's formulas go, their values stay."""
    return cells.withColumn("formula", F.when(~(inside(ref) & on(sheet, workbook)), F.col("formula")))


def set_cells(cells: DataFrame, new: DataFrame) -> DataFrame:
    """New cells take the place of those at the same positions of the same sheets."""
    at = new.select(*[F.col(k).alias(f"__{k}") for k in (*SHEET, "row", "col")])
    same = F.lit(True)
    for k in (*SHEET, "row", "col"):
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cells.join(at, same, "left_anti").unionByName(new.select(*cells.columns))


def value_cell(spark: SparkSession, ref: str, value=None, formula: str | None = None, sheet: str = "Sheet1", workbook: str = "") -> DataFrame:
    """A cell with a typed value (or none) or a formula, for set_cells()."""
    row, col = cell_position(ref)
    own = {bool: ("boolean", None, None, value, None), str: ("text", None, value, None, None)}.get(type(value))
    if isinstance(value, str) and value in ERRORS:
        own = ("error", None, None, None, value)
    if own is None:
        own = ("blank", None, None, None, None) if value is None else ("number", float(value), None, None, None)
    return spark.createDataFrame([(workbook, sheet, row, col, *own, formula.removeprefix("=") if formula else None, None)], CELLS)


def shift(cells: DataFrame, axis: str, at: int, count: int, sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """Inserts (count > 0) or deletes (count < 0) rows or columns of a sheet, or of each: deleted cells go, later ones move.

    The formulas of those sheets are rewritten: relative references move with what they name, and those to a deleted cell
    are #REF!. Cells that leave the sheet at its end go.
    """
    from pyspark.sql.types import StringType

    c, own = F.col(axis), on(sheet, workbook)
    left = cells.filter(~(own & c.between(at, at - count - 1))) if count < 0 else cells
    edge = at - count if count < 0 else at
    moved = left.withColumn(axis, F.when(own & (c >= edge), c + count).otherwise(c)).filter(F.col(axis) <= (MOST_ROWS if axis == "row" else MOST_COLUMNS))
    if "formula" not in cells.columns:
        return moved

    @F.arrow_udf(StringType())
    def rewritten(formulas: pa.Array) -> pa.Array:
        return pa.array([None if f is None else formula_after_shift(f, axis, at, count) for f in formulas.to_pylist()], pa.string())

    return moved.withColumn("formula", F.when(own & F.col("formula").isNotNull(), rewritten(F.when(own, F.col("formula")))).otherwise(F.col("formula")))


# Merged cells: (workbook, sheet, first_row, first_col, last_row, last_col).
AREA = ["first_row", "first_col", "last_row", "last_col"]


def merged_cells(merges: DataFrame, ref: str, sheet: str, workbook: str = "") -> DataFrame:
    """The merges of sheets with one more; one that overlaps another is refused."""
    area = cell_range(ref)
    r1, c1, r2, c2 = area
    clash = merges.filter(on(sheet, workbook) & (F.col("first_row") <= r2) & (F.col("last_row") >= r1) & (F.col("first_col") <= c2) & (F.col("last_col") >= c1))
    if not clash.isEmpty():
        raise ValueError(f"{ref} overlaps merged cells")
    return merges.unionByName(merges.sparkSession.createDataFrame([(workbook, sheet, *area)], MERGES))


MERGES = "workbook string, sheet string, first_row int, first_col int, last_row int, last_col int"


def unmerged_cells(merges: DataFrame, ref: str, sheet: str, workbook: str = "") -> DataFrame:
    """Without the merge that covers a range."""
    r1, c1, r2, c2 = cell_range(ref)
    return merges.filter(~(on(sheet, workbook) & (F.col("first_row") <= r1) & (F.col("last_row") >= r2) & (F.col("first_col") <= c1) & (F.col("last_col") >= c2)))


def visible(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Without the cells that merges hide: all of a merge but its first. An equi-join by sheet and row."""
    hidden = merges.select(*SHEET, F.explode(F.sequence("first_row", "last_row")).alias("__row"), "first_row", "first_col", "last_col").select(*[F.col(k).alias(f"__{k}") for k in SHEET], "__row", "first_row", "first_col", "last_col")
    same = (F.col("row") == F.col("__row")) & F.col("col").between(F.col("first_col"), F.col("last_col")) & ~((F.col("row") == F.col("first_row")) & (F.col("col") == F.col("first_col")))
    for k in SHEET:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cells.join(hidden, same, "left_anti")


# Sheets: (workbook, sheet, place), places from 0.
def sheet_added(sheets: DataFrame, name: str, place: int | None = None, workbook: str = "") -> DataFrame:
    """The sheets of workbooks with a new one, last or at a place; a name that is taken is refused."""
    if not name or len(name) > 31 or re.search(r"[\[\]:*?/\\]", name):
        raise ValueError(f"{name!r} is no name of a sheet")
    own = F.col("workbook").eqNullSafe(F.lit(workbook))
    if not sheets.filter(own & (F.lower("sheet") == name.lower())).isEmpty():
        raise ValueError(f"there is a sheet {name} already")
    n = sheets.filter(own).count() if place is None else place
    moved = sheets.withColumn("place", F.when(own & (F.col("place") >= n), F.col("place") + 1).otherwise(F.col("place")))
    return moved.unionByName(sheets.sparkSession.createDataFrame([(workbook, name, n)], sheets.schema))


def sheet_removed(sheets: DataFrame, name: str, workbook: str = "") -> DataFrame:
    """Without a sheet; a workbook keeps at least one."""
    own = F.col("workbook").eqNullSafe(F.lit(workbook))
    gone = sheets.filter(own & (F.lower("sheet") == name.lower())).first()
    if gone is None:
        raise ValueError(f"there is no sheet {name}")
    if sheets.filter(own).count() < 2:
        raise ValueError("a workbook needs a sheet")
    left = sheets.filter(~(own & (F.lower("sheet") == name.lower())))
    return left.withColumn("place", F.when(own & (F.col("place") > gone["place"]), F.col("place") - 1).otherwise(F.col("place")))


def sheet_moved(sheets: DataFrame, name: str, place: int, workbook: str = "") -> DataFrame:
    """A sheet at a new place; those between move by one."""
    own = F.col("workbook").eqNullSafe(F.lit(workbook))
    was = sheets.filter(own & (F.lower("sheet") == name.lower())).first()
    if was is None or not 0 <= place < sheets.filter(own).count():
        raise ValueError(f"{name} can't move to {place}")
    at, p = was["place"], F.col("place")
    step = F.when(p == at, place).when((p > at) & (p <= place), p - 1).when((p < at) & (p >= place), p + 1).otherwise(p)
    return sheets.withColumn("place", F.when(own, step).otherwise(p).cast(sheets.schema["place"].dataType))


# Rectangles, as references on the driver and as columns first_row, first_col, last_row, last_col.
def holds(outer: str, inner: str) -> bool:
    """Whether a range holds a cell or another range."""
    a, b = cell_range(outer), cell_range(inner)
    return a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]


def overlap(a: str, b: str) -> bool:
    x, y = cell_range(a), cell_range(b)
    return x[0] <= y[2] and x[2] >= y[0] and x[1] <= y[3] and x[3] >= y[1]


def bounding(a: str, b: str) -> str:
    """The smallest range that holds both."""
    x, y = cell_range(a), cell_range(b)
    first, last = (min(x[0], y[0]), min(x[1], y[1])), (max(x[2], y[2]), max(x[3], y[3]))
    return ":".join(f"{column_letters(c)}{r}" for r, c in (first, last))


def area_holds(a: str, b: str) -> Column:
    """The same over columns whose names begin with a and with b."""
    return (F.col(f"{a}first_row") <= F.col(f"{b}first_row")) & (F.col(f"{a}first_col") <= F.col(f"{b}first_col")) & (F.col(f"{a}last_row") >= F.col(f"{b}last_row")) & (F.col(f"{a}last_col") >= F.col(f"{b}last_col"))


def areas_overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}first_row") <= F.col(f"{b}last_row")) & (F.col(f"{a}last_row") >= F.col(f"{b}first_row")) & (F.col(f"{a}first_col") <= F.col(f"{b}last_col")) & (F.col(f"{a}last_col") >= F.col(f"{b}first_col"))


def bounding_area(a: str, b: str) -> list[Column]:
    pick = {"first_row": F.least, "first_col": F.least, "last_row": F.greatest, "last_col": F.greatest}
    return [fn(F.col(f"{a}{k}"), F.col(f"{b}{k}")).alias(k) for k, fn in pick.items()]


def auto_filtered(cells: DataFrame, ref: str, criteria: dict[int, object], sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """A range's rows that meet a criterion for each of some columns, counted from 1 inside it; its first row and all cells outside it stay."""
    from .criteria import criterion

    r1, c1, r2, _ = cell_range(ref)
    body = on(sheet, workbook) & F.col("row").between(r1 + 1, r2)
    cell_value = F.struct(*[F.col(k) for k in ("kind", "num", "txt", "bool", "err")])
    wanted = [F.max(F.when(F.col("col") == c1 + k - 1, cell_value)).alias(f"v{k}") for k in criteria]
    rows = cells.filter(body).groupBy(*SHEET, "row").agg(*wanted)
    met = F.lit(True)
    for k, c in criteria.items():
        v = F.coalesce(F.col(f"v{k}"), first_cell(F.array().cast(f"array<{CELL}>")))
        met = met & F.coalesce(criterion(of_cell(v), c), F.lit(False))
    gone = rows.filter(~met).select(*[F.col(x).alias(f"__{x}") for x in SHEET], F.col("row").alias("__row"))
    same = (F.col("row") == F.col("__row")) & body
    for x in SHEET:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    return cells.join(gone, same, "left_anti")


def flagged(df: DataFrame, column: str, rule: str, value=None, name: str = "flag") -> DataFrame:
    """Conditional formats as flags, or as shares for scales: a rule's kind over a column of a table.

    cellIs (a criterion), expression (SQL), beginsWith, endsWith, containsText, top10 (how many), uniqueValues,
    duplicateValues, and colorScale, dataBar and iconSet (from 0 to 1 between the least and the greatest value).
    """
    from .criteria import criterion
    from .orderstats import rank_rows

    c = F.col(f"`{column}`")
    text = F.lower(c.cast("string"))
    plain = {
        "cellIs": lambda: criterion(column_value(column, dict(df.dtypes)[column]), value), "expression": lambda: F.expr(value), "beginsWith": lambda: F.startswith(text, F.lit(str(value).lower())),
        "endsWith": lambda: F.endswith(text, F.lit(str(value).lower())), "containsText": lambda: F.contains(text, F.lit(str(value).lower())),
    }
    if rule in plain:
        return df.withColumn(name, F.coalesce(plain[rule](), F.lit(False)))
    if rule == "top10":
        return rank_rows(df, column, "__rank").withColumn(name, F.coalesce(F.col("__rank") <= (value or 10), F.lit(False))).drop("__rank")
    if rule in ("uniqueValues", "duplicateValues"):
        once = written(df.filter(c.isNotNull()).groupBy(c.alias("__value")).agg(F.count("*").alias("__n")), "value-counts")
        found = left_join_hot(df, c, once, "__value")
        return found.withColumn(name, F.coalesce(F.col("__n") == 1 if rule == "uniqueValues" else F.col("__n") > 1, F.lit(False))).drop("__n")
    if rule in ("colorScale", "dataBar", "iconSet"):
        low, high = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
        span = (high - low) if low is not None else 0
        return df.withColumn(name, F.when(c.isNotNull(), (c.cast("double") - F.lit(low)) / F.lit(span) if span else F.lit(1.0)))
    raise ValueError(f"{rule} is no rule's kind")


def shown(cells: DataFrame, codes: dict[int, str] | None = None, name: str = "shown") -> DataFrame:
    """Adds each cell's display text: a text as it is, TRUE and FALSE, an error's code, a number by the format of its style."""
    from ..functions.numberformat import format_value

    number = general(F.col("num"))
    for style, code in (codes or {}).items():
        number = F.when(F.col("style") == style, format_value(F.col("num"), code)).otherwise(number)
    text = F.when(F.col("kind") == "text", F.col("txt")).when(F.col("kind") == "boolean", F.when(F.col("bool"), "TRUE").otherwise("FALSE")).when(F.col("kind") == "error", F.col("err")).when(F.col("kind") == "number", number)
    return cells.withColumn(name, F.coalesce(text, F.lit("")))


def chart_series(cells: DataFrame, ref: str, sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """(workbook, sheet, series, seq, category, value) of a range: its first column holds categories, if there are several, and its
    first row names if the first series' cell there is a text. Without a name a series has its column's letters; what is no number is 0."""
    r1, c1, r2, c2 = cell_range(ref)
    wide = c2 > c1
    first = c1 + wide
    own = shown(read_range(cells, ref, blanks=True, sheet=sheet, workbook=workbook))
    head = own.filter((F.col("row") == r1) & (F.col("col") == first)).select(*[F.col(k).alias(f"__{k}") for k in SHEET], (F.col("num").isNull() & (F.col("shown") != "")).alias("__named"))
    same = F.col("workbook").eqNullSafe(F.col("__workbook")) & F.col("sheet").eqNullSafe(F.col("__sheet"))
    named = own.join(head, same).drop("__workbook", "__sheet")  # a row for each sheet
    name = F.max(F.when((F.col("row") == r1) & F.col("__named") & (F.col("shown") != ""), F.col("shown")))
    letters = F.element_at(F.array(*[F.lit(column_letters(c)) for c in range(c1, c2 + 1)]), F.col("col") - c1 + 1)
    names = named.filter(F.col("col") >= first).groupBy(*SHEET, "col").agg(name.alias("n")).select(*[F.col(k).alias(f"__{k}") for k in SHEET], F.col("col").alias("__col"), F.coalesce("n", letters).alias("series"))
    body = named.filter((F.col("row") > r1) | ~F.col("__named"))
    points = body.filter(F.col("col") >= first).join(names, same & (F.col("col") == F.col("__col"))).drop("__workbook", "__sheet", "__col")
    if not wide:
        return points.select(*SHEET, "series", F.col("row").alias("seq"), F.lit("").alias("category"), F.coalesce("num", F.lit(0.0)).alias("value"))
    labels = body.filter(F.col("col") == c1).select(*[F.col(k).alias(f"__{k}") for k in SHEET], F.col("row").alias("__row"), F.col("shown").alias("category"))
    return points.join(labels, same & (F.col("row") == F.col("__row"))).select(*SHEET, "series", F.col("row").alias("seq"), "category", F.coalesce("num", F.lit(0.0)).alias("value"))


REFERENCE = re.compile(r"(\"(?:[^\"]|\"\")*\")|(?<![\w.])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![\w(])")


def filled_down(formula: str, rows: int, cols: int = 0) -> str:
    """A formula moved by rows and columns: relative parts move, those with $ stay; off the sheet is #REF!."""

    def move(m: re.Match) -> str:
        if m[1]:
            return m[1]
        row, col = cell_position(m[3] + m[5])
        row, col = row + rows * (not m[4]), col + cols * (not m[2])
        return f"{m[2]}{column_letters(col)}{m[4]}{row}" if 1 <= row <= MOST_ROWS and 1 <= col <= MOST_COLUMNS else "#REF!"

    return REFERENCE.sub(move, formula)


def formula_after_shift(formula: str, axis: str, at: int, count: int) -> str:
    """A formula after rows or columns were inserted or deleted: relative references move with their cells, those to deleted ones are #REF!, those with $ stay."""

    def move(m: re.Match) -> str:
        if m[1]:
            return m[1]
        row, col = cell_position(m[3] + m[5])
        n = row if axis == "row" else col
        if m[4] if axis == "row" else m[2]:
            return m[0]
        if count < 0 and at <= n < at - count:
            return "#REF!"
        n += count if n >= at else 0
        row, col = (n, col) if axis == "row" else (row, n)
        return f"{m[2]}{column_letters(col)}{m[4]}{row}" if 1 <= row <= MOST_ROWS and 1 <= col <= MOST_COLUMNS else "#REF!"

    return REFERENCE.sub(move, formula)


def unique_names(names: list[str]) -> list[str]:
    """Column names of a table: an empty one is Column and its place, a repeated one gets the next free number."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        n = base = n or f"Column{i}"
        k = 2
        while n.lower() in {x.lower() for x in out}:
            n, k = f"{base}{k}", k + 1
        out.append(n)
    return out


def as_table(cells: DataFrame, ref: str, names: list[str] | None = None, sheet: str | None = None, workbook: str | None = None) -> DataFrame:
    """A range's wide form on one sheet: the first row as names (read from it unless given), other rows as rows with their number.

    If the cells are of several sheets, the one must be named.
    """
    r1, c1, r2, c2 = cell_range(ref)
    text = F.coalesce(F.col("txt"), F.col("num").cast("string"), F.col("bool").cast("string"), F.col("err"))
    found = cells.filter(inside(ref) & on(sheet, workbook))
    if found.select(*SHEET).distinct().limit(2).count() > 1:
        raise ValueError("the range lies on several sheets")
    own = found.select("row", "col", text.alias("v"))
    if names is None:
        head = {r["col"]: r["v"] for r in own.filter(F.col("row") == r1).collect()}  # one row of a sheet
        names = unique_names([head.get(c) or "" for c in range(c1, c2 + 1)])
    body = own.filter(F.col("row") > r1).groupBy("row")
    return body.agg(*[F.max(F.when(F.col("col") == c, F.col("v"))).alias(n) for c, n in zip(range(c1, c2 + 1), names, strict=True)])


def cells_of(df: DataFrame, sheet: str, pos: str, header: bool = True, workbook: str = "") -> DataFrame:
    """A wide table as cells; pos orders its rows from 1, below the header. Dates are serial numbers."""
    kinds = [(c, t) for c, t in df.dtypes if c != pos]
    structs = []
    for k, (c, t) in enumerate(kinds, 1):
        col, null = F.col(f"`{c}`"), lambda kind: F.lit(None).cast(kind)
        kind = "text" if t == "string" else "boolean" if t == "boolean" else "number"
        structs.append(F.struct(F.lit(k).alias("col"), F.when(col.isNull(), "blank").otherwise(kind).alias("kind"), (column_value(c, t).col if kind == "number" else null("double")).alias("num"), (col if kind == "text" else null("string")).alias("txt"), (col if kind == "boolean" else null("boolean")).alias("bool")))
    rest = [F.lit(None).cast("string").alias("err"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("int").alias("style")]
    body = df.select((F.col(pos) + int(header)).cast("int").alias("row"), F.explode(F.array(*structs)).alias("c")).select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), "row", "c.col", "c.kind", "c.num", "c.txt", "c.bool", *rest)
    if not header:
        return body
    head = df.sparkSession.createDataFrame([(workbook, sheet, 1, k, "text", None, c, None, None, None, None) for k, (c, _) in enumerate(kinds, 1)], CELLS)
    return head.unionByName(body)


def plain_text(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row, line): each row's cells separated by tabs, blanks between them kept, from the sheet's first used column to its last."""
    text = F.coalesce(F.col("txt"), F.col("num").cast("string"), F.col("bool").cast("string"), F.col("err"), F.lit(""))
    low = written(used_range(cells).select(*SHEET, F.col("first_col").alias("__first"), F.col("last_col").alias("__last")), "used-ranges")
    by_col = F.map_from_entries(F.collect_list(F.struct("col", text.alias("t"))))  # at most a sheet's columns
    rows = join_groups(cells.groupBy(*SHEET, "row").agg(by_col.alias("m")), low, SHEET)
    return rows.select(*SHEET, "row", F.array_join(F.transform(F.sequence("__first", "__last"), lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(""))), "\t").alias("line"))


def generated(spark: SparkSession, kind: str, count: int, start: float = 1, step: float = 1, seed: int = 0) -> DataFrame:
    """(pos, value): sequence, decimal sequence, random number or integer, or dates as serials."""
    pos = (F.col("id") + 1).alias("pos")
    value = {"sequence": F.col("id") * step + start, "decimal": F.col("id") * step + start, "random": F.rand(seed) * step + start, "integer": F.floor(F.rand(seed) * (step + 1)) + start, "date": F.col("id") * step + start}[kind]
    return spark.range(count).select(pos, value.cast("double").alias("value"))


# Data validation: rules compile to predicates; the table of violations is an extension.
def validation(cell: str, kind: str, operator: str, first, second=None) -> Column:
    """Whether a cell meets a rule: whole, decimal, list, date, time, textLength or custom; a blank does."""
    c = F.col(f"`{cell}`")
    if kind == "custom":
        return F.coalesce(F.expr(first), F.lit(False))
    if kind == "list":
        return c.isNull() | c.cast("string").isin(*first)
    v = F.length(c) if kind == "textLength" else c.cast("double") if kind in ("whole", "decimal") else c
    a, b = (F.lit(x) if x is not None else None for x in (first, second))
    test = {"between": lambda: v.between(a, b), "notBetween": lambda: ~v.between(a, b), "equal": lambda: v == a, "notEqual": lambda: v != a, "greaterThan": lambda: v > a, "lessThan": lambda: v < a, "greaterThanOrEqual": lambda: v >= a, "lessThanOrEqual": lambda: v <= a}[operator]()
    return c.isNull() | (test & (F.floor(v) == v) if kind == "whole" else test)


def invalid_cells(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) of each rule that a row doesn't meet, in one scan."""
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    return df.select(id_col, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))
