"""Pivot grids, distinct items, totals rows and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import running, written

#: Columns that a sheet can have; a grid with more isn't one.
MOST_COLUMNS = 16_384
#: Rows of a block of a moving window.
BLOCK = 100_000

#: The name of the item of rows without a value.
BLANK_ITEM = "(blank)"

# The aggregate functions of data fields and of totals rows.
DATA = {
    "sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min, "product": F.product,
    "countNums": lambda c: F.count(c.try_cast("double")),
    "stdDev": F.stddev_samp, "stdDevP": F.stddev_pop, "var": F.var_samp, "varP": F.var_pop,
}
LABELS = {"sum": "Sum", "count": "Count", "average": "Average", "max": "Max", "min": "Min", "product": "Product", "countNums": "Count", "stdDev": "StdDev", "stdDevP": "StdDevP", "var": "Var", "varP": "VarP"}


def pivot_grid(df: DataFrame, rows: list[str], column: str | None, data: list[tuple[str, str]], page: Column | None = None, items: list | None = None) -> DataFrame:
    """The computed grid: page filter, row fields, one column for each item of the column field and data field.

    With the items given, the plan is one aggregation and no job runs to find them.
    """
    base = df.filter(page) if page is not None else df
    values = [DATA[fn](F.col(c)).alias(f"{fn}_{c}") for c, fn in data]
    grouped = base.groupBy(*rows)
    if column is None:
        return grouped.agg(*values)
    if items is None:
        found = base.select(column).distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) * len(data) > MOST_COLUMNS:
            raise ValueError(f"{column} has more items than a sheet has columns")
        items = sorted((r[0] for r in found if r[0] is not None), key=str) + [None] * any(r[0] is None for r in found)
    if None not in items:
        return grouped.pivot(column, items).agg(*values)
    # The blank item is a column of its own: its name must be one that no other item has.
    blank = BLANK_ITEM
    while blank in items:
        blank += "_"
    keyed = base.withColumn(column, F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(blank)))
    return keyed.groupBy(*rows).pivot(column, [blank if i is None else str(i) for i in items]).agg(*values)


def with_subtotals(df: DataFrame, rows: list[str], data: list[tuple[str, str]]) -> DataFrame:
    """Row groups with subtotals and the grand total, and the level of each row (0: a group)."""
    values = [DATA[fn](F.col(c)).alias(f"{fn}_{c}") for c, fn in data]
    return df.rollup(*rows).agg(F.grouping_id().cast("long").alias("level"), *values)


def distinct_items(df: DataFrame, field: str, pos: str) -> DataFrame:
    """A field's items in the order in which they are first seen: (item, first_pos)."""
    return df.groupBy(F.col(field).alias("item")).agg(F.min(pos).alias("first_pos"))


# The functions of a totals row.
TOTALS = {"none": lambda c: F.max(F.lit(None)), "sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min, "stdDev": F.stddev_samp, "var": F.var_samp, "countNums": F.count}


def totals_row(df: DataFrame, functions: dict[str, str], label: str | None = None, text: str = "Total") -> DataFrame:
    """One row: the totals of the columns named, the label's text, and null elsewhere. A function that begins with = is a formula of one's own."""
    own = {c: f for c, f in functions.items() if f.startswith("=")}
    aggs = []
    for c, t in df.dtypes:
        if c in functions and c not in own:
            aggs.append(TOTALS[functions[c]](F.col(f"`{c}`")).alias(c))
        else:
            aggs.append((F.max(F.lit(text)) if c == label else F.max(F.lit(None).cast(t))).alias(c))
    total = df.agg(*aggs)
    if not own:
        return total
    from ..plans.compiler import summary

    return total.drop(*own).join(F.broadcast(summary(df, own)), F.lit(True)).select(*df.columns)  # one row each


def pivot_checked(headers: list[str | None], source: tuple[int, int, int, int], target: tuple[int, int], same_sheet: bool) -> list[str]:
    """The field names of a pivot's source, refused as its creation refuses them: a header in each column, the target outside."""
    if source[2] < source[0]:
        raise ValueError("the source needs a header row")
    if same_sheet and source[0] <= target[0] <= source[2] and source[1] <= target[1] <= source[3]:
        raise ValueError("the target lies inside the source")
    if not headers or any(not h for h in headers):
        raise ValueError("each column of the source needs a header")
    return list(headers)


def with_totals(df: DataFrame, functions: dict[str, str], label: str | None = None) -> DataFrame:
    """The table and its totals row, marked by is_total."""
    return df.withColumn("is_total", F.lit(False)).unionByName(totals_row(df, functions, label).withColumn("is_total", F.lit(True)))


def running_total(df: DataFrame, order: str, value: str, name: str = "running_total", tie: list[str] | None = None) -> DataFrame:
    """A sum filled down a whole table in the order of a column (then of the ties' columns), in two levels of prefix sums."""
    own = F.coalesce(F.col(f"`{value}`"), F.lit(0.0))
    total = running(df.select(*[F.col(f"`{c}`") for c in df.columns if c != name]), [F.col(order), *[F.col(t) for t in tie or []]], {"__before": own}, "running-total")
    return total.withColumn(name, F.col("__before") + own).drop("__before")


def moving(df: DataFrame, by: list[str], order: str, value: str, back: int, fn: str = "average", name: str = "moving") -> DataFrame:
    """An aggregate of each row and the `back` rows before it in its group, as a range of fixed length filled down gives.

    Groups are dealt by their keys; without any, rows are cut into ranges that each carry the `back` rows before them.
    """
    if by:
        return df.withColumn(name, DATA[fn](F.col(f"`{value}`")).over(W.partitionBy(*by).orderBy(order).rowsBetween(-back, 0)))
    placed = written(running(df, [F.col(order)], {"__at": F.lit(1).cast("long")}, "moving").withColumn("__block", F.floor(F.col("__at") / BLOCK)), "moving-places")
    tail = placed.filter((F.col("__at") % BLOCK >= BLOCK - back) & F.lit(back < BLOCK)).withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False))
    both = placed.withColumn("__own", F.lit(True)).unionByName(tail)
    if back >= BLOCK:
        raise ValueError(f"a window has at most {BLOCK} rows")
    window = W.partitionBy("__block").orderBy("__at").rowsBetween(-back, 0)
    return both.withColumn(name, DATA[fn](F.col(f"`{value}`")).over(window)).filter("__own").drop("__own", "__at", "__block")
