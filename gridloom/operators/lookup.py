"""Lookups as joins: exact by key, ordered by value, and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import column_value, general
from ..shared import left_join_hot, literal_array, running, searched, written
from .orderstats import staircase

#: A lookup table is broadcast, or searched as a literal, only if it was counted and has at most this many rows.
SMALL_ROWS, SEARCHED_ROWS = 100_000, 10_000


def matching(df: DataFrame, name: str) -> Column:
    """A key as lookups compare it: numbers by value, texts without regard to case, a number like its text."""
    kind = dict(df.dtypes)[name]
    v = column_value(name, kind)
    return general(v.col) if v.kind == "number" else F.lower(v.col.cast("string"))


def keyed(df: DataFrame, name: str, other: DataFrame, other_name: str) -> tuple[Column, Column]:
    """The two sides' keys; of the same plain type they are compared as they are, numbers of two types as doubles."""
    a, b = dict(df.dtypes)[name], dict(other.dtypes)[other_name]
    if a == b and a != "string":
        return F.col(f"`{name}`"), F.col(f"`{other_name}`")
    left, right = column_value(name, a), column_value(other_name, b)
    if left.kind == right.kind == "number":
        return left.col, right.col
    return matching(df, name), matching(other, other_name)


def first_rows(table: DataFrame, key: Column, pos: str, values: list[str]) -> DataFrame:
    """__key and the values of the first row of each key, by position; partial aggregation, no sort."""
    one = F.min_by(F.struct(*[F.col(f"`{v}`") for v in values]), F.col(pos))
    return table.groupBy(key.alias("__key")).agg(one.alias("__row")).filter("__key is not null").select("__key", *[F.col(f"__row.`{v}`").alias(v) for v in values])


def vlookup(df: DataFrame, key: str, table: DataFrame, table_key: str, pos: str, values: dict[str, str]) -> DataFrame:
    """Exact lookup: the first row by position whose key is equal; a miss is null. values: new name -> table's column."""
    left, right = keyed(df, key, table, table_key)
    found = first_rows(table, right, pos, list(dict.fromkeys(values.values())))
    found = found.select("__key", *[F.col(f"`{c}`").alias(n) for n, c in values.items()])
    return left_join_hot(df, left, found, "__key", SMALL_ROWS)


def match_position(df: DataFrame, key: str, table: DataFrame, table_key: str, pos: str, name: str = "position") -> DataFrame:
    """MATCH of type 0: the position of the first equal key."""
    return vlookup(df, key, table, table_key, pos, {name: pos})


def hlookup(df: DataFrame, key: str, wide: DataFrame, headers: list[str], row: str, row_index: Column, name: str) -> DataFrame:
    """The value under the first header equal to the key, in the row picked by a predicate: unpivot, then an exact lookup."""
    one = wide.filter(row_index).select(row, *headers)
    tall = one.unpivot([row], headers, "header", "value").withColumn("__pos", F.array_position(F.array(*map(F.lit, headers)), F.col("header")))
    return vlookup(df, key, tall, "header", "__pos", {name: "value"})


def ordered_key(df: DataFrame, name: str, as_text: bool) -> Column:
    """A key as ordered lookups compare it: as a number, or as a text without regard to case."""
    return F.upper(matching(df, name)) if as_text else F.col(f"`{name}`").cast("double")


def texts(*kinds: str) -> bool:
    return any(k == "string" for k in kinds)


def match_ordered(df: DataFrame, key: str, table: DataFrame, table_key: str, pos: str, values: dict[str, str], ascending: bool = True) -> DataFrame:
    """MATCH of type 1 (or -1): the row with the greatest position among keys <= (or >=) the wanted one; a miss is null.

    If either side is a text, both are compared as texts without regard to case. Keys that are null match nothing, nor do
    null keys of the table. A table of up to SEARCHED_ROWS rows becomes a sorted literal that each row searches, so the
    rows stay where they are. Beyond it both sides are sorted together in ranges, each range gets the best row of those
    before it, and a window inside carries the best row so far: no pairs, and equal keys may lie in several ranges.
    """
    as_text = texts(dict(df.dtypes)[key], dict(table.dtypes)[table_key])
    right = table.select("*", ordered_key(table, table_key, as_text).alias("__k")).filter("__k is not null")
    few = right.select("__k", F.col(f"`{pos}`").alias("__pos")).limit(SEARCHED_ROWS + 1).collect()
    if len(few) <= SEARCHED_ROWS:
        bounds, best = staircase([(r["__k"], r["__pos"]) for r in few], ascending)
        return picked(df, ordered_key(df, key, as_text), bounds, best, as_text, ascending, right.drop("__k"), pos, values)
    return carried(df, ordered_key(df, key, as_text), right, pos, values, ascending)


def picked(df: DataFrame, wanted: Column, bounds: list, best: list, as_text: bool, ascending: bool, table: DataFrame, pos: str, values: dict[str, str]) -> DataFrame:
    """The table's rows at the positions that a search of the bounds gives."""
    holds = (lambda b, k: b <= k) if ascending else (lambda b, k: b >= k)
    at = searched(literal_array(bounds, "string" if as_text else "double"), len(bounds), F.col("__wanted"), holds)
    place = F.when(F.col("__wanted").isNotNull(), F.get(literal_array(best, "bigint"), at - 1))
    found = df.select("*", wanted.alias("__wanted")).withColumn("__place", place)
    return index_rows(found, "__place", table, pos, values).drop("__wanted", "__place")


def carried(df: DataFrame, wanted: Column, right: DataFrame, pos: str, values: dict[str, str], ascending: bool) -> DataFrame:
    """An as-of join of two large sides in one exchange."""
    best = F.struct(F.col(f"`{pos}`").alias("__pos"), *[F.col(f"`{c}`").alias(n) for n, c in values.items()])
    right = right.select("__k", best.alias("__row"))
    left = df.select(wanted.alias("__k"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__left"))
    none = lambda of, name: F.lit(None).cast(of.schema[name].dataType).alias(name)
    both = right.select("__k", "__row", none(left, "__left"), F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__tie"))
    both = both.unionByName(left.filter("__k is not null").select("__k", none(right, "__row"), "__left", F.lit(1).alias("__side"), F.xxhash64("__left").alias("__tie")))
    order = [F.col("__k").asc() if ascending else F.col("__k").desc(), F.col("__side"), F.col("__tie")]
    found = running(both, order, {"__best": F.col("__row")}, "as-of", "max").filter("__side = 1").select("__left", "__best")
    found = found.unionByName(left.filter("__k is null").select("__left", none(right, "__row").alias("__best")))
    return found.select(*[F.col(f"__left.`{c}`").alias(c) for c in df.columns], *[F.col(f"__best.`{n}`").alias(n) for n in values])


def vlookup_approx(df: DataFrame, key: str, table: DataFrame, table_key: str, pos: str, values: dict[str, str], in_order: bool = True) -> DataFrame:
    """Approximate lookup: the last row before the first key that is greater than the wanted one.

    For a table in order that is the last key that isn't greater. For any other, keys are first raised to their running
    maximum by position, which keeps the same rows before the first greater key.
    """
    if in_order:
        return match_ordered(df, key, table, table_key, pos, values)
    as_text = texts(dict(df.dtypes)[key], dict(table.dtypes)[table_key])
    right = table.filter(F.col(f"`{pos}`").isNotNull()).select("*", ordered_key(table, table_key, as_text).alias("__k"))
    few = right.filter("__k is not null").select("__k", F.col(f"`{pos}`").alias("__pos")).limit(SEARCHED_ROWS + 1).collect()
    if len(few) <= SEARCHED_ROWS:
        bounds, best, top = [], [], None
        size = (lambda k: k.encode()) if as_text else (lambda k: k)
        for k, p in sorted(((r["__k"], r["__pos"]) for r in few), key=lambda r: r[1]):
            top = k if top is None else max(top, k, key=size)
            bounds.append(top)
            best.append(p)
        return picked(df, ordered_key(df, key, as_text), bounds, best, as_text, True, right.drop("__k"), pos, values)
    raised = running(right, [F.col(f"`{pos}`")], {"__before": F.col("__k")}, "raised", "max")
    raised = raised.withColumn("__k", F.greatest("__before", "__k")).drop("__before").filter("__k is not null")
    return carried(df, ordered_key(df, key, as_text), written(raised, "raised-keys"), pos, values, True)


def index_rows(df: DataFrame, position: str, table: DataFrame, pos: str, values: dict[str, str]) -> DataFrame:
    """INDEX by row number: the table's row at a position; null if there is none."""
    right = table.select(F.col(f"`{pos}`").cast("long").alias("__pos"), *[F.col(f"`{c}`").alias(n) for n, c in values.items()])
    return left_join_hot(df, F.col(f"`{position}`").cast("long"), right.filter("__pos is not null"), "__pos", SMALL_ROWS)


def sum_product_by_position(a: DataFrame, b: DataFrame, pos: str, x: str, y: str) -> DataFrame:
    """One row (value): products of two ranges by position, as far as the shorter one goes."""
    left, right = a.select(pos, F.col(x).alias("__x")), b.select(pos, F.col(y).alias("__y"))
    return left.join(right, pos).agg(F.coalesce(F.sum(F.coalesce(F.col("__x"), F.lit(0.0)) * F.coalesce(F.col("__y"), F.lit(0.0))), F.lit(0.0)).alias("value"))
