"""Order statistics that hold at scale, over a whole column or by group: from counts of distinct values, never from one sorted task.

counted() reduces a column to (x, n); ranked() adds how many values lie at or below each one and how many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import SMALL_ROWS, left_join_hot, running, written

#: Largest k of a top-k that is taken by a bounded sort.
TOP = 10_000


def counted(df: DataFrame, x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, F.col(x).cast("double").alias("x")).filter("x is not null and not isnan(x)").groupBy(*by, "x").agg(F.count("*").alias("n"))


def join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Joins a written table with one row for each group, null keys with null keys; broadcast only if it was counted and is small."""
    side = groups.select(*[F.col(f"`{b}`").alias(f"__of_{i}") for i, b in enumerate(by)], *[F.col(f"`{c}`") for c in groups.columns if c not in by])
    side = F.broadcast(side) if groups.count() <= SMALL_ROWS else side
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & F.col(f"`{b}`").eqNullSafe(F.col(f"__of_{i}"))
    return df.join(side, cond).drop(*[f"__of_{i}" for i in range(len(by))])


def without_groups(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of groups that a table doesn't name."""
    side = groups.select(*[F.col(f"`{b}`").alias(f"__of_{i}") for i, b in enumerate(by)])
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & F.col(f"`{b}`").eqNullSafe(F.col(f"__of_{i}"))
    return df.join(side, cond, "left_anti")


def ranked(df: DataFrame, x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """by, x, n, upto, total: each distinct value, how often it stands there, how many values aren't above it, and how many there are."""
    r = running(counted(df, x, by), [*[F.col(b) for b in by], F.col("x")], {"before": F.col("n")}, "ranked")
    if not by:
        total = r.agg(F.sum("n")).first()[0] or 0
        return r.select("x", "n", (F.col("before") + F.col("n")).alias("upto"), F.lit(total).cast("long").alias("total"))
    r = written(r, "ranked-groups")
    groups = written(r.groupBy(*by).agg(F.min("before").alias("__start"), F.sum("n").alias("total")), "groups")
    return join_groups(r, groups, by).select(*by, "x", "n", (F.col("before") + F.col("n") - F.col("__start")).alias("upto"), "total")


def kth_values(df: DataFrame, k: int, ascending: bool, x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """by, value: the k-th smallest or largest; no row, or a null, if there are fewer. A bounded top-k, else the ranks."""
    if not by and k <= TOP:
        order = F.col(x).asc() if ascending else F.col(x).desc()
        top = df.select(x).filter(F.col(x).isNotNull()).orderBy(order).limit(max(k, 0))
        last = F.max(x) if ascending else F.min(x)
        return top.agg(F.when(F.count(x) == k, last).alias("value")) if k >= 1 else df.sparkSession.sql("select cast(null as double) as value")
    place = F.lit(k) if ascending else F.col("total") - k + 1
    held = ranked(df, x, by).filter((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place) & (place >= 1) & F.lit(k >= 1))
    return held.groupBy(*by).agg(F.max("x").alias("value"))


def quantiles(df: DataFrame, shares: list[float], x: str = "x", by: Sequence[str] = (), ranks: DataFrame | None = None) -> DataFrame:
    """by, share, value: linear interpolation between the values at ranks around share * (n - 1). ranks: those of the column, if they are known."""
    r = ranked(df, x, by) if ranks is None else ranks
    found = []
    for s in shares:
        rank = F.lit(float(s)) * (F.col("total") - 1)
        holds = lambda p: (F.col("upto") > p) & (F.col("upto") - F.col("n") <= p)
        low, high = F.when(holds(F.floor(rank)), F.col("x")), F.when(holds(F.ceil(rank)), F.col("x"))
        found.append(F.when(low.isNotNull() | high.isNotNull(), F.struct(F.lit(float(s)).alias("share"), low.alias("low"), high.alias("high"), (rank - F.floor(rank)).alias("part"))))
    near = r.select(*by, F.explode(F.filter(F.array(*found), lambda q: q.isNotNull())).alias("q")).groupBy(*by, "q.share")
    low, high = F.max("q.low"), F.max("q.high")
    return near.agg((low + F.max("q.part") * (high - low)).alias("value"))


def trimmed_mean(df: DataFrame, share: float, x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """by, value: the mean without round(n * share), half to even, values at each end; null if none is left."""
    share = min(max(share, 0.0), 1.0)
    cut = F.rint(F.col("total") * share)
    left = F.greatest(F.least(F.col("upto"), F.col("total") - cut) - F.greatest(F.col("upto") - F.col("n"), cut), F.lit(0.0))
    kept = ranked(df, x, by).select(*by, "x", left.alias("k"), "total")
    return kept.groupBy(*by).agg(F.when((F.max("total") >= 2) & (F.sum("k") > 0), F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("value"))


def mean_absolute_deviation(df: DataFrame, x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """by, value: two passes over the counts, the mean first."""
    c = written(counted(df, x, by), "counted")
    mean = (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m")
    with_mean = join_groups(c, written(c.groupBy(*by).agg(mean), "means"), by) if by else c.withColumn("m", F.lit(c.agg(mean).first()[0]))
    return with_mean.groupBy(*by).agg((F.sum(F.abs(F.col("x") - F.col("m")) * F.col("n")) / F.sum("n")).alias("value"))


def modal_value(df: DataFrame, x: str = "x", pos: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, value: the most frequent value, of ties the first seen (by pos; else the smallest); null if all differ."""
    seen = F.min(pos) if pos else F.min(x)
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("x")).agg(F.count("*").alias("n"), seen.alias("first"))
    best = F.max_by(F.when(F.col("n") > 1, F.col("x")), F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy(*by).agg(best.alias("value"))


def folded(df: DataFrame, kind: str, x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """by, value: the greatest common divisor or the least common multiple of a column's whole magnitudes.

    Each task folds its rows by group; the groups' parts are then folded in order of the group, so a hot group sends one row
    for each task. A multiple that leaves 64 bits is null; one with a zero among its values is zero.
    """
    import pyarrow as pa

    base = df.filter(F.col(x).isNotNull()).select(F.to_json(F.struct(*by) if by else F.struct(F.lit(0))).alias("__group"), *by, F.abs(F.col(x)).cast("long").alias("x"))
    schema = "__group string, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields[1:-1]) + "x long"

    def fold(batches):
        import math

        op = math.gcd if kind == "gcd" else math.lcm
        got, rows, like = {}, {}, None
        for batch in batches:
            like = batch.schema
            for i, (g, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                value = got.get(g, 0 if kind == "gcd" else 1)
                value = None if v is None or value is None else op(value, v)
                got[g] = value if value is None or value < 1 << 63 else None
                if g not in rows:
                    rows[g] = batch.slice(i, 1)
            if len(got) > 50_000:
                yield from parts(got, rows, like)
                got, rows = {}, {}
        if got:
            yield from parts(got, rows, like)

    def parts(got, rows, like):
        whole = pa.Table.from_batches([rows[g] for g in got], schema=like)
        yield from whole.set_column(whole.num_columns - 1, like.field(whole.num_columns - 1), pa.array(list(got.values()), pa.int64())).combine_chunks().to_batches()

    partial = base.mapInArrow(fold, schema)
    # Groups that one task folds come together and few at a time; a group's parts are as many as tasks.
    final = (partial.repartition("__group").sortWithinPartitions("__group") if by else partial.repartition(1)).mapInArrow(fold, schema)
    return final.groupBy(*by).agg(F.max(F.col("x").cast("double")).alias("value")) if not by else final.select(*by, F.col("x").cast("double").alias("value"))


def places(df: DataFrame, x: str, name: str, value: Column) -> DataFrame:
    """Adds to each row what its value has among the ranks, null for a null."""
    side = written(ranked(df, x).select(F.col("x").alias("__value"), value.alias(name)), "places")
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c != name])
    return left_join_hot(rest, F.col(f"`{x}`").cast("double"), side, "__value")


def rank_rows(df: DataFrame, x: str, name: str = "rank", ascending: bool = False) -> DataFrame:
    """Adds the competition rank of each row (ties share the best); null for a null."""
    return places(df, x, name, ((F.col("upto") - F.col("n") + 1) if ascending else (F.col("total") - F.col("upto") + 1)).cast("long"))


def percent_rank_rows(df: DataFrame, x: str, name: str = "percent_rank") -> DataFrame:
    """Adds (values below + half of those equal) / (n - 1)."""
    share = (F.col("upto") - F.col("n") + F.col("n") * F.lit(0.5)) / F.greatest(F.col("total") - 1, F.lit(1))
    return places(df, x, name, share.cast("double"))


def staircase(rows: list[tuple], ascending: bool) -> tuple[list, list]:
    """Keys in the order of a search, and for each the greatest position among those before it and itself."""
    bounds, best, top = [], [], None
    order = (lambda r: r[0].encode()) if rows and isinstance(rows[0][0], str) else (lambda r: r[0])
    for key, pos in sorted(rows, key=order, reverse=not ascending):
        top = pos if top is None else max(top, pos)
        bounds.append(key)
        best.append(top)
    return bounds, best

