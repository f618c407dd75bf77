"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the copies each of its documents should get. The whole part is given; the fraction
is rounded by pairs: two documents trade words, by chance in a proportion that keeps each one's expectation, until one
of them is whole. The words of a pair stay the same, so a source ends within half a document of its target. Pairs are
formed inside blocks of about FAN documents; each block's residual goes up a reduction tree of the same fan. In a block
the longest documents trade first, among themselves, and the short ones settle what they leave; the last residual of a
source, which has nothing to trade with, goes to the nearer side.

Chance is a hash of the ids and a seed, and blocks are sorted by size and by it, so reruns agree however the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_CLASS, join_hot, join_small, packed, repeated, row_digest, running_sums, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
FAN = 64
SEED = 20240607
TINY = 1e-9
KEYS = ["source", "doc_id", "size"]


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")).cast("long")


def chance(*keys: Column) -> Column:
    """A number from 0 up to 1, the same for the same keys."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def targets(units: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Each source's size, number of units, weight and target.

    Sources are filled by weight until they reach most times their size: with sources sorted by size over weight,
    those before the first whose share of what is left fits under its stop are at their stop. Sources may be as many as
    documents: their order and sums are made in ranges, and only totals come to the driver.
    """
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    s = running_sums(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = s.select("*", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("stop"))
    s = s.withColumn("height", F.col("stop") / F.col("weight"))
    s = written(running_sums(s, [F.col("height"), F.col("rank")], {"stops": F.col("stop"), "lighter": F.col("weight")}, "mix-heights"), "mix-levels")
    size, total_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (size or 0)) - F.col("stops")) / (F.lit(float(total_weight or 0)) - F.col("lighter"))
    s = s.withColumn("level", level)
    # A weight's part of the first level that fits; relative slack for the last bits of the sums.
    fits = F.col("level") * F.col("weight") <= F.col("stop") * F.lit(1 + 1e-12)
    fill = s.filter(fits).agg(F.min_by("level", F.struct("height", "rank"))).first()[0]
    target = F.col("stop") if fill is None else F.least("stop", F.lit(fill) * F.col("weight"))
    return s.select("source", "source_size", "units", target.alias("target"))


def rounded_block(items: Column) -> Column:
    """Folds a block: struct(done, open), done with x of 0 or 1, open the one unit left over."""
    unit = "struct<order:bigint,h:bigint,source:string,doc_id:bigint,size:bigint,rows:bigint,extra:bigint,x:double>"

    def put(u: Column, x: Column) -> Column:
        return F.struct(*[u[k].alias(k) for k in ("order", "h", "source", "doc_id", "size", "rows", "extra")], x.alias("x"))

    def snap(x: Column) -> Column:
        return F.when(x < TINY, 0.0).when(x > 1 - TINY, 1.0).otherwise(x)

    def whole(x: Column) -> Column:
        return (x == 0.0) | (x == 1.0)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def trade(acc: Column, c: Column) -> Column:
        p = acc["open"]
        up = F.least((1 - p["x"]) * p["size"], c["x"] * c["size"])  # words that c can give to p
        down = F.least(p["x"] * p["size"], (1 - c["x"]) * c["size"])
        moves = F.struct(up.alias("up"), down.alias("down"), (chance(p["h"], c["h"], p["doc_id"], c["doc_id"]) * (up + down) < down).alias("rise"))

        def moved(m: Column) -> Column:
            px = F.when(m["rise"], p["x"] + m["up"] / p["size"]).otherwise(p["x"] - m["down"] / p["size"])
            cx = F.when(m["rise"], c["x"] - m["up"] / c["size"]).otherwise(c["x"] + m["down"] / c["size"])
            return F.struct(snap(px).alias("p"), snap(cx).alias("c"))

        def settle(x: Column) -> Column:
            first = whole(x["p"])
            out, stay = F.when(first, put(p, x["p"])).otherwise(put(c, x["c"])), F.when(first, put(c, x["c"])).otherwise(put(p, x["p"]))
            return F.struct(F.concat(acc["done"], F.array(out)).alias("done"), stay.alias("open"))

        return let(let(moves, moved), settle)

    def step(acc: Column, c: Column) -> Column:
        empty = acc["open"].isNull()
        closed = whole(acc["open"]["x"])
        first = F.struct(acc["done"].alias("done"), c.alias("open"))
        after = F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), c.alias("open"))
        return F.when(empty, first).when(closed, after).otherwise(trade(acc, c))

    start = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.lit(None).cast(unit).alias("open"))
    return F.aggregate(items, start, step)


def round_units(pool: DataFrame, most_units: int) -> DataFrame:
    """x of every unit as 0 or 1: one level of blocks after another, each level's residuals in the next one's blocks.

    pool: source, doc_id, size > 0, rows, extra, 0 < x < 1, units (of the source).
    """
    cols = ["source", "doc_id", "size", "rows", "extra", "x"]
    done, level, blocks = [], 0, most_units
    while True:
        blocks = -(-blocks // FAN)
        of_source = F.ceil(F.col("units") / F.lit(float(FAN ** (level + 1)))).cast("long")
        h = F.xxhash64(F.lit(SEED + level), "doc_id", "size")
        items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), h.alias("h"), *cols)))
        dealt = pool.select("*", F.pmod(F.xxhash64(F.lit(SEED - 1 - level), "doc_id", "size"), F.greatest(of_source, F.lit(1))).alias("block"))
        folded = dealt.groupBy("source", "block").agg(F.max("units").alias("units"), items.alias("items"))
        folded = written(folded.select("units", rounded_block(F.col("items")).alias("r")), f"mix-level{level}")
        done.append(folded.select(F.explode("r.done").alias("u")).select(*[f"u.{c}" for c in cols]))
        rest = folded.select("units", "r.open").select("units", *[f"open.{c}" for c in cols])
        if blocks <= 1:
            done.append(rest.select(*cols[:-1], F.when(F.col("x") < 0.5, 0.0).otherwise(1.0).alias("x")))
            break
        done.append(rest.filter(F.col("x").isin(0.0, 1.0)).select(*cols))
        pool, level = rest.filter(~F.col("x").isin(0.0, 1.0)), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, doc_id, size, rows, source_size, target, base, extra, x: of the rows with equal keys, each is taken base times, and extra + x of them once more.

    Rows with equal source, id and size are one unit, so a repeated row is no hot group. Nulls: a null text has no
    words; a null source is a source, the last; a null id is an id. Documents without words get no copies.
    """
    units = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"))
    units = written(units.groupBy(*KEYS).agg(F.count("*").alias("rows")), "mix-units")
    aims = written(targets(units, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate + TINY)
    u = join_small(units, aims, ["source"]).select("*", base.cast("long").alias("base"), F.greatest(rate - base, F.lit(0.0)).alias("part"))
    mass = F.when(F.col("size") > 0, F.col("part") * F.col("rows")).otherwise(F.lit(0.0))
    u = u.select("*", F.floor(mass + TINY).cast("long").alias("extra"), mass.alias("mass"))
    u = u.select("*", F.greatest(F.col("mass") - F.col("extra"), F.lit(0.0)).alias("x"))
    frac = F.col("x") > TINY
    most_units = aims.agg(F.max("units")).first()[0] or 0
    settled = u.filter(~frac).select("source", "doc_id", "size", "rows", "extra", F.lit(0.0).alias("x"))
    if most_units:
        pool = u.filter(frac).select("source", "doc_id", "size", "rows", "extra", "x", "units")
        settled = settled.unionByName(round_units(pool, most_units))
    both = join_small(settled, aims, ["source"])
    return both.select(*KEYS, "rows", "source_size", "target", base.cast("long").alias("base"), "extra", F.col("x").cast("long").alias("x"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source. Cases as copies(); an empty table gives no rows."""
    c = written(copies(docs, **how), "mix-copies")
    each = repeated(c, "rows", "k")
    n = F.col("base") + (F.col("k") <= F.col("extra") + F.col("x")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), "source")


def unit_key(source: Column, doc_id: Column, size: Column) -> Column:
    """A unit as one text; nulls differ from all values."""
    return F.concat_ws(":", size.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns, in no order.

    Rows of one unit that differ (equal id, source and size, other text) are given their copies by the order of a digest
    of the whole row; rows that are alike are counted and unfolded at the end, so they make no hot group.
    """
    c = written(copies(docs, id_col, text_col, source_col, **how).select(*KEYS, "rows", "base", "extra", "x"), "mix-copies")
    d = packed(docs, unit=unit_key(F.col(source_col).cast("string"), F.col(id_col).cast("long"), word_count(F.col(text_col))))
    c = c.withColumn("unit", unit_key(F.col("source"), F.col("doc_id"), F.col("size")))
    j = join_hot(d, c, "unit", c.select("unit", F.col("rows").alias("n")))
    single = j.filter(F.col("rows") == 1).withColumn("copies", F.col("base") + F.col("extra") + F.col("x")).filter("copies > 0")
    out = single.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    if not c.filter("rows > 1").isEmpty():
        out = out.unionByName(repeated(shared_out(j.filter(F.col("rows") > 1)), "copies", "copy").select("row", "copy"))
    return out.select("row.*")


def shared_out(many: DataFrame) -> DataFrame:
    """row, copies of the units with several rows: each row gets base, and the first extra + x by digest one more.

    The place of a row is that of its digest's bucket, from at most 4,096 sums for a unit, and its place in the bucket.
    """
    unit = [*KEYS, "base", "extra", "x"]
    alike = many.withColumn("digest", row_digest()).groupBy(*unit, "digest").agg(F.count("*").alias("m"), F.first("row").alias("row"))
    alike = written(alike.withColumn("bucket", F.substring("digest", 1, 3)), "mix-alike")
    sums = alike.groupBy(*KEYS, "bucket").agg(F.sum("m").alias("c"))
    so_far = F.sum("c").over(W.partitionBy(*KEYS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    begins = sums.select(*[F.col(k).alias(f"of_{k}") for k in [*KEYS, "bucket"]], F.coalesce(so_far, F.lit(0)).alias("begin"))
    same = F.lit(True)
    for k in [*KEYS, "bucket"]:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inside = F.sum("m").over(W.partitionBy(*KEYS, "bucket").orderBy("digest").rowsBetween(W.unboundedPreceding, -1))
    placed = alike.join(begins, same).withColumn("at", F.col("begin") + F.coalesce(inside, F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("m"), F.col("extra") + F.col("x") - F.col("at")))
    return placed.select("row", (F.col("m") * F.col("base") + more).cast("long").alias("copies"))
