"""What operators share at scale: tables in the shared folder, running totals without a global sort, searches in small tables, joins with hot keys."""

from __future__ import annotations

import json
import posixpath
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side of a join is broadcast only if it has been counted and holds at most this many rows.
SMALL_ROWS = 20_000
#: A key is hot if it holds more than this part of a table's rows, so fewer keys than that can be.
HOT_KEYS = 1000
#: Bytes of a table that is dealt out anew before heavy work at most.
DEAL_BYTES = 32 << 20
#: Parts that rows without a key are dealt to.
SALTS = 1024
#: Tables and folders that each session's operators have made in the shared folder.
MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset in local mode (tests).

    Beside a local master there is no folder that executors are sure to share, so an unset one is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if "://" not in conf:  # a bare path lies in the cluster's own file system, which other readers must be told
            path = spark._jvm.org.apache.hadoop.fs.Path(conf)
            conf = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    path = posixpath.join(shared_dir(spark), "gridloom", f"{name}-{uuid.uuid4().hex}")
    MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes what the session's operators have written to the shared folder, once their results are no longer read."""
    jvm, gone = spark._jvm, 0
    for path in MADE.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which survives any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, path: str) -> DataFrame:
    """A small table of fewer files than cores, dealt out to all cores: a file of one row group is one task, however heavy what follows.

    Beyond DEAL_BYTES, where there are row groups enough, the table stays as it lies. The rows are the same either way.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    cores = spark.sparkContext.defaultParallelism
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > DEAL_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def join_hot(big: DataFrame, small: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Inner join by `key`, never null, with a table that has at most one row for each key.

    counts: the rows of big by key, as n, for all keys of small.

    With few keys small is broadcast. Else the rows of hot keys meet theirs by a broadcast of fewer than HOT_KEYS rows,
    whatever the input, and the rest are shuffled, so a key with a third of the rows stays dealt out as it was.
    """
    keys, total, most = counts.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if keys <= SMALL_ROWS:
        return big.join(F.broadcast(small), key)
    if most <= total // HOT_KEYS:
        return big.join(small, key)
    heavy = F.broadcast(counts.filter(F.col("n") > total // HOT_KEYS).select(key))
    hot = F.broadcast(small.join(heavy, key, "left_semi"))
    return big.join(hot, key).unionByName(big.join(heavy, key, "left_anti").join(small, key))


def left_join_hot(df: DataFrame, key: Column, small: DataFrame, small_key: str, most: int = SMALL_ROWS) -> DataFrame:
    """Left join with a table that has at most one row for each key, none null; the key's columns go.

    A small table is broadcast. Else hot keys meet theirs by a broadcast of fewer than HOT_KEYS rows, and rows without a
    key, which match nothing, are dealt out by a salt.
    """
    new = [c for c in small.columns if c != small_key]
    marked = df.select("*", key.alias("__key"))
    side = small.select(F.col(f"`{small_key}`").alias("__of"), *[F.col(f"`{c}`") for c in new])
    same = F.col("__key") == F.col("__of")
    kept = [*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`") for c in new]]
    if small.limit(most + 1).count() <= most:
        return marked.join(F.broadcast(side), same, "left").select(*kept)
    counts = marked.filter("__key is not null").groupBy(F.col("__key").alias("__heavy")).agg(F.count("*").alias("n"))
    total = df.count()
    heavy = F.broadcast(written(counts.filter(F.col("n") > total // HOT_KEYS).select("__heavy"), "hot-keys"))
    is_heavy = F.col("__key") == F.col("__heavy")
    hot = F.broadcast(side.join(heavy, F.col("__of") == F.col("__heavy"), "left_semi"))
    few = marked.join(heavy, is_heavy, "left_anti").withColumn("__salt", F.when(F.col("__key").isNull(), F.monotonically_increasing_id() % SALTS).otherwise(F.lit(-1)))
    rest = few.join(side.withColumn("__of_salt", F.lit(-1).cast("long")), same & (F.col("__salt") == F.col("__of_salt")), "left")
    return marked.join(heavy, is_heavy, "left_semi").join(hot, same, "left").select(*kept).unionByName(rest.select(*kept))


def literal_array(values: list, kind: str) -> Column:
    """A bounded list as one literal that is folded once, not as an expression for each element."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def searched(bounds: Column, size: int, key: Column, holds: Callable[[Column, Column], Column] = lambda bound, key: bound <= key) -> Column:
    """How many of the bounds, first to last, hold for the key: a binary search in an expression.

    bounds: an array in whose order holds(bound, key) is first true, then false.
    """
    if not size:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("low"), F.lit(size).alias("high"))

    def half(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        up = F.struct((middle + 1).alias("low"), acc["high"].alias("high"))
        down = F.struct(acc["low"].alias("low"), middle.alias("high"))
        return F.when(acc["low"] >= acc["high"], acc).when(holds(F.get(bounds, middle), key), up).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(size.bit_length())), start, half, lambda acc: acc["low"])


def running(df: DataFrame, order: list[Column], values: dict[str, Column], name: str, fold: str = "sum") -> DataFrame:
    """The rows with, for each name, the sum (0 for the first) or the maximum (null) over the rows before them in an order.

    No task sees all rows: ranges of rows get theirs from one row for each range before, and the rest is inside a range. Equal
    values of the order's first column can lie in several ranges if later ones differ. The rows and their ranges are written.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()]).repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    dealt = written(ranges, name)
    fn = {"sum": F.sum, "max": F.max}[fold]
    both = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if fold == "sum" else F.greatest
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    tops = dealt.groupBy("__range").agg(*[fn(f"__v_{k}").alias(f"__t_{k}") for k in values])
    tops = F.broadcast(tops.select("__range", *[fn(f"__t_{k}").over(before).alias(f"__b_{k}") for k in values]))  # a row for each range
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(tops, "__range").select(*[F.col(f"`{c}`") for c in df.columns], *[both(F.col(f"__b_{k}"), fn(f"__v_{k}").over(inside)).alias(k) for k in values])
