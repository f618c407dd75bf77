"""What the training-data operators share: shared storage, Arrow batches, column names, joins with small sides."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import SMALL_ROWS, fresh_path, join_hot, release, running, shared_dir, written

__all__ = ["fresh_path", "join_hot", "release", "running_sums", "shared_dir", "written"]  # of the engine's own, used by every operator

#: The white space that separates words in most of the contracts.
SPACE_CLASS = r"\x20\x09-\x0D"
running_sums = running
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = {ord(c): c.lower() for c in ASCII_UPPER}

#: Rows in an Arrow batch sent to Python. Long texts come by the hundred, not by the ten thousand, so a worker stays small.
ARROW_ROWS = 256
#: Rows that one array of repeats is unfolded into at most.
REPEATS = 1024


def file_broadcast(spark: SparkSession, path: str):
    """A vocabulary file's bytes, read on the driver, for every executor: no executor needs the path. Files of a few MB."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of an Arrow batch for the session's later Python stages; never raises a smaller setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, columns: list[Column], schema: str, start: Callable[[], Callable[..., tuple]], rows: int = ARROW_ROWS) -> DataFrame:
    """One output row for each input row, made in Python from Arrow batches.

    start() runs once in a task and returns the function of a row's values; it loads vocabularies and caches. If that
    function has a `prepare`, it gets the columns of a batch before the rows do.
    """
    arrow_batches(df.sparkSession, rows)
    names = [f"c{i}" for i in range(len(columns))]
    picked = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])
    fields = arrow_schema(picked.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        one = start()
        prepare = getattr(one, "prepare", None)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            if prepare:
                prepare(*cols)
            out = [one(*values) for values in zip(*cols, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return picked.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", most: int = SMALL_ROWS) -> DataFrame:
    """Joins with a written table: broadcast if it has been counted and is small, else a shuffled join (skew is dealt anew by AQE)."""
    more = [c for c in small.columns if c not in keys]
    side = small.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *more)
    side = F.broadcast(side) if small.count() <= most else side
    cond = F.lit(True)
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        cond = cond & one if i else one
    return big.join(side, cond, how).select(*big.columns, *more)


def searched(bounds: list[str], key: Column) -> Column:
    """How many of the sorted bounds, texts without line ends, aren't above the key."""
    return shared.searched(F.split(F.lit("\n".join(bounds)), "\n"), len(bounds), key)  # one literal, folded once


def repeated(df: DataFrame, times: str, number: str) -> DataFrame:
    """Each row as often as its column `times` says, with `number` from 1; rows with many repeats are dealt out in parts first."""
    few = df.filter(F.col(times) <= REPEATS).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col(times), F.lit(1).cast("long")))))
    few = few.filter(F.col(number) <= F.col(times))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(REPEATS).cast("long")))
    many = df.filter(F.col(times) > REPEATS).withColumn("__part", part).repartition("__part")
    last = F.least(F.col("__part") + REPEATS, F.col(times))
    return few.unionByName(many.withColumn(number, F.explode(F.sequence(F.col("__part") + 1, last))).drop("__part"))


def row_digest(row: str = "row") -> Column:
    """A digest of a packed row, whatever the types of its columns (hashes of maps aren't allowed)."""
    return F.sha2(F.to_json(F.col(row)), 256)


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The row as one column, `row`, beside columns of our own: no name of the table can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


class Memo(dict):
    """A bounded cache of pure results in two generations: a full young one becomes the old one.

    It is bounded by entries and by the characters of their keys, to which the results are in proportion; a key longer
    than `longest` is made anew each time, so text without blanks fills no worker.
    """

    def __init__(self, make: Callable, most: int = 300_000, most_chars: int = 8_000_000, longest: int = 1000):
        super().__init__()
        self.make, self.most, self.most_chars, self.longest, self.chars, self.old = make, most, most_chars, longest, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if len(key) > self.longest:
            return value
        if len(self) >= self.most or self.chars >= self.most_chars:
            self.old, self.chars = dict(self), 0
            self.clear()
        self[key] = value
        self.chars += len(key)
        return value
