"""SimHash near-dedup by deletion-variant signatures.

Fingerprints within two bits: cut into two halves of 32 bits, one half differs by at most one bit, so with that bit as
a wildcard the halves agree. Each distinct fingerprint is indexed under its 64 one-wildcard variants; fingerprints that
meet under one are verified. Buckets of two give their pair from an aggregate, buckets of up to PAIRED an equality
join. The fingerprints of larger buckets are linked exactly without pairs: two are within two bits if and only if some
word is within one bit of both, so each goes to its 65 such words, where at most 65 meet, all of them linked.

Links go into connected components by rounds of random contraction over tables in the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, join_hot, packed, row_digest, written

SHINGLE, SEED = 3, 42
HALF_VARIANTS = 32
#: Buckets of more fingerprints than this are linked through words instead of pairs.
PAIRED = 8
#: Words of 64 bits in the filter that is broadcast: at most so many rows of two longs, whatever the input.
FILTER_WORDS = 1 << 18
#: Shingles hashed at a time, so that a very long text needs bounded memory.
SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text's word shingles, as a signed long; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        h = hash64(b" ".join(words), SEED)
        return h - (1 << 64) if h >> 63 else h
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SLICE):
        to = min(k + SLICE, n)
        spans = zip(begins[k:to].tolist(), ends[k + SHINGLE - 1 : to + SHINGLE - 1].tolist())
        hashes = np.array([hash64(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a column, made in Python from Arrow batches."""

    @F.arrow_udf("bigint")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())

    return made(text)


def variants(fp: str) -> list[Column]:
    """The 64 signatures of a fingerprint: which half and which wildcard, and the half without that bit."""
    v = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * HALF_VARIANTS - 1).cast("long")))
    return [F.col(fp), v.alias("v")]


def signature() -> Column:
    half = F.when(F.col("v") < HALF_VARIANTS, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, cast(v % 32 as int))")
    return F.expr("shiftleft(v, 32)").bitwiseOR(half.bitwiseAND(F.bitwise_not(bit)))


def indexed(fps: DataFrame) -> DataFrame:
    return fps.select(*variants("fp")).select("fp", signature().alias("sig"))


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def maybe_in(sigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of sigs whose sig may be among those wanted: all that are, and others by chance.

    A hash of each wanted sig sets a bit, and the words of bits are broadcast. With many more sigs than bits the filter
    lets most rows through, and the join that follows is as large as without it.
    """
    h = F.xxhash64("sig")
    word, bit = h.bitwiseAND(F.lit(FILTER_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bits = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return sigs.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select(*sigs.columns)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within two bits of each other, directly or through others.

    fps: one column fp, distinct. Every two that are within two bits end up connected; no link joins others.
    """
    sigs = indexed(fps)
    buckets = written(sigs.groupBy("sig").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simhash-buckets")
    pairs = buckets.filter("n = 2").select("a", "b").filter(near("a", "b")).distinct()
    full = buckets.filter("n > 2").select("sig", "n")
    maybe = written(maybe_in(sigs, full), "simhash-maybe")
    members = written(join_hot(maybe, full, "sig", full).select("sig", "n", "fp"), "simhash-members")
    few = members.filter(F.col("n") <= PAIRED).select("sig", "fp")
    other = few.select("sig", F.col("fp").alias("b"))
    met = few.withColumnRenamed("fp", "a").join(other, "sig").filter(F.col("a") < F.col("b")).filter(near("a", "b")).select("a", "b").distinct()
    crowd = members.filter(F.col("n") > PAIRED).select("fp").distinct()
    word = F.explode(F.sequence(F.lit(-1).cast("int"), F.lit(63).cast("int")))
    words = crowd.select("fp", word.alias("i")).select("fp", F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, i)"))).alias("w"))
    # At most 65 fingerprints are within one bit of a word, so the list is bounded.
    meet = words.groupBy("w").agg(F.sort_array(F.collect_list("fp")).alias("f")).filter(F.size("f") > 1)
    stars = meet.select(F.element_at("f", 1).alias("a"), F.explode(F.slice("f", 2, 64)).alias("b")).distinct()
    return pairs.unionByName(met).unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): one fingerprint of its component for each that has a link, the same for all of them.

    Each round gives every fingerprint a place by chance (a hash of it and the round) and moves it to the neighbour that
    has the lowest place, or leaves it where its own is the lowest; links move along, and those inside a fingerprint go.
    At least about half of the fingerprints that are left go in each round, on average, whatever the links' shape, so
    rounds grow with the logarithm of the links and all of them together cost about two of the first. Where each went is
    followed from the last round back. Every round is two tables in the shared folder; hot fingerprints are joined by a
    bounded broadcast.
    """
    moves, left = [], written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links")
    while not left.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c), F.col(c))  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min_by("b", place("b")).alias("b"), F.count("*").alias("n"))
        move = written(low.select("a", F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("to"), "n"), "simhash-moves")
        moved = join_hot(left, move.select("a", "to"), "a", move.select("a", "n")).select(F.col("to").alias("x"), "b")
        of_b = move.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = join_hot(moved, of_b, "b", move.select(F.col("a").alias("b"), "n")).filter("x <> y")
        moves.append(move.select(F.col("a").alias("fp"), "to"))
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-links")
    if not moves:
        return edges.select(F.col("a").alias("fp"), F.col("a").alias("root")).limit(0)
    roots = moves[-1].withColumnRenamed("to", "root")
    for move in moves[-2::-1]:
        later = roots.select(F.col("fp").alias("to"), F.col("root").alias("later"))
        counts = move.groupBy("to").agg(F.count("*").alias("n"))
        # One that is no fingerprint of a later round has arrived.
        later = counts.join(later, "to", "left").select("to", F.coalesce("later", "to").alias("root"))
        roots = written(join_hot(move, later, "to", counts).select("fp", "root"), "simhash-roots")
    return roots


def with_components(marks: DataFrame, with_root: bool = False) -> DataFrame:
    """doc_id, fp, component_id for a written table of doc_id and fp; with_root adds one fingerprint that stands for the component."""
    more = ["root"] if with_root else []
    each = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(written(links(each.select("fp")), "simhash-edges"))
    lowest = each.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_hot(roots, written(lowest, "simhash-lowest"), "root", roots.groupBy("root").agg(F.count("*").alias("n"))).select("fp", "component_id", *more)
    of = each.join(named, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), *[F.coalesce("root", "fp").alias("root") for _ in more])
    return join_hot(marks, written(of, "simhash-components"), "fp", each.select("fp", "n")).select("doc_id", "fp", "component_id", *more)


def hex64(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp of each row, written."""
    arrow_batches(docs.sparkSession)
    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "simhash-marks")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (the smallest id that is reachable through links).

    Null, empty and blank texts have fingerprint zero and link like any other; a null id gets its row and names no
    component unless all ids there are null; repeated rows each get their row; other columns are ignored; an empty
    table gives no rows.
    """
    return with_components(marked(docs, id_col, text_col)).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component: one document of each group, with all its columns.

    Of rows that repeat such an id one stays for each component that it names. A row without an id stays only if no row of its component has one, and
    then one such row for each text does.
    """
    classes = written(with_components(marked(docs, id_col, text_col), with_root=True), "simhash-classes")
    names = F.col("doc_id") == F.col("component_id")
    keep = classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(names).alias("naming")).filter("naming > 0").select("doc_id", "n")
    rows = packed(docs, id=F.col(id_col).cast("long"))
    kept = rows.join(keep.withColumnRenamed("doc_id", "keep_id"), F.col("id") == F.col("keep_id"))
    if not keep.filter("n > 1").isEmpty():
        first = classes.filter(names).select("doc_id", F.col("fp").alias("first_fp"), "root").distinct()
        again = kept.filter("n > 1").select("id", "row", fingerprint_column(F.col(f"row.`{text_col}`")).alias("fp"))
        again = again.join(first, (F.col("id") == F.col("doc_id")) & (F.col("fp") == F.col("first_fp"))).groupBy("id", "root").agg(F.min_by("row", row_digest()).alias("row"))
        kept = kept.filter("n = 1").select("row").unionByName(again.select("row"))
    kept = kept.select("row")
    nameless = classes.filter("component_id is null").select(F.col("fp").alias("nameless_fp")).distinct()
    if not nameless.isEmpty():
        arrow_batches(docs.sparkSession)
        rows = packed(docs.filter(F.col(id_col).isNull()), text=F.col(text_col)).withColumn("fp", fingerprint_column(F.col("text")))
        rows = rows.join(nameless, F.col("fp") == F.col("nameless_fp"), "left_semi")
        kept = kept.unionByName(rows.dropDuplicates(["text"]).select("row"))
    return kept.select("row.*")
