"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts of words, symbols, repeated lines and repeated word windows. Four integer measures of the
documents that pass the base rule go into histogram sketches per language and source: bins of five significant bits,
so a quantile is within 1/16 of its value, and two sketches merge by adding the counts of equal bins. A group's fences
lie beyond its outer deciles, as far as those lie from its median and at least by a measure's least reach; groups with few
documents take the merged sketch of their language, or of all. Documents are then joined with their group's fences and
filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_CLASS, join_small, written

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Documents that a group needs for fences of its own.
LEAST_GROUP = 30
#: How far a fence lies at least beyond the decile: hundredths of letters in a word, else thousandths. Each is below what the base rule leaves.
LEAST_REACH = {"word_len": 150, "symbols": 60, "dup_lines": 150, "repeats": 60}
#: The percentiles that fences are made of.
LOW, MIDDLE, HIGH = 10, 50, 90


def repeat_words(w: Column, n: Column) -> Column:
    """Words of w that stand in a window of five words found twice or more in w.

    Hashes of the windows tell the texts without any repeat apart; equal hashes are then checked on the words.
    """
    starts = F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    maybe = F.size(F.array_distinct(hashes)) < F.size(starts)
    windows = F.sort_array(F.transform(starts, lambda x, i: F.struct(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, WINDOW)]).alias("g"), i.alias("i"))))

    def at(s: Column, j: Column) -> Column:
        return F.get(s, j)["g"]

    def found(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: x["g"].eqNullSafe(at(s, j - 1)) | x["g"].eqNullSafe(at(s, j + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda a, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, v: acc + v)

    exact = F.get(F.transform(F.transform(F.array(windows), found), covered), F.lit(0))
    return F.when((n >= WINDOW + 1) & maybe, exact).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every document; a null text has no words. Only built-in expressions, and no shuffle."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        t.alias("t"),
        F.array_remove(F.split(t, f"[{SPACE_CLASS}]+"), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]")).alias("lines"),
    )
    n = F.size("w")
    return split.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w"), n).alias("n_repeat_words"),
    )


def group_key(c: str) -> Column:
    """A key that is never null: a null language or source is a group of its own."""
    return F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c)))


def bin_of(v: Column) -> Column:
    """The lower end of v's bin: v itself below 32, else its five highest bits."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def measured(feats: DataFrame) -> DataFrame:
    """Adds the base rule, the group's keys and the four integer measures."""
    share = lambda a, b, k: F.when(F.col(b) > 0, F.floor((F.col(a) * k) / F.col(b))).otherwise(F.lit(0)).cast("long")
    return feats.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)).alias("base_failed"),
        group_key("lang").alias("lang_key"),
        group_key("source").alias("source_key"),
        share("word_chars", "n_words", 100).alias("word_len"),
        share("n_symbols", "word_chars", 1000).alias("symbols"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
        share("n_repeat_words", "n_words", 1000).alias("repeats"),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """The histogram sketch of each language, source and measure: one row for a bin and its count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in LEAST_REACH]))
    return rows.filter(~F.col("base_failed")).select("lang_key", "source_key", pairs.alias("p")).groupBy("lang_key", "source_key", "p.measure", "p.bin").agg(F.count("*").alias("n"))


def deciles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merges sketches to the given keys and reads the percentiles of each measure: n, then q10, q50 and q90 by measure."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    run = merged.select("*", F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(by).alias("total"))
    q = lambda k: F.min(F.when(F.col("upto") * 100 >= F.col("total") * k, F.col("bin"))).alias(f"q{k}")
    each = run.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *[q(k) for k in (LOW, MIDDLE, HIGH)])
    wide = [F.max("total").alias("group_n")]
    for m in LEAST_REACH:
        for name in (f"q{k}" for k in (LOW, MIDDLE, HIGH)):
            wide.append(F.max(F.when(F.col("measure") == m, F.col(name))).alias(f"{m}_{name}"))
    return each.groupBy(*keys).agg(*wide)


def fences(sketch: DataFrame) -> DataFrame:
    """Lowest word length and highest measures of each (lang_key, source_key), from the finest level with enough documents."""
    levels = [deciles(sketch, ["lang_key", "source_key"]), deciles(sketch, ["lang_key"]), deciles(sketch.withColumn("all_key", F.lit("a")), ["all_key"])]
    names = [c for c in levels[0].columns if c not in ("lang_key", "source_key")]
    a, b, c = (x.select(*[F.col(k).alias(k) for k in x.columns if k not in names], F.struct(*names).alias(f"l{i}")) for i, x in enumerate(levels))
    picked = a.withColumn("all_key", F.lit("a")).join(b, "lang_key", "left").join(c, "all_key", "left")
    best = F.when(F.col("l0.group_n") >= LEAST_GROUP, F.col("l0")).when(F.col("l1.group_n") >= LEAST_GROUP, F.col("l1")).otherwise(F.col("l2"))
    picked = picked.select("lang_key", "source_key", best.alias("l"))
    at = lambda m, k: F.col(f"l.{m}_q{k}")
    above = lambda m: at(m, HIGH) + F.greatest(at(m, HIGH) - at(m, MIDDLE), F.lit(LEAST_REACH[m]))
    below = at("word_len", LOW) - F.greatest(at("word_len", MIDDLE) - at("word_len", LOW), F.lit(LEAST_REACH["word_len"]))
    return picked.select("lang_key", "source_key", below.alias("word_len_least"), *[above(m).alias(f"{m}_most") for m in LEAST_REACH])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document with its counts, the base rule and the verdict.

    Null, empty and blank texts have no words and fail the base rule; a null id stays null; a null language or source
    is a group of its own; repeated rows each get their row and each count in the sketches; other columns are ignored; an
    empty table gives no rows.
    The texts are read once: the counts are written to the shared folder and read for the sketches and for the verdict.
    """
    rows = written(measured(features(docs, id_col, text_col, lang_col, source_col)), "quality")
    limits = written(fences(sketches(rows)), "fences")
    both = join_small(rows, limits, ["lang_key", "source_key"])
    inside = F.col("word_len") >= F.col("word_len_least")
    for m in LEAST_REACH:
        inside = inside & (F.col(m) <= F.col(f"{m}_most"))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )
