"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lowered, everything else is one space; n-grams of one to three characters are hashed into BINS columns.
Document frequencies are counted over all labelled training rows. The weights are fitted on a bounded sample of those
rows with follow-the-regularised-leader and elastic-net penalties, which leaves most of them zero, and a temperature
is set on rows of the sample that the fit didn't see.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_rows, packed

BINS = 1 << 15
#: Bounds of the fit: rows in the sample, and labels; a table with more labels is an error.
MOST_ROWS, MOST_LABELS = 3000, 200
#: Columns of a sampled row at most, the same choice of columns for all; so the sample takes at most some 120 MB on the driver.
MOST_GRAMS = 4096
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.02, 0.001, 3
UNKNOWN = "und"
SEED = 7


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns and counts of a text's n-grams, or None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = c[letter | np.concatenate([[True], letter[:-1]])]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]) if c[0] != 32 else np.concatenate([c, [np.uint32(32)]])
    a = c * np.uint32(2654435761)
    two = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * np.uint32(2246822519) + a[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + a[2:]
    shift = np.uint32(17)  # 32 bits to BINS
    mixed = [(h ^ (h >> np.uint32(16))) * np.uint32(668265263) + np.uint32(n) >> shift for n, h in enumerate((a, two, three))]
    counts = np.bincount(np.concatenate(mixed), minlength=BINS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # labels x BINS
    bias: np.ndarray
    temperature: float = 1.0
    stats: dict = field(default_factory=dict)

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self.vector(at, counts) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        got = grams(text)
        if got is None or not self.labels:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*got) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], min(1.0, max(0.0, float(p[k])))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The rows that may be learned from: a label, and not in the fold that is held out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a row without an id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with letters, and for each column those that have it; BINS rows come to the driver, whatever the input."""

    def run(batches):
        total, seen = 0, np.zeros(BINS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                got = grams(text)
                if got is not None:
                    total += 1
                    seen[got[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], total), pa.int64())], names=["bin", "n"])

    counted = rows.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    at, n = counted.column("bin").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(BINS, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), df


def sampled(rows: DataFrame, counts: list[tuple[str, int]], most: int) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Labels, columns and counts of about `most` rows (a quarter more at most), as even over the labels as they go.

    Rows are picked by a hash of id and text, so rows that share an id, or have none, are picked one by one; rows alike
    in id, text and label count once.
    """
    each = max(1, most // max(1, len(counts)))
    keep = F.lit(False)
    pick = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1_000_000))
    for lang, n in counts:  # at most MOST_LABELS branches
        keep = keep | ((F.col("lang") == lang) & (pick < min(1_000_000, -(-1_000_000 * each // n))))
    schema = "h long, lang string, at array<int>, n array<float>"

    def start() -> Callable[..., tuple]:
        def one(h, lang, text):
            got = grams(text)
            if got is None:
                return h, lang, [], []
            at, n = got
            if len(at) > MOST_GRAMS:
                some = np.sort(np.argsort(np.random.default_rng(SEED).permutation(BINS)[at])[:MOST_GRAMS])
                at, n = at[some], n[some]
            return h, lang, at, n

        return one

    once = rows.filter(keep).groupBy(F.xxhash64(F.lit(SEED + 1), "doc_id", "text").alias("h"), "lang").agg(F.first("text").alias("text"))
    found = map_rows(once, [F.col("h"), F.col("lang"), F.col("text")], schema, start)
    table = found.filter(F.size("at") > 0).orderBy("h", "lang").limit(most + most // 4).toArrow()
    at, n = table.column("at"), table.column("n")
    return table.column("lang").to_pylist(), [x.values.to_numpy() for x in at], [x.values.to_numpy() for x in n]


def fit(labels: list[str], idf: np.ndarray, langs: list[str], at: list[np.ndarray], counts: list[np.ndarray], epochs: int = EPOCHS) -> Model:
    """Follow-the-regularised-leader (proximal) with L1 and L2, then a temperature on every fifth row."""
    k = len(labels)
    model = Model(labels, idf, np.zeros((k, BINS), np.float32), np.zeros(k))
    index = {x: i for i, x in enumerate(labels)}
    rows = [(index[y], a, model.vector(a, c)) for y, a, c in zip(langs, at, counts, strict=True) if y in index]
    tune, train = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    train = train or rows
    z, n, bz, bn = np.zeros((k, BINS)), np.zeros((k, BINS)), np.zeros(k), np.zeros(k)

    def solved(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for y, a, x in train:
            zi, ni = z[:, a], n[:, a]
            w, b = solved(zi, ni), solved(bz, bn)
            g = softmax(w @ x + b)
            g[y] -= 1
            grad = g[:, None] * x
            z[:, a] = zi + grad - (np.sqrt(ni + grad * grad) - np.sqrt(ni)) / ALPHA * w
            n[:, a] = ni + grad * grad
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA * b
            bn += g * g
    model.weights, model.bias = solved(z, n).astype(np.float32), solved(bz, bn)
    if tune:
        scores = np.array([model.weights[:, a] @ x + model.bias for _, a, x in tune])
        truth = np.array([y for y, _, _ in tune])

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())

        model.temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss))
    model.stats = {"rows": len(rows), "nonzero": int((model.weights != 0).sum())}
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS) -> Model:
    """Learns from the labelled rows outside the held-out fold; without any, a model that knows no label."""
    arrow_batches(docs.sparkSession)
    rows = training_rows(docs, id_col, text_col, lang_col)
    counts = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS + 1).collect()]
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages: rows of those that aren't learned would be named as others")
    if not counts:
        return Model([], np.ones(BINS, np.float32), np.zeros((0, BINS), np.float32), np.zeros(0))
    total, df = document_frequencies(rows)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    return fit(sorted(lang for lang, _ in counts), idf, *sampled(rows, counts, most_rows))


def predicted(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The same rows with a predicted language and its calibrated probability; a clashing name is replaced."""
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LABELS x BINS floats

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        got = [held.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang", "score"])

    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (lang_name, score_name)]
    marked = packed(docs, guess=guess(F.col(text_col)))
    return marked.select(*rest, F.col("guess.lang").alias(lang_name), F.col("guess.score").alias(score_name))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are 'und' with score 0; without any labelled row all are. A null id is never
    held out; repeated rows each get their row; labels and sources are no input of a prediction.
    """
    model = train(docs, id_col, text_col, lang_col, most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return predicted(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


