"""Quality classifier: hashed word n-grams, logistic regression trained by
follow-the-regularised-leader (FTRL-Proximal) updates, sparse dot products.

Features of a text: its words without surrounding signs, the signs around a
word, and pairs of neighbouring words (a word followed by itself counts as one
common pair), hashed to a fixed number of columns with value log(1 + count),
the vector scaled to length 1, and a constant. Features are made where the
text lies; the model is an array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import mix64, text_slices, word_lists

BITS = 18               # 2 ** BITS columns
TRAIN_ROWS = 8000       # bound of the labelled sample that the model is fitted on
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
CUT = 0.3               # predicted 1 from this score on
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _word_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word's core (lower-case, without surrounding signs) and of
    the signs around it (0: none)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    coded = words.dictionary_encode()
    core, around = [], []
    for w in coded.dictionary.cast(pa.binary()).to_pylist():
        left = w.lstrip(SIGNS)
        inner = left.rstrip(SIGNS)
        core.append(digest(inner.lower()))
        signs = w[:len(w) - len(left)] + b" " + left[len(inner):]
        around.append(digest(signs, 1) if signs != b" " else 0)
    at = coded.indices.to_numpy(zero_copy_only=False)
    return np.asarray(core, np.uint64)[at], np.asarray(around, np.uint64)[at]


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, column, value) of the texts, sorted by row."""
    rows, words = word_lists(text)
    core, around = _word_codes(words)
    pair = rows[1:] == rows[:-1]
    a, b = core[:-1][pair], core[1:][pair]
    both = np.where(a == b, np.uint64(7), mix64(a * np.uint64(3) + b))
    signs = around != 0
    code = np.concatenate([mix64(core), mix64(around[signs]), mix64(both)]) >> np.uint64(64 - BITS)
    row = np.concatenate([rows, rows[signs], rows[1:][pair]])
    key, count = np.unique(row.astype(np.uint64) << np.uint64(BITS) | code, return_counts=True)
    row, column = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value ** 2, minlength=len(text)))
    return row, column, value / norm[row]


class Ftrl:
    """FTRL-Proximal logistic regression; the last weight is the constant's, without penalty."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.size = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1, l2 = np.where(at == self.size, 0.0, L1), np.where(at == self.size, 0.0, L2)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, self.size), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-float(np.clip(w @ x, -35, 35)))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _rows_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        row, column, value = features(part.column("text"))
        ends = np.searchsorted(row, np.arange(part.num_rows + 1))
        col = [column[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
        val = [value[a:b].astype("<f4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), pa.array(col, pa.binary()),
                                          pa.array(val, pa.binary())], names=["order", "label", "col", "val"])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["order"], r["label"], r["col"]))
    model = Ftrl(1 << BITS)
    for _ in range(EPOCHS):
        for r in rows:
            model.learn(np.frombuffer(r["col"], "<u4").astype(np.int64), np.frombuffer(r["val"], "<f4"), r["label"])
    w = model.weights(np.arange((1 << BITS) + 1)).astype("<f4")
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights fitted on about ``rows`` labelled documents (all, if there are
    fewer): those whose hash of the doc_id lies below a bound. ``labels``
    (doc_id, label) without null labels; the sample's size is bounded by
    ``rows``, which makes its broadcast and the one training task safe. Of the
    rows of one doc_id a single text teaches, the one with the least hash."""
    total = labels.count()
    scale = 1 << 30
    order = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    share = min(1.0, rows / max(total, 1))
    sample = labels.select("doc_id", "label", order.alias("order")).where(F.col("order") < int(share * scale))
    texts = docs.select(F.monotonically_increasing_id().alias("row_key"), docs["doc_id"].cast("long").alias("doc_id"),
                        docs["text"].alias("text"))
    one = texts.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "row_key")).alias("f"))
    taught = one.select("doc_id", F.col("f.row_key").alias("row_key")).join(F.broadcast(sample), "doc_id").drop("doc_id")
    vectors = (texts.join(F.broadcast(taught), "row_key").select("order", "label", "text")
               .mapInArrow(_rows_task, "order long, label int, col binary, val binary"))
    model = vectors.repartition(1).mapInArrow(_train_task, "weights binary").collect()
    return np.frombuffer(model[0]["weights"], "<f4") if model else np.zeros((1 << BITS) + 1, "<f4")


def _score_task(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for part in text_slices(batches):
            row, column, value = features(part.column("text"))
            dot = np.bincount(row, weights=w[column] * value, minlength=part.num_rows) + w[-1]
            score = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score)],
                                             names=["doc_id", "held_out", "score"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` doc_id and quality; other
    columns are not read. Rows of ``labels`` with a null, or whose CRC-32 of the
    doc_id is 0 modulo 5, teach nothing. A null or blank text is scored by the
    constant alone; a null doc_id is scored and not held out; repeated rows
    get equal scores; without any label all scores are 0.5; an empty table
    gives an empty result.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, known))     # a fixed 1 MB
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    scored = slim.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(
        _score_task(weights), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
