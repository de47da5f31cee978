"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader.

Features of a text: word one- and two-grams (lower-cased letters and digits), one- and two-grams of
its punctuation runs, and the shapes of its words (capital, small, digit), all hashed into 2**BITS
weights; a feature's value is 1 + log of its count, and texts are scaled to length 1. The score is the
sparse dot product with the weights, squashed.

Training reads at most TRAIN_ROWS labelled rows, those first by a hash of doc_id, EPOCHS times, as
a stream through one task whose memory is the weights. Everything else reads all documents.

A null or empty text has the bias alone as its score. Labels that are null or of no document are left out;
a document that comes twice in labels is learned from twice. Without labels the score is 0.5. Each row gives a row;
other columns are kept by filter_quality(), whatever their names: scored() puts its column last, and where a kept one is called
quality_score its name gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.llm.common import BLANKS, LOWER, NOT_ALNUM, buffers, crc_mod, free, mix, need, packed, table
from quiverlake.llm.common import _words as split_words

BITS = 18
TRAIN_ROWS = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

#: Letters, digits and blanks part runs of punctuation.
NOT_PUNCTUATION = ~NOT_ALNUM | BLANKS
NOT_PUNCTUATION[65:91] = True
NOT_PUNCTUATION[97:123] = True
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97
CHUNK = 1 << 19


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For a run lo..hi of texts: document (from lo), feature and value, ordered by document; every text is in a run."""
    at, data = buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = min(max(int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1, lo + 1), n)
        raw, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        keys = []
        for salt, blanks, fold, pairs in ((1, NOT_ALNUM, LOWER, True), (2, NOT_PUNCTUATION, LOWER, True), (3, BLANKS, SHAPE, False)):
            w = split_words(raw, own, 0, lo, hi, blanks, fold)
            if not len(w.doc):
                continue
            one = mix(w.hash + np.uint64(salt))
            keys.append(w.doc.astype(np.uint64) << np.uint64(BITS) | one >> np.uint64(64 - BITS))
            if pairs and len(w.doc) > 1:
                same = w.doc[1:] == w.doc[:-1]
                two = mix(w.hash[:-1] * np.uint64(31) + w.hash[1:] + np.uint64(salt + 8))[same]
                keys.append(w.doc[1:][same].astype(np.uint64) << np.uint64(BITS) | two >> np.uint64(64 - BITS))
        if keys:
            found = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            count = np.diff(np.append(first, len(found)))
            found = found[first]
            doc = (found >> np.uint64(BITS)).astype(np.int64)
            value = 1 + np.log(count)
            norm = np.sqrt(np.bincount(doc, value * value, minlength=hi - lo))
            yield lo, hi, doc, (found & np.uint64((1 << BITS) - 1)).astype(np.int64), value / norm[doc]
        else:
            yield lo, hi, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        lo = hi


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed, limit: int) -> DataFrame:
    """doc_id, y, text of at most limit labelled rows of which allowed holds, first by hash."""
    need(labels, "doc_id", label)
    picked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(allowed & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    picked = picked.withColumn("turn", F.xxhash64("doc_id", "y")).orderBy("turn", "doc_id", "y").limit(limit)
    # at most `limit` rows of three numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turn, y, index, value = [], [], [], []
        for lo, hi, doc, f, v in features(batch.column("text")):
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                turn.append(batch.column("turn")[lo + i].as_py())
                y.append(batch.column("y")[lo + i].as_py())
                index.append(packed(f[cut[i] : cut[i + 1]], "<u4"))
                value.append(packed(v[cut[i] : cut[i + 1]], "<f4"))
        yield pa.RecordBatch.from_pydict({"turn": pa.array(turn, pa.int64()), "y": pa.array(y, pa.int32()), "index": pa.array(index, pa.binary()), "value": pa.array(value, pa.binary())})


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2; the last weight is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.seen = [1, 1]

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        i, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(i)
        self.seen[y] += 1
        balance = sum(self.seen) / (2 * self.seen[y])  # the rarer label counts as much as the other
        g = balance * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        rate = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - rate * w
        self.n[i] += g * g


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl(1 << BITS)
    for batch in batches:
        for y, index, value in zip(*(batch.column(c).to_pylist() for c in ("y", "index", "value")), strict=True):
            model.learn(np.frombuffer(index, "<u4"), np.frombuffer(value, "<f4").astype(float), y)
    yield pa.RecordBatch.from_pydict({"weights": pa.array([packed(model.weights(), "<f4")], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> np.ndarray:
    """Weights, the bias last: 2**BITS + 1 numbers, the only thing that the driver gets."""
    rows = sample(docs, labels, "quality", crc_mod("doc_id", FOLDS) != HELD_OUT, limit)
    seen = rows.select("turn", "y", "text").mapInArrow(_featured, "turn long, y int, index binary, value binary")
    order = seen.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).repartition(1).sortWithinPartitions("epoch", F.xxhash64("turn", "epoch"), "turn")
    got = order.select("y", "index", "value").mapInArrow(_trained, "weights binary").first()
    return np.frombuffer(got[0], "<f4").astype(float) if got else np.zeros((1 << BITS) + 1)


def _scored(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            logit = np.full(batch.num_rows, w[-1])
            for lo, hi, doc, f, v in features(batch.column("text")):
                logit[lo:hi] += np.bincount(doc, v * w[f], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return run


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """keep, text and quality_score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    chosen = docs.select(*dict.fromkeys([*keep, "text"]))
    name = free("quality_score", chosen.columns)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in chosen.schema), T.StructField(name, T.DoubleType())])
    return chosen.mapInArrow(_scored(held, name), schema)


def filter_quality(docs: DataFrame, labels: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The rows of docs, in its own columns, that score THRESHOLD or more; reference: documents to learn from."""
    found = scored(docs, train(docs if reference is None else reference, labels), docs.columns)
    return found.where(F.col(found.columns[-1]) >= THRESHOLD).select(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    score = F.col("quality_score")
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
