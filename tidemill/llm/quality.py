"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as a sparse dot product.

A text is cut into words and punctuation runs. Features are the items themselves,
their pairs, and pairs and triples of their shapes (case, digits, punctuation as it
is), each hashed into one weight vector; a text's value for a feature is its share
of all features, so length does not matter and whole texts count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import documents, hash_sample, id_and_text, own_worker, prepare, small_batches, within

BITS = 18
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_ITEM = re.compile(r"\w+|[^\w\s]+")


def shape(item: str) -> str:
    if item.isdigit():
        return "9"
    if item.isalpha():
        return "a" if item.islower() else "A" if len(item) > 1 and item.isupper() else "Aa" if item[0].isupper() and item[1:].islower() else "aA"
    return "a9" if item[0].isalnum() else item[:4]


class Hashes:
    """Item -> hashes of the item and of its shape; emptied when it holds more items or
    characters than it may, so that a batch's own come on top of that at most."""

    def __init__(self, capacity: int = 400_000, characters: int = 16_000_000):
        self.capacity, self.characters, self.held = capacity, characters, 0
        self.row, self.item, self.shape = {}, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def rows(self, items: list[str]) -> np.ndarray:
        new = list(set(items).difference(self.row))
        if new:
            if len(self.row) + len(new) > self.capacity or self.held > self.characters:
                self.__init__(self.capacity, self.characters)
                new = list(set(items))
            at = len(self.row)
            self.held += sum(map(len, new))
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
            crc = lambda texts: np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in texts], np.uint64)
            self.item = np.concatenate([self.item, crc([x.lower() for x in new])])
            self.shape = np.concatenate([self.shape, crc(["\0" + shape(x) for x in new])])
        return np.fromiter(map(self.row.__getitem__, items), np.int64, len(items))


def _fold(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS - 8)) & np.uint64((1 << BITS) - 1)


def features(text: str, hashes: Hashes) -> np.ndarray:
    """The feature numbers of a whole text, repeated as often as they occur."""
    rows = hashes.rows(_ITEM.findall(text))
    if not len(rows):
        return np.zeros(0, np.int64)
    w, s = hashes.item[rows], hashes.shape[rows]
    found = [_fold(w), _fold(w[:-1], w[1:]), _fold(s), _fold(s[:-1], s[1:]), _fold(s[:-2], s[1:-1], s[2:])]
    return np.concatenate(found).astype(np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 5, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.002) -> np.ndarray:
    """Weights (the last one is the bias) from rows of (features, values, label) by
    per-coordinate FTRL-proximal updates, in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, value, label in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def _values(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(found, return_counts=True)
    return np.append(at, 1 << BITS), np.append(count * (10.0 / max(1, len(found))), 1.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 32_000_000) -> np.ndarray:
    """Train on labelled documents outside the held-out fold: max_rows at most, those
    with the smallest hash of the id, and of these as many as have max_chars characters
    together. These bounds are what makes fitting on the driver safe.

    A document labelled twice counts once with its larger label; of rows that share an
    id one text counts, that with the smallest hash. Without any labelled document all
    weights are zero."""
    spark = docs.sparkSession
    labelled = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    texts = id_and_text(docs).withColumn("key", F.xxhash64("text"))
    sizes = texts.join(F.broadcast(hash_sample(labelled, ["doc_id"], max_rows)), "doc_id")
    sizes = sizes.groupBy("doc_id", "label").agg(F.min(F.struct("key", F.length("text").alias("chars"))).alias("one")).select("doc_id", "label", "one.*").collect()
    rows = sorted(sizes, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    chosen = [(r["doc_id"], r["label"], r["key"]) for r in within(rows, max_chars, lambda r: r["chars"])]
    texts = texts.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int, key long")), ["doc_id", "key"]).dropDuplicates(["doc_id"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small_batches(it):
            pairs = [_values(features(t, hashes)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a.astype(np.int32) for a, _ in pairs], pa.list_(pa.int32())), pa.array([v for _, v in pairs], pa.list_(pa.float64()))], ["doc_id", "label", "at", "value"])

    found = texts.select("doc_id", "label", "text").mapInArrow(batches, "doc_id long, label int, at array<int>, value array<double>").toArrow()
    rows = list(zip(found["doc_id"].to_pylist(), found["at"].to_numpy(), found["value"].to_numpy(), found["label"].to_pylist(), strict=True))
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return train([(a.astype(np.int64), v, y) for _, a, v, y in rows]).astype(np.float32)


def held_out(folds: int, fold: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def score_documents(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; narrow.

    Null and empty texts are scored by the bias alone; long ones count whole. A null
    doc_id is in no fold (held_out false); repeated rows are scored each; other columns
    are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # fixed size: 2**BITS + 1 floats

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("quality", lambda: None)
        hashes, w = Hashes(), shared.value
        for batch in small_batches(it):
            out = []
            for text in batch.column("text").to_pylist():
                found = features(text, hashes)
                x = float(w[-1]) + (10.0 * float(w[found].sum(dtype=np.float64)) / len(found) if len(found) else 0.0)
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))
            scores = np.array(out, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = id_and_text(docs).withColumn("held_out", F.coalesce(held_out(5, 0), F.lit(False)))
    return rows.mapInArrow(batches, SCHEMA)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prepare(spark)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
