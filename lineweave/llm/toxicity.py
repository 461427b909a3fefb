"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import byte_values, cut, drop, mix64, pieces, prefix_hash, span_hash, utf8
from lineweave.llm.ftrl import Ftrl

#: Bits of the feature space, labelled rows that are learned from at most (about: they are chosen by hash), passes over them.
BITS, SAMPLE, PASSES = 20, 8_000, 5
#: Distances between the two words of a feature: 1 is a bigram, more are skip-grams.
REACH = (1, 2, 3)
RATE, L1, L2 = 1.0, 6.0, 0.1

# Bytes of a word: small letters after lower-casing, digits, and all beyond ASCII
_PART = np.zeros(256, bool)
_PART[48:58] = _PART[97:123] = _PART[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words, bigrams and skip-grams of all texts, repeats included."""
    data = _LOWER[data]
    inside = _PART[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    some = off[:-1] < off[1:]
    start[off[:-1][some]] = inside[off[:-1][some]]
    end[off[1:][some] - 1] = inside[off[1:][some] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(off, s, side="right") - 1
    h = span_hash(prefix_hash(byte_values(data)), s, e)
    rows, keys = [row], [h]
    for k in REACH:
        if len(s) > k:
            same = row[k:] == row[:-k]
            rows.append(row[:-k][same])
            keys.append(mix64(h[:-k][same] * np.uint64(3) + np.uint64(k) + mix64(h[k:][same])))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * (1 << BITS) + buckets)
    return both >> BITS, both & ((1 << BITS) - 1)


def train(examples: DataFrame) -> np.ndarray:
    """Weights of a few thousand examples (doc_id, text, label): the sparse weights, in float32, with the bias last.

    Texts become features where they lie; one task takes the examples in the order of a hash and makes the steps. The
    number of examples is bounded by the caller. Without examples of both labels the score is the same for all texts.
    """

    def featurize(batches):
        for b in batches:
            data, off = utf8(b.column("text"))
            found = []
            for i, j in pieces(off):
                row, bucket = distinct(*features(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                at = np.searchsorted(row, np.arange(j - i + 1))
                found += [bucket[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("label"), pa.array(found, pa.binary())], ["order", "label", "features"])

    def fit(batches):
        model = Ftrl(1 << BITS, 1, RATE, 1.0, L1, L2)
        rows = [(k, y, np.frombuffer(x, "<u4").astype(np.int32)) for b in batches for k, y, x in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: r[:2])
        for _ in range(PASSES):
            for _, y, x in rows:
                model.step(x, 1.0, y)
        w = model.weights()[:, 0].astype(np.float32)
        keep = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1), pa.int64()), pa.array(np.append(w[keep], model.bias).astype(np.float32), pa.float32())], ["bucket", "weight"])

    rows = examples.select(F.xxhash64("doc_id").alias("order"), F.col("label").cast("int").alias("label"), "text")
    # rows of features meet in one task: their number is bounded
    fitted = rows.mapInArrow(featurize, "order long, label int, features binary").repartition(1).mapInArrow(fit, "bucket long, weight float").toArrow()
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[fitted["bucket"].to_numpy()] = fitted["weight"].to_numpy()
    return out


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of each row: the model's probability that the whole text is toxic. Null and empty texts get the
    bias alone; doc_id may be null or repeat; other columns are not looked at."""
    keep = np.flatnonzero(weights[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((keep, weights[keep], float(weights[-1])))  # at most 2^20 weights, few of them not zero

    def run(batches):
        keep, values, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[keep] = values
        for b in batches:
            data, off = utf8(b.column("text"))
            total = np.full(b.num_rows, bias, np.float64)
            for i, j in pieces(off):
                row, bucket = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                use = w[bucket] != 0
                row, bucket = distinct(row[use], bucket[use])
                total[i:j] += np.bincount(row, w[bucket].astype(np.float64), minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def remainder(key: str, by: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    Learns from about `sample` labelled rows at most, chosen by a hash of doc_id among those whose crc32 fold isn't the
    held one. Null texts and empty ones get the bias; rows with a null doc_id are scored and not held out; labels that
    are null are left out; a doc_id labelled twice counts by its largest label, one with several texts learns from the least.
    Other columns of docs are not looked at.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(remainder("doc_id", folds) != held).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    n = known.count()
    share = min(1.0, sample / n) if n else 1.0
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) < F.lit(int(share * (1 << 53))))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about `sample` small rows, each doc_id once
    examples = cut(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    weights = train(examples)
    drop(examples)
    out = scored(docs, weights)
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
