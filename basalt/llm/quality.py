"""Quality rules: counted base rules and a calibrated classifier.

The classifier is a logistic regression over hashed word and character
n-grams: words and pairs of words, and n-grams of 3 and 4 bytes, each family
scaled to sum to one. It is fitted on a bounded sample of labelled documents,
at most ``per_class`` of each quality, those with the least hash of doc_id; a fifth of
the sample is held out to calibrate probabilities (Platt's method), with the
classes weighted by their numbers among all labels. Every text is scored
whole, in Arrow batches, against a fixed threshold.

Defined results: a null or empty text has no words and fails the base rules;
labels with null doc_id or quality are not used, repeated labels count once,
and those that contradict each other not at all; of repeated documents the
least text is fitted on; with fewer than two classes labelled the classifier passes every
document with probability 1; repeated rows give repeated rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import small_batches

#: Fixed limits of the base rules and of the verdict.
MIN_WORDS, MAX_REPEATED_PERCENT, MIN_PROBABILITY = 50, 50, 0.5
#: Labelled documents of each class that are fitted on; buckets of the hashed features.
PER_CLASS, BITS = 1000, 16
SIZE = 1 << BITS
CACHE = 150_000
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Bytes that begin a code point.
_STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_IS_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_IS_SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])


class Words:
    """Numbers and hashes of words, remembered by a Python worker."""

    def __init__(self):
        self.hashes: dict[bytes, int] = {}

    def get(self, words: list[bytes]) -> np.ndarray:
        for w in set(words).difference(self.hashes):
            if len(self.hashes) >= CACHE:
                self.hashes = {x: self.hashes[x] for x in words if x in self.hashes}
            self.hashes[w] = zlib.crc32(w) | zlib.adler32(w) << 32
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = np.frombuffer(raw, np.uint8)
    chars = int((_STARTS[b] & ~_IS_SPACE[b]).sum())
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    repeated = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        n = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        key = n[:-2] * len(ids) + n[1:-1]
        if len(ids) >= 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
        _, inverse, count = np.unique(key * len(ids) + n[2:], return_inverse=True, return_counts=True)
        often, hit = count[inverse] > 1, np.zeros(len(words), bool)
        for i in range(3):
            hit[i : i + len(often)] |= often
        repeated = int(hit.sum())
    return chars, int(_IS_SYMBOL[b].sum()), len(lines) - len(set(lines)), repeated


def _slots(h: np.ndarray, seed: int) -> np.ndarray:
    return (((h + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def families(raw: bytes, words: list[bytes], memory: Words) -> list[np.ndarray]:
    """Buckets of the word features and of the character features."""
    w = memory.get(words)
    pairs = w[:-1] * np.uint64(31) + w[1:]
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    three = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)
    four = three[:-1] | b[3:] << np.uint64(24) if len(b) > 3 else three[:0]
    return [np.concatenate([_slots(w, 1), _slots(pairs, 2)]), np.concatenate([_slots(three, 3), _slots(four, 4)])]


class Classifier:
    """Weights by bucket for the two families, bias, and the calibration's slope and offset."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0, slope: float = 1.0, offset: float = 50.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, fam: list[np.ndarray]) -> float:
        if self.weights is None:
            return 1.0
        z = self.bias + sum(float(self.weights[k][f].mean()) for k, f in enumerate(fam) if len(f))
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -500, 500))))


def _train(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, fold: np.ndarray, prior: dict[int, int]) -> Classifier:
    """Logistic regression with AdaGrad steps over all rows of the fitted folds, then Platt's calibration."""
    n, use = len(y), ~fold
    if len(set(y[use])) < 2:
        return Classifier()
    w, b, g2, gb = np.zeros(2 * SIZE), 0.0, np.full(2 * SIZE, 1e-8), 1e-8
    share = np.array([(y[use] == 0).mean(), (y[use] == 1).mean()])
    sample = np.where(use, 0.5 / share[y], 0) / use.sum()
    for _ in range(60):
        z = np.bincount(rows, vals * w[cols], n) + b
        err = sample * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.bincount(cols, vals * err[rows], 2 * SIZE) + 1e-9 * w
        g2 += grad**2
        gb += err.sum() ** 2
        w -= 1.0 * grad / np.sqrt(g2)
        b -= 0.5 * err.sum() / np.sqrt(gb)
    z = np.bincount(rows, vals * w[cols], n) + b
    test = fold if len(set(y[fold])) == 2 else use
    zt, yt = z[test], y[test]
    weight = np.where(yt == 1, prior[1] / max(1, (yt == 1).sum()), prior[0] / max(1, (yt == 0).sum()))
    weight = weight / weight.sum()
    positive, negative = (yt == 1).sum(), (yt == 0).sum()
    target = np.where(yt == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Newton's method on two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * zt + offset, -500, 500)))
        d, h = weight * (p - target), weight * p * (1 - p) + 1e-12
        grad = np.array([(d * zt).sum() + 1e-6 * slope, d.sum()])
        hess = np.array([[(h * zt * zt).sum() + 1e-6, (h * zt).sum()], [(h * zt).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-9:
            break
    return Classifier(w.reshape(2, SIZE).astype(np.float32), b, max(float(slope), 1e-3), float(offset))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier:
    """Fit on at most ``per_class`` labelled documents of each quality."""
    spark = docs.sparkSession
    small_batches(spark)
    lab = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    lab = lab.filter("quality = other").select("doc_id", F.col("quality").cast("int").alias("quality"))
    prior = {0: 0, 1: 0} | {r[0]: r[1] for r in lab.groupBy("quality").count().collect()}
    if not all(prior.values()):
        return Classifier()
    first = lambda q: lab.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = first(0).union(first(1)).withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(5)) == 0)

    def features(batches):
        memory = Words()
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                raw = (text or "").encode()
                f = families(raw, raw.split(), memory)
                got = [np.unique(x, return_counts=True) for x in f]
                out.append((np.concatenate([got[0][0], got[1][0] + SIZE]).astype("<i4").tobytes(), np.concatenate([g[1] / max(1, len(x)) for g, x in zip(got, f, strict=True)]).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), b.column(1), b.column(2)], ["cols", "vals", "quality", "fold"])

    # The chosen labels are bounded by 2 * per_class rows, so they are sent to every executor.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "fold").agg(F.min("text").alias("text")).select("text", "quality", "fold")
    got = rows.mapInArrow(features, "cols binary, vals binary, quality int, fold boolean").collect()
    got.sort(key=lambda r: (r[2], bytes(r[0]), bytes(r[1])))
    if not got:
        return Classifier()
    cols, vals = [np.frombuffer(r[0], "<i4") for r in got], [np.frombuffer(r[1], "<f4") for r in got]
    index = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    return _train(index, np.concatenate(cols), np.concatenate(vals).astype(float), np.array([r[2] for r in got]), np.array([r[3] for r in got]), prior)


def score(docs: DataFrame, model: Classifier, threshold: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]

    def run(batches):
        memory, m = Words(), sent.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                words = raw.split()
                n, counts = len(words), base_counts(raw, words)
                failed = n < MIN_WORDS or 100 * counts[3] > MAX_REPEATED_PERCENT * n
                p = m.probability(families(raw, words, memory))
                rows.append((n, *counts, failed, p, not failed and p >= threshold))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fitted on the labelled documents, every document scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model)
