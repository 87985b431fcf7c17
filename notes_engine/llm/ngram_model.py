"""Linear classifiers over character n-grams, whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notes_engine.llm.common import dropped, let_go, stored

#: Orders of the n-grams, and the number of hash buckets (a power of two) that they fall into.
ORDERS = (3, 4, 5, 6)
BITS = 21
#: Documents added to each bucket's counts, divided as the classes are; and the standard errors by which a log-count ratio is drawn towards nought.
SMOOTHING = 2.0
ERRORS = 3.0
STEPS = 150
#: The power of the number of n-grams by which counts are divided: 0 sums up evidence, 1 averages it.
LENGTH_POWER = 0.25
#: Characters of the sample that one task fits on; the tasks' weights are averaged.
SHARD_CHARS = 4_000_000


def buckets_of(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The bucket of each n-gram of the whole text, in lower case, between two blanks, line ends as blanks."""
    code = np.frombuffer(f" {text.lower()} ".replace("\n", " ").encode("utf-32-le", "surrogatepass"), "<u4")
    found, power, size = [], code, 1
    for n in sorted(orders):
        if len(code) < n:
            break
        while size < n:  # a longer n-gram's hash goes on from the shorter one's
            power = power[:-1] * np.uint32(0x01000193) + code[size:]
            size += 1
        h = power + np.uint32(n)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append((h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class NgramModel:
    """Log-odds of each class against the first: bias + the weights of all n-grams of a text, divided by a power of their number."""

    weights: np.ndarray  # (classes - 1, buckets), float32
    bias: np.ndarray  # (classes - 1,)
    orders: tuple[int, ...] = ORDERS

    def __getstate__(self) -> dict:
        """What is sent to tasks: the buckets that have weights, which are few."""
        used = np.flatnonzero((self.weights != 0).any(axis=0)).astype(np.uint32)
        return {"shape": self.weights.shape, "used": used, "some": self.weights[:, used], "bias": self.bias, "orders": self.orders}

    def __setstate__(self, state: dict) -> None:
        by_bucket = np.zeros(state["shape"][::-1], np.float32)
        by_bucket[state["used"]] = state["some"].T
        self.__dict__.update(weights=by_bucket.T, bias=state["bias"], orders=state["orders"])  # one table: _by_bucket is the same

    @cached_property
    def _by_bucket(self) -> np.ndarray:
        """(buckets, classes - 1): a bucket's weights side by side, so that an n-gram is looked up once for all classes."""
        return np.ascontiguousarray(self.weights.T)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, classes)"""
        odds = np.empty((len(texts), len(self.bias)))
        for k, text in enumerate(texts):
            b = buckets_of(text, self.orders)
            found = self._by_bucket.take(b, axis=0)
            odds[k] = [found[:, c].sum(dtype=np.float64) for c in range(len(self.bias))]
            odds[k] = self.bias + odds[k] / max(1, len(b)) ** LENGTH_POWER
        return softmax(odds)


def softmax(odds: np.ndarray) -> np.ndarray:
    """(rows, classes) from log-odds against the first class."""
    z = np.concatenate((np.zeros((len(odds), 1)), odds), axis=1)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Features:
    """A sparse matrix of texts by buckets, and its products with vectors. Entries of no weight are left out; rows: ascending."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        some = values != 0
        self.rows, self.cols, self.values, self.shape = rows[some], cols[some], values[some].astype(float), shape
        self.starts = np.flatnonzero(np.diff(self.rows, prepend=-1))
        self.held = np.empty(len(self.rows))  # one place for the products of all entries

    def by_text(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        if len(self.rows):
            np.take(w, self.cols, out=self.held, mode="clip")
            self.held *= self.values
            out[self.rows[self.starts]] = np.add.reduceat(self.held, self.starts)
        return out

    def by_bucket(self, d: np.ndarray) -> np.ndarray:
        np.take(d, self.rows, out=self.held, mode="clip")
        self.held *= self.values
        return np.bincount(self.cols, self.held, self.shape[1])


def _fit_shard(texts: list[str], label: np.ndarray, weight: np.ndarray, ratios: np.ndarray, bias: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the buckets, and bias, by accelerated gradient steps on the softmax loss over features ratio * count / length^LENGTH_POWER.

    The step's size comes from the largest curvature at the start, which a few
    power iterations find, and is halved where the loss grows; the number of
    steps bounds the weights.
    """
    cols, values, bounds = [], [], [0]
    for text in texts:
        b, n = np.unique(buckets_of(text, orders), return_counts=True)
        size = max(1, n.sum()) ** LENGTH_POWER
        some = (ratios[:, b] != 0).any(axis=0)  # others have no weight
        cols.append(b[some])
        values.append((n[some] / size).astype(np.float32))
        bounds.append(bounds[-1] + len(cols[-1]))
    used, cols = np.unique(np.concatenate(cols), return_inverse=True)
    values, rows, others, n = np.concatenate(values), np.repeat(np.arange(len(texts)), np.diff(bounds)), len(bias), len(texts)
    features = [_Features(rows, cols, values * r[used][cols], (n, len(used))) for r in ratios]
    del rows, cols, values
    wanted = (label[:, None] == np.arange(1, others + 1)).astype(float)
    share = weight / weight.sum()
    curved = 0.0
    for c in range(others):
        spread = share * max((share * wanted[:, c]).sum() * (1 - (share * wanted[:, c]).sum()), 1e-3)
        x = np.abs(features[c].by_bucket(share)) + 1e-12
        for _ in range(6):
            x /= np.linalg.norm(x)
            x = features[c].by_bucket(spread * features[c].by_text(x)) + 1e-12
        curved = max(curved, float(np.linalg.norm(x)))
    step = 1 / (curved + 0.25)
    w, bias = np.zeros((others, len(used))), bias.astype(float)
    ahead, bias_ahead, pace, before = w, bias, 1.0, np.inf
    for _ in range(STEPS):
        odds = np.stack([features[c].by_text(ahead[c]) for c in range(others)], axis=1) + bias_ahead
        p = softmax(odds)
        loss = -(share * np.log(np.maximum(p[np.arange(n), label], 1e-12))).sum()
        if loss > 1.02 * before:  # too far: go back, with smaller steps
            step, ahead, bias_ahead, pace = step / 2, w, bias, 1.0
            before = np.inf
            continue
        before = loss
        off = share[:, None] * (p[:, 1:] - wanted)
        to = ahead - step * np.stack([features[c].by_bucket(off[:, c]) for c in range(others)])
        bias_to = bias_ahead - step * off.sum(axis=0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, bias_ahead = to + (pace - 1) / faster * (to - w), bias_to + (pace - 1) / faster * (bias_to - bias)
        w, bias, pace = to, bias_to, faster
    out = np.zeros_like(ratios)
    out[:, used] = w * ratios[:, used]
    return out, bias


def _ratio(own: np.ndarray, own_docs: float, first: np.ndarray, first_docs: float) -> np.ndarray:
    """Log-count ratios of a class to the first, by bucket: the bound, ERRORS standard errors from the estimate, that is nearer to nought."""
    part = own_docs / max(own_docs + first_docs, 1)
    if not 0 < part < 1:
        return np.zeros(len(own), np.float32)
    p, q = own.astype(np.float32) + np.float32(SMOOTHING * part), first.astype(np.float32) + np.float32(SMOOTHING * (1 - part))
    ratio = np.log(p / np.float32(part)) - np.log(q / np.float32(1 - part))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - np.float32(ERRORS) * np.sqrt(1 / p + 1 / q))


def fit_ngram_model(sample: DataFrame, classes: int, orders: tuple[int, ...] = ORDERS) -> NgramModel:
    """A model from a bounded sample (text, label, weight), labels from 0 to classes - 1.

    weight: how many documents a sampled one stands for. First pass: in how many
    documents of each class a bucket is; from that, for all buckets, the
    log-count ratio of each class to the first. Second pass: each task fits
    weights on its part of the sample, of SHARD_CHARS or one text, and they are
    averaged. What the driver gets is bounded by the sample: one compressed
    vector a task and class. Null texts: empty. Very long texts: memory of a
    task in proportion. No rows of some class: its probability is nought, or
    where no class has rows, all are alike.
    """
    none = NgramModel(np.zeros((classes - 1, 1 << BITS), np.float32), np.zeros(classes - 1), orders)
    rows = stored(sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"), F.col("weight").cast("double")), "sample")
    told = {r.label: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum("weight").alias("weight"), F.sum(F.length("text")).alias("chars")).collect()}
    if not told:
        dropped(rows)
        return none
    docs = np.array([told[c].docs if c in told else 0 for c in range(classes)], float)
    total = np.array([told[c].weight if c in told else 0.0 for c in range(classes)])
    bias = np.log(np.maximum(total[1:], 1e-9) / max(total[0], 1e-9))
    shards = max(4, -(-sum(r.chars for r in told.values()) // SHARD_CHARS))
    dealt = rows.repartition(int(shards))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((classes, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label][np.unique(buckets_of(text, orders))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["counts"])
        del counts
        let_go()

    counts = np.zeros((classes, 1 << BITS), np.int32)
    for r in dealt.select("text", "label").mapInArrow(counted, "counts binary").collect():
        counts += np.frombuffer(zlib.decompress(r.counts), np.int32).reshape(classes, -1)
    ratios = np.stack([_ratio(counts[c], docs[c], counts[0], docs[0]) for c in range(1, classes)])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label, weight = [], [], []
        for batch in batches:
            for held, column in zip((texts, label, weight), batch.columns, strict=True):
                held += column.to_pylist()
        if texts:
            w, own = _fit_shard(texts, np.array(label), np.array(weight), ratios, bias, orders)
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int64()), pa.array([zlib.compress(w.tobytes(), 1)], pa.binary()), pa.array([own.tobytes()], pa.binary())], names=["docs", "weights", "bias"])
            del texts, w
        let_go()

    del counts
    weights, means, n = np.zeros((classes - 1, 1 << BITS)), np.zeros(classes - 1), 0
    for r in dealt.mapInArrow(fitted, "docs long, weights binary, bias binary").collect():
        weights += r.docs * np.frombuffer(zlib.decompress(r.weights), np.float32).reshape(classes - 1, -1)
        means += r.docs * np.frombuffer(r.bias)
        n += r.docs
    dropped(rows)
    return NgramModel((weights / n).astype(np.float32), means / n, orders)


def sample_by_class(labelled: DataFrame, *, id_col: str, label_col: str, classes: int, most: int) -> DataFrame:
    """At most `most` ids of each class, those of the least hashes: id, label, weight (class size over ids taken). Bounded by classes * most rows."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = None
    for c in range(classes):
        n = sizes.get(c, 0)
        part = labelled.where(F.col(label_col) == c).orderBy(F.xxhash64(id_col), id_col).limit(most)
        part = part.select(id_col, F.lit(c).alias("label"), F.lit(n / max(1, min(n, most))).alias("weight"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
