"""A quality classifier learned from trusted positives and unlabelled text (positive-unlabelled learning).

Labels of bad documents are never used. With pi the share of good documents, l(z) = log(1 + exp(-z)) the logistic loss, P the
mean over positives and U over unlabelled text, the risk of a scorer z is

    pi * P l(z)  +  max(0, U l(-z) - pi * P l(-z)),

whose second term estimates what the bad ones among the unlabelled cost; it is kept from going below zero, where a
flexible scorer would only fit noise: a step that finds it below climbs out of there instead (the non-negative unbiased risk).

pi is estimated from the data: a first scorer tells P from U; of all texts, counted in BINS bins of its score, the upper
tail of U can hold no fewer than pi times the upper tail of P, so the least ratio of the tails, with a margin for chance, is the estimate.

A document is its character statistics: shares of character classes, word lengths, repetition of words and lines, and hashed shares of
neighbouring byte classes, all of its whole text. Scorers are fitted on at most POSITIVES and UNLABELLED documents
that a hash of the id picks (fewer if there are fewer), so the driver holds a bounded matrix whatever the corpus; tails and scores cover every text.
Nothing but ids, labels and one bin a document is shuffled.

Edge cases: null and empty texts are scored like any other, by statistics of zero; an id with contradicting labels is not trusted; repeated rows are
scored alike and count as often as they occur; without any trusted positive every score is 0.5; very long
texts are batches of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.staging import staged, unstage
from granary.llm.text import SPACE, grams, slices, spans_hash, utf8, words

POSITIVES, UNLABELLED = 3000, 6000
BINS = 2048
STEPS, RATE, DECAY = 300, 0.05, 1e-4
_CLASSES = 24
PAIR_BUCKETS = _CLASSES * _CLASSES
N_STATS = 16


def _byte_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, lead and continuation bytes, and each frequent sign its own."""
    out = np.full(256, 23, np.int64)
    out[128:192], out[192:] = 0, 1
    out[65:91], out[97:123], out[48:58] = 2, 3, 4
    out[SPACE] = 5
    out[10] = 6
    for i, sign in enumerate(b".,;:!?'\"()-/#$%&"):
        out[sign] = 7 + i
    return out


_CLASS = _byte_classes()


def features(text) -> np.ndarray:
    """The statistics of each text of an Arrow column."""
    data, off = utf8(text)
    rows = len(off) - 1
    s, e, first = words(data, off)
    size, n = np.diff(off), np.diff(first)
    owner = np.repeat(np.arange(rows), size)
    kind = _CLASS[data]
    pair = np.zeros(len(data), np.int64)
    pair[1:] = kind[:-1] * _CLASSES + kind[1:]
    inner = np.ones(len(data), bool)
    inner[off[:-1][size > 0]] = False
    pairs = np.bincount(owner[inner] * PAIR_BUCKETS + pair[inner], minlength=rows * PAIR_BUCKETS).reshape(rows, PAIR_BUCKETS)
    pairs = np.sqrt(pairs / np.maximum(size, 1)[:, None])
    length = e - s
    ends = np.zeros((4, len(s)), bool)  # how words begin and end
    if len(s):
        head, tail = data[s], data[e - 1]
        sign = ~(((tail >= 48) & (tail < 58)) | ((tail | 32) >= 97) & ((tail | 32) < 123) | (tail >= 128))
        ends[0] = sign & ~np.isin(tail, np.frombuffer(b".,;:", np.uint8))
        ends[1], ends[2] = (head >= 65) & (head < 91), sign
        ends[3] = length == 1
    hashes = spans_hash(data, s, e)
    per_word = np.maximum(n, 1)

    def share(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[first]) / per_word

    distinct, top, trigram, lines = (np.zeros(rows) for _ in range(4))
    for r in range(rows):
        h = hashes[first[r] : first[r + 1]]
        if len(h):
            _, times = np.unique(h, return_counts=True)
            distinct[r], top[r] = len(times) / len(h), times.max() / len(h)
            three = grams(h, 3)
            trigram[r] = len(np.unique(three)) / max(len(three), 1)
        lines[r] = np.count_nonzero(data[off[r] : off[r + 1]] == 10)
    same = np.zeros(len(s))
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][(n > 0)]] = 0
    stats = [
        np.log1p(size), np.log1p(n), share(length), np.sqrt(np.maximum(share(length.astype(np.float64) ** 2) - share(length) ** 2, 0)), *(share(x) for x in ends), share(same),
        distinct, top, trigram, np.log(np.maximum(n, 1)) * distinct, np.log1p(lines) / np.maximum(np.log1p(n), 1), (n < 20).astype(float), (n == 0).astype(float),
    ]
    return np.concatenate([np.stack(stats, 1), pairs], 1).astype(np.float32)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive and the negative part of the unbiased risk, and the gradient of the non-negative one for each score.

    Where the negative part is below zero its own gradient is turned round and the positive part's left out."""
    loss = np.logaddexp
    positive = prior * loss(0, -z_p).mean()
    negative = loss(0, z_u).mean() - prior * loss(0, z_p).mean()
    of_p, of_u = -prior * _sigmoid(z_p) / len(z_p), _sigmoid(z_u) / len(z_u)
    if negative >= 0:
        return positive, negative, of_p - prior * _sigmoid(-z_p) / len(z_p), of_u
    return positive, negative, -of_p, -of_u


def train(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Scorer:
    """A linear scorer by Adam on the non-negative risk; with no prior it tells positives from unlabelled text."""
    both = np.concatenate([positives, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positives, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    one, two = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z_p, z_u = p @ w + b, u @ w + b
        if prior is None:
            g_p, g_u = -0.5 * _sigmoid(-z_p) / len(p), 0.5 * _sigmoid(z_u) / len(u)
        else:
            _, _, g_p, g_u = risk(z_p, z_u, prior)
        g = np.append(g_p @ p + g_u @ u + DECAY * w, g_p.sum() + g_u.sum())
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        move = RATE / (1 + 0.02 * step) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Scorer(mean, scale, w, b, 0.5 if prior is None else prior)


def tail_ratio(positive: np.ndarray, unlabelled: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """The share of positives in unlabelled text, from counts of both by bin of a score that rises with being positive:
    the ratio of the upper tails where it is least, counting in what chance may add."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    p, u = positive[::-1].cumsum() / n_p, unlabelled[::-1].cumsum() / n_u
    some = p > 0
    chance = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p)))
    at = ((u[some] + chance) / p[some]).argmin()
    return float(np.clip(u[some][at] / p[some][at], 0.01, 0.99))


def _place(key: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _matrix(docs: DataFrame, text: str, most: int) -> np.ndarray:
    """The features, computed in tasks, of the ``most`` documents of the smallest place."""

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, text):
                x = features(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("place")), pa.array([r.tobytes() for r in x], pa.binary())], ["place", "x"])

    rows = docs.select("place", text).mapInArrow(kernel, "place double, x binary").orderBy("place", "x").limit(most).collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), N_STATS + PAIR_BUCKETS)


def fit(docs: DataFrame, labels: DataFrame, train_row: Column, key: str = "doc_id", text: str = "text", good: str = "quality") -> Scorer | None:
    """A scorer from the rows for which ``train_row`` (an expression of the key) holds; None without trusted positives."""
    learned = labels.where(F.col(key).isNotNull() & train_row).groupBy(F.col(key).alias("l")).agg(F.min(F.coalesce(F.col(good), F.lit(0))).alias("g"))
    trusted = staged(learned.where("g = 1").select("l"), "trusted")
    texts = docs.select(key, text).where(F.coalesce(train_row, F.lit(False)))
    n_p, n_u = trusted.count(), texts.count()
    # A threshold leaves little more than the bound, so few texts are moved or read for the top of them.
    picked = trusted.withColumn("place", _place(F.col("l"), 21)).where(F.col("place") < min(1.0, 1.1 * POSITIVES / max(n_p, 1)))
    p = _matrix(texts.join(F.broadcast(picked.orderBy("place").limit(POSITIVES)), F.col(key) == F.col("l")), text, POSITIVES)
    # Rows alike in id and text are alike in place, so a repeated row is picked as often as it occurs.
    place = _place(F.struct(F.col(key), F.xxhash64(text)), 22)
    u = _matrix(texts.withColumn("place", place).where(F.col("place") < min(1.0, 1.1 * UNLABELLED / max(n_u, 1))), text, UNLABELLED)
    if not len(p) or not len(u):
        return None
    first = train(p, u, None)

    def bins(batches):
        for batch in batches:
            for part in slices(batch, text):
                z = first(features(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(np.minimum(z * BINS, BINS - 1).astype(np.int32))], ["id", "bin"])

    binned = texts.mapInArrow(bins, f"id {docs.schema[key].dataType.simpleString()}, bin int")
    # Ids compress so well that the planner would take a long table of them for a small one and broadcast it.
    tails = binned.join(trusted.hint("merge"), F.col("id") == F.col("l"), "left").groupBy("bin").agg(F.count("*").alias("u"), F.count("l").alias("p"))
    count_p, count_u = np.zeros(BINS), np.zeros(BINS)
    for r in tails.collect():  # a row a bin
        count_p[r["bin"]], count_u[r["bin"]] = r["p"], r["u"]
    unstage(trusted)
    return train(p, u, tail_ratio(count_p, count_u))


def score(docs: DataFrame, scorer: Scorer | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with score and predicted of every row's whole text."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    if scorer is None:
        return docs.select(*keep, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, text):
                z = scorer(features(part.column(part.schema.get_field_index(text)))).astype(np.float64)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(z), pa.array((z >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(kernel, schema)
