"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes, all of it. Bytes are embedded, filters of several widths slide over
a window, each keeps its largest response (max pooling), and a softmax gives the languages; a text's scores are
the mean of its windows' log-probabilities, weighted by length. Forward and backward passes are numpy.

The classifier is fitted on at most TRAIN_TEXTS labelled texts, or PER_LANGUAGE for each language if those are more (a
hash of the id picks them, evenly by language), with WINDOWS windows each, so training costs the same at any
corpus size; every language that has labels is learned. Prediction reads whole texts in Arrow batches and moves nothing
between tasks.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any labelled text all are;
between languages of one probability the first by code point is told; a very long text is a batch of its own;
rows that repeat get the same answer; an empty table gives an empty result; columns that the caller wants kept
pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.text import ranges, slices, utf8

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 12, 4
TRAIN_TEXTS, PER_LANGUAGE, WINDOWS = 3000, 40, 3
_REACH = max(WIDTHS)


class Network:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.languages = languages
        mask = np.zeros((_REACH, DIM, n), np.float32)
        for i, w in enumerate(WIDTHS):
            mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = mask.reshape(_REACH * DIM, n)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": (rng.normal(0, 0.4, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.3, (n, len(languages))).astype(np.float32),
            "out_bias": np.zeros(len(languages), np.float32),
        }
        self.p["embed"][0] = 0

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest response of each filter in each window of bytes, and where if asked."""
        padded = np.zeros((len(x), WINDOW + _REACH - 1), np.uint8)
        padded[:, :WINDOW] = x
        e = self.p["embed"][padded].reshape(len(x), -1)
        patches = np.lib.stride_tricks.sliding_window_view(e, _REACH * DIM, axis=1)[:, ::DIM]
        r = np.ascontiguousarray(patches).reshape(-1, _REACH * DIM) @ self.p["filters"]
        r = r.reshape(len(x), WINDOW, -1)
        at = r.argmax(1) if places else None
        top = np.maximum(r.max(1) + self.p["bias"], 0)
        return (top, at, padded) if places else top

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.pooled(x[i : i + 128]) for i in range(0, len(x), 128)]) @ self.p["out"] + self.p["out_bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        one, two, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.languages)), 1)).astype(np.float32)[y]
        weight *= len(y) / weight.sum()
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                pick = order[i : i + 64]
                step += 1
                for k, g in self.gradients(x[pick], y[pick], weight[pick]).items():
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-7)
                self.p["filters"] *= self.mask
                self.p["embed"][0] = 0

    def gradients(self, x, y, weight) -> dict[str, np.ndarray]:
        h, at, padded = self.pooled(x, places=True)
        z = h @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z *= weight[:, None] / len(y)
        dh = (z @ self.p["out"].T) * (h > 0)
        spots = at[:, :, None] + np.arange(_REACH)  # window, filter, reach
        seen = padded[np.arange(len(x))[:, None, None], spots]
        patches = self.p["embed"][seen].reshape(len(x), h.shape[1], -1)
        filters = np.einsum("mf,mfk->kf", dh, patches) * self.mask
        back = dh[:, :, None] * self.p["filters"].T[None]
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, seen.reshape(-1), back.reshape(-1, DIM))
        return {"embed": embed, "filters": filters, "bias": dh.sum(0), "out": h.T @ z, "out_bias": z.sum(0)}


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' windows, zero-padded; each one's text and length."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    start = ranges(np.zeros(len(size), np.int64), n) * WINDOW
    length = np.minimum(WINDOW, size[text] - start)
    out = np.zeros((len(text), WINDOW), np.uint8)
    out[np.repeat(np.arange(len(text)), length), ranges(np.zeros(len(text), np.int64), length)] = data
    return out, text, length


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Network | None:
    """A network trained on a bounded sample of the rows for which ``train`` holds; None without labels."""
    has = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    langs = has.groupBy(lang).agg(F.count("*").alias("n")).orderBy(lang).collect()  # a row a language
    if not langs:
        return None
    place = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bound = max(TRAIN_TEXTS, PER_LANGUAGE * len(langs))
    quota = bound / len(langs)
    share = F.element_at(F.create_map(*[F.lit(v) for r in langs for v in (r[lang], min(1.0, 1.2 * quota / r["n"]))]), F.col(lang))
    picked = has.where(place < share)
    start = [F.pmod(F.xxhash64(key, F.lit(i)), F.greatest(F.length(text) - WINDOW // 2, F.lit(1))).cast("int") + 1 for i in range(WINDOWS)]
    cut = [F.substring(F.col(text), s, F.lit(WINDOW)).alias(f"w{i}") for i, s in enumerate(start)]
    # The place within the language's share, so that the limit cuts all languages alike.
    sample = picked.select(lang, (place / share).alias("place"), *cut).orderBy("place").limit(bound).collect()
    names = sorted({r[lang] for r in sample})
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for r in sample:
        for i in range(WINDOWS):
            raw = r[f"w{i}"].encode()[:WINDOW]
            if i == 0 and len(raw) > 24:  # short texts are to be told too
                raw = raw[: int(rng.integers(16, len(raw)))]
            rows.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
            labels.append(names.index(r[lang]))
    if not names:
        return None
    network = Network(names)
    network.fit(np.array(rows), np.array(labels))
    return network


def predict(docs: DataFrame, network: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score of every row's whole text."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    docs = docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    if network is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, off = utf8(part.column(part.schema.get_field_index(text)))
                x, own, length = windows(data, off)
                mean = np.zeros((part.num_rows, len(network.languages)))
                if len(x):
                    np.add.at(mean, own, network.log_probabilities(x) * length[:, None])
                mean /= np.maximum(np.diff(off), 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                letters = part.column(part.schema.get_field_index("_letters")).to_numpy(zero_copy_only=False)
                names = pa.array(np.array([*network.languages, "und"], object)[np.where(letters, best, len(network.languages))], pa.string())
                score = np.where(letters, p[np.arange(len(p)), best], 0.0)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, names, pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, text]), "_letters").mapInArrow(kernel, schema)
