"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The vocabulary is every training word (64-bit hashes), the end token, and one unknown word. It falls into
classes x members buckets: the most frequent words have one each, all other words share the buckets of the last
class by hash, the unknown word has its last. A token's probability is

    P(class | history) * P(bucket | class, history) * P(word | bucket)

The first two are softmaxes over sparse hashed features of the two words before (bias, n-gram and skip
features); the last is the smoothed relative frequency in the bucket, so the whole is a proper
distribution over the vocabulary.

The model grows with the corpus, without an upper end: the numbers of history values, of pairs and of buckets
grow with the fourth root of its bytes, the weights so with the square root (``Shape``): some 5 million at
30 GB, 250 million at 100 TB.

Training reads every training text. Tokens with the same hashed history have the same features and so the
same gradient: each task counts (history, class) and (history, bucket) sparsely, the counts are summed by a
shuffle into blocks of histories, and every step computes the exact gradient over all training tokens from
them, block by block in parallel, sums the rows that blocks share by a shuffle, and hands the driver one row
a weight row. The driver holds the weights and one gradient.

Word counts are exact and cover the corpus. Documents are dealt into chunks by hash; each chunk ships one
row per distinct word, words are summed, and each chunk gets back the counts that differ from its own. A
frequent word thus costs one row per chunk, however often it stands. Nothing that grows with the corpus
is broadcast or collected.

Edge cases: null and empty texts are the end token alone; with no training documents every word is unknown;
a repeated row is counted and scored once each; a null doc_id counts as training (no remainder); rows are dealt
by id and text, so null or repeated ids don't meet in one chunk; a very long text is one row of one chunk; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged
from granary.llm.text import U, mix, slices, word_hashes
from granary.llm.text import dealt as spread

GROUP = 4  # values of the word before in a block of counts
PAIRS = 16  # hashed values of the word before that, for each value of the word before
ENTRIES = 1 << 20  # distinct counts that a task holds
END = U(0x1B873593CC9E2D51)  # the end token's key
ALPHA = 0.1
CHUNK_BYTES = 16 << 20
TASK_BYTES = 64 << 20
_mib = 1 << 20


class Shape:
    """The model's sizes for a corpus of ``size`` bytes."""

    def __init__(self, size: int):
        growth = max(1.0, size / 8e6) ** 0.25
        self.classes = self.members = round(32 * growth**0.5)
        self.buckets = self.classes * self.members
        self.rest, self.unknown = self.members - 1, self.buckets - 1
        self.top = self.buckets - self.members
        self.history = 2 * round(32 * growth)  # hashed values of one history word
        self.class_rows = 1 + 2 * self.history + PAIRS * self.history
        #: a history word's counts: of (word before that, class), then of buckets
        self.span = self.history * self.classes + self.buckets


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all tokens, each text's end included, and the texts' offsets."""
    h, first = word_hashes(column, lower=True)
    n = len(first) - 1
    off = first + np.arange(n + 1)
    out = np.full(len(h) + n, END, U)
    words = np.ones(len(out), bool)
    words[off[1:] - 1] = False
    out[words] = h
    return out, off


def _distinct(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(which, np.concatenate(counts), len(keys)).astype(np.int64)


def _chunk_words(key, table):
    parts, counts = [np.zeros(0, U)], [np.zeros(0)]
    for batch in table.to_batches():
        for part in slices(batch, "text"):
            t, off = _tokens(_column(part, "text"))
            train = _column(part, "train").to_numpy(zero_copy_only=False)
            k, which = np.unique(t, return_inverse=True)
            parts.append(k)
            counts.append(np.bincount(which, np.repeat(train, np.diff(off)), len(k)))
            if len(parts) > 16:
                k, c = _distinct(parts, counts)
                parts, counts = [k], [c]
    k, c = _distinct(parts, counts)
    return pa.table({"key": k.view(np.int64), "chunk": np.full(len(k), key[0].as_py(), np.int64), "own": c})


_COUNTS = "kind int, key long, chunk long, n long"
WORD_ROW, STAT_ROW, TOP_ROW = 0, 1, 2


def _sum_words(shape: Shape):
    """Of a partition of (key, chunk, own), a key's rows together: rows whose sum differs from their own
    count, the partition's part of the corpus statistics, and its most frequent words."""

    def kernel(batches):
        yield from _summed([b for b in batches if b.num_rows], shape)

    return kernel


def _summed(rows: list[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    key = np.concatenate([np.zeros(0, np.int64), *[_column(b, "key").to_numpy() for b in rows]])
    chunk = np.concatenate([np.zeros(0, np.int64), *[_column(b, "chunk").to_numpy() for b in rows]])
    own = np.concatenate([np.zeros(0, np.int64), *[_column(b, "own").to_numpy() for b in rows]])
    keys, which = np.unique(key, return_inverse=True)
    total = np.bincount(which, own, len(keys)).astype(np.int64)
    sums = total[which]
    other = np.flatnonzero(sums != own)
    known = total > 0
    rest = _rest(keys[known].view(U), shape)
    words = np.bincount(rest, total[known], shape.rest).astype(np.int64)
    stats = [total.sum(), known.sum(), (total == 1).sum(), *words, *np.bincount(rest, minlength=shape.rest)]
    top = np.argsort(-total, kind="stable")[: shape.top]
    top = top[total[top] > 0]
    for at in range(0, len(other), _mib):
        i = other[at : at + _mib]
        yield _rows(WORD_ROW, key[i], chunk[i], sums[i])
    yield _rows(STAT_ROW, np.arange(len(stats)), np.zeros(len(stats)), np.array(stats))
    yield _rows(TOP_ROW, keys[top], np.zeros(len(top)), total[top])


def _rows(kind, key, chunk, n) -> pa.RecordBatch:
    cols = [np.full(len(key), kind, np.int32), *(np.asarray(x).astype(np.int64) for x in (key, chunk, n))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "key", "chunk", "n"])


def _rest(keys: np.ndarray, shape: Shape) -> np.ndarray:
    return (mix(keys) % U(shape.rest)).astype(np.int64)


class Vocabulary:
    """The most frequent words' keys by rank, and the corpus statistics."""

    def __init__(self, top: np.ndarray, top_n: np.ndarray, stats: np.ndarray, shape: Shape):
        self.shape, rest = shape, shape.rest
        self.n, self.v, self.once = (int(x) for x in stats[:3])
        self.order = np.argsort(top)
        self.sorted = top[self.order]
        own = _rest(top, shape)
        words = stats[3 : 3 + rest].astype(float) - np.bincount(own, top_n, rest)
        kinds = stats[3 + rest : 3 + 2 * rest].astype(float) - np.bincount(own, minlength=rest)
        #: log10 of each rest bucket's sum of smoothed counts
        self.rest = np.log10(np.maximum(words + ALPHA * kinds, 1e-300))
        #: the share of the unknown word, after words seen once, and the tokens of each bucket
        self.unknown = max(self.once, ALPHA) / max(self.n, 1)
        self.tokens = np.zeros(shape.buckets)
        self.tokens[: len(top_n)] = top_n
        self.tokens[shape.top : shape.unknown] = words
        self.tokens[shape.unknown] = self.tokens.sum() * self.unknown

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """A frequent word's rank, or -1."""
        if not len(self.sorted):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], -1)

    def history(self, keys: np.ndarray, rank: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashed values of the word before and of the one before that; 0 before a text's start."""
        half = self.shape.history // 2
        own = 1 + np.where((rank >= 0) & (rank < half), rank, half + (mix(keys) >> U(40)).astype(np.int64) % (half - 1))
        one, two = np.zeros_like(own), np.zeros_like(own)
        one[1:], two[2:] = own[:-1], own[:-2]
        one[off[:-1]] = two[off[:-1]] = 0
        second = off[:-1][np.diff(off) > 1] + 1
        two[second] = 0
        return one, two


def _features(one: np.ndarray, two: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Row numbers in the class weights: bias, the word before, the skip feature, both."""
    h = shape.history
    pair = one * PAIRS + (mix((one * h + two).astype(U)) % U(PAIRS)).astype(np.int64)
    return [np.zeros_like(one), 1 + one, 1 + h + two, 1 + 2 * h + pair]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def class_scores(weights: np.ndarray, one: np.ndarray, two: np.ndarray, shape: Shape) -> np.ndarray:
    """log P(class | history) of all classes."""
    return _log_softmax(sum(weights[f] for f in _features(one, two, shape)))


def member_scores(weights: np.ndarray, one: np.ndarray, shape: Shape) -> np.ndarray:
    """log P(bucket | class, history) of all buckets, for each value of the word before."""
    x = (weights[0] + weights[1 + one]).reshape(len(one), shape.classes, shape.members)
    return _log_softmax(x).reshape(len(one), shape.buckets)


def _count_rows(codes: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """Sorted codes and their counts, a row for each block of ``width`` codes."""
    block, at = np.unique(codes // width, return_index=True)
    ends = np.append(at[1:], len(codes))
    local = (codes - codes // width * width).astype("<i4")
    cut = list(zip(at.tolist(), ends.tolist(), strict=True))
    data = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (local, n.astype("<i8"))]
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), *data], ["block", "codes", "n"])


def _count_histories(vocabulary: Vocabulary):
    shape = vocabulary.shape

    def kernel(batches):
        codes, counts, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                t, off = _tokens(_column(part, "text"))
                rank = vocabulary.rank(t)
                bucket = np.where(rank >= 0, rank, shape.top + _rest(t, shape))
                one, two = vocabulary.history(t, rank, off)
                seen = one * shape.span + two * shape.classes + bucket // shape.members
                own = one * shape.span + shape.history * shape.classes + bucket
                k, c = np.unique(np.concatenate([seen, own]), return_counts=True)
                codes, counts, held = [*codes, k], [*counts, c], held + len(k)
                if held > 2 * ENTRIES:
                    k, c = _distinct(codes, counts)
                    if len(k) > ENTRIES:
                        yield _count_rows(k, c, GROUP * shape.span)
                        k, c = k[:0], c[:0]
                    codes, counts, held = [k], [c], len(k)
        if held:
            yield _count_rows(*_distinct(codes, counts), GROUP * shape.span)

    return kernel


def _sum_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts, held = [], [], 0
    for batch in batches:
        for k, c in zip(_column(batch, "codes").to_pylist(), _column(batch, "n").to_pylist(), strict=True):
            codes.append(np.frombuffer(k, "<i4"))
            counts.append(np.frombuffer(c, "<i8"))
            held += len(codes[-1])
            if held > 4 * ENTRIES:
                k, c = _distinct(codes, counts)
                codes, counts, held = [k], [c], len(k) // 2
    k, c = _distinct(codes, counts)
    data = [pa.array([x.tobytes()], pa.binary()) for x in (k.astype("<i4"), c.astype("<i8"))]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), *data], ["block", "codes", "n"])


def _add_rows(out: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """out[at] += g, where ``at`` may repeat."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    out[rows] += np.add.reduceat(g[order], first)


def _block_gradient(block: int, codes: np.ndarray, n: np.ndarray, weights, vocabulary: Vocabulary) -> Iterator[tuple[int, int, bytes]]:
    """The gradient of the negative log-likelihood over one block of histories: (level, row, values)."""
    shape, unknown = vocabulary.shape, vocabulary.unknown
    one, rest = np.divmod(codes, shape.span)
    is_class = rest < shape.history * shape.classes
    # Classes: a row for each history that occurs, some at a time.
    history, which = np.unique(one[is_class] * shape.history + rest[is_class] // shape.classes, return_inverse=True)
    target, times = rest[is_class] % shape.classes, n[is_class]
    low = block * GROUP
    bias, skip = np.zeros(shape.classes), np.zeros((shape.history, shape.classes))
    before, pairs = np.zeros((GROUP, shape.classes)), np.zeros((GROUP * PAIRS, shape.classes))
    first_pair = 1 + 2 * shape.history + low * PAIRS
    for at in range(0, len(history), 8192):
        part = history[at : at + 8192]
        a, b = np.searchsorted(which, [at, at + len(part)])  # codes are sorted, and so are their histories
        seen = np.zeros((len(part), shape.classes))
        seen[which[a:b] - at, target[a:b]] = times[a:b]
        seen[:, -1] += seen.sum(1) * unknown  # the unknown word's share
        h1, h2 = np.divmod(part, shape.history)
        features = _features(h1 + low, h2, shape)
        g = seen.sum(1, keepdims=True) * np.exp(_log_softmax(sum(weights[0][f].astype(float) for f in features))) - seen
        bias += g.sum(0)
        _add_rows(before, h1, g)
        _add_rows(skip, h2, g)
        _add_rows(pairs, features[3] - first_pair, g)
    tables = [(0, bias[None]), (1 + low, before), (1 + shape.history, skip), (first_pair, pairs)]
    for first, table in tables:
        for r in np.flatnonzero(table.any(1)).tolist():
            yield 0, first + r, table[r].astype("<f4").tobytes()
    # Members of the classes.
    total = np.zeros(shape.buckets)
    for own in np.unique(one[~is_class]).tolist():
        mine = ~is_class & (one == own)
        by = np.zeros(shape.buckets)
        by[rest[mine] - shape.history * shape.classes] = n[mine]
        by[-1] += by.sum() * unknown
        p = np.exp(member_scores(weights[1], np.array([low + own]), shape))[0].reshape(shape.classes, -1)
        by = by.reshape(shape.classes, -1)
        g = (by.sum(1, keepdims=True) * p - by).reshape(-1)
        total += g
        yield 1, 1 + low + own, g.astype("<f4").tobytes()
    yield 1, 0, total.astype("<f4").tobytes()


_GRADIENT = "level int, row long, g binary"


def _gradient_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    level, row, g = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(row, pa.int64()), pa.array(g, pa.binary())], ["level", "row", "g"])


def _gradients(weights, vocabulary: Vocabulary):
    def kernel(batches):
        for batch in batches:
            for block, codes, n in zip(*(_column(batch, c).to_pylist() for c in ("block", "codes", "n")), strict=True):
                counts = np.frombuffer(codes, "<i4").astype(np.int64), np.frombuffer(n, "<i8").astype(float)
                yield _gradient_batch(list(_block_gradient(block, *counts, weights, vocabulary)))

    return kernel


def _sum_gradients(batches):
    """A partition's rows, those of one weight row added up."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for level, row, g in zip(*(_column(batch, c).to_pylist() for c in ("level", "row", "g")), strict=True):
            x = np.frombuffer(g, "<f4").astype(float)
            total[level, row] = total[level, row] + x if (level, row) in total else x
    if total:
        yield _gradient_batch([(level, row, x.astype("<f4").tobytes()) for (level, row), x in total.items()])


def train(blocks: DataFrame, vocabulary: Vocabulary, steps: int = 12, rate: float = 0.4) -> list[np.ndarray]:
    """Class and member weights by ``steps`` adaptive gradient steps over all blocks."""
    w = initial(vocabulary)
    square = [np.zeros_like(x) for x in w]
    for step in range(steps):
        rows = blocks.mapInArrow(_gradients(w, vocabulary), _GRADIENT).repartition("level", "row")
        got = rows.mapInArrow(_sum_gradients, _GRADIENT).toArrow()  # one row a weight row
        decay = np.float32(rate / (1 + 0.1 * step))
        for batch in got.to_batches():
            for level, row, g in zip(*(_column(batch, c).to_pylist() for c in ("level", "row", "g")), strict=True):
                g = np.frombuffer(g, "<f4")
                square[level][row] += g * g
                w[level][row] -= decay * g / np.sqrt(square[level][row] + 1)
    return w


def initial(vocabulary: Vocabulary) -> list[np.ndarray]:
    """Weights whose biases alone give the relative frequencies of classes and buckets."""
    shape = vocabulary.shape
    total = vocabulary.tokens + 1e-3
    w = [np.zeros((shape.class_rows, shape.classes), np.float32), np.zeros((1 + shape.history, shape.buckets), np.float32)]
    by_class = np.log(total.reshape(shape.classes, -1).sum(1))
    w[0][0], w[1][0] = by_class - by_class.max(), np.log(total / total.max())
    return w


def member_norms(weights: np.ndarray, shape: Shape) -> np.ndarray:
    """The log of each class's sum over its members, for each value of the word before."""
    out = np.empty((shape.history, shape.classes), np.float32)
    for one in range(shape.history):
        x = (weights[0] + weights[1 + one]).reshape(shape.classes, -1).astype(float)
        most = x.max(1, keepdims=True)
        out[one] = (most + np.log(np.exp(x - most).sum(1, keepdims=True)))[:, 0]
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _model(bucket: np.ndarray, one: np.ndarray, two: np.ndarray, weights, norms: np.ndarray, shape: Shape) -> np.ndarray:
    """ln P(bucket | history) of each token: each history that occurs is scored once, some at a time."""
    target = bucket // shape.members
    out = weights[1][0, bucket] + weights[1][1 + one, bucket] - norms[one, target]
    history, which = np.unique(one * shape.history + two, return_inverse=True)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(0, len(history) + 8192, 8192))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        part = history[k * 8192 : (k + 1) * 8192]
        mine = order[a:b]
        out[mine] += class_scores(weights[0], *np.divmod(part, shape.history), shape)[which[mine] - k * 8192, target[mine]]
    return out.astype(float)


def _score(vocabulary: Vocabulary, weights, norms: np.ndarray):
    shape = vocabulary.shape

    def kernel(key, docs, counts):
        keys = counts.column("key").to_numpy().view(U)
        n = counts.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        # Words whose only count is this chunk's own are not sent back: count them here.
        own = _chunk_words(key, docs)
        own_keys, own_n = own.column("key").to_numpy().view(U), own.column("own").to_numpy().copy()
        if len(keys):
            at = np.minimum(np.searchsorted(keys, own_keys), len(keys) - 1)
            own_n = np.where(keys[at] == own_keys, n[at], own_n)
        log_n = math.log10(vocabulary.n + ALPHA * (vocabulary.v + 1))
        base = np.log10(own_n + ALPHA)
        rank = vocabulary.rank(own_keys)
        bucket = np.where(own_n > 0, np.where(rank >= 0, rank, shape.top + _rest(own_keys, shape)), shape.unknown)
        rest = (bucket >= shape.top) & (bucket < shape.unknown)
        inside = np.zeros(len(base))
        inside[rest] = base[rest] - vocabulary.rest[bucket[rest] - shape.top]
        out = []
        for batch in docs.to_batches():
            for part in slices(batch, "text"):
                t, off = _tokens(_column(part, "text"))
                w = np.searchsorted(own_keys, t)
                one, two = vocabulary.history(t, rank[w], off)
                model = _model(bucket[w], one, two, weights, norms, shape) / math.log(10) + inside[w]
                size = np.diff(off)
                row = np.repeat(np.arange(len(size)), size)
                score = np.add.reduceat(model, off[:-1]) if len(size) else np.zeros(0)
                plain = np.add.reduceat(base[w], off[:-1]) if len(size) else np.zeros(0)
                known = np.bincount(row, own_n[w] > 0, len(size)).astype(np.int64)
                train_ = _column(part, "train").to_numpy(zero_copy_only=False)
                out.append(pa.table({"doc_id": _column(part, "doc_id"), "held_out": pa.array(train_ == 0), "n_tokens": size, "n_known": known, "train_tokens": np.full(len(size), vocabulary.n), "base_score": plain - size * log_n, "score": score}))
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})
        return pa.concat_tables(out) if out else empty

    return kernel


def score(docs: DataFrame, held_out, steps: int = 12, rate: float = 0.4) -> DataFrame:
    """SCORES of all documents; ``held_out`` is the column that keeps a document from training."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape(size)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(parts, -(-size // CHUNK_BYTES))
    parts = max(parts, -(-size // TASK_BYTES))  # so that a task's share stays the same
    train_ = F.when(F.coalesce(held_out, F.lit(False)), 0).otherwise(1)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))
    read = docs.select("doc_id", "text", train_.alias("train"), chunk.alias("chunk"))
    dealt = read.repartition(parts, "chunk")
    words = dealt.groupBy("chunk").applyInArrow(_chunk_words, "key long, chunk long, own long")
    # A chunk has a row for each distinct word, on texts about one for 30 bytes.
    counts = staged(spread(words, size // 24, "key").mapInArrow(_sum_words(shape), _COUNTS), "counts")
    stats = np.zeros(3 + 2 * shape.rest, np.int64)
    for r in counts.where(F.col("kind") == STAT_ROW).groupBy("key").agg(F.sum("n").alias("n")).collect():  # as many rows as stats
        stats[r.key] = r.n
    top = counts.where(F.col("kind") == TOP_ROW).orderBy(F.desc("n"), "key").limit(shape.top).select("key", "n").toArrow()
    vocabulary = Vocabulary(top.column("key").to_numpy().view(U), top.column("n").to_numpy(), stats, shape)
    kind = "block long, codes binary, n binary"
    histories = read.where("train = 1").select("text").mapInArrow(_count_histories(vocabulary), kind)
    blocks = staged(histories.groupBy("block").applyInArrow(_sum_blocks, kind), "histories")
    weights = train(blocks, vocabulary, steps, rate)
    back = counts.where(F.col("kind") == WORD_ROW).select("chunk", "key", "n").repartition(parts, "chunk")
    scored = _score(vocabulary, weights, member_norms(weights[1], shape))
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scored, SCORES)
