"""Filter interaction audit: what each of five filters removes in every order that they can be applied in.

A document's failures are five bits. A table of 32 masks by 120 orders, made once, holds the step at which a mask is first
caught in an order (the sixth "step" is being kept); tasks index it with the masks they see, np.bincount counts by part,
label, order and step, and the partial counts are summed by Spark. Everything asked for follows from those counts: a filter at
step 1 removes all that fail it, a filter at step 5 only those that fail nothing else, so failures and unique failures
are removals too.

The texts are read once, into a row of five numbers and a digest for each document. The duplicate filter compares
SHA-256 digests: the smallest id of each digest is a map-side combined aggregate, written before it is joined back, so the
join has two plain exchanges and a text that is a third of all is split by adaptive execution.

Edge cases: a null text is empty; a null part is the empty string; a null id is neither smaller than another nor has smaller ones; rows
alike in id and text are not copies of each other, since neither id is smaller; several labels of one id
count as good or toxic if any does; a null label is neither. A very long text is a batch of its own. An empty table gives an empty result.
Extra columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged, unstage
from granary.llm.text import slices, spans_hash, utf8, words

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
STEPS = len(FILTERS)
#: FIRST[mask, order]: the step (from 0) whose filter is the first that the mask fails, STEPS if none.
FIRST = np.array([[next((s for s, f in enumerate(o) if mask >> f & 1), STEPS) for o in ORDERS] for mask in range(1 << STEPS)])
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
PARTS = 256  # parts whose counts a task holds at once
LABELS = 4  # bit 0: good, bit 1: toxic

_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[list(SIGNS)] = True


def failures(text) -> np.ndarray:
    """The bits of filters A to D for each text of an Arrow column."""
    data, off = utf8(text)
    s, e, first = words(data, off)
    hashes = spans_hash(data, s, e)
    n = np.diff(first)
    distinct = np.fromiter((len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)), np.int64, len(n))

    def count(hit: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(hit)])[off])

    capitals, points = count((data >= 65) & (data <= 90)), count(data & 0xC0 != 0x80)
    fails = [n < LEAST_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * points, count(_IS_SIGN[data]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: Column | str = "source", made: list | None = None) -> DataFrame:
    """(id, part, mask) of every document; the tables it reads are appended to ``made``."""
    part = F.col(part) if isinstance(part, str) else part
    given = docs.select(F.col(key).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def kernel(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                col = {n: some.column(i) for i, n in enumerate(some.schema.names)}
                yield pa.RecordBatch.from_arrays([col["id"], col["part"], col["digest"], pa.array(failures(col["text"]), pa.int32())], ["id", "part", "digest", "mask"])

    kind = docs.schema[key].dataType.simpleString()
    read = staged(given.mapInArrow(kernel, f"id {kind}, part string, digest binary, mask int"), "failures")
    least = read.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = staged(least, "copies")
    if made is not None:
        made += [read, copies]
    joined = read.join(copies, F.col("digest") == F.col("d"), "left")
    copy = F.when(F.col("least") < F.col("id"), 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def _counts(batches):
    """(part, at, n): documents by label, order and step, at = (label * orders + order) * (steps + 1) + step."""
    cells = len(ORDERS) * (STEPS + 1)
    held: dict[str, np.ndarray] = {}
    order = np.arange(len(ORDERS)) * (STEPS + 1)

    def out():
        for part, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["part", "at", "n"])
        held.clear()

    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        part = col["part"].dictionary_encode()
        which = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mask, label = (col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "label"))
        seen, times = np.unique((which * LABELS + label) * (1 << STEPS) + mask, return_counts=True)
        which, rest = np.divmod(seen, LABELS << STEPS)
        label, mask = np.divmod(rest, 1 << STEPS)
        names = part.dictionary.to_pylist()
        for p in np.unique(which):
            mine = which == p
            at = (label[mine] * cells)[:, None] + order + FIRST[mask[mine]]
            # Weights are whole numbers far below 2**53, so the sums are exact.
            n = np.bincount(at.reshape(-1), np.repeat(times[mine], len(ORDERS)), LABELS * cells).astype(np.int64)
            held[names[p]] = held[names[p]] + n if names[p] in held else n
            if len(held) >= PARTS:
                yield from out()
    yield from out()


def _report(batches):
    """The rows of each part, out of its summed counts."""
    orders = np.array(ORDERS)
    names = ["".join(FILTERS[f] for f in o) for o in ORDERS]
    firsts = np.array([np.flatnonzero(orders[:, 0] == f)[0] for f in range(STEPS)])
    lasts = np.array([np.flatnonzero(orders[:, -1] == f)[0] for f in range(STEPS)])
    for batch in batches:
        for part, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.zeros(LABELS * len(ORDERS) * (STEPS + 1), np.int64)
            x[at] = n
            x = x.reshape(LABELS, len(ORDERS), STEPS + 1)
            every, good, toxic = x.sum(0), x[1] + x[3], x[2] + x[3]
            removed = every[:, :STEPS]
            shapley = np.bincount(orders.reshape(-1), removed.reshape(-1), STEPS).astype(np.int64)
            fails, unique = removed[firsts, 0], removed[lasts, -1]
            cols = {
                "kept": every.sum(1, keepdims=True) - removed.cumsum(1), "removed": removed, "redundant": fails[orders] - removed, "unique_fails": unique[orders],
                "good_lost": good[:, :STEPS], "toxic_lost": toxic[:, :STEPS], "shapley": shapley[orders],
            }
            rows = len(ORDERS) * STEPS
            head = [pa.array([part] * rows, pa.string()), pa.array([o for o in names for _ in range(STEPS)]), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(v.reshape(-1)) for v in cols.values())], ["part", "filter_order", "step", *cols])


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: Column | str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row for each part, order of the filters and step."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("l"))
    marks = staged(marks.agg(F.max((F.coalesce(F.col(good) == 1, F.lit(False))).cast("int")).alias("g"), F.max((F.coalesce(F.col(toxic) == 1, F.lit(False))).cast("int")).alias("t")), "marks")
    made = [marks]
    # Ids compress so well that the planner would take a long table of labels for a small one and broadcast it.
    joined = masks(docs, key, text, part, made).join(marks.hint("merge"), F.col("id") == F.col("l"), "left")
    seen = joined.select("part", "mask", (F.coalesce("g", F.lit(0)) + 2 * F.coalesce("t", F.lit(0))).alias("label"))
    counts = staged(seen.mapInArrow(_counts, "part string, at int, n long").groupBy("part", "at").agg(F.sum("n").alias("n")), "counts")
    for table in made:
        unstage(table)
    # At most LABELS x orders x (steps + 1) = 2,880 counts a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("at", "n")).alias("c"))
    return parts.select("part", F.col("c.at").alias("at"), F.col("c.n").alias("n")).mapInArrow(_report, REPORT)
