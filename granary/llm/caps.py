"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A vector is rotated, cut into PARTS blocks, and each block has a code of ``size`` random directions; a filter
is one code word per block, so size**PARTS directions cost only PARTS small products a vector. A vector
is list-decoded to every filter whose score exceeds its cap: block sums are kept sorted in pairs, and only
combinations that reach the cap are enumerated. Vectors that share label and filter are compared in double
precision.

The cap is relative to a vector's best filter (its maximum less ``slack``), so no vector is without filters.
At cosine c two unit vectors differ by d = sqrt(2 - 2c), and any filter's score by at most d; with a slack of
2d the best filter of either is surely in both lists. That is far more than is needed, so the slack is measured
for the dimension and the code at hand (``slack_for``): the smallest of a rising series at which each of PAIRS
random pairs at exactly the limit shares SHARED filters or more. The rotation is random, so how a pair lies to
the filters does not depend on the data.

A filter's vectors are compared in blocks of at most ``BLOCK``: a hot filter becomes many block pairs, spread
over tasks, and a task holds two blocks. A pair is counted in the first filter that both have,
so links are counted once; a block returns a count per vector and a spanning forest, never pairs. Exact
copies (same label, same components) are collapsed to their smallest id before, with their number.

Edge cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components
link with nothing and keep themselves; vectors of unlike lengths never link; rows that share an id are one
node and link by any of its vectors; rows without an id keep it and have no component; columns other than the
three named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged
from granary.llm.cluster import components
from granary.llm.text import ranges

PARTS = 3
PAIRS, SHARED = 256, 4
BLOCK = 1024


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def matrix(column, dim: int) -> np.ndarray:
    """A list column whose rows all have ``dim`` finite components, as doubles."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def code(dim: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """The rotation, each block's code words (unit vectors times 1/sqrt(PARTS)), and the blocks."""
    rng = np.random.default_rng([seed, dim, size])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    bounds = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
    blocks = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    codes = []
    for b in blocks:
        c = rng.normal(size=(size, b.stop - b.start))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(blocks)))
    return rotation, codes, blocks


def decode(x: np.ndarray, rotation, codes, blocks, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, filter) whose score is at least the row's best score less ``slack``."""
    y = x @ rotation
    rows = np.arange(len(x))
    ids = np.zeros(len(x), np.int64)
    lost = np.zeros(len(x))  # what the combination so far falls short of the best one
    for c, b in zip(codes, blocks, strict=True):
        score = y[:, b] @ c.T
        short = score.max(1, keepdims=True) - score
        order = np.argsort(short, axis=1)
        short = np.take_along_axis(short, order, 1)
        n = np.array([np.searchsorted(s, slack + 1e-9, "right") for s in short])
        pick = n[rows]
        at = np.repeat(np.arange(len(rows)), pick)
        j = np.arange(len(at)) - np.repeat(np.cumsum(pick) - pick, pick)
        total = lost[at] + short[rows[at], j]
        keep = total <= slack + 1e-9
        at, j = at[keep], j[keep]
        ids = ids[at] * len(c) + order[rows[at], j]
        lost, rows = total[keep], rows[at]
    return rows, ids


def slack_for(dim: int, size: int, seed: int, least: float) -> float:
    """The smallest slack of a rising series at which random pairs at cosine ``least`` share SHARED filters."""
    sure = 2 * float(np.sqrt(max(0.0, 2 - 2 * least)))
    if dim < 2 or not sure:
        return sure
    rng = np.random.default_rng([seed, dim])
    parts = code(dim, size, seed)
    x, z = (unit(rng.normal(size=(PAIRS, dim))) for _ in range(2))
    y = least * x + np.sqrt(1 - least**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
    slack = sure / 40
    while slack < sure:
        shared = []
        for at in range(0, PAIRS, 64):
            both = [decode(v[at : at + 64], *parts, slack) for v in (x, y)]
            one, two = (rows * size**PARTS + ids for rows, ids in both)
            common = np.intersect1d(one, two, assume_unique=True) // size**PARTS
            shared.append(np.bincount(common, minlength=len(x[at : at + 64])).min())
        if min(shared) >= SHARED:
            return slack
        slack *= 1.1
    return sure


def _decode_kernel(dim: int, size: int, seed: int, slack: float, number: type):
    def kernel(batches):
        parts = code(dim, size, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = unit(matrix(_column(part, "v"), dim))
                rows, ids = decode(x, *parts, slack)
                order = np.lexsort((ids, rows))
                rows, ids = rows[order], ids[order]
                off = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(number)))
                yield pa.RecordBatch.from_arrays([*[_column(part, c) for c in ("node", "label", "copies", "v")], lists], ["node", "label", "copies", "v", "filters"])

    return kernel


def _whole_groups(batches):
    """Sorted batches, cut so that each holds whole groups of equal (label, filter, left, right), and the groups' bounds."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in ("label", "filter", "left", "right"):
            c = _column(batch, name)
            c = (c.dictionary_encode().indices if name == "label" else c).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        starts = np.append(0, np.flatnonzero(new))
        held = batch.slice(starts[-1])  # two blocks at most
        if starts[-1]:
            yield batch.slice(0, starts[-1]), starts
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The root of each of n nodes under the links (i, j)."""
    root = np.arange(n)

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    best = np.arange(n)
    np.minimum.at(best, np.maximum(i, j), np.minimum(i, j))
    for k in np.flatnonzero(best != np.arange(n)).tolist():
        root[find(k)] = find(int(best[k]))
    ri = np.array([find(k) for k in range(n)])
    for p, q in zip(*(z[ri[i] != ri[j]].tolist() for z in (i, j)), strict=True):
        root[find(p)] = find(q)
    return np.array([find(k) for k in range(n)], np.int64)


def _compare(dim: int, least: float):
    """Links of groups (a filter's block with itself or another) that come sorted; most groups hold none and end
    after one product, so a group costs microseconds, not a call from the JVM."""

    def kernel(batches):
        for batch, bounds in _whole_groups(batches):
            node, copies, side = (_column(batch, c).to_numpy() for c in ("node", "copies", "block"))
            filters, left, right = (_column(batch, c).to_numpy() for c in ("filter", "left", "right"))
            x = unit(matrix(_column(batch, "v"), dim))
            lists = _column(batch, "filters")
            off, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            off = off - off[0]
            found = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                if left[s] == right[s]:
                    i, j = np.nonzero(x[s:e] @ x[s:e].T >= least - 1e-9)
                    up = i < j
                    i, j = i[up], j[up]
                else:
                    a, b = np.flatnonzero(side[s:e] == left[s]), np.flatnonzero(side[s:e] == right[s])
                    i, j = np.nonzero(x[s + a] @ x[s + b].T >= least - 1e-9)
                    i, j = a[i], b[j]
                if len(i):
                    sure = (x[s + i] * x[s + j]).sum(1) >= least
                    i, j = i[sure], j[sure]
                if not len(i):
                    continue
                # Count a pair in the smallest filter that both vectors have. Only linked rows matter from here.
                rows, which = np.unique(np.concatenate([i, j]), return_inverse=True)
                i, j = which[: len(i)], which[len(i) :]
                size = off[s + rows + 1] - off[s + rows]
                mine = flat[ranges(off[s + rows], size)]
                low = mine < filters[s]
                names, name = np.unique(mine[low], return_inverse=True)
                has = np.zeros((len(rows), len(names)), np.float32)
                has[np.repeat(np.arange(len(rows)), size)[low], name] = 1
                first = (has @ has.T)[i, j] == 0
                n, times = len(rows), copies[s + rows]
                links = np.bincount(i[first], times[j[first]], n) + np.bincount(j[first], times[i[first]], n)
                root = _forest(n, i, j)
                out = (links > 0) | (root != np.arange(n))
                found.append((node[s + rows[out]], node[s + rows[root[out]]], links[out].astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["node", "other", "links"])

    return kernel


def link(rows: DataFrame, vec_id: str, embedding: str, label: str, least: float = 0.98, size: int | None = None, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id) for every row. ``size``: code words a block; by default it grows
    with the cube root of the number of vectors, so a filter's list stays about as long."""
    kind = rows.schema[embedding].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = F.col(embedding).cast(kind)
    usable = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(vec_id).alias("node"), F.col(label).cast("string").alias("label"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    kinds = base.where("usable and node is not null")
    groups = staged(kinds.groupBy("label", "v").agg(F.min("node").alias("least"), F.count("*").alias("copies")), "vectors")
    dims = [r[0] for r in groups.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    counted, edges = [], []
    for dim in dims:
        own = groups.where(F.size("v") == dim).select(F.col("least").alias("node"), "label", "copies", "v")
        n = own.count()
        k = size or max(4, round((10 * n) ** (1 / PARTS)))
        number, name = (np.int32, "int") if k**PARTS < 1 << 31 else (np.int64, "long")
        kernel = _decode_kernel(dim, k, seed, slack_for(dim, k, seed, least), number)
        decoded = own.mapInArrow(kernel, f"node long, label string, copies long, v {kind}, filters array<{name}>")
        decoded = staged(decoded.withColumn("uid", F.monotonically_increasing_id()), "decoded")
        # Which filters another vector has is settled on ids; the vectors are dealt once, to those filters only.
        slim = decoded.select("uid", "label", F.explode("filters").alias("filter"))
        per = slim.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1").select(F.col("label").alias("l"), F.col("filter").alias("f"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        slim = slim.join(staged(per, "filters"), (F.col("label") == F.col("l")) & (F.col("filter") == F.col("f")))
        live = slim.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("filter", "blocks"))).alias("live"))
        dealt = decoded.drop("filters").join(staged(live, "live"), "uid").select("node", "label", "copies", "v", "live", F.posexplode("live").alias("at", "own"))
        below = F.slice(F.col("live.filter"), F.lit(1), F.col("at"))  # a pair counts in the smallest filter it shares
        dealt = dealt.select("node", "label", "copies", "v", F.col("own.filter").alias("filter"), F.col("own.blocks").alias("blocks"), below.alias("filters"))
        block = F.pmod(F.xxhash64("node", "filter"), F.col("blocks")).cast("int")
        dealt = dealt.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"left": F.least("block", "with"), "right": F.greatest("block", "with")})
        group = ["label", "filter", "left", "right"]
        dealt = dealt.select(*group, "node", "copies", "block", "v", "filters").repartition(*group).sortWithinPartitions(*group)
        found = dealt.mapInArrow(_compare(dim, least), "node long, other long, links long")
        found = staged(found, "links")
        counted.append(found.groupBy("node").agg(F.sum("links").alias("links")))
        edges.append(found.where("node != other").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct())
    if not dims:
        return rows.select(F.col(vec_id).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    links, graph = counted[0], edges[0]
    for c, e in zip(counted[1:], edges[1:], strict=True):
        links, graph = links.union(c), graph.union(e)
    links = staged(links.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    # Copies hang below their smallest id.
    member = kinds.join(groups.withColumnsRenamed({"label": "gl", "v": "gv"}), (F.col("label") == F.col("gl")) & (F.col("v") == F.col("gv"))).select("node", F.col("least").alias("head"), (F.col("copies") - 1).alias("same"))
    member = staged(member, "members")
    graph = graph.union(member.where("node != head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    comp = staged(components(graph), "components")
    per_node = member.join(links.withColumnRenamed("node", "head"), "head", "left").groupBy("node").agg(F.sum(F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.select("node").join(per_node, "node", "left").join(comp, "node", "left")
    return out.select(F.col("node").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
