"""Connected components over written intermediate tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged as written
from granary.functions.staging import unstage

CHUNK = 1 << 20  # links that a task contracts at once


def _contracted(batches):
    """The links (u, v) of one task as a forest of depth one for each CHUNK of them: the same nodes are connected."""
    parts, held = [], 0
    for batch in batches:
        parts.append(batch)
        held += batch.num_rows
        if held >= CHUNK:
            yield _stars(parts)
            parts, held = [], 0
    if held:
        yield _stars(parts)


def _stars(parts) -> pa.RecordBatch:
    u, v = (np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in parts]) for c in ("u", "v"))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:  # each node to the smallest root beside it, then to that one's root, until all links lie within a tree
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        if (root == before).all():
            break
    child = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[root[child]])], ["u", "v"])


def _is_done(edges: DataFrame) -> bool:
    """Whether every edge hangs a node below a root."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the smallest
    node reachable; nodes without an edge are not returned.

    Each task contracts the links it has; then large-star / small-star contraction: each round hangs all larger neighbours of a node below its
    smallest neighbour, then all smaller ones, until nothing changes; O(log^2) rounds. The smallest
    neighbour is a map-side combined aggregate that is written before it is joined back, so the join
    has two plain exchanges and adaptive execution can split a hub. It ends as soon as all trees have depth one.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = e.join(least, "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        out = written(out.where("u != v").distinct(), "edges")
        unstage(least)
        return out

    kind = edges.schema[u].dataType.simpleString()
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v")
    e = written(e.mapInArrow(_contracted, f"u {kind}, v {kind}").distinct(), "edges")
    while not _is_done(e):
        e, old = star(star(e, True), False), e
        unstage(old)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
