"""Centroid clustering in integers: Lloyd's rounds with an annulus search for the nearest centroid.

Components become floor(scale * x), so every sum, mean and distance is an exact integer and a rerun gives the same
clusters whatever the partitioning. For each vector, the distance to the centroids whose norms lie next to its own bounds
the distance to the nearest one from above. By the triangle inequality only centroids whose norms differ from the
vector's by that bound at most can be as near: a binary search among the sorted norms finds the ends of that annulus, both ends
included and widened by more than the rounding of a norm, and only the centroids in it are compared, exactly, ties
to the smaller number.

The vectors are written once as integers; each round reads them, sums within tasks, and brings k x dim sums to the driver.
Centroids travel with the tasks: at most CENTROID_CELLS integers (64 MB), more are an error.

Edge cases: a vector that is null, of another length, or holds null or non-finite components takes no part. Integers saturate at
the bound that keeps squared distances below 2**62 (2**27 for 64 components: values of 131,072 and more). Fewer vectors than k
make fewer centroids; an empty centroid stays where it is. Repeated rows count as often as they occur; equal start hashes are
ordered by components; a null id hashes as ``null``. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged, unstage
from granary.llm.text import ranges

CENTROID_CELLS = 1 << 23
PAIRS = 1 << 15  # vector-centroid pairs that are compared at once


def limit(dim: int) -> int:
    """The largest component for which squared distances of ``dim`` components fit 62 bits."""
    return int((2.0**62 / max(dim, 1)) ** 0.5) // 2


def integers(df: DataFrame, id_col: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part, v being their integer components."""
    most = float(limit(dim))

    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    v = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-most)), F.lit(most))).cast("int"))
    return df.where((F.size(vector) == dim) & ~F.exists(x, bad)).select(F.col(id_col).alias("id"), v.alias("v"))


class Annulus:
    """The nearest of some centroids, exactly."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids * centroids).sum(1).astype(np.float64))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], centroids[self.number]

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[at]
        return np.einsum("ij,ij->i", gap, gap)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place, by norm, of the centroids in each vector's annulus."""
        norm = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        bound = np.minimum(self._distance(x, above), self._distance(x, np.maximum(above - 1, 0)))
        reach = np.sqrt(bound.astype(np.float64))
        reach += 1e-9 * (norm + reach + 1)
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid and the squared distance to it."""
        first, end = self.candidates(x)
        upto = np.cumsum(end - first)
        cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
        at = 0
        while at < len(x):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
            n = (end - first)[at:to]
            place = ranges(first[at:to], n)
            d = self._distance(np.repeat(x[at:to], n, axis=0), place)
            starts = np.cumsum(n) - n  # no annulus is empty: the centroid of the bound lies in it
            distance[at:to] = np.minimum.reduceat(d, starts)
            number = np.where(d == np.repeat(distance[at:to], n), self.number[place], len(self.number))
            cluster[at:to] = np.minimum.reduceat(number, starts)
            at = to
        return cluster, distance


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of all integer vectors."""
    search = Annulus(np.array(centroids, np.int64))

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                cluster, distance = search.nearest(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(kernel, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each task sums the vectors of each cluster, Spark adds the sums up exactly."""
    search = Annulus(np.array(centroids, np.int64))
    k, dim = len(centroids), len(centroids[0])

    def kernel(batches):
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                cluster, _ = search.nearest(x)
                order = np.argsort(cluster, kind="stable")
                own, starts, n = np.unique(cluster[order], return_index=True, return_counts=True)
                sums[own] += np.add.reduceat(x[order], starts, axis=0)
                counts[own] += n
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(kernel, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    totals = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = [list(c) for c in centroids]
    for r in totals.collect():  # k x dim rows
        out[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
    return out


@dataclass
class Clustering:
    assigned: DataFrame  # id, cluster, distance
    centroids: list[list[int]]

    def digests(self) -> list[str]:
        """The sha256 of each centroid's components as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3") -> Clustering:
    """``rounds`` of Lloyd's algorithm from the ``k`` vectors with the smallest sha256 of ``salt:id``, then one last assignment."""
    if k * dim > CENTROID_CELLS:
        raise ValueError(f"{k} centroids of {dim} components are more than {CENTROID_CELLS} integers")
    vectors = staged(integers(df, id_col, vector, dim, scale), "vectors")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    centroids = [list(r["v"]) for r in vectors.orderBy(key, "v").limit(k).collect()]
    if not centroids:
        return Clustering(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    for _ in range(rounds):
        after = moved(vectors, centroids)
        if after == centroids:  # nothing moves any more
            break
        centroids = after
    assigned = staged(assign(vectors, centroids), "assigned")
    unstage(vectors)
    return Clustering(assigned, centroids)
