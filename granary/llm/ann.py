"""Nearest neighbours by an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and residual codebooks are fitted on at most SAMPLE vectors, picked by a hash; every vector
is indexed. PILOTS vectors of the sample are then compared with all vectors, at every size of the table: that
gives their true neighbours, and so how many cells must be probed, and how many candidates reranked, for RECALL of
them. Those two numbers, without an upper end, are used for the search.

Cells are dealt into shards of at most SHARD codes (a larger cell is salted over several), and the queries that
probe a shard into blocks of QBLOCK; a code goes to the blocks of its own shard only. A task holds one shard and
one block: it builds a distance table for each query and cell, sums table entries by code, and returns each query's
best candidates of the shard. Candidates of all shards are cut to the best by estimate and reranked on the
original vectors in double precision.

Exact copies are indexed once; a copied vector stands for its smallest ids, as many as an answer can need. So a
vector that a third of all rows share takes one code, and ties go to the smaller id.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids; a query is never its own neighbour; with fewer candidates than k all are returned; vectors of another
length than the query's are not compared; rows that share an id are one candidate and one query, by their
nearest vectors; the index sees components cut to 1e100, the scores don't, and are scaled where their squares would
overflow; columns other than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.staging import staged
from granary.llm.caps import _column, matrix

SAMPLE, PILOTS, RECALL = 20_000, 100, 0.98
PROBES, RERANK = 32, 500  # at least
SHARD, QBLOCK, CELLS, ITERATIONS = 32_768, 512, 4_096, 8


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each row's nearest row of ``c``."""
    cuts = range(0, len(x), 1024)
    return np.concatenate([squared(x[at : at + 1024], c).argmin(1) for at in cuts]) if len(x) else np.zeros(0, np.int64)


def seen(column, dim: int) -> np.ndarray:
    """The vectors as the index sees them, with squares that stay finite."""
    return np.clip(matrix(column, dim), -1e100, 1e100)


def kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ITERATIONS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Centroids, codebooks, and the two measured search widths."""

    def __init__(self, x: np.ndarray, n: int, k: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        self.cells = max(1, min(CELLS, round(n**0.5), len(x)))
        self.centroids = kmeans(x, self.cells, rng)
        rest = x - self.centroids[nearest(x, self.centroids)]
        bounds = np.linspace(0, dim, min(dim, max(1, dim // 4)) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.books = [kmeans(rest[:, p], min(256, len(x)), rng) for p in self.parts]
        self.pilots = x[rng.permutation(len(x))[:PILOTS]]
        self.probes, self.rerank = PROBES, max(RERANK, 5 * k)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = [nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        words = [b[codes[:, j]] for j, b in enumerate(self.books)]
        return self.centroids[cell] + np.concatenate(words, 1)

    def estimate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to a cell's codes, by table."""
        rest = q - self.centroids[cell]
        out = np.zeros((len(q), len(codes)))
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += squared(rest[:, p], b)[:, codes[:, j]]
        return out

    def measure(self, reps: DataFrame, codes: DataFrame, k: int) -> None:
        """Widths that find RECALL of the pilots' ``k`` nearest of all vectors."""
        dim = self.centroids.shape[1]
        best = Window.partitionBy("pilot").orderBy("far", "guess")
        found = reps.mapInArrow(_pilot_nearest(self, dim, k), "pilot int, far double, guess double, cell int")
        true = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).toArrow()  # PILOTS * k rows
        pilot, guess, cell = (true.column(c).to_numpy() for c in ("pilot", "guess", "cell"))
        if not len(pilot):
            return
        order = np.argsort(squared(self.pilots, self.centroids), 1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.cells)[None], 1)
        at = int(np.ceil(RECALL * len(pilot))) - 1
        self.probes = max(self.probes, int(np.sort(rank[pilot, cell])[at]) + 1)
        before = codes.mapInArrow(_pilot_places(self, pilot, guess), "neighbour int, n long")
        places = before.groupBy("neighbour").agg(F.sum("n").alias("n")).toArrow().column("n").to_numpy()
        self.rerank = max(self.rerank, int(np.sort(places)[at]) + 1)


def _pilot_nearest(index: Index, dim: int, k: int):
    """A partition's nearest vectors of each pilot, but the pilot itself: exact and estimated distance, cell."""

    def kernel(batches):
        held = [np.zeros((len(index.pilots), 0)) for _ in range(3)]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = seen(_column(batch.slice(at, 2048), "v"), dim)
                cell, code = index.encode(x)
                far, guess = squared(index.pilots, x), squared(index.pilots, index.decode(cell, code))
                for i, j in zip(*np.nonzero(far <= 1e-9 * (index.pilots**2).sum(1)[:, None]), strict=True):
                    if (x[j] == index.pilots[i]).all():
                        far[i, j] = np.inf
                new = [far, guess, np.broadcast_to(cell.astype(float), far.shape)]
                held = [np.concatenate(z, 1) for z in zip(held, new, strict=True)]
                near = np.argsort(held[0], 1, kind="stable")[:, :k]
                held = [np.take_along_axis(z, near, 1) for z in held]
        far, guess, cell = (z.ravel() for z in held)
        pilot = np.repeat(np.arange(len(index.pilots), dtype=np.int32), held[0].shape[1])
        fine = np.isfinite(far)
        cols = [pilot[fine], far[fine], guess[fine], cell[fine].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["pilot", "far", "guess", "cell"])

    return kernel


def _pilot_places(index: Index, pilot: np.ndarray, limit: np.ndarray):
    """How many of a partition's vectors are estimated nearer than each of the true neighbours."""

    def kernel(batches):
        n = np.zeros(len(pilot), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                code = np.frombuffer(b"".join(_column(part, "code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                guess = np.sort(squared(index.pilots, index.decode(_column(part, "cell").to_numpy(), code)), 1)
                for i in range(len(index.pilots)):
                    mine = pilot == i
                    n[mine] += np.searchsorted(guess[i], limit[mine])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["neighbour", "n"])

    return kernel


def _assign(index: Index, dim: int):
    def kernel(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own, codes = index.encode(seen(_column(part, "v"), dim))
                data = [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays([_column(part, "rep"), *data], ["rep", "cell", "code"])

    return kernel


def _probe(index: Index, dim: int):
    def kernel(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                far = squared(seen(_column(part, "q"), dim), index.centroids)
                near = np.argsort(far, 1)[:, : index.probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]).astype(np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([_column(part, "query_id"), _column(part, "q"), lists], ["query_id", "q", "cells"])

    return kernel


def _search(index: Index, dim: int):
    def kernel(key, codes, queries):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "guess": pa.array([], pa.float64())})
        if not codes.num_rows or not queries.num_rows:
            return empty
        rep, cell = codes.column("rep").to_numpy(), codes.column("cell").to_numpy()
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)
        q, ids = seen(queries.column("q"), dim), queries.column("query_id").to_numpy()
        probed = np.zeros((len(ids), index.cells), bool)
        lists = queries.column("cells").combine_chunks()
        flat, width = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        probed[np.repeat(np.arange(len(ids)), width), flat] = True
        guess = np.full((len(ids), len(rep)), np.inf)
        for c in np.unique(cell):
            who, mine = np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)
            if len(who):
                guess[np.ix_(who, mine)] = index.estimate(q[who], c, code[mine])
        out = []
        for i in range(len(ids)):
            g = guess[i]
            near = np.argpartition(g, index.rerank)[: index.rerank] if len(g) > index.rerank else np.arange(len(g))
            near = near[np.isfinite(g[near])]
            out.append((np.full(len(near), ids[i]), rep[near], g[near]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": a, "rep": b, "guess": c})

    return kernel


def _exact(batches):
    for batch in batches:
        if batch.num_rows:
            q, v = _column(batch, "q"), _column(batch, "v")
            dim = len(q[0])
            with np.errstate(over="ignore"):
                a, b = matrix(q, dim), matrix(v, dim)
                d = a - b
                score = np.sqrt((d * d).sum(1))
            odd = np.flatnonzero(~np.isfinite(score) | ((score < 1e-140) & d.any(1)))  # squares out of range
            if len(odd):
                scale = np.maximum(np.abs(a[odd]).max(1), np.abs(b[odd]).max(1))[:, None]
                d = a[odd] / scale - b[odd] / scale
                most = np.maximum(np.abs(d).max(1, keepdims=True), 1e-300)
                with np.errstate(over="ignore"):
                    score[odd] = np.sqrt(((d / most) ** 2).sum(1)) * most[:, 0] * scale[:, 0]
            yield pa.RecordBatch.from_arrays([_column(batch, "query_id"), _column(batch, "rep"), pa.array(score)], ["query_id", "rep", "score"])


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, vec_id: str, embedding: str, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where ``is_query`` holds."""
    spark = rows.sparkSession
    v = F.col(embedding).cast("array<double>")
    base = rows.where(usable(v) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    found = []
    for dim in [r[0] for r in base.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]:
        own = base.where(F.size("v") == dim)
        reps = staged(own.groupBy("v").agg(F.min("vec_id").alias("rep")), "vectors")
        n = reps.count()
        share = min(1.0, 1.1 * SAMPLE / n)
        sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("rep").limit(SAMPLE).select("v") if n > SAMPLE else reps.select("v")
        x = seen(sample.toArrow().column("v"), dim)
        index = Index(x, n, k)
        codes = staged(reps.mapInArrow(_assign(index, dim), "rep long, cell int, code binary"), "codes")
        index.measure(reps, codes, k)
        shard_of, shard, used = [], 0, 0  # (cell, salts, first shard): one row a cell
        for r in sorted(codes.groupBy("cell").count().collect(), key=lambda r: r["cell"]):
            salts = -(-r["count"] // SHARD)
            if salts > 1 or used + r["count"] > SHARD:
                shard, used = shard + (used > 0), 0
            shard_of.append((r["cell"], salts, shard))
            used += r["count"]
            if salts > 1:
                shard, used = shard + salts, 0
        shards = spark.createDataFrame(shard_of, "cell int, salts int, first int")
        queries = staged(own.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct().mapInArrow(_probe(index, dim), "query_id long, q array<double>, cells array<int>"), "queries")
        asked = queries.withColumn("cell", F.explode("cells")).join(F.broadcast(shards), "cell")
        asked = asked.withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("salts") - 1)))
        asked = staged(asked.groupBy("query_id", "q", "shard").agg(F.collect_list("cell").alias("cells")), "asked")
        # A shard's codes go to as many blocks as the queries that probe it fill.
        blocks = staged(asked.groupBy("shard").agg(F.ceil(F.count("*") / QBLOCK).cast("int").alias("blocks")), "blocks")
        of_shard = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("salts"))).cast("int")
        placed = codes.join(F.broadcast(shards), "cell").select(of_shard.alias("shard"), "rep", "cell", "code").join(blocks, "shard")
        placed = placed.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "cell", "code")
        block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
        asked = asked.join(blocks, "shard").select("shard", block.alias("block"), "query_id", "q", "cells")
        near = placed.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(index, dim), "query_id long, rep long, guess double")
        best = Window.partitionBy("query_id").orderBy("guess", "rep")
        near = staged(near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= index.rerank).select("query_id", "rep"), "candidates")
        exact = near.join(reps, "rep").join(queries.select("query_id", "q"), "query_id").mapInArrow(_exact, "query_id long, rep long, score double")
        # Copies: a representative stands for its k + 1 smallest ids (the query may be one of them).
        first = Window.partitionBy("query_id").orderBy("score", "rep")
        exact = exact.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r")
        member = own.select("v", "vec_id").join(reps, "v").select("rep", "vec_id").distinct()
        low = Window.partitionBy("rep").orderBy("vec_id")
        member = staged(member.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= k + 1).drop("_r"), "members")
        found.append(exact.join(member, "rep").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
