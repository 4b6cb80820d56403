"""Documents whose sets of word shingles have a high Jaccard similarity, by PartEnum signatures.

Sets fall into bands by size, each band reaching as far as the similarity lets sizes differ, so similar sets
lie in the same band or in neighbours; every set signs for its own band and the next. Within a band
similar sets differ in at most k elements. The domain is hashed into n1 = ceil((k + 1) / 2) partitions, so in one
of them the sets differ in at most one element; each partition is divided into n2 cells, and a signature is
the content of n2 - 1 of them, for every choice: one choice leaves out the cell with the difference, so similar
sets share a signature, always. Where a choice could be empty (thin partitions) its content alone says
nothing; such partitions are signed by their whole content and by it less each element, which a
difference of one cannot escape either. Sets with k = 0 are signed whole.

Exact copies and equal signatures are combined map-side: a chunk of text ships a signature once, so a
signature that a third of all documents carry costs a row per chunk. Candidates are verified exactly on
the sets: first each document with the leader it meets most, then the other leaders outside its component,
then, for signatures that still span components, pairs across components that parity sketches of the sets
(lower bounds of their difference) do not rule out. The last are compared where they meet, without becoming rows: only the documents
of such a pair are sent on, with wider sketches, and those still left with their sets. Pairs inside a component are never made, since they cannot change the result.

Edge cases: null and empty texts (or white space only) have no set and link with nothing; a text shorter than
a shingle is one shingle; a null doc_id is returned with a null component; rows that share a doc_id are one
node; a very long text is a batch of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged, unstage
from granary.llm.cluster import components
from granary.llm.text import U, dealt, grams, mix, slices, word_hashes

CHUNK = 16 << 20  # bytes of text combined before signatures are shipped
BLOCK = 1024  # documents of one signature compared in one task, by pairs of such blocks
PASSES = 2  # signatures are shuffled a part at a time, so that only such a part lies on the disk beside the staged ones
WIDER = 8  # times a sketch is as wide for the documents that others leave over
SMALL = 64  # bands up to this size have three cells a partition, others two


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def shingle_sets(column, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' distinct shingles (sorted by text, then hash), the texts' offsets, each shingle's text."""
    h, first = word_hashes(column, lower=True)
    count = np.diff(first)
    g = grams(h, n)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(g)) + n <= first[doc[: len(g)] + 1] if len(g) else np.zeros(0, bool)
    g, owner = g[inside], doc[: len(inside)][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([_sequence(h[first[i] : first[i + 1]]) for i in short], U)
        g, owner = np.concatenate([g, whole]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(count) + 1)), owner


def _sequence(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * 0x100000001B3 + x) & 0xFFFFFFFFFFFFFFFF
    return out


class Bands:
    """The bands for a similarity of ``percent`` / 100, up to sets of ``most`` elements."""

    def __init__(self, percent: int, most: int):
        self.last = []
        low = 1
        while True:
            self.last.append(low * 100 // percent)
            if low > most:
                break
            low = self.last[-1] + 1
        self.last.append(low * 100 // percent)
        self.last = np.array(self.last, np.int64)
        k = (100 - percent) * 2 * self.last // (100 + percent)
        self.k, self.n1 = k, (k + 2) // 2
        self.n2 = np.where(self.last <= SMALL, 3, 2)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.last, sizes)


def signatures(g: np.ndarray, off: np.ndarray, owner: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of all sets."""
    size = np.diff(off)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, U)
    bands = Bands(percent, int(size.max()))
    docs, sigs = [], []
    total = np.zeros(len(g) + 1, U)
    np.cumsum(g, out=total[1:])
    whole = total[off[1:]] - total[off[:-1]]
    for step in (0, 1):
        band = bands.of(np.maximum(size, 1)) + step
        tag = mix(band.astype(U) + U(0x51ED2701))
        exact = np.flatnonzero((size > 0) & (bands.k[band] == 0))
        docs.append(exact)
        sigs.append(mix(whole[exact] ^ tag[exact]))
        fuzzy = bands.k[band] > 0
        n1, n2 = np.where(fuzzy, bands.n1[band], 0), bands.n2[band]
        mine = fuzzy[owner]
        e, d = g[mine], owner[mine]
        if not len(e):
            continue
        he = mix(e ^ tag[d])
        a = (he % n1[d].astype(U)).astype(np.int64)
        c = ((he >> U(40)) % n2[d].astype(U)).astype(np.int64)
        part_first = np.cumsum(n1) - n1
        cell_first = np.cumsum(n1 * n2) - n1 * n2
        part, cell = part_first[d] + a, cell_first[d] + a * n2[d] + c
        parts, cells = int(n1.sum()), int((n1 * n2).sum())
        in_part, in_cell = np.zeros(parts, U), np.zeros(cells, U)
        np.add.at(in_part, part, e)
        np.add.at(in_cell, cell, e)
        part_n, cell_n = np.bincount(part, minlength=parts), np.bincount(cell, minlength=cells)
        part_doc = np.repeat(np.arange(len(n1)), n1)
        part_no = np.arange(parts) - part_first[part_doc]
        per = n2[part_doc]
        cell_part = np.repeat(np.arange(parts), per)
        rest_n = part_n[cell_part] - cell_n
        least = np.minimum.reduceat(rest_n, np.cumsum(per) - per)
        part_tag = mix(tag[part_doc] + part_no.astype(U))
        chosen = np.flatnonzero(least[cell_part] >= 1)
        p = cell_part[chosen]
        no = chosen - (np.cumsum(per) - per)[p]
        docs.append(part_doc[p])
        sigs.append(mix((in_part[p] - in_cell[chosen]) ^ (part_tag[p] + no.astype(U) + U(1))))
        thin = least <= 1
        p = np.flatnonzero(thin)
        docs.append(part_doc[p])
        sigs.append(mix(in_part[p] ^ (part_tag[p] - U(1))))
        own = np.flatnonzero(thin[part])
        docs.append(d[own])
        sigs.append(mix((in_part[part[own]] - e[own]) ^ (part_tag[part[own]] - U(1))))
    return np.concatenate(docs), np.concatenate(sigs)


_SIGNED = "doc_id long, n long, head long, bits binary, sigs array<long>, shared array<long>, leaders array<long>"


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _sign(percent: int, n: int):
    def kernel(batches):
        heads: dict[tuple, int] = {}
        ids: list = []
        sizes: list = []
        first: list = []
        sketches: list = []
        docs, sigs, held = [], [], 0

        def flush():
            nonlocal ids, sizes, first, sketches, docs, sigs, held
            d, s = np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, U), *sigs])
            order = np.lexsort((d, s))
            d, s = d[order], s[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            again = np.zeros(len(s), bool)
            again[1:] = ~new[1:] & (d[1:] != d[:-1])
            leader = d[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else d
            node = np.array([-1 if i is None else i for i in ids], np.int64)

            def by_doc(keep, values):
                rows = d[keep]
                o = np.argsort(rows, kind="stable")
                return _lists(rows[o], len(ids), values[keep][o])

            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(sketches, pa.binary()), by_doc(new, s.view(np.int64)), by_doc(again, s.view(np.int64)), by_doc(again, node[leader] if len(s) else node[:0])],
                ["doc_id", "n", "head", "bits", "sigs", "shared", "leaders"],
            )
            ids, sizes, first, sketches, docs, sigs, held = [], [], [], [], [], [], 0
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                g, off, owner = shingle_sets(_column(part, "text"), n)
                size = np.diff(off)
                total = np.zeros((2, len(g) + 1), U)
                np.cumsum(g, out=total[0, 1:])
                np.cumsum(mix(g ^ U(0xABCDEF)), out=total[1, 1:])
                name = (total[:, off[1:]] - total[:, off[:-1]]).T.tolist()
                own = _column(part, "doc_id").to_pylist()
                rep = np.zeros(len(own), bool)
                for i, (doc, k, key) in enumerate(zip(own, size.tolist(), name, strict=True)):
                    head = doc
                    if doc is not None and k:
                        head = heads.setdefault((*key, k), doc)
                        rep[i] = head == doc
                    first.append(head)
                    sketches.append(sketch(g[off[i] : off[i + 1]]) if rep[i] else None)
                keep = rep[owner]
                d, s = signatures(g[keep], np.searchsorted(owner[keep], np.arange(len(own) + 1)), owner[keep], percent)
                docs.append(d + len(ids))
                sigs.append(s >> U(16))  # 48 bits take less room; what meets by chance is ruled out by its sketch
                ids += own
                sizes += size.tolist()
                held += part.nbytes
                if held >= CHUNK:
                    yield flush()
            if len(heads) > 2_000_000:
                heads.clear()  # later copies are found by their signatures
        if ids:
            yield flush()

    return kernel


def _meet(batches):
    """One partition of (sig, doc): rows (sig, doc, leader) of signatures that several documents have."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    s = np.concatenate([_column(b, "sig").to_numpy() for b in rows])
    d = np.concatenate([_column(b, "doc").to_numpy() for b in rows])
    order = np.lexsort((d, s))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    leader = d[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    again = ~new
    again[1:] &= (d[1:] != d[:-1]) | new[1:]
    keep = np.flatnonzero(again & (leader != d))
    for at in range(0, len(keep), 1 << 18):
        i = keep[at : at + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(d[i]), pa.array(leader[i])], ["sig", "doc", "leader"])


def _sets(n: int):
    def kernel(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                g, off, _ = shingle_sets(_column(part, "text"), n)
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(g.view(np.int64)))], ["doc_id", "shingles"])

    return kernel


def _sketches(n: int):
    """(doc_id, n, bits): sketches WIDER times as wide as those that all documents have."""

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                g, off, _ = shingle_sets(_column(part, "text"), n)
                bits = [sketch(g[a:b], WIDER) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), pa.array(np.diff(off)), pa.array(bits, pa.binary())], ["doc_id", "n", "bits"])

    return kernel


def sketch(v: np.ndarray, times: int = 1) -> bytes:
    """A set's parities: bit i tells whether an odd number of elements hash to i. Sets that differ in h
    elements differ in at most h bits, so more differing bits than h rule a pair out, surely; the more surely, the more ``times`` as wide."""
    width = times * min(4096, max(512, 1 << int(2 * len(v)).bit_length()))
    odd = np.bincount((mix(v) % U(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _possible(percent: int):
    """Candidate pairs that sizes and sketches do not rule out."""

    def kernel(batches):
        for batch in batches:
            n, m = _column(batch, "n").to_numpy(), _column(batch, "m").to_numpy()
            most = (100 - percent) * (n + m) // (100 + percent)
            ok = np.abs(n - m) <= most
            x, y = _column(batch, "x").to_pylist(), _column(batch, "y").to_pylist()
            for i in np.flatnonzero(ok).tolist():
                p, q = _folded([x[i], y[i]])
                ok[i] = np.bitwise_count(p ^ q).sum() <= most[i]
            i = pa.array(np.flatnonzero(ok))
            yield batch.select(["doc", "leader", "times"]).take(i)

    return kernel


def _folded(bits: list[bytes]) -> np.ndarray:
    """Sketches at the smallest width among them: longer ones are folded by exclusive or."""
    width = min(map(len, bits))
    out = np.empty((len(bits), width // 8), U)
    for i, x in enumerate(bits):
        v = np.frombuffer(x, U).reshape(-1, width // 8)
        out[i] = np.bitwise_xor.reduce(v, 0) if len(v) > 1 else v[0]
    return out


def _blocks(rows: list[pa.RecordBatch]):
    """The rows of one partition as a table, and for each signature's block pair the places of its rows and of its two blocks' rows."""
    table = pa.Table.from_batches(rows)
    sig, left, right, block, doc = (table.column(x).to_numpy() for x in ("sig", "left", "right", "block", "doc"))
    o = np.lexsort((doc, right, left, sig))
    new = np.ones(len(o), bool)
    new[1:] = (sig[o[1:]] != sig[o[:-1]]) | (left[o[1:]] != left[o[:-1]]) | (right[o[1:]] != right[o[:-1]])
    bounds = np.append(np.flatnonzero(new), len(o))

    def groups():
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            g, every = o[a:b], np.arange(b - a)
            alone = left[g[0]] == right[g[0]]
            x, y = (every, every) if alone else (np.flatnonzero(block[g] == left[g[0]]), np.flatnonzero(block[g] == right[g[0]]))
            if len(x) and len(y):
                yield g, x, y, alone

    return table, groups()


def _close(percent: int, sketch: np.ndarray, n: np.ndarray, c: np.ndarray, i: int, y: np.ndarray) -> np.ndarray:
    """Those of the rows ``y`` that lie in another component than row ``i`` and that sizes and sketches don't rule out."""
    y = y[c[y] != c[i]]
    most = (100 - percent) * (n[i] + n[y]) // (100 + percent)
    fits = np.abs(n[i] - n[y]) <= most
    y, most = y[fits], most[fits]
    return y[np.bitwise_count(sketch[i] ^ sketch[y]).sum(1) <= most]


_BLOCK_ROWS = "sig long, left int, right int, block int, doc long, c long, n long"


def _across(percent: int):
    """The rows of each signature's block pair that may be similar to one of another component: a row comes once, however many those are."""

    def kernel(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table, groups = _blocks(rows)
        c, n = (table.column(x).to_numpy() for x in ("c", "n"))
        bits = table.column("bits").to_pylist()
        some = np.zeros(len(c), bool)
        for g, x, y, alone in groups:
            sketch, own_c, own_n = _folded([bits[i] for i in g]), c[g], n[g]
            for i in x.tolist():
                near = _close(percent, sketch, own_n, own_c, i, y[y > i] if alone else y)
                if len(near):
                    some[g[near]] = some[g[i]] = True
        if some.any():
            yield from table.drop_columns("bits").filter(pa.array(some)).to_batches()

    return kernel


def _linked(percent: int):
    """Links between components, for each signature's block pair: pairs are compared by their whole sets where they meet. A link makes
    two components one, so no more links come out than rows have gone in."""

    def kernel(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table, groups = _blocks(rows)
        doc, c = (table.column(x).to_numpy() for x in ("doc", "c"))
        sets = table.column("shingles").combine_chunks()
        off, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(U)
        u, v, failed = [], [], set()
        for g, x, y, alone in groups:
            own = [values[off[i] : off[i + 1]] for i in g.tolist()]
            wide, own_c, own_n = _folded([sketch(s, WIDER) for s in own]), c[g].copy(), np.diff(off)[g]
            narrow = np.bitwise_xor.reduce(wide.reshape(len(wide), WIDER, -1), 1)
            for i in x.tolist():
                near = _close(percent, narrow, own_n, own_c, i, y[y > i] if alone else y)
                for j in _close(percent, wide, own_n, own_c, i, near).tolist():
                    pair = (int(doc[g[i]]), int(doc[g[j]]))
                    if own_c[i] == own_c[j] or pair in failed:
                        continue
                    both = len(own[i]) + len(own[j]) - len(np.union1d(own[i], own[j]))
                    if both * 100 >= (len(own[i]) + len(own[j]) - both) * percent:
                        u.append(pair[0])
                        v.append(pair[1])
                        own_c[own_c == own_c[j]] = own_c[i]
                    elif len(failed) < 1 << 20:
                        failed.add(pair)  # it may meet again on another signature
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return kernel


def similar(docs: DataFrame, percent: int = 85, n: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents: components of the graph that links documents
    whose shingle sets' intersection is at least ``percent`` per cent of their union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = staged(texts.mapInArrow(_sign(percent, n), _SIGNED), "signed")
    signed = staged(full.select("doc_id", "n", "head", "bits"), "sizes")
    copies = signed.where("doc_id != head").select(F.col("doc_id").alias("u"), F.col("head").alias("v"))
    n_sigs = full.agg(F.sum(F.size("sigs"))).first()[0] or 0
    every = full.select(F.explode("sigs").alias("sig"), F.col("doc_id").alias("doc"))
    local = full.where(F.size("shared") > 0).select("doc_id", F.explode(F.arrays_zip("shared", "leaders")).alias("x")).select(F.col("x.shared").alias("sig"), F.col("doc_id").alias("doc"), F.col("x.leaders").alias("leader"))
    parts = [staged(local.where("leader != doc"), "met")]
    for k in range(PASSES):
        part = dealt(every.where(F.col("sig") % PASSES == k), n_sigs // PASSES, "sig")
        parts.append(staged(part.mapInArrow(_meet, "sig long, doc long, leader long"), "met", release=True))
    unstage(full)
    met = functools.reduce(DataFrame.union, parts)
    sketches = signed.where("bits is not null").select("doc_id", "n", "bits")
    x = sketches.select(F.col("doc_id").alias("doc"), "n", F.col("bits").alias("x"))
    y = sketches.select(F.col("doc_id").alias("leader"), F.col("n").alias("m"), F.col("bits").alias("y"))
    pairs = met.groupBy("doc", "leader").agg(F.count("*").alias("times")).join(x, "doc").join(y, "leader")
    pairs = pairs.select("doc", "leader", "times", "n", "m", "x", "y").mapInArrow(_possible(percent), "doc long, leader long, times long")
    pairs = staged(pairs.groupBy("doc", "leader").agg(F.max("times").alias("times")), "pairs", release=True)

    def texts_of(nodes: DataFrame) -> DataFrame:
        return texts.join(staged(nodes.distinct(), "nodes"), F.col("doc_id") == F.col("node"), "left_semi")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return staged(texts_of(nodes).mapInArrow(_sets(n), "doc_id long, shingles array<long>"), "sets", release=True)

    def verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
        a = sets.select(F.col("doc_id").alias("doc"), F.col("shingles").alias("a"))
        b = sets.select(F.col("doc_id").alias("leader"), F.col("shingles").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        kept = candidates.select("doc", "leader").join(a, "doc").join(b, "leader").withColumn("both", both)
        return kept.where(F.col("both") * 100 >= (F.size("a") + F.size("b") - F.col("both")) * percent).select(F.col("doc").alias("u"), F.col("leader").alias("v"))

    sets = sets_of(pairs.select(F.explode(F.array("doc", "leader")).alias("node")))
    best = pairs.groupBy("doc").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("leader"))
    best = staged(best, "best")
    edges = staged(copies.union(verified(best, sets)), "links")
    comp = staged(components(edges), "components")

    def apart(candidates: DataFrame) -> DataFrame:
        x = comp.select(F.col("node").alias("doc"), F.col("component").alias("cd"))
        y = comp.select(F.col("node").alias("leader"), F.col("component").alias("cl"))
        joined = candidates.join(x, "doc", "left").join(y, "leader", "left")
        return joined.where(F.coalesce("cd", "doc") != F.coalesce("cl", "leader")).select("doc", "leader")

    second = staged(apart(pairs.select("doc", "leader").join(best, ["doc", "leader"], "left_anti")), "second")
    unstage(pairs)
    if not second.isEmpty():
        edges = staged(edges.union(verified(second, sets)), "links")
        comp = staged(components(edges), "components")
    # Signatures whose documents still lie in several components: pairs of others than the leader.
    member = met.select("sig", "doc").union(met.select("sig", F.col("leader").alias("doc"))).distinct()
    member = member.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("c"))
    member = staged(member, "member")
    for used in parts:
        unstage(used)
    wide = member.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("rows")).where("lo != hi")
    wide = staged(wide.select("sig", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), "rows"), "wide")
    n_open = 8 * (wide.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0)  # a row holds a sketch
    open_ = member.join(wide, "sig").join(sketches, F.col("doc") == F.col("doc_id")).select("sig", "doc", "c", "n", "bits", "blocks")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("doc", "sig"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("sig", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "block", "doc", "c", "n", "bits")
    third = staged(dealt(open_, n_open, "sig", "left", "right").mapInArrow(_across(percent), _BLOCK_ROWS), "third", release=True)
    block_pair = ("sig", "left", "right")
    if not third.isEmpty():
        wider = texts_of(third.select(F.col("doc").alias("node"))).mapInArrow(_sketches(n), "d long, n long, bits binary")
        wider = third.drop("n").join(staged(wider, "sketches", release=True), F.col("doc") == F.col("d")).drop("d")
        weight = 2 * (third.agg(F.sum("n")).first()[0] or 0)
        narrow, third = third, staged(dealt(wider, weight, *block_pair).mapInArrow(_across(percent), _BLOCK_ROWS), "third", release=True)
        unstage(narrow)
    if not third.isEmpty():
        # Pairs are verified where they meet, so they never become rows, of which there may be as many as the square of a group.
        whole = sets_of(third.select(F.col("doc").alias("node"))).withColumnRenamed("doc_id", "d")
        weight = third.agg(F.sum("n")).first()[0] or 0
        third = dealt(third.join(whole, F.col("doc") == F.col("d")).drop("d"), weight, *block_pair)
        more = staged(third.mapInArrow(_linked(percent), "u long, v long").distinct(), "links", release=True)
        if not more.isEmpty():
            comp = staged(components(edges.union(more)), "components")
    return _result(signed, comp)


def _result(signed: DataFrame, comp: DataFrame) -> DataFrame:
    joined = signed.select("doc_id", "n").join(comp, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
