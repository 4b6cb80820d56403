"""Exact substring dedup by level-wise doubling of repeated word windows.

A window of ``length`` words can repeat only if its parts do. Level one takes windows of about a quarter of the
length, and of those only each text's anchors: positions whose hash is the smallest among the starts inside
some full window, chosen by content alone, so equal full windows have equal anchors. Anchors that repeat
anywhere are extended to twice the length, to the right and to the left; extensions that repeat are
extended to the whole window. Each level looks only at what the one before left, and ends when nothing is
left. At the last level every full window around a surviving anchor is compared.

Windows of a level are compared by 64-bit hashes. A chunk of text ships each hash once: a hash that repeats inside
the chunk is known to repeat, and only the chunk's sole occurrences wait for an answer. So a passage that stands
in a third of all texts costs a row per chunk and level. Full windows travel by runs: consecutive windows of a text that
have the same leading anchor are one row, dealt by the hash of that anchor, for equal windows have equal anchors. Two
windows are equal if both their anchors' and their own hashes are, 128 bits. An anchor with more than its share of
the runs (at most HOT such anchors exist) is split by the windows' hashes.

Edge cases: null and empty texts and those shorter than a window lose nothing; kept words are joined by one
space (nothing kept: the digest of the empty string); a very long text is a batch of its own; rows that are exactly alike are documents of their own
and so repeat each other; rows that share a doc_id are told apart by their text; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged, unstage
from granary.llm.text import U, dealt, grams, mix, ranges, slices, spans_hash, utf8, words

CHUNK = 16 << 20
HOT = 4096  # an anchor is hot that has more than one in HOT of all runs of windows


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _words(column):
    data, off = utf8(column)
    s, e, first = words(data, off)
    return data, s, e, first, spans_hash(data, s, e)


def _inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the window of n words at each start stays in its text."""
    m = max(total - n + 1, 0)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:m]
    return np.arange(m) + n <= first[doc + 1]


def anchors(h: np.ndarray, first: np.ndarray, length: int, part: int) -> np.ndarray:
    """Sorted starts of windows of ``part`` words that are the smallest (leftmost among equals) of some full
    window's starts, by a hash of their content."""
    full = np.flatnonzero(_inside(first, length, len(h)))
    if not len(full):
        return full
    return np.unique(_least(mix(grams(h, part) ^ U(0x5DEECE66D)), length - part + 1)[full])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the smallest of ``width`` consecutive entries stands, by doubling spans."""
    at = np.arange(len(x))
    span = 1
    while span < width:
        step = min(span, width - span)
        m = len(at) - step
        if m <= 0:
            return at[:0]
        left, right = at[:m], at[step:]
        at = np.where(x[right] < x[left], right, left)
        span += step
    return at


class _Chunk:
    """Collects (hash, row, position, ...) of a chunk and tells known repeats from those to ask about."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.bytes = 0

    def split(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Masks of rows that are their hash's first here and of those whose hash repeats here, and the
        columns, all in the texts' order."""
        cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.argsort(cols[0], kind="stable")
        h = cols[0][order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        size = np.diff(np.append(np.flatnonzero(first), len(h)))
        new, many = np.empty_like(first), np.empty_like(first)
        new[order] = first
        many[order] = np.repeat(size > 1, size)
        self.parts, self.bytes = [], 0
        return new, many, cols


#: h: the window's hash, asks: whether this row waits for an answer (else it tells of a repeat in its chunk),
#: a, b: the row's key, at: the position, right, left: hashes of the extensions (0 where there is none).
_LEVEL = "h long, asks boolean, known boolean, a long, b long, at int, right long, left long"


def _level_rows(new, many, cols):
    """Rows to ship: sole occurrences, one teller for each hash that repeats here, and the known repeats."""
    h, a, b, at, right, left = cols
    for asks, known, keep in ((True, False, ~many), (False, False, many & new), (False, True, many)):
        i = np.flatnonzero(keep)
        for k in range(0, len(i), 1 << 18):
            j = i[k : k + (1 << 18)]
            flags = [pa.array(np.full(len(j), x)) for x in (asks, known)]
            sides = [pa.array(x[j].view(np.int64)) for x in (right, left)]
            cols = [pa.array(h[j].view(np.int64)), *flags, pa.array(a[j]), pa.array(b[j]), pa.array(at[j].astype(np.int32)), *sides]
            yield pa.RecordBatch.from_arrays(cols, ["h", "asks", "known", "a", "b", "at", "right", "left"])


def _first_level(length: int, part: int):
    def kernel(batches):
        chunk = _Chunk()
        for batch in batches:
            for p in slices(batch, "text"):
                _, _, _, first, h = _words(_column(p, "text"))
                at = anchors(h, first, length, part)
                if len(at):
                    double = min(2 * part, length)
                    doc = np.searchsorted(first, at, "right") - 1
                    g, e = grams(h, part)[at], grams(h, double)
                    right, left = np.zeros(len(at), U), np.zeros(len(at), U)
                    ok = at + double <= first[doc + 1]
                    right[ok] = e[at[ok]] | U(1)
                    ok = at - part >= first[doc]
                    left[ok] = e[at[ok] - part] | U(1)
                    a, b = (_column(p, c).to_numpy() for c in ("a", "b"))
                    chunk.parts.append((g, a[doc], b[doc], at - first[doc], right, left))
                chunk.bytes += p.nbytes
                if chunk.bytes >= CHUNK and chunk.parts:
                    yield from _level_rows(*chunk.split())
        if chunk.parts:
            yield from _level_rows(*chunk.split())

    return kernel


def _answers(batches):
    """One partition of shipped rows, a hash's rows together: the asking rows whose hash another row has."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    i = np.flatnonzero(_repeats(table.column("h").to_numpy()) & table.column("asks").to_numpy())
    for k in range(0, len(i), 1 << 18):
        yield from table.take(pa.array(i[k : k + (1 << 18)])).combine_chunks().to_batches()


def _repeats(*keys: np.ndarray) -> np.ndarray:
    """Whether each row's keys stand in another row as well."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    out = np.zeros(len(order), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _by_text(batches):
    """(a, b, anchors): places of a batch's rows by text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, at = (_column(batch, c).to_numpy() for c in ("a", "b", "at"))
        order = np.lexsort((at, b, a))
        a, b, at = a[order], b[order], at[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        start = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(a)).astype(np.int32)), pa.array(at.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), lists], ["a", "b", "anchors"])


def _repeated(shipped: DataFrame) -> DataFrame:
    """Of level rows, those whose window repeats."""
    asked = dealt(shipped.where("not known").drop("known"), shipped.count(), "h")
    asked = asked.mapInArrow(_answers, _LEVEL.replace("known boolean, ", ""))
    return asked.drop("asks").union(shipped.where("known").drop("asks", "known"))


def _places(rows: DataFrame, name: str) -> DataFrame:
    """(ka, kb, name): each text's positions, from lists of them."""
    return rows.groupBy(F.col("a").alias("ka"), F.col("b").alias("kb")).agg(F.flatten(F.collect_list(name)).alias(name))


#: keys, starts, sizes: of a text's runs (their anchor's hash, first window, number of windows); hashes: of all their windows.
_FULL = "doc_id long, a long, b long, n_words int, clean string, text string, keys array<long>, starts array<int>, sizes array<int>, hashes array<long>"


def _last_level(length: int, part: int):
    """Texts with surviving anchors: the hashes of the full windows that hold one; other texts are done."""

    def kernel(batches):
        for batch in batches:
            for p in slices(batch, "text"):
                data, s, e, first, h = _words(_column(p, "text"))
                n = np.diff(first)
                full = np.flatnonzero(_inside(first, length, len(h)))
                live = np.zeros(len(h) + 1, bool)
                lists = _column(p, "anchors")
                at = lists.flatten().to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(p.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                live[first[own] + at] = True
                lead, g, anchor = full, np.zeros(0, U), np.zeros(0, U)
                if len(full):
                    small = grams(h, part)
                    lead = _least(mix(small ^ U(0x5DEECE66D)), length - part + 1)[full]
                    full, lead = full[live[lead]], lead[live[lead]]
                    g, anchor = grams(h, length)[full], small[lead]
                doc = np.searchsorted(first, full, "right") - 1
                new = np.ones(len(full), bool)
                new[1:] = (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1]) | (full[1:] != full[:-1] + 1)
                run = np.flatnonzero(new)
                has = np.bincount(doc, minlength=p.num_rows) > 0
                raw = data.tobytes()
                text = _column(p, "text").to_pylist()
                spans = zip(first[:-1].tolist(), first[1:].tolist(), has.tolist(), strict=True)
                clean = [None if some else _digest(raw, s[i:j], e[i:j]) for i, j, some in spans]
                of_runs = pa.array(np.searchsorted(doc[run], np.arange(p.num_rows + 1)).astype(np.int32))
                of_windows = pa.array(np.searchsorted(doc, np.arange(p.num_rows + 1)).astype(np.int32))
                sizes = np.diff(np.append(run, len(full)))
                out = {
                    "doc_id": _column(p, "doc_id"), "a": _column(p, "a"), "b": _column(p, "b"), "n_words": pa.array(n.astype(np.int32)),
                    "clean": pa.array(clean, pa.string()), "text": pa.array([t if has[i] else None for i, t in enumerate(text)], pa.string()),
                    "keys": pa.ListArray.from_arrays(of_runs, pa.array(anchor[run].view(np.int64))),
                    "starts": pa.ListArray.from_arrays(of_runs, pa.array((full - first[doc])[run].astype(np.int32))),
                    "sizes": pa.ListArray.from_arrays(of_runs, pa.array(sizes.astype(np.int32))),
                    "hashes": pa.ListArray.from_arrays(of_windows, pa.array(g.view(np.int64))),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return kernel


def _digest(raw: bytes, s, e) -> str:
    return hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)])).hexdigest()


#: A run's windows that wait for an answer or tell of a repeat, and (known) those known to repeat in their chunk.
_RUN = "key long, salt int, asks boolean, known boolean, a long, b long, windows array<int>, hashes array<long>"


def _ship_full(hot: dict[int, int]):
    """Runs of a chunk's windows. hot: the number of parts of each anchor that has too many runs for one task."""
    hot_keys = np.array(sorted(hot), np.int64)
    hot_parts = np.array([hot[k] for k in hot_keys.tolist()], np.int64)

    def rows(parts):
        key, a, b, at, h = (np.concatenate(c) for c in zip(*parts, strict=True))
        salt = np.zeros(len(key), np.int64)
        if len(hot_keys):
            place = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
            of_hot = hot_keys[place] == key
            salt[of_hot] = (mix(h[of_hot].view(U)) % hot_parts[place[of_hot]].astype(U)).astype(np.int64)
        many = _repeats(h, key)
        order = np.lexsort((h, key))
        first = np.zeros(len(h), bool)
        first[order[:1]] = True
        first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
        for asks, known, keep in ((True, False, ~many), (False, False, many & first), (False, True, many)):
            i = np.flatnonzero(keep)
            if not asks and not known:  # whose text it is doesn't matter to tellers: a row for each anchor
                i = i[np.lexsort((h[i], salt[i], key[i]))]
                same = [key[i], salt[i]]
            else:
                i = i[np.lexsort((at[i], salt[i], key[i], b[i], a[i]))]
                same = [a[i], b[i]] if known else [a[i], b[i], key[i], salt[i]]
            new = np.ones(len(i), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
            start = np.flatnonzero(new)
            bounds = np.append(start, len(i))
            for k in range(0, len(start), 1 << 15):
                r = start[k : k + (1 << 15)]
                j = i[r[0] : bounds[min(k + (1 << 15), len(start))]]
                off = pa.array((np.append(r, r[0] + len(j)) - r[0]).astype(np.int32))
                none = pa.array(np.zeros(len(r) + 1, np.int32))
                windows = pa.ListArray.from_arrays(off, pa.array(at[j].astype(np.int32)))
                hashes = pa.ListArray.from_arrays(none if known else off, pa.array(h[:0] if known else h[j]))
                flags = [pa.array(np.full(len(r), x)) for x in (asks, known)]
                cols = [pa.array(key[i[r]]), pa.array(salt[i[r]].astype(np.int32)), *flags, pa.array(a[i[r]]), pa.array(b[i[r]]), windows, hashes]
                yield pa.RecordBatch.from_arrays(cols, ["key", "salt", "asks", "known", "a", "b", "windows", "hashes"])

    def kernel(batches):
        parts, held = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                p = batch.slice(k, 64)
                size = _column(p, "sizes").flatten().to_numpy()
                own = np.repeat(np.arange(p.num_rows), pc.list_value_length(_column(p, "keys")).to_numpy(zero_copy_only=False))
                own = np.repeat(own, size)
                at = ranges(_column(p, "starts").flatten().to_numpy(), size)
                key = np.repeat(_column(p, "keys").flatten().to_numpy(), size)
                a, b = (_column(p, c).to_numpy()[own] for c in ("a", "b"))
                parts.append((key, a, b, at, _column(p, "hashes").flatten().to_numpy()))
                held += 40 * len(at)
                if held >= 2 * CHUNK:
                    yield from rows(parts)
                    parts, held = [], 0
        if parts:
            yield from rows(parts)

    return kernel


def _same_windows(batches):
    """One partition of runs, an anchor's together: of the asking runs, the windows that another run has."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    lists = table.column("hashes").combine_chunks()
    size = lists.value_lengths().to_numpy()
    h, key = lists.flatten().to_numpy(), np.repeat(table.column("key").to_numpy(), size)
    hit = _repeats(h, key) & np.repeat(table.column("asks").to_numpy(), size)
    run = np.repeat(np.arange(len(size)), size)[hit]
    at = table.column("windows").combine_chunks().flatten().to_numpy()[hit]
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else run
    a, b = (table.column(c).to_numpy()[run[start]] for c in ("a", "b"))
    for k in range(0, len(start), 1 << 15):
        r = start[k : k + (1 << 15)]
        to = start[k + (1 << 15)] if k + (1 << 15) < len(start) else len(run)
        off = pa.array((np.append(r, to) - r[0]).astype(np.int32))
        lists = pa.ListArray.from_arrays(off, pa.array(at[r[0] : to]))
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 15)]), pa.array(b[k : k + (1 << 15)]), lists], ["a", "b", "windows"])


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(length: int, with_text: bool):
    def kernel(batches):
        for batch in batches:
            for p in slices(batch, "text"):
                data, s, e, first, _ = _words(_column(p, "text"))
                raw = data.tobytes()
                lists = _column(p, "windows").to_pylist()
                removed, shas, texts = [], [], []
                for i, w in enumerate(lists):
                    a, b = first[i], first[i + 1]
                    gone = np.zeros(b - a, bool)
                    if w:
                        w = np.unique(np.array(w))
                        gone[np.unique(ranges(w, np.full(len(w), length)))] = True
                    keep = a + np.flatnonzero(~gone)
                    kept = b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if with_text else None)
                cols = [_column(p, "doc_id"), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(shas), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return kernel


def remove_repeats(docs: DataFrame, length: int = 35, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of all documents, without the words of windows of
    ``length`` words that occur more than once; ``kept`` (their text) only where asked for and changed."""
    part = max(1, (length + 3) // 4)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("a"), F.xxhash64("text", F.col("doc_id").isNull()).alias("b")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key)
    first = staged(texts.select("text", "a", "b").mapInArrow(_first_level(length, part), _LEVEL), "anchors")
    alive = staged(_repeated(first), "alive", release=True)
    unstage(first)
    # Level two: extensions to twice the length. A full window around an anchor holds one of the two.
    side = F.explode(F.array(F.col("right"), F.col("left"))).alias("h")
    zero = F.lit(0).cast("long")
    double = alive.select("a", "b", "at", side).where("h != 0").withColumns({"asks": F.lit(True), "known": F.lit(False), "right": zero, "left": zero})
    double = double.select("h", "asks", "known", "a", "b", "at", "right", "left")
    double = staged(double.mapInArrow(_combine, _LEVEL), "double")
    unstage(alive)
    live = _repeated(double).select("a", "b", "at").mapInArrow(_by_text, "a long, b long, anchors array<int>")
    live = staged(_places(live, "anchors"), "anchored", release=True)
    unstage(double)
    joined = texts.join(live, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left").select("doc_id", "text", "a", "b", "anchors")
    full = staged(joined.mapInArrow(_last_level(length, part), _FULL), "full", release=True)
    unstage(live)
    # The last level: full windows, by runs.
    runs = full.where("clean is null").select("a", "b", "keys", "starts", "sizes", "hashes")
    per = staged(runs.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "runs")
    n = per.agg(F.sum("n")).first()[0] or 0
    share = max(HOT, n // HOT)
    hot = {r["key"]: -(-r["n"] // share) for r in per.where(F.col("n") > share).collect()}  # fewer than HOT rows
    unstage(per)
    shipped = staged(runs.mapInArrow(_ship_full(hot), _RUN), "shipped")
    asked = dealt(shipped.where("not known").select("key", "salt", "asks", "a", "b", "windows", "hashes"), 16 * n, "key", "salt")
    asked = asked.mapInArrow(_same_windows, "a long, b long, windows array<int>")
    hit = staged(_places(asked.union(shipped.where("known").select("a", "b", "windows")), "windows"), "repeated", release=True)
    unstage(shipped)
    same = (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb"))
    rest = full.where("clean is null").select("doc_id", "text", "a", "b").join(hit, same, "left")
    cut = rest.select("doc_id", "text", "windows").mapInArrow(_remove(length, with_text), _RESULT)
    clean = full.where("clean is not null").select(
        "doc_id", F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_removed"), F.col("clean").alias("kept_sha256"), F.lit(None).cast("string").alias("kept")
    )
    return cut.union(clean)


def _combine(batches):
    """Extensions of one partition, combined as a chunk's."""
    chunk = _Chunk()
    for b in batches:
        if b.num_rows:
            sides = (_column(b, c).to_numpy().view(U) for c in ("right", "left"))
            chunk.parts.append((_column(b, "h").to_numpy().view(U), *(_column(b, c).to_numpy() for c in ("a", "b", "at")), *sides))
            chunk.bytes += 48 * b.num_rows
            if chunk.bytes >= 2 * CHUNK:
                yield from _level_rows(*chunk.split())
    if chunk.parts:
        yield from _level_rows(*chunk.split())
