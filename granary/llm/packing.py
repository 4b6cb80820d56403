"""Packing token sequences into windows by multiway differencing.

Every document is tokenised, closed with an end id, and cut: as many whole windows as it fills, then a rest
in pieces of at most ``piece`` ids. Rests are gathered, partition by partition, into groups of about
``group`` windows, and Karmarkar-Karp differencing splits each group into the fewest near-equal windows:
partial partitions start as single pieces; the two with the largest spread are merged, the largest part of
one with the smallest of the other, until one is left. If its largest window exceeds the capacity, the
window count rises and the group is split anew. There is no shuffle, so no key can be hot, memory is one
group's, and a lost task repeats its own input split only.

All ids are the library's own. A byte-level BPE file without a normaliser lets a text be divided before an ASCII
white-space byte that follows a character other than white space: no pre-token and no added token spans such a
place, so the ids of the spans, one after another, are those of the whole text. Spans repeat, so a task keeps the
ids of those it has seen, as arrays of at most CACHE bytes, and gives them up when it ends; spans over LONG bytes
are encoded anew each time. New spans are encoded many at a time, one after another as in a text. Under any other kind of file whole texts are encoded.

Edge cases: null and empty texts hold the end id alone; an added token written out in a text gets its id, as in the
library; a very long text is cut into many whole windows, and one without white space is a single span, which is
not kept; rows that repeat are packed once each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.text import SPACE, U, ranges, slices, spans_hash, utf8

CACHE = 32 << 20
LONG = 64
LOT = 256  # new spans encoded as one text
SLICE = 1 << 20  # bytes of text encoded at once
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_open: dict[str, Encoder] = {}


class Encoder:
    """A tokenizers file, and the ids of spans seen so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        known = json.loads(self.tokenizer.to_str())
        pre = known["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = known["added_tokens"] or []
        whole = any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        self.divides = bool(plain and known["normalizer"] is None and not whole)
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of text that an id stands for
        if self.divides:
            for token, i in known["model"]["vocab"].items():
                self.width[i] = len(token)  # a letter of the byte-level alphabet is a byte
            for t in added:
                self.width[t["id"]] = len(t["content"].encode())
        self.clear()

    def clear(self) -> None:
        self.keys, self.used = np.zeros(0, U), np.zeros(0, bool)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each one's number of ids."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, lists), np.int32, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(length.sum()))
        return ids, length

    def encode_spans(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some spans, and where each one's begin and how many they are; ``last`` tells which end a text.

        Spans that begin with white space and don't end a text may follow one another, as they would in a text: LOT of them are
        encoded as one, and told apart again by the bytes that their ids stand for."""
        raw = data.tobytes()
        parts = [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        start, size = np.zeros(len(s), np.int64), np.zeros(len(s), np.int32)
        ids, joined = np.zeros(0, np.uint32), np.zeros(len(s), bool)
        if self.divides and len(s):
            joined = SPACE[data[s]] & ~last
            k = np.flatnonzero(joined).tolist()
            ids, _ = self.encode([b"".join([parts[i] for i in k[at : at + LOT]]).decode("utf-8", "replace") for at in range(0, len(k), LOT)])
            ends, cuts = np.cumsum(self.width[ids]), np.cumsum((e - s)[joined])
            at = np.searchsorted(ends, cuts)
            if len(ends) == (at[-1] + 1 if len(at) else 0) and (ends[at] == cuts).all():
                size[joined] = np.diff(at, prepend=-1)
                start[joined] = at + 1 - size[joined]
            else:  # a file whose ids don't add up to the text
                ids, joined = ids[:0], np.zeros(len(s), bool)
        alone = np.flatnonzero(~joined)
        more, size[alone] = self.encode([parts[i].decode("utf-8", "replace") for i in alone.tolist()])
        start[alone] = len(ids) + np.cumsum(size[alone], dtype=np.int64) - size[alone]
        return np.concatenate([ids, more]), start, size

    def spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the spans that may be encoded apart."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        if self.divides:
            space = SPACE[data]
            cut[1:-1] = space[1:] & ~space[:-1]
            # A character of two or three bytes before it may be other white space: leave those places whole.
            wide = np.flatnonzero(cut[:-1] & np.concatenate([[False], data[:-1] >= 0x80]))
            odd = (data[wide - 2] == 0xC2) | ((wide >= 3) & np.isin(data[wide - 3], (0xE1, 0xE2, 0xE3)))
            cut[wide[odd]] = False
        cut[off[:-1]] = True
        cut[len(data)] = False
        s = np.flatnonzero(cut)
        return s, np.append(s[1:], len(data))

    def batch(self, column, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end``, and the offsets of the texts in them."""
        data, off = utf8(column)
        s, e = self.spans(data, off)
        keys, first, which = np.unique(spans_hash(data, s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        from_, to = s[first[new]], e[first[new]]
        ids, begin, size = self.encode_spans(data, from_, to, np.isin(to, off[1:]))
        # The batch's ids by distinct span: kept ones, then new ones.
        start, length = np.empty(len(keys), np.int64), np.empty(len(keys), np.int32)
        start[known], length[known] = self.start[at[known]], self.length[at[known]]
        start[new], length[new] = len(self.ids) + begin, size
        pool = np.concatenate([self.ids, ids])
        per_span = length[which].astype(np.int64)
        # A text's ids, then its end: room for one more id after each text.
        n = len(off) - 1
        total = np.zeros(len(s) + 1, np.int64)
        np.cumsum(per_span, out=total[1:])
        doc_off = total[np.searchsorted(s, off)] + np.arange(n + 1)
        out = np.full(int(doc_off[-1]), end, np.uint32)
        place = np.ones(len(out), bool)
        place[doc_off[1:] - 1] = False
        out[place] = pool[ranges(start[which], per_span)]
        self.used[at[known]] = True
        short = new[(e - s)[first[new]] <= LONG]
        self.keep(keys[short], start[short], length[short], pool)
        return out, doc_off

    def keep(self, keys: np.ndarray, start: np.ndarray, length: np.ndarray, pool: np.ndarray) -> None:
        """Adds spans; when CACHE is full, those that were not met again since it was last full go."""
        keys = np.concatenate([self.keys, keys])
        start, length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        used = np.concatenate([self.used, np.zeros(len(keys) - len(self.used), bool)])
        order = np.argsort(keys, kind="stable")
        self.ids = pool
        if 21 * len(keys) + 4 * len(pool) > CACHE:
            order = order[used[order]]
            if 21 * len(order) + 4 * int(length[order].sum()) > CACHE // 2:
                order = order[:0]
            self.ids = pool[ranges(start[order], length[order])]
            start[order] = np.cumsum(length[order], dtype=np.int64) - length[order]
            used[:] = False
        self.keys, self.used, self.start, self.length = keys[order], used[order], start[order], length[order]


def differencing(sizes: np.ndarray, m: int) -> list[list[int]]:
    """Splits items into ``m`` parts of near-equal sums."""
    n = len(sizes)
    left: list[int] = []
    right: list[int] = []
    states = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        total = np.zeros(m, np.int64)
        bins = np.full(m, -1, np.int64)
        total[0], bins[0] = size, i
        states[i] = (total, bins)
        heap.append((-size, i))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (ta, ba), (tb, bb) = states.pop(a), states.pop(b)
        tb, bb = tb[::-1], bb[::-1]
        total = ta + tb
        both = np.flatnonzero((ba >= 0) & (bb >= 0))
        bins = np.maximum(ba, bb)
        if len(both):
            bins[both] = n + len(left) + np.arange(len(both))
            left += ba[both].tolist()
            right += bb[both].tolist()
        order = np.argsort(-total, kind="stable")
        total, bins = total[order], bins[order]
        states[serial] = (total, bins)
        heapq.heappush(heap, (int(total[-1] - total[0]), serial))
        serial += 1
    parts = []
    for b in next(iter(states.values()))[1].tolist() if states else []:
        items, stack = [], [b] if b >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x - n], right[x - n])
        parts.append(items)
    return parts


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The fewest near-equal windows by differencing that hold at most ``capacity`` each."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        parts = differencing(sizes, m)
        if max((int(sizes[p].sum()) for p in parts), default=0) <= capacity:
            return [sorted(p) for p in parts if p]
        m += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, piece: int = 512, group: int = 96) -> DataFrame:
    """Pieces of documents placed in sequences: SCHEMA, where ids holds little-endian 32-bit ids.

    tokenizer: the path of a file of the tokenizers library on every machine. A sequence's pieces lie gapless from
    offset 0; sequence_id is unique over the whole result.
    """

    def kernel(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 32
        waiting: list[tuple] = []
        held = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def close() -> list[tuple]:
            nonlocal serial, waiting, held
            rows = []
            for part in windows(np.array([w[2] for w in waiting], np.int64), capacity):
                offset = 0
                for i in part:
                    rows.append((*waiting[i], serial, offset))
                    offset += waiting[i][2]
                serial += 1
            waiting, held = [], 0
            return rows

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                encoder = _open.get(tokenizer) or _open.setdefault(tokenizer, Encoder(tokenizer))
                ids, off = encoder.batch(part.column(part.schema.get_field_index("text")), end)
                ids_of = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                rows = []
                for d, a, b in zip(ids_of, off[:-1].tolist(), off[1:].tolist(), strict=True):
                    n, at = b - a, 0
                    while n - at >= capacity:
                        rows.append((d, at, capacity, ids[a + at : a + at + capacity].tobytes(), n, serial, 0))
                        serial += 1
                        at += capacity
                    while at < n:
                        size = min(piece, n - at)
                        waiting.append((d, at, size, ids[a + at : a + at + size].tobytes(), n))
                        held += size
                        at += size
                        if held >= group * capacity:
                            rows += close()
                if rows:
                    yield emit(rows)
        if waiting:
            yield emit(close())
        if tokenizer in _open:
            _open[tokenizer].clear()  # the worker goes on to other stages

    return docs.select("doc_id", "text").mapInArrow(kernel, SCHEMA)
