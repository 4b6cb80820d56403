"""Document operators against brute force on odd rows and on the small tables."""

import collections
import hashlib
import itertools
import os
import random

import numpy as np
import pytest

from granary.llm import lines, maxent, mixture, packing, partenum, substrings

SF = "/root/testdata/sf0.001/documents.parquet"
tables = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def both(spark, odd_docs):
    yield odd_docs
    if os.path.exists(SF):
        yield spark.read.parquet(SF)


def jaccard_components(rows, n, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = split(t, True)
        s = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        sets[i].append(s)
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: sorted(map(len, s)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, odd_docs, n, percent):
    for docs in both(spark, odd_docs):
        want, sizes = jaccard_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n, percent)
        got = partenum.similar(docs, percent, n).collect()
        assert len(got) == docs.count()
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        by = collections.defaultdict(list)
        for r in got:
            by[r.doc_id].append(r.n_shingles)
        assert {k: sorted(v) for k, v in by.items()} == sizes


def test_signatures_are_shuffled_in_parts(spark, odd_docs, monkeypatch):
    """However many parts signatures are shuffled in, the groups are the same, and the tables of what met are gone in the end."""
    made, gone = [], []
    stage, drop = partenum.staged, partenum.unstage

    def staged(df, name, **how):
        out = stage(df, name, **how)
        made.append((name, out._staged_at))
        return out

    monkeypatch.setattr(partenum, "staged", staged)
    monkeypatch.setattr(partenum, "unstage", lambda df: (gone.append(df._staged_at), drop(df)))
    got = []
    for n in (1, 3):
        monkeypatch.setattr(partenum, "PASSES", n)
        made.clear()
        got.append(sorted(map(str, partenum.similar(odd_docs, 80, 2).collect())))
        met = [at for name, at in made if name in ("met", "pairs")]
        assert len(met) == n + 2 and set(met) <= set(gone)
    assert got[0] == got[1] and len(got[0]) > 5


def test_pairs_across_components_are_no_rows():
    """Of a signature's documents, each of its own component, come as many rows as there are documents, though nearly all pairs pass their
    sketches; the links that are left are those of the whole sets."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 200, dtype=np.int64)
    sets = [np.unique(np.concatenate([base[: 182 - 2 * (i % 2)], rng.integers(0, 1 << 63, 16, dtype=np.int64)])).view(np.uint64) for i in range(150)]
    sets += [np.unique(np.append(sets[0][1:], sets[149][:1])), sets[7][2:]]
    n, ids = len(sets), range(len(sets))
    names = ["sig", "left", "right", "block", "doc", "c", "n", "bits"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
    values = [[5] * n, [0] * n, [0] * n, [0] * n, ids, ids, map(len, sets), map(partenum.sketch, sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names)
    close = pa.Table.from_batches(partenum._across(85)([batch]))
    assert 100 < close.num_rows <= n
    close = close.append_column("shingles", pa.array([sets[i].view(np.int64).tolist() for i in close.column("doc").to_pylist()], pa.list_(pa.int64())))
    got = pa.Table.from_batches(partenum._linked(85)(close.to_batches())).to_pylist()
    alike = [len(np.intersect1d(x, y)) * 100 >= 85 * len(np.union1d(x, y)) for x, y in itertools.combinations(sets, 2)]
    want = [p for p, ok in zip(itertools.combinations(ids, 2), alike, strict=True) if ok]
    assert len(got) < n

    def parts(links):
        root = list(ids)
        for _ in ids:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert want and parts([(r["u"], r["v"]) for r in got]) == parts(want)


def test_signatures_never_miss():
    """Sets at the limit of similarity share a signature, whatever their size."""
    rng = np.random.default_rng(0)
    from granary.llm.text import U

    for size in [1, 2, 5, 6, 7, 8, 12, 20, 33, 64, 65, 100, 300, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).astype(U))
            out = rng.integers(0, int(size * 15 / 100) + 1)
            b = a[out:]
            room = int(len(b) * 100 / 85) - len(a)
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, max(room, 0), dtype=np.int64).astype(U)]))
            both_ = len(np.intersect1d(a, b))
            if 100 * both_ < 85 * (len(a) + len(b) - both_):
                continue
            g = np.concatenate([a, b])
            off = np.array([0, len(a), len(g)])
            d, s = partenum.signatures(g, off, np.repeat([0, 1], [len(a), len(b)]), 85)
            assert set(s[d == 0].tolist()) & set(s[d == 1].tolist()), (size, out)


def removed_windows(rows, length):
    count = collections.Counter(tuple(w[j : j + length]) for _, w in rows for j in range(len(w) - length + 1))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if count[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [1, 2, 8, 35])
def test_substrings(spark, odd_docs, length):
    for docs in both(spark, odd_docs):
        rows = [(r.doc_id, split(r.text)) for r in docs.select("doc_id", "text").collect()]
        got = substrings.remove_repeats(docs, length).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == removed_windows(rows, length)


def test_substrings_with_a_hot_anchor(spark, monkeypatch):
    """A passage shorter than a window in every text, so its anchor has most runs and is split; some texts repeat."""
    from tests.llm.conftest import words

    monkeypatch.setattr(substrings, "HOT", 3)
    passage = words(70, 30)
    texts = [f"{words(100 + i, 12)} {passage} {words(200 + i, 12)}" for i in range(30)]
    texts += texts[:3] + [f"{words(300, 9)} {t}" for t in texts[5:8]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(docs, 35).collect()
    want = removed_windows([(i, split(t)) for i, t in enumerate(texts)], 35)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want


def test_lines(spark, odd_docs):
    got = {(r.doc_id, r.text): (r.kept_text, r.lines_removed) for r in lines.dedup(odd_docs).collect()}
    by = {k[0]: v for k, v in got.items()}
    assert by[13][1] == 0 and by[14][1] == 1
    assert by[8][0] == "one" and by[9] == ("", 1) and by[3] == (None, 0) and by[5][1] == 0
    assert set(odd_docs.columns) <= set(lines.dedup(odd_docs).columns)


def test_lines_with_clashing_names(spark):
    names = ["a", "b", "h", "c0", "removed", "kept", "gone", "key", "kept_text", "lines_removed", "x.y"]
    docs = spark.createDataFrame([(i, "one line of text here", *range(11)) for i in range(3)], f"doc_id long, text string, {', '.join(f'`{c}` int' for c in names)}")
    got = sorted(lines.dedup(docs).collect(), key=lambda r: r.doc_id)
    assert [r.lines_removed for r in got] == [0, 1, 1] and [r.kept_text for r in got] == ["one line of text here", "", ""]
    assert got[0].asDict() == {"doc_id": 0, "text": "one line of text here", **dict(zip(names, range(11))), "kept_text": "one line of text here", "lines_removed": 0}


def normalised(text):
    return [b" ".join(row.split()) for row in (text or "").encode().lower().split(b"\n")]


@tables
@pytest.mark.parametrize("agree", [3, 4])
def test_lines_against_all_pairs(spark, monkeypatch, agree):
    """All line pairs of a table by edit similarity, without SimHash: most of those at 0.95 and more are found (the README has
    the figures for all from 0.8), and the result is what the found links and equal lines give, with different plans."""
    plan = lines.Plan(agree, agree - 2)
    monkeypatch.setattr(lines, "plan_for", lambda n: plan)
    docs = spark.read.parquet(SF).where("doc_id < 60")
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    different = sorted({row for _, t in texts for row in normalised(t)} - {b""})
    size = np.array([len(x) for x in different])
    grams = np.zeros((len(different), 4096), np.int16)  # an edit changes two counts of letter pairs out and two in
    for k, row in enumerate(different):
        np.add.at(grams[k], [(x * 31 + y) % 4096 for x, y in zip(row, row[1:])], 1)
    pairs = []
    for k in range(len(different)):
        most = 0.2 * np.maximum(size[:k], size[k])
        ok = np.flatnonzero((np.abs(size[:k] - size[k]) <= most) & (np.abs(grams[:k] - grams[k]).sum(1) <= 4 * most))
        pairs += [(int(j), k) for j in ok if lines.distance(different[j], different[k]) <= 0.2 * max(size[j], size[k]) + 1e-9]
    import pyarrow as pa

    sims = [int(lines.lines_of(pa.array([row.decode()]))[1][0]) for row in different]
    found = [(i, j) for i, j in pairs if (sims[i] ^ sims[j]).bit_count() <= lines.BITS]
    near = [(i, j) for i, j in pairs if lines.distance(different[i], different[j]) <= 0.05 * max(size[i], size[j])]
    print("found of all pairs", len(found), len(pairs), "of those from 0.95", len(set(found) & set(near)), len(near))
    assert len(near) > 5 and len(set(found) & set(near)) >= 0.8 * len(near)
    root = list(range(len(different)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in found:
        root[find(i)] = find(j)
    name, kept, want = {row: k for k, row in enumerate(different)}, set(), {}
    for d, t in texts:
        want[d] = 0
        for row in normalised(t):
            if row and (c := find(name[row])) in kept:
                want[d] += 1
            elif row:
                kept.add(c)
    assert {r.doc_id: r.lines_removed for r in lines.dedup(docs).collect()} == want


def test_more_lines_than_one_sort_holds(monkeypatch):
    """SimHashes and meetings do not depend on how many lines are sorted at once."""
    import pyarrow as pa

    texts = pa.array(["\n".join(f"line {i % 7} of {i % 50} words {i}" for i in range(300)), "one line", "\n\n"])
    want = lines.lines_of(texts)
    rng = np.random.default_rng(3)
    sim = np.sort(rng.integers(0, 1 << 12, 500, dtype=np.uint64))
    plan = lines.Plan(4, 2)

    def met():
        found = set()
        key = np.zeros(len(sim), np.int64)
        for x, y in lines._by_block(plan, key, sim, np.arange(len(sim))):
            found |= {(min(i, j), max(i, j)) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        return found

    pairs = met()
    monkeypatch.setattr(lines, "LINES", 16)
    assert all((a == b).all() for a, b in zip(want, lines.lines_of(texts), strict=True))
    assert met() == pairs and pairs


def test_similar_lines(spark):
    import pyarrow as pa

    from tests.llm.conftest import words

    base = words(31, 200)
    near = [" ".join("other" if j == k else w for j, w in enumerate(base.split())) for k in range(20)]
    far = words(32, 200)
    texts = [base, *near, far, "\n".join([far, base.upper(), ""])]
    sims = np.array([lines.lines_of(pa.array([t]))[1][0] for t in texts[:21]])
    close = np.bitwise_count(sims[:, None] ^ sims[None]) <= lines.BITS
    reach = close.astype(int)
    for _ in range(5):
        reach = (reach @ reach > 0).astype(int)
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].lines_removed for i in range(21)] == [int(reach[i, :i].any()) for i in range(21)] and sum(r.lines_removed for r in got.values()) > 5
    assert got[21].lines_removed == 0 and (got[22].lines_removed, got[22].kept_text) == (2, "")


@pytest.mark.parametrize(("agree", "m"), [(3, 1), (3, 3), (4, 2), (5, 1)])
def test_lines_within_the_radius_always_meet(agree, m):
    """Every pair within BITS, spread over the blocks at its worst or not, is found; planted at all distances."""
    from granary.llm.text import U

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.int64).astype(U)
    base[:200] = base[0] ^ (base[:200] & U(0xFFFF))  # a crowded part, so that groups are split
    near = base.copy()
    for i in range(400):
        for b in rng.permutation(64)[: i % 13]:
            near[i] ^= U(1) << U(int(b))
    sim = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(sim)) for j in range(i) if int(sim[i] ^ sim[j]).bit_count() <= lines.BITS}
    found, met, near = set(), set(), {}
    plan = lines.Plan(agree, m)
    for k, chosen in enumerate(plan.chosen):
        key = np.full(len(sim), k)
        for start, width in (plan.blocks[i] for i in chosen):
            key = (key << lines.WIDE) + ((sim >> U(start)) & U((1 << width) - 1)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        for x, y in lines._by_block(plan, key[order], sim[order], np.arange(len(sim))):
            found |= {(max(p), min(p)) for p in zip(order[x].tolist(), order[y].tolist(), strict=True)}
        # Without components: whatever is near something is found near, or stands in a crowd.
        crowd = np.zeros(len(sim), bool)
        near[k] = [(order[x], order[y]) for x, y in lines._by_block(plan, key[order], sim[order], None, crowd)]
        met |= {int(i) for pair in near[k] for side in pair for i in side.tolist()} | set(order[crowd].tolist())
    assert found == want and len(want) > 200
    assert {i for pair in want for i in pair} <= met


def test_lines_with_one_changed_word_of_forty(spark):
    """59 of the 60 pairs lie within 8 bits, 27 within 3."""
    from tests.llm.conftest import words

    texts = []
    for k in range(60):
        w = words(500 + k, 40).split()
        texts += [" ".join(w), " ".join("other" if j == k % 40 else x for j, x in enumerate(w))]
    got = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.lines_removed for r in got) >= 50


def test_distance_by_dynamic_programming():
    import random

    rnd = random.Random(1)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a, b = (bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(14))) for _ in range(2))
        assert lines.distance(a, b) == slow(a, b)


def test_near_lines_of_other_components_are_no_rows():
    """Lines of the same words in other orders have one SimHash: those that meet are sent on once each, however many pairs they make, and only links come out."""
    import pyarrow as pa

    rnd = random.Random(4)
    words_ = [f"word{i}" for i in range(20)]
    texts = [" ".join(rnd.sample(words_, 20)) for _ in range(200)]
    texts += [texts[i].replace("word3 ", "wordx3 ") for i in range(0, 200, 10)] + [texts[0] + "".join(f" other{i}" for i in range(20))]
    h, sim, _, _, size = lines._sized(pa.array(texts))
    assert size.tolist() == [len(t) for t in texts]
    sim[:] = sim[0]
    plan = lines.Plan(4, 1)
    keys = [plan.key(k, sim) for k in range(len(plan.chosen))]
    cols = [np.concatenate(keys), *(np.tile(x, len(keys)) for x in (h.view(np.int64), sim.view(np.int64), size.astype(np.int32), h.view(np.int64)))]
    rows = pa.Table.from_arrays([pa.array(x) for x in cols], ["key", "h", "sim", "size", "c"])
    some = pa.Table.from_batches(lines._across(plan, 0.8)(rows.to_batches()))
    assert some.num_rows == len(texts) - 1  # on the first key only; the longest line is too long for all others
    text = dict(zip(h.view(np.int64).tolist(), texts, strict=True))
    some = some.append_column("bytes", pa.array([text[x].encode() for x in some.column("h").to_pylist()]))
    links = {(r["u"], r["v"]) for b in lines._linked(plan, 0.8)(some.to_batches()) for r in b.to_pylist()}
    names = sorted(text)
    want = {(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if lines.distance(text[x].encode(), text[y].encode()) <= 0.2 * max(len(text[x]), len(text[y])) + 1e-9}
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        assert (min(x, y), max(x, y)) in want and find(x) != find(y)
        root[find(x)] = find(y)
    assert all(find(x) == find(y) for x, y in want) and len(want) >= 20


def test_similarity_of_many_pairs():
    """Pairs of all lengths around the 64 bits of a block, equal and empty ones too, are judged as by the distance of single pairs."""
    rnd = random.Random(2)
    some = []
    for k in range(1200):
        a = [rnd.choice("abcd \u00e9") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 128, 129, 200]))]
        b = [c for c in a if rnd.random() > rnd.choice([0, 0.1, 0.3])]
        some.append(("".join(a).encode(), "".join(rnd.choice("abcd") if rnd.random() < 0.1 * (k % 3) else c for c in b).encode()))
    some += [(b"a" * 5000, b"a" * 4999 + b"b"), (b"ab" * 3000, b"ba" * 3000)]
    x, y = zip(*some, strict=True)
    data, off = np.frombuffer(b"".join(x + y), np.uint8), np.cumsum([0, *map(len, x + y)])
    at = np.arange(len(some))
    for least in (0.8, 0.95):
        want = [lines.distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9 for a, b in some]
        assert lines.similar(data, off, at, at + len(some), least).tolist() == want
        assert 100 < sum(want) < len(want) - 100


def test_mixture(spark, odd_docs):
    for docs in both(spark, odd_docs):
        rows = mixture.mix(docs).collect()
        assert len(rows) == docs.count() and all(0 <= r.mix_copies <= 2 for r in rows)
        size, taken, target = collections.Counter(), collections.Counter(), {}
        for r in rows:
            assert r.mix_size == len(split(r.text))
            size[r.source] += r.mix_size
            taken[r.source] += r.mix_size * r.mix_copies
            target[r.source] = r.mix_target
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        capped: set = set()
        while True:
            left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
            rate = left / max(1, sum(weight[s] for s in order if s not in capped))
            more = {s for s in order if s not in capped and rate * weight[s] > 2 * size[s]}
            if not more:
                break
            capped |= more
        largest = max(r.mix_size for r in rows)
        for s in order:
            assert target[s] == pytest.approx(min(2 * size[s], rate * weight[s]))
            assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6
        assert sorted(map(str, rows)) == sorted(map(str, mixture.mix(docs.repartition(2)).collect()))


def test_mixture_with_null_ids_and_clashing_names(spark):
    from tests.llm.conftest import words

    added = ["size", "place", "mix_size", "mix_target", "below", "c0", "source_size"]
    rows = [(None if i % 5 else i, words(i, 20 + i % 9), "s", *range(len(added))) for i in range(300)] + [(None, words(700, 9000), "t", *range(len(added)))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} int' for c in added)}")
    got = mixture.mix(docs, weights=(1, 1), share=0.6, most=2.0).collect()
    assert len(got) == len(rows) and [got[0][c] for c in ("size", "place", "below", "c0", "source_size")] == [0, 1, 4, 5, 6]
    s = [r for r in got if r.source == "s"]
    assert abs(sum(r.mix_size * r.mix_copies for r in s) - s[0].mix_target) <= 15


def test_packing_round_trip(spark, odd_docs):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    added = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y  ", "<|endoftext|> \n<|endoftext|>x", "<|endoftext", "x\u3000y  z", "q" * 9000]
    more = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(added)], "doc_id long, text string")
    for docs in both(spark, odd_docs):
        docs = docs.where("doc_id is null or doc_id != 12").select("doc_id", "text").union(more)
        want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.where("doc_id is not null").collect()}
        parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.pack(docs, path).collect():
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length > 0
            sequences[r.sequence_id].append((r.offset, r.length))
            if r.doc_id is not None:
                assert r.doc_tokens == len(want[r.doc_id])
                parts[r.doc_id].append((r.start, ids))
        assert {d: [x for _, p in sorted(v) for x in p] for d, v in parts.items()} == want
        total = 0
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
            total += at
        assert len(sequences) <= total / 2048 * 1.1 + 8


def test_packing_encodes_new_spans_together(monkeypatch):
    """Spans of odd texts go to the library many at a time, and come back with the ids that whole texts have."""
    import pyarrow as pa
    import tokenizers

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rnd = random.Random(9)
    pieces = [" ", "  ", "\t", "\n\n", "\r\n", "\u00a0", "\u3000", "\u2003", "\x85", "\x0b", "<|endoftext|>", "don't", "12,5", "é", "日本", "🙂", "\x00", "\x1c", "'s", "x"]
    texts = [None, "", " ", "a ", " a", *("".join(rnd.choice(pieces) if rnd.random() < 0.5 else f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 60))) for _ in range(300))]
    texts += [" ".join(f"n{rnd.randrange(10**7)}" for _ in range(3000))]
    encoder, asked = packing.Encoder(path), []
    real = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda some: asked.append(len(some)) or real(some))
    library = tokenizers.Tokenizer.from_file(path)
    for _ in range(2):
        ids, off = encoder.batch(pa.array(texts, pa.string()), 1)
        got = [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert sum(asked) < 1000  # more than 6,000 different spans


def test_packing_with_a_small_cache(monkeypatch):
    """Ids are the library's when spans are given up and met again."""
    import pyarrow as pa

    from tests.llm.conftest import words

    encoder = packing.Encoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "CACHE", 1 << 14)
    for k in range(8):
        texts = [words(k % 3, 400) + " <|endoftext|> " + words(k, 90), None, " \n", words(9, 50)]
        ids, off = encoder.batch(pa.array(texts), 1)
        for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
            assert ids[a:b].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert 21 * len(encoder.keys) + 4 * len(encoder.ids) <= 1 << 14


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 512, 600)
    parts = packing.windows(sizes, 2048)
    sums = [int(sizes[p].sum()) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(600))
    assert max(sums) <= 2048 and max(sums) - min(sums) < 64 and len(parts) <= sizes.sum() / 2048 + 2


def test_language_model(spark, odd_docs):
    import math
    import zlib

    from granary.llm.queries import remainder

    for docs in both(spark, odd_docs):
        rows = docs.select("doc_id", "text").collect()
        train = collections.Counter()
        for r in rows:
            if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
                train.update([*split(r.text, True), None])
        n, v = sum(train.values()), len(train)
        got = maxent.score(docs, remainder(10) == 0, steps=3).collect()
        want = []
        for r in rows:
            w = [*split(r.text, True), None]
            base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            want.append((r.doc_id, r.doc_id is not None and not zlib.crc32(str(r.doc_id).encode()) % 10, len(w), sum(train[x] > 0 for x in w), n, round(base, 6)))
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@tables
def test_model_beats_the_base_on_held_out_texts(spark):
    from granary.llm.queries import op10_maxent

    held = [r for r in op10_maxent(spark, "/root/testdata/sf0.01").where("held_out").collect()]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_vocabulary(size: int = 0) -> maxent.Vocabulary:
    shape = maxent.Shape(size)
    stats = np.zeros(3 + 2 * shape.rest, np.int64)
    stats[:3] = 5000, 40, 3
    return maxent.Vocabulary(np.arange(10, 20, dtype=np.uint64), np.arange(20, 10, -1), stats, shape)


def test_model_is_a_distribution():
    for size in (0, 10**9):
        shape = maxent.Shape(size)
        rng = np.random.default_rng(0)
        w = rng.normal(size=(shape.class_rows, shape.classes)), rng.normal(size=(1 + shape.history, shape.buckets))
        one, two = np.array([3, shape.history - 1]), np.array([0, 9])
        p = np.exp(maxent.class_scores(w[0], one, two, shape)).repeat(shape.members, 1) * np.exp(maxent.member_scores(w[1], one, shape))
        assert p.sum(1) == pytest.approx([1, 1])
        bucket = np.arange(shape.buckets)
        norms = maxent.member_norms(w[1], shape)
        got = maxent._model(bucket, np.full_like(bucket, 3), np.zeros_like(bucket), w, norms, shape)
        assert got == pytest.approx(np.log(p[0]), abs=1e-4)


def test_model_grows_with_the_corpus():
    sizes = [maxent.Shape(10**k) for k in range(8, 15)]
    for name in ("classes", "buckets", "top", "history", "class_rows"):
        grown = [getattr(s, name) for s in sizes]
        assert grown == sorted(set(grown))


def test_model_gradient():
    """A block's gradient against differences of its negative log-likelihood, token by token."""
    vocabulary = small_vocabulary()
    shape, rng = vocabulary.shape, np.random.default_rng(1)
    n = 400
    one, two = 4 + rng.integers(0, 4, n), rng.integers(0, shape.history, n)
    bucket = rng.integers(0, 40, n) * 20
    w = [rng.normal(size=(shape.class_rows, shape.classes)), rng.normal(size=(1 + shape.history, shape.buckets))]
    codes = np.concatenate([(one - 4) * shape.span + two * shape.classes + bucket // shape.members, (one - 4) * shape.span + shape.history * shape.classes + bucket])
    codes, times = np.unique(codes, return_counts=True)
    got = [np.zeros_like(x) for x in w]
    for level, row, g in maxent._block_gradient(1, codes, times.astype(float), w, vocabulary):
        got[level][row] += np.frombuffer(g, "<f4")

    def loss():
        c, m = maxent.class_scores(w[0], one, two, shape), maxent.member_scores(w[1], one, shape)
        at = np.arange(n)
        seen = (c[at, bucket // shape.members] + m[at, bucket]).sum()
        return -seen - vocabulary.unknown * (c[:, -1] + m[:, -1]).sum()

    for level in (0, 1):
        used = np.argwhere(got[level])
        for row, column in used[rng.permutation(len(used))[:40]]:
            kept = w[level][row, column]
            w[level][row, column] = kept + 1e-5
            up = loss()
            w[level][row, column] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            w[level][row, column] = kept
            assert slope == pytest.approx(got[level][row, column], rel=1e-3, abs=1e-3)
    assert not got[0][1:5].any() and got[0][5:9].any()  # only the block's own words


def test_empty_tables(no_docs):
    assert partenum.similar(no_docs).count() == 0
    assert substrings.remove_repeats(no_docs).count() == 0
    assert lines.dedup(no_docs).count() == 0
    assert mixture.mix(no_docs).count() == 0
    assert packing.pack(no_docs, "unused").count() == 0
    from pyspark.sql import functions as F

    assert maxent.score(no_docs, F.lit(False), steps=1).count() == 0
