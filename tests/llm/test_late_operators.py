"""Centroid clustering, the quality classifier and the filter audit against plain versions of themselves."""

import hashlib
import os
from itertools import permutations
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import audit, centroids, quality
from granary.llm.queries import remainder, table
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
LABELS = "doc_id long, quality int, toxic int, text string, n long"


# --- centroid clustering


def lloyd(rows, k, rounds, dim, scale=1024):
    most = centroids.limit(dim)
    kept = [(i, [max(-most, min(most, floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = [[] for _ in c]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(groups, c, strict=True)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), c


def test_clusters_as_by_brute_force(spark):
    rng = np.random.default_rng(3)
    dim, nan = 6, float("nan")
    x = np.concatenate([rng.normal(size=(120, dim)) * rng.uniform(0.2, 9, (120, 1)), np.round(rng.normal(size=(60, dim)))])
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    rows += [(200, rows[5][1]), (7, rows[7][1]), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (300, None), (301, [0.0] * dim), (302, [nan] + [0.0] * 5), (303, [float("-inf")] + [0.0] * 5), (304, [None] + [0.0] * 5), (305, []), (306, [1.0]), (307, [1e300, -1e300, 0.0, 0.0, 0.0, 0.0]), (308, [1e300, -1e300, 1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    for k in (1, 8, 500):
        got = centroids.cluster(df, k=k, rounds=4, dim=dim)
        want, c = lloyd(rows, k, 4, dim)
        assert got.centroids == c
        assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got.assigned.collect()) == want


def test_annulus_holds_ties_and_leaves_others_out():
    c = np.array([[3, 4], [5, 0], [0, 5], [0, -5], [300, 400], [3, 4]], np.int64)
    search = centroids.Annulus(c)
    x = np.array([[0, 0], [4, 4], [3, 4], [290, 400], [-5, 0]], np.int64)
    number, distance = search.nearest(x)
    assert number.tolist() == [0, 0, 0, 4, 2] and distance.tolist() == [25, 1, 0, 100, 50]
    first, end = search.candidates(x)
    assert (end - first).tolist()[0] == 5 and (end - first).tolist()[3] == 1


def test_too_many_centroids_are_an_error(spark):
    with pytest.raises(ValueError, match="centroids"):
        centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"), k=1 << 20)


def test_no_vectors(spark):
    none = centroids.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert none.assigned.collect() == [] and none.centroids == []


# --- quality classifier


def test_risk_and_its_gradient():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, 30), rng.normal(0, 1, 50)

    def at(p, u, prior):
        plus, minus, _, _ = quality.risk(p, u, prior)
        return plus + minus if quality.risk(p0, u0, prior)[1] >= 0 else -minus

    for prior in (0.3, 0.95):
        p0, u0 = p, u
        _, minus, g_p, g_u = quality.risk(p, u, prior)
        assert (minus >= 0) == (prior == 0.3)
        for x, g, of in ((p, g_p, 0), (u, g_u, 1)):
            for i in (0, 7):
                step = np.zeros(len(x))
                step[i] = 1e-5
                high, low = (at(*((x + s, u) if of == 0 else (p, x + s)), prior) for s in (step, -step))
                assert abs((high - low) / 2e-5 - g[i]) < 1e-6


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.9])
def test_prior_from_tails(prior):
    rng = np.random.default_rng(2)
    good = np.minimum(rng.beta(6, 2, 40_000) * 100, 99).astype(int)
    bad = np.minimum(rng.beta(1, 8, 40_000) * 100, 99).astype(int)
    p = np.bincount(good[:20_000], minlength=100)
    u = np.bincount(good[20_000 : 20_000 + int(20_000 * prior)], minlength=100) + np.bincount(bad[: int(20_000 * (1 - prior))], minlength=100)
    assert abs(quality.tail_ratio(p, u) - prior) < 0.05


def test_features_of_odd_texts():
    texts = ["", None, "one", " \n ", "a b a b a b", "!!! ### |", "é 漢字 ü", words(1, 3000)]
    x = quality.features(pa.array(texts))
    assert x.shape == (8, quality.N_STATS + quality.PAIR_BUCKETS) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    one = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])  # no text changes another's
    assert np.allclose(x, one, atol=1e-6)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (6, 1, 1), (6, 0, 0), (8, None, None), (None, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    all_rows = F.lit(True)
    scorer = quality.fit(odd_docs, labels, all_rows)
    got = quality.score(odd_docs, scorer, ["doc_id", "size"]).collect()
    assert len(got) == 20 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[0] == by[1] and by[3] == by[4]  # equal texts, equal scores: ids and labels are no inputs
    assert quality.score(no_docs, scorer, ["doc_id"]).collect() == []
    assert quality.fit(no_docs, labels, all_rows) is None
    bad = labels.where("quality = 0")
    assert quality.fit(odd_docs, bad, all_rows) is None
    assert {(r["score"], r["predicted"]) for r in quality.score(odd_docs, None, ["doc_id"]).collect()} == {(0.5, 1)}


@tables
def test_quality_on_held_out_rows(spark):
    from granary.llm.queries import op12_quality

    sf = "/root/testdata/sf0.1"
    got = op12_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 100
    assert np.mean([s >= 0.5 for s in good]) >= 0.98 and np.mean([s < 0.5 for s in bad]) >= 0.95


@tables
def test_no_label_of_a_held_out_row_is_learned(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train = ~(remainder(3) == 1)
    lies = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    x, y = (quality.score(docs, quality.fit(docs, t, train), ["doc_id"]).orderBy("doc_id").collect() for t in (labels, lies))
    assert np.allclose([r["score"] for r in x], [r["score"] for r in y], atol=1e-6)


# --- filter audit


def plain_audit(docs, labels):
    import re

    texts = [(i, p or "", t or "") for i, p, t in docs]
    rows = []
    for i, p, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and s == t for j, _, s in texts)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": e}
        good, toxic = (i is not None and any(x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))
        rows.append((p, f, good, toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for o in map("".join, permutations("ABCDE")):
            left = mine
            for s, f in enumerate(o, 1):
                here = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fails = sum(r[1][f] for r in mine)
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                out[part, o, s] = [len(left), len(here), fails - len(here), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_as_by_brute_force(spark, odd_docs, no_docs):
    more = [(20, words(20, 60), None, "", 0, "x", "y", "z"), (21, words(20, 60).upper(), None, "", 0, "x", "y", "z"), (22, "a # " * 60, None, "s1", 0, "x", "y", "z"), (23, "é" * 80 + "ABCD" + " é" * 49, None, "s1", 0, "x", "y", "z"), (24, words(24, 50), None, "s1", 0, "x", "y", "z"), (2, None, None, None, 0, "x", "y", "z")]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema)).repartition(4)
    labels = [(0, 1, 0), (1, 1, 1), (6, 0, 1), (6, None, 0), (6, 1, None), (20, 1, 1), (None, 1, 1), (99, 1, 1), (12, 1, 0), (22, 1, 1)]
    got = audit.audit(docs, spark.createDataFrame([(*r, "t", 5) for r in labels], LABELS)).collect()
    want = plain_audit([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in got} == want and len(got) == len(want)
    assert audit.audit(no_docs, spark.createDataFrame([], LABELS)).collect() == []
    assert audit.audit(docs, spark.createDataFrame([], LABELS)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_of_many_parts_and_copies(spark):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("The Same Text").alias("text"), (F.col("id") % 700).cast("string").alias("source")).repartition(3)
    got = audit.audit(docs, spark.createDataFrame([], LABELS))
    assert got.count() == 700 * 600
    first = {(r["filter_order"], r["removed"]) for r in got.where("step = 1").groupBy("filter_order").agg(F.sum("removed").alias("removed")).collect()}
    assert {r for o, r in first if o[0] == "E"} == {n - 1} and {r for o, r in first if o[0] in "AC"} == {n} and {r for o, r in first if o[0] in "BD"} == {0}
