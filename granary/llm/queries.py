"""One query per operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.lines import dedup

    kept = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "lines_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.caps import link

    linked = link(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", least=0.98)
    return linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixture import mix

    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.urls import judge, junk

    return judge(table(spark, sf_dir, "pages"), bad=junk(F.col("html")))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.langid import fit, predict

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))
    return predict(docs, fit(docs, ~F.col("held_out")), ["doc_id", "held_out"])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.packing import pack

    return digest_pieces(pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=35).drop("kept")


def op9_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.partenum import similar

    return similar(table(spark, sf_dir, "documents"), percent=85, n=4)


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.maxent import score

    return score(table(spark, sf_dir, "documents"), remainder(10) == 0)


def op11_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.centroids import cluster

    done = cluster(table(spark, sf_dir, "embeddings"))
    sums = done.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    sizes = {r["cluster"]: int(r["s"]) for r in sums}
    rows = [(i, sizes.get(i, 0), sum(sizes.values()), digest) for i, digest in enumerate(done.digests())]
    each = spark.createDataFrame(rows, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = done.assigned.join(F.broadcast(each), F.col("cluster") == F.col("c"))
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    return score(docs.withColumn("held_out", held_out), fit(docs, table(spark, sf_dir, "labels"), ~held_out), ["doc_id", "held_out"])


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_urls says without its templates: host, path, rule and the rule's verdict."""
    from granary.llm.urls import RULES, host_and_path, matching

    host, path = host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    found = matching(RULES, F.col("host"), F.col("path"))
    return pages.select("page_id", "host", "path", found["rule"].alias("rule"), found["verdict"].alias("verdict"))


QUERIES = {
    "op1_lines": op1_lines, "op4_urls": op4_urls, "op7_ann": op7_ann, "op5_langid": op5_langid, "op8_substrings": op8_substrings,
    "op9_partenum": op9_partenum, "op2_caps": op2_caps, "op3_mixture": op3_mixture, "op6_packing": op6_packing, "op10_maxent": op10_maxent,
    "op11_annulus": op11_annulus, "op12_quality": op12_quality, "op13_audit": op13_audit, "url_rules": url_rules,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str) -> str:
    """Recursive closure of the links e (x < y): (node, component)."""
    return f"""
, ways AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e),
reach AS (SELECT DISTINCT {nodes} UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""


def _lloyd(k: int, rounds: int) -> str:
    """Lloyd's rounds in integers, written out: m0 are the first centroids, a<i> the assignments of a round, m<i> the centroids after it."""
    out = f"""
WITH u AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v AS m FROM u ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    for i in range(rounds + 1):
        out += f""",
d{i} AS (SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM u CROSS JOIN m{i}),
a{i} AS MATERIALIZED (SELECT vec_id, first(v) AS v, CAST(first(c ORDER BY distance, c) AS INTEGER) AS c, min(distance) AS distance FROM d{i} GROUP BY vec_id)"""
        if i < rounds:
            out += f""",
e{i} AS (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS k FROM a{i}),
s{i} AS (SELECT c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{i} GROUP BY c, k),
n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS m FROM s{i} GROUP BY c),
m{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM m{i} o LEFT JOIN n{i} n ON n.c = o.c)"""
    return (
        out
        + f"""
SELECT vec_id, a.c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c"""
    )


ORACLE: dict[str, str] = {
    "op2_caps": """
WITH RECURSIVE u AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98)"""
    + _components("vec_id AS node, vec_id AS root FROM embeddings")
    + """
SELECT vec_id, (SELECT count(*) FROM ways WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON node = vec_id""",
    "op3_mixture": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || coalesce(text, '')), 1, 9) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS w FROM d GROUP BY source),
rates AS (
  SELECT 0 AS step, 1.5 * (SELECT sum(source_size) FROM s) / (SELECT sum(w) FROM s) AS rate
  UNION ALL
  SELECT step + 1, (1.5 * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(2 * source_size) FROM s WHERE 2 * source_size < w * rate), 0)) / (SELECT sum(w) FROM s WHERE 2 * source_size >= w * rate)
  FROM rates WHERE step < 64 AND rate IS NOT NULL),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * (SELECT CAST(max(rate) AS DOUBLE) FROM rates)) AS target FROM s),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
v AS (SELECT source, place, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM d GROUP BY source, place),
c AS (
  SELECT v.source, CASE WHEN 2 * (target - whole * source_size - (upto - n)) > n THEN place + 1 ELSE place END AS below
  FROM v JOIN b ON v.source IS NOT DISTINCT FROM b.source WHERE upto >= target - whole * source_size AND upto - n < target - whole * source_size)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN place < coalesce(below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source""",
    "op8_substrings": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM starts),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM windows WHERE g IN (SELECT g FROM repeated)),
each AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.k) AS text FROM each e LEFT JOIN gone g ON g.r = e.r AND g.k = e.k WHERE g.k IS NULL GROUP BY e.r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN lost ON lost.r = d.r""",
    "op9_partenum": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c))"""
    + _components("doc_id AS node, doc_id AS root FROM documents")
    + """
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON node = d.doc_id""",
    "op11_annulus": _lloyd(8, 10),
    "op13_audit": f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
i AS (SELECT CAST(range AS INTEGER) + 1 AS i FROM range(5)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
x AS (SELECT part, good, toxic, n, fails, o, coalesce(list_position(list_transform(o, lambda k: fails[k]), true), 6) AS gone FROM m CROSS JOIN o),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM x),
r AS (
  SELECT part, o, CAST(step AS INTEGER) AS step, o[step] AS f, CAST(coalesce(sum(n) FILTER (gone > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (gone = step), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone < step AND fails[o[step]]), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda v: v)) = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (gone = step AND good = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (gone = step AND toxic = 1), 0) AS BIGINT) AS toxic_lost
  FROM steps GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
    "url_rules": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(verdict, name, start)),
hits AS (
  SELECT page_id, arg_max(name || start, len(name || start)) AS rule, arg_max(verdict, len(name || start)) AS verdict
  FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN hits ON hits.page_id = p.page_id""",
}
