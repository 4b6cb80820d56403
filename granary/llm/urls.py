"""URL filters: explicit rules, and path templates rejected by smoothed labelled purity. DataFrame operations only.

A url's host and path are cut into segments. Digits are generalised first, so a host's paths fall
into few shapes; then each host's tree of segments is walked from its root: where a node has
more than FANOUT different children, the segment is variable and all become ``*``. Sibling branches whose labelled
shares of bad pages do not differ from their pooled share by more than Z deviations are merged and judged on the pooled
evidence; a branch without labels is merged with none.

A branch's purity is (bad + STRENGTH * purity above) / (labelled + STRENGTH), that above a host being PRIOR: few labels are
drawn towards what is known of the branch above, and a branch without labels is judged by it alone. A branch with all
the labels of the one above tells nothing new and keeps its purity. A template is rejected if its purity exceeds LIMIT.

Labels are the caller's column (``junk`` makes one from a page's content) and the pages that a rule decides. What a rule says counts only
at and below the rule's own path, where it takes the place of the page's other label: a rule against ``/de/`` is no evidence on
``/en/``, nor on the host.

Everything is aggregated by host and shape before it is joined, so a host that holds a third of all pages is a
few rows, unless its paths are; then the partial aggregates of a node carry the load. A stretch of segments without a branching or
an end in it is one edge, found by the first and last of a branch's shapes in their order, so the walk has as many rounds as a
path has branchings and ends of others on it, however long it is.

Edge cases: a null url and one without ``://`` have an empty host and path and no rule; those are allowed unless labels
say otherwise; empty segments and a last slash don't count; a very long path is followed as far as another one goes the
same way; rows that repeat are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged

FANOUT, Z = 64, 1.96
STRENGTH, PRIOR, LIMIT = 2.0, 0.3, 0.7
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(rules, host: Column, path: Column) -> Column:
    """The longest rule that fits a host and path, as a struct (verdict, rule), or null."""
    out = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*out) if out else F.lit(None).cast("struct<verdict:string,rule:string>")


def shape(path: Column) -> Column:
    """A path's segments with runs of digits as ``#``, long hexadecimal names as ``{hex}``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}").otherwise(F.regexp_replace(s, "[0-9]+", "#")))


def junk(html: Column) -> Column:
    """Whether a page's own text looks bad: signs for letters, shouting, hardly a sentence, or the same words again and again. Null for
    pages of fewer than 20 words, which say too little."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->|<[^>]*>|&#?\w{1,8};", " ")

    def bad(text: Column) -> Column:
        words = F.filter(F.split(F.translate(text, "\t\n\r", "   "), " "), lambda w: w != "")

        def count(signs: str) -> Column:
            return F.length(text) - F.length(F.translate(text, signs, ""))

        def told(w: Column) -> Column:
            spaces = F.length(text) - F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
            size = F.length(text) - spaces + F.size(w) - 1  # with one space between words
            shouts = count(string.ascii_uppercase) > count(string.ascii_lowercase)
            return F.when(F.size(w) >= 20, (count("#$%&*|!") * 20 > size) | shouts | (F.size(F.array_distinct(w)) * 5 < F.size(w)))

        return F.get(F.transform(F.array(words), told), F.lit(0))

    return F.get(F.transform(F.array(body), bad), F.lit(0))  # the text is made once, not for each use


def purities(shapes: DataFrame, scopes: list[int]) -> DataFrame:
    """(host, name, purity) of all (host, name, shape, scope, labelled, bad, ruled, ruled_bad), walking each host's tree from the root.

    scope: from which depth on a rule decides the shape's pages, null without one; then ruled and ruled_bad count instead of labelled and
    bad. scopes: all that occur."""

    def smooth(bad, labelled, above):
        return (bad + STRENGTH * above) / (labelled + STRENGTH)

    def told(names: tuple[str, str]) -> list[Column]:
        """For each scope, and for none, what its shapes say above it; for each scope what they say below."""
        out = [F.sum(F.when(F.col("scope").isNull(), F.col(names[0]))).alias(f"{names[0]}_x")]
        for s in scopes:
            out += [F.sum(F.when(F.col("scope") == s, F.col(c))).alias(f"{c}_{s}") for c in names]
        return out

    def evidence(names: tuple[str, str], depth: Column) -> Column:
        out = F.coalesce(f"{names[0]}_x", F.lit(0))
        for s in scopes:
            out += F.coalesce(F.when(depth >= s, F.col(f"{names[1]}_{s}")).otherwise(F.col(f"{names[0]}_{s}")), F.lit(0))
        return out

    counts, bads = ("labelled", "ruled"), ("bad", "ruled_bad")
    roots = shapes.groupBy("host").agg(*told(counts), *told(bads)).select(F.col("host").alias("h"), evidence(counts, F.lit(0)).alias("n"), evidence(bads, F.lit(0)).alias("n_bad"))
    roots = roots.withColumn("purity", smooth(F.col("n_bad"), F.col("n"), F.lit(PRIOR)))
    now = shapes.join(roots, F.col("host") == F.col("h")).drop("h").withColumns({"at": F.lit(""), "depth": F.lit(0)})
    now, done = staged(now, "tree"), []
    while True:
        done.append(now.where(F.size("shape") <= F.col("depth")).select("host", "name", "purity"))
        now = now.where(F.size("shape") > F.col("depth"))
        if now.isEmpty():
            break
        now = now.withColumn("segment", F.get(F.col("shape"), F.col("depth")))
        wide = now.groupBy(F.col("host").alias("h"), F.col("at").alias("p")).agg((F.count_distinct("segment") > FANOUT).alias("wide"))
        now = now.join(wide, (F.col("host") == F.col("h")) & (F.col("at") == F.col("p"))).drop("h", "p")
        child = F.concat_ws("/", "at", F.when(F.col("wide"), "*").otherwise(F.col("segment")))
        tail = F.slice("shape", F.col("depth") + 2, F.size("shape"))
        now = staged(now.withColumns({"child": child, "tail": tail}), "tree")
        kids = now.groupBy("host", "at", "child").agg(
            *told(counts), *told(bads), F.min("tail").alias("low"), F.max("tail").alias("high"), F.max("depth").alias("d"), F.max("n").alias("n"), F.max("n_bad").alias("n_bad"), F.max("purity").alias("above")
        )
        # What the first and the last shape below have in common all have: it belongs to the same edge.
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        depth = F.col("d") + 1 + F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int")
        kids = kids.withColumn("reached", depth).withColumns({"k": evidence(counts, F.col("reached")), "k_bad": evidence(bads, F.col("reached"))})
        n, k = (F.nullif(F.col(c), F.lit(0)) for c in ("n", "k"))  # null without labels, and then alike is null too
        share = F.col("n_bad") / n
        deviation = F.sqrt(share * (1 - share) * (1 / k + 1 / n))
        alike = F.abs(F.col("k_bad") / k - share) <= Z * deviation + 1e-12
        kids = staged(kids.withColumn("alike", F.coalesce(alike, F.lit(False))), "branches")
        merged = kids.where("alike").groupBy(F.col("host").alias("mh"), F.col("at").alias("mp")).agg(F.sum("k").alias("m"), F.sum("k_bad").alias("m_bad"))
        kids = kids.join(merged, F.col("alike") & (F.col("host") == F.col("mh")) & (F.col("at") == F.col("mp")), "left")
        m, m_bad = F.coalesce("m", "k"), F.coalesce("m_bad", "k_bad")
        same = (m == F.col("n")) & (m_bad == F.col("n_bad"))  # nothing but what is known above
        purity = F.when(same | (m == 0), F.col("above")).otherwise(smooth(m_bad, m, F.col("above")))
        kids = kids.select(F.col("host").alias("h"), F.col("child").alias("c"), "k", "k_bad", "reached", purity.alias("of_child"))
        now = now.drop("n", "n_bad", "purity", "at", "depth", "segment", "wide", "tail").join(kids, (F.col("host") == F.col("h")) & (F.col("child") == F.col("c")))
        now = now.select(*shapes.columns, F.col("k").alias("n"), F.col("k_bad").alias("n_bad"), F.col("of_child").alias("purity"), F.col("child").alias("at"), F.col("reached").alias("depth"))
        now = staged(now, "tree")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def judge(pages: DataFrame, url: str = "url", rules=RULES, bad: Column | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` with host, path, rule and verdict of every page. ``bad``: a boolean label by other means than rules, null where unknown."""
    host, path = host_and_path(F.col(url))
    label = bad if bad is not None else F.lit(None).cast("boolean")
    base = pages.select(*keep, host.alias("host"), path.alias("path"), label.alias("_label"))
    base = base.withColumn("_rule", matching(rules, F.col("host"), F.col("path")))
    depths = {rule: len([x for x in rule.partition("/")[2].split("/") if x]) for _, rule in rules}
    scope = F.coalesce(*[F.when(F.col("_rule.rule") == rule, d) for rule, d in depths.items()]) if rules else F.lit(None).cast("int")
    base = base.withColumns({"_shape": shape(F.col("path")), "_scope": scope, "_ruled": F.col("_rule.verdict") == "block"})
    base = base.withColumn("_name", F.array_join("_shape", "/"))

    def trues(c: str) -> Column:
        return F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0)))

    shapes = base.groupBy("host", F.col("_name").alias("name"), F.col("_scope").alias("scope")).agg(
        F.first("_shape").alias("shape"), F.count("_label").alias("labelled"), trues("_label").alias("bad"), F.count("_ruled").alias("ruled"), trues("_ruled").alias("ruled_bad")
    )
    out = purities(staged(shapes, "shapes"), sorted(set(depths.values()))).where(F.col("purity") > LIMIT).select("host", "name").distinct()
    out = staged(out, "rejected").select(F.col("host").alias("_h"), F.col("name").alias("_s"), F.lit(True).alias("_no"))
    joined = base.join(out, (F.col("host") == F.col("_h")) & (F.col("_name") == F.col("_s")), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_no"), "block"), F.lit("allow"))
    return joined.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
