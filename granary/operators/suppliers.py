"""Vendor keys, supplier risk, clusters, top trends and lead-time spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged
from granary.operators.inventory import fifo_match, lead_times
from granary.params import Params


def vendor_key(name: str | Column) -> Column:
    """Upper-case letters, marks and digits of all scripts; a name without any is its own key."""
    return F.coalesce(F.nullif(F.regexp_replace(F.upper(F.trim(name)), r"[^\p{L}\p{M}\p{N}]+", ""), F.lit("")), F.trim(name))


def dedup_vendors(vendors: DataFrame, name: str = "vendor_name") -> DataFrame:
    """Adds vendor_key and canonical_name (the smallest spelling): an aggregate and a join that the planner broadcasts
    while the vendor list is small."""
    keyed = vendors.withColumn("vendor_key", vendor_key(F.col(name)))
    names = keyed.groupBy("vendor_key").agg(F.min(name).alias("canonical_name"))
    return keyed.join(names, "vendor_key", "left")  # a null name stays, without a key


def supplier_risk(pov: DataFrame, grn: DataFrame) -> DataFrame:
    """Per vendor: spend and its share, items, lead time (mean and spread over items), pending ratio (indicators assumed)."""
    # By item first: a hot vendor's lines are summed before they meet, and items are counted without keeping them apart.
    items = pov.groupBy("vendor", "sku").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.sum("qty").alias("qty"))
    spend = items.groupBy("vendor").agg(
        F.sum("amount").cast("decimal(28,2)").alias("spend"), F.count("sku").alias("n_skus"), F.sum("n").alias("n_lines"),
        F.sum("qty").cast("decimal(28,3)").alias("ordered"),
    )
    spend = staged(spend, "spend")  # a row a vendor
    got = grn.groupBy("vendor").agg(F.sum("qty").cast("decimal(28,3)").alias("received"))
    per = lead_times(fifo_match(pov, grn, ["sku", "vendor"]), ["sku", "vendor"])
    d, n = F.col("lead_time_days"), F.count("*")
    lead = per.groupBy("vendor").agg(
        F.round(F.avg(d), 4).alias("lead_time_mean"),
        F.round(F.sqrt(F.greatest((n * F.sum(d * d) - F.sum(d) * F.sum(d)) / (n * n), F.lit(0.0))), 4).alias("lead_time_spread"),
    )
    total = spend.agg(F.sum("spend").cast("double").alias("total"))
    joined = spend.join(got, "vendor", "left").join(lead, "vendor", "left").crossJoin(F.broadcast(total))  # total is one row
    ratio = F.round(F.greatest((F.col("ordered") - F.coalesce("received", F.lit(0))).cast("double") / F.col("ordered").cast("double"), F.lit(0.0)), 6)
    return joined.select(
        "vendor", "spend", F.round(F.col("spend").cast("double") / F.col("total"), 8).alias("spend_share"), "n_skus", "n_lines", "lead_time_mean", "lead_time_spread",
        ratio.alias("pending_ratio"),
    )


def supplier_clusters(risk: DataFrame, p: Params = Params()) -> DataFrame:
    """k-means on scaled indicators with a fixed seed (algorithm assumed), fitted when called; fewer different vendors than two are one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    columns = ["spend_share", "lead_time_mean", "lead_time_spread", "pending_ratio", "n_skus"]
    # A row a vendor, read by each of the steps below: written once, or each would match all orders and receipts again.
    ready = staged(risk.select("vendor", *[F.col(c).cast("double").alias(c) for c in columns]), "risk")
    known = ready.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns])  # one row
    # A vendor without receipts has no lead time; it is taken for an average one.
    ready = ready.crossJoin(F.broadcast(known)).withColumns({c: F.coalesce(c, f"mean_{c}") for c in columns})
    clusters = ready.select(*columns).distinct().limit(p.clusters).count()  # no more than there are different vendors
    if clusters < 2:
        return ready.select("vendor", *columns, F.lit(0).alias("cluster"))
    ready = VectorAssembler(inputCols=columns, outputCol="raw").transform(ready)
    ready = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(ready).transform(ready)
    model = KMeans(k=clusters, seed=p.seed, featuresCol="features", predictionCol="cluster").fit(ready)
    return model.transform(ready).select("vendor", *columns, "cluster")


def top_trends(demand: DataFrame, p: Params = Params()) -> DataFrame:
    """The series of the ``top_n`` items by total demand, ties to the smaller sku."""
    total = demand.groupBy("sku").agg(F.sum("demand").cast("decimal(28,3)").alias("total"))
    top = total.orderBy(F.desc("total"), "sku").limit(p.top_n)
    return demand.join(F.broadcast(top), "sku").select("sku", "total", "t", "demand")  # top_n rows


def lead_time_box(per_item: DataFrame, by: str = "vendor") -> DataFrame:
    """Exact quartiles and extremes of lead times."""
    d = F.col("lead_time_days")
    return per_item.groupBy(by).agg(
        F.count("*").alias("n"), F.min(d).alias("low"), F.round(F.percentile(d, F.lit(0.25)), 4).alias("q1"), F.round(F.percentile(d, F.lit(0.5)), 4).alias("median"),
        F.round(F.percentile(d, F.lit(0.75)), 4).alias("q3"), F.max(d).alias("high"),
    )
