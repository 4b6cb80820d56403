"""Syntetos-Boylan classes of demand series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.params import Params


def sbc_class(demand: DataFrame, p: Params = Params()) -> DataFrame:
    """(sku, n_periods, n_demands, total, adi, cv2, sbc): ADI is calendar periods (demand has a row for each) over periods with
    demand, CV squared comes from the moments of demand sizes above 0. An item without demand is NoDemand."""
    d = F.col("demand").cast("double")
    some = F.when(F.col("demand") > 0, d)
    m = demand.groupBy("sku").agg(F.count("*").alias("n_periods"), F.count(some).alias("n_demands"), F.coalesce(F.sum(some), F.lit(0.0)).alias("total"), F.sum(some * some).alias("squares"))
    adi = F.when(F.col("n_demands") > 0, F.round(F.col("n_periods") / F.nullif("n_demands", F.lit(0)), 6))
    cv2 = F.when(F.col("total") > 0, F.round((F.col("n_demands") * F.col("squares") - F.col("total") * F.col("total")) / F.nullif(F.col("total") * F.col("total"), F.lit(0.0)), 6))
    m = m.withColumns({"adi": adi, "cv2": cv2})
    often, even = F.col("adi") < p.adi_cutoff, F.col("cv2") < p.cv2_cutoff
    label = F.when(F.col("n_demands") == 0, "NoDemand").when(often & even, "Smooth").when(often, "Erratic").when(even, "Intermittent").otherwise("Lumpy")
    return m.select("sku", "n_periods", "n_demands", "total", "adi", "cv2", label.alias("sbc"))
