"""Ledger files as they arrive: a stream of typed rows with running value totals by item.

A stream has no whole column to decide decimal marks or the order of day and month from, so ``Reading`` decides them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.ledgers import LEDGERS, Reading, typed


def _raw(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """A header in another order than the ledger's is an error, not a mix-up of columns."""
    schema = ", ".join(f"{f.name} string" for f in LEDGERS[kind])
    return spark.readStream.option("header", True).option("enforceSchema", False).schema(schema).csv(folder)


def _bad(kind: str, reading: Reading) -> Column:
    names = [F.when(typed(F.col(f.name), f.kind, reading).isNull() & (F.lit(f.required) | (F.coalesce(F.trim(f.name), F.lit("")) != "")), f.name) for f in LEDGERS[kind]]
    return F.concat_ws(", ", *names)


def stream_ledger(spark: SparkSession, kind: str, folder: str, reading: Reading = Reading()) -> DataFrame:
    """Typed rows of .csv files with the ledger's own column names, in its order, that land in a folder; rows that can't be typed
    are those of stream_rejects."""
    rows = _raw(spark, kind, folder).where(_bad(kind, reading) == "")
    return rows.select(*[typed(F.col(f.name), f.kind, reading).alias(f.name) for f in LEDGERS[kind]])


def stream_rejects(spark: SparkSession, kind: str, folder: str, reading: Reading = Reading()) -> DataFrame:
    """(reason, cells) of the rows that stream_ledger leaves out."""
    raw = _raw(spark, kind, folder).withColumn("_bad", _bad(kind, reading)).where("_bad != ''")
    return raw.select(F.concat(F.lit("missing or unreadable: "), "_bad").alias("reason"), F.array(*[f.name for f in LEDGERS[kind]]).alias("cells"))


def running_value(pov: DataFrame, late: str = "30 days", span: str = "30 days") -> DataFrame:
    """Value by item and ``span`` of a stream of purchase orders, spans counted from 1970-01-01; closed once the watermark has passed."""
    timed = pov.withColumn("at", F.col("order_date").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", span), "sku").agg(F.sum("amount").alias("value"), F.sum("qty").alias("qty"))
