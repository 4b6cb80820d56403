"""Delivery sessions: a vendor's receipts with no pause of ``gap`` or more between them, in batch and as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(grn: DataFrame, gap: str = "7 days", delay: str = "30 days") -> DataFrame:
    """(vendor, first_day, end, n_receipts, qty) of each session; it ends ``gap`` after its last receipt. Of a stream, a session comes out
    when the watermark, ``delay`` behind the newest receipt, has passed its end; a receipt behind the watermark is left out and counted
    by ``late_rows``."""
    timed = grn.withColumn("at", F.col("receipt_date").cast("timestamp"))
    if grn.isStreaming:
        timed = timed.withWatermark("at", delay)
    found = timed.groupBy(F.session_window("at", gap).alias("s"), "vendor").agg(F.count("*").alias("n_receipts"), F.sum("qty").cast("decimal(28,3)").alias("qty"))
    return found.select("vendor", F.col("s.start").cast("date").alias("first_day"), F.col("s.end").cast("date").alias("end"), "n_receipts", "qty")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a run of a stream has left out because they came behind its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])


def replayed_sessions(spark, grn: DataFrame, folder: str, splits: int = 2, delay: str = "30 days") -> tuple[DataFrame, int]:
    """All sessions after the receipts have arrived in ``splits`` lots by date and a closing row has passed, and how many rows came late."""
    from granary.streaming.fifo import closing

    first, last = grn.agg(F.min("receipt_date"), F.max("receipt_date")).first()
    late = 0
    for lot in range(splits + 1):
        at = F.floor(F.datediff("receipt_date", F.lit(first)) * splits / ((last - first).days + 1))
        some = grn.where(at == lot) if lot < splits else closing(spark, grn.schema, "receipt_date")
        some.write.mode("append").parquet(f"{folder}/grn")
        run = sessions(spark.readStream.schema(grn.schema).parquet(f"{folder}/grn"), delay=delay).writeStream.format("parquet")
        query = run.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        late += late_rows(query)
    return spark.read.parquet(f"{folder}/out"), late
