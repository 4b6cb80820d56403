"""FIFO matching of receipts to orders as both arrive, in any order of arrival.

Rows wait in the state of their item's bucket until the watermark has passed their date; then nothing older can come, and orders and
receipts that are complete join their queues in the order of ``inventory.fifo_match``: by date, source and row. What the heads
of the two queues have in common is a match and goes out. An event-time timer on a bucket's oldest waiting day wakes it up when the
watermark gets there, so state holds open orders, unmatched receipts and the days within the watermark's delay, no more.

Late rows: a row dated on or before the watermark that its item has already acted on could change matches that have gone out. It
takes no part in any; it comes out once, by itself, as kind ``late`` with its date in order_date or receipt_date and its quantity in matched.

The stream ends up with the matches of the batch form whatever micro-batches it is cut into, as long as nothing is late. Rows newer
than the watermark are still waiting when a stream stops; ``closing`` makes a row that moves the watermark past all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.functions.staging import staged

DAY_MS = 86_400_000
#: Items share the state of their bucket. The number is fixed for a stream's life; a bucket's rows are what a task holds at once.
BUCKETS = 1024
#: Rows in the order of their queues: an item's orders, then its receipts, by place; quantities in thousandths.
WAITING = pa.schema(
    [("sku", pa.string()), ("receipt", pa.bool_()), ("day", pa.int32()), ("src_file", pa.string()), ("src_row", pa.int64()), ("line_no", pa.int32()), ("vendor", pa.string()), ("qty", pa.int64()), ("amount", pa.int64())]
)
ACTED = pa.schema([("sku", pa.string()), ("day", pa.int32())])
RAW = "sku string, kind string, ordered int, received int, milli long"
OUT = "sku string, kind string, order_date date, receipt_date date, matched decimal(28,3)"
SENTINEL = "\0closing"


def moves(pov: DataFrame, grn: DataFrame, delay: str = "45 days") -> DataFrame:
    """Orders and receipts as one stream with a watermark; the columns ``line_no``, ``src_file``, ``src_row`` may be missing."""

    def side(df: DataFrame, day: str, receipt: bool) -> DataFrame:
        names = set(df.columns)
        given = {"src_file": "string", "src_row": "long", "line_no": "int", "vendor": "string", "amount": "decimal(18,2)"}
        cells = {c: F.col(c).cast(t) if c in names else F.lit(None).cast(t) for c, t in given.items()}
        return df.where("qty > 0").select(
            "sku", F.lit(receipt).alias("receipt"), F.col(day).cast("timestamp").alias("at"), F.unix_date(F.col(day).cast("date")).alias("day"),
            cells["src_file"].alias("src_file"), cells["src_row"].alias("src_row"), cells["line_no"].alias("line_no"), cells["vendor"].alias("vendor"),
            (F.col("qty") * 1000).cast("long").alias("qty"), (cells["amount"] * 100).cast("long").alias("amount"),
        )

    both = side(pov, "order_date", False).unionByName(side(grn, "receipt_date", True))
    # The engine would drop late rows of a column that carries the watermark; the days are plain numbers, so all rows come through.
    return both.withWatermark("at", delay).drop("at")


def closing(spark: SparkSession, schema, day: str = "order_date", on: str = "9999-01-01") -> DataFrame:
    """A batch of one row, for the ledger whose date is ``day``, that closes all days before ``on``; its item shows in no output."""
    row = {"sku": SENTINEL, day: datetime.strptime(on, "%Y-%m-%d").date(), "qty": 1}
    return spark.createDataFrame(
        [tuple(row.get(f.name) for f in schema)], ", ".join(f"{f.name} {'int' if f.name == 'qty' else f.dataType.simpleString()}" for f in schema),
    ).select(*[F.col(f.name).cast(f.dataType) for f in schema])


class Fifo(StatefulProcessor):
    """The items of one bucket. State is Arrow data, so that a bucket costs a few calls a batch however many items and rows it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # lots of rows as they came
        self.open = handle.getValueState("open", "rows binary")  # complete orders and receipts that are not yet matched
        self.acted = handle.getValueState("acted", "rows binary")  # the last day that has been closed, by item

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        acted, lots, first = _loaded(self.acted, ACTED), [], None
        for df in rows:
            lot = pa.Table.from_pandas(df[WAITING.names], WAITING, preserve_index=False)
            lot = lot.filter(pc.not_equal(lot["sku"], SENTINEL))
            at = pc.index_in(lot["sku"], acted["sku"])
            late = pc.fill_null(pc.less_equal(lot["day"], acted["day"].take(at)), False)
            if pc.any(late).as_py():
                gone = lot.filter(late)
                day, receipt, none = gone["day"], gone["receipt"], pa.scalar(None, pa.int32())
                yield _frame(gone["sku"], "late", pc.if_else(receipt, none, day), pc.if_else(receipt, day, none), gone["qty"])
                lot = lot.filter(pc.invert(late))
            if lot.num_rows:
                lots.append((_packed(lot),))
                least = pc.min(lot["day"]).as_py()
                first = least if first is None else min(first, least)
        if lots:
            self.waiting.appendList(lots)
            due = (first + 1) * DAY_MS
            if not any(t <= due for t in self.handle.listTimers()):
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A day is closed when the watermark has reached the next one.
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1
        waiting = pa.concat_tables([WAITING.empty_table(), *(_unpacked(lot) for (lot,) in self.waiting.get())])
        is_ready = pc.less_equal(waiting["day"], closed)
        ready, rest = waiting.filter(is_ready), waiting.filter(pc.invert(is_ready))
        if not ready.num_rows:
            return
        out, left = matched(pa.concat_tables([_loaded(self.open, WAITING), ready]))
        done = pc.unique(ready["sku"])
        acted = _loaded(self.acted, ACTED)
        acted = acted.filter(pc.invert(pc.is_in(acted["sku"], done)))
        now = pa.table([done, pa.array(np.full(len(done), closed, np.int32))], schema=ACTED)
        self.acted.update((_packed(pa.concat_tables([acted, now])),))
        self.open.update((_packed(left),)) if left.num_rows else self.open.clear()
        if rest.num_rows:
            self.waiting.put([(_packed(rest),)])
            self.handle.registerTimer((pc.min(rest["day"]).as_py() + 1) * DAY_MS)
        else:
            self.waiting.clear()
        if len(out[0]):
            yield _frame(out[0], "match", *out[1:])

    def close(self) -> None:
        pass


def matched(rows: pa.Table) -> tuple[tuple, pa.Table]:
    """The matches (sku, order's day, receipt's day, thousandths) of all items' complete rows, and what is left of the rows."""
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in WAITING.names], null_placement="at_start"))
    item = pc.rank(rows["sku"], tiebreaker="dense").to_numpy().astype(np.int64) - 1
    receipt, day, qty = (rows[c].to_numpy(zero_copy_only=False) for c in ("receipt", "day", "qty"))
    n = int(item.max(initial=-1)) + 1
    total = np.zeros((2, n), np.int64)
    np.add.at(total, (receipt.astype(int), item), qty)
    # All items lie on one axis of quantities, each from ``base`` on; a row's right end on it is ``end``.
    base = np.cumsum(total.max(0)) - total.max(0)
    limit = base + total.min(0)
    end, sides = np.empty(len(qty), np.int64), []
    for side in (0, 1):
        i = np.flatnonzero(receipt == bool(side))
        end[i] = np.cumsum(qty[i]) - (np.cumsum(total[side]) - total[side])[item[i]] + base[item[i]]
        sides.append(i)
    cuts = np.unique(end[end <= limit[item]])
    own = np.searchsorted(base, cuts) - 1
    before = np.maximum(base[own], np.append(0, cuts[:-1])[: len(cuts)])
    order, got = (day[i[np.searchsorted(end[i], cuts)]] for i in sides)
    sku = pc.unique(rows["sku"])
    left = np.minimum(np.maximum(end - limit[item], 0), qty)
    rest = rows.set_column(rows.schema.get_field_index("qty"), "qty", pa.array(left)).filter(pa.array(left > 0))
    return (sku.take(pa.array(own)), order, got, cuts - before), rest


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def _loaded(state, schema: pa.Schema) -> pa.Table:
    return _unpacked(state.get()[0]) if state.exists() else schema.empty_table()


def _frame(sku, kind: str, ordered, received, milli) -> pd.DataFrame:
    days = [pd.array(np.asarray(d) if isinstance(d, np.ndarray) else d.to_pylist(), "Int32") for d in (ordered, received)]
    return pd.DataFrame({"sku": sku.to_pandas(), "kind": kind, "ordered": days[0], "received": days[1], "milli": np.asarray(milli)})


def fifo_stream(pov: DataFrame, grn: DataFrame, delay: str = "45 days") -> DataFrame:
    """(sku, kind, order_date, receipt_date, matched): matches as they become certain, and late rows. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), which keeps state on disk; ``with_rocksdb`` sets it."""
    keyed = moves(pov, grn, delay).withColumn("bucket", F.pmod(F.xxhash64("sku"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")
    out = keyed.transformWithStateInPandas(Fifo(), outputStructType=RAW, outputMode="Append", timeMode="EventTime")
    days = (F.date_from_unix_date("ordered").alias("order_date"), F.date_from_unix_date("received").alias("receipt_date"))
    return out.select("sku", "kind", *days, (F.col("milli").cast("decimal(25,0)") / 1000).cast("decimal(28,3)").alias("matched"))


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed(spark: SparkSession, pov: DataFrame, grn: DataFrame, folder: str, splits: int = 3, delay: str = "45 days") -> DataFrame:
    """The stream's output after the ledgers have arrived in ``splits`` lots by date, each taken up by a run that starts from the
    checkpoint of the one before, and after the closing rows."""
    with_rocksdb(spark)
    first, last = pov.agg(F.min("order_date"), F.max("order_date")).first()

    def in_lots(df: DataFrame, day: str) -> tuple[DataFrame, str]:
        at = F.floor(F.datediff(day, F.lit(first)) * splits / ((last - first).days + 1))
        return staged(df.withColumn("lot", F.least(F.greatest(at, F.lit(0)), F.lit(splits - 1))), "lots", release=True), day

    days = {"pov": in_lots(pov, "order_date"), "grn": in_lots(grn, "receipt_date")}
    for lot in range(splits + 1):
        for name, (df, day) in days.items():
            if lot == splits:
                some = closing(spark, df.drop("lot").schema, day)
            else:
                some = df.where(F.col("lot") == lot).drop("lot")
            some.write.mode("append").parquet(f"{folder}/{name}")
        streams = [spark.readStream.schema(df.drop("lot").schema).parquet(f"{folder}/{name}") for name, (df, _) in days.items()]
        run = fifo_stream(*streams, delay).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
