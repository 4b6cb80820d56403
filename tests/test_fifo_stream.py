"""FIFO of a stream ends with the batch's matches; late rows come out apart."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import inventory
from granary.streaming.fifo import closing, fifo_stream, with_rocksdb
from tests.test_engines import _ledgers


class Arrivals:
    """Two folders that rows land in, and the stream's state between its runs."""

    def __init__(self, spark, at, pov, grn, delay):
        self.spark, self.at, self.delay, self.schemas = spark, at, delay, {"pov": pov.schema, "grn": grn.schema}
        with_rocksdb(spark)

    def land(self, name, df):
        df.coalesce(1).write.mode("append").parquet(f"{self.at}/{name}")

    def close(self):
        self.land("pov", closing(self.spark, self.schemas["pov"]))
        self.land("grn", closing(self.spark, self.schemas["grn"], "receipt_date"))

    def run(self):
        streams = [self.spark.readStream.schema(s).parquet(f"{self.at}/{n}") for n, s in self.schemas.items()]
        out = fifo_stream(*streams, self.delay).writeStream.format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.at}/out")


def pieces(df):
    return sorted((r.sku, str(r.order_date), str(r.receipt_date), r.q) for r in df.groupBy("sku", "order_date", "receipt_date").agg(F.sum("matched").alias("q")).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_ends_with_the_batch_result(spark, tmp_path, seed):
    pov, grn = (df.cache() for df in _ledgers(spark, 420))
    here = Arrivals(spark, str(tmp_path), pov, grn, "300 days")  # longer than the ledgers: rows may come in any order
    rnd = random.Random(seed)
    lots = rnd.randint(2, 4)
    lot = lambda c: F.pmod(F.xxhash64("src_row", c, F.lit(seed)), F.lit(lots))
    for i in range(lots):
        here.land("pov", pov.where(lot("order_date") == i))
        here.land("grn", grn.where(lot("receipt_date") == i))
        if i % 2:
            here.run()
    here.close()
    out = here.run()
    assert {r.kind for r in out.select("kind").distinct().collect()} == {"match"}
    assert pieces(out) == pieces(inventory.fifo_match(pov, grn))


def test_a_late_receipt_comes_out_by_itself(spark, tmp_path):
    from datetime import date

    pov = spark.createDataFrame([("a", date(2020, 1, 1), 10), ("a", date(2020, 3, 1), 5), ("b", date(2020, 1, 2), 4)], "sku string, order_date date, qty int")
    grn = spark.createDataFrame([("a", date(2020, 1, 10), 6), ("a", date(2020, 3, 20), 2)], "sku string, receipt_date date, qty int")
    here = Arrivals(spark, str(tmp_path), pov, grn, "5 days")
    here.land("pov", pov)
    here.land("grn", grn)
    out = here.run()  # the watermark is at 15 March, so the receipt of the 20th waits
    assert pieces(out) == [("a", "2020-01-01", "2020-01-10", 6)]
    late = spark.createDataFrame([("a", date(2020, 1, 5), 3), ("a", date(2020, 3, 18), 4)], "sku string, receipt_date date, qty int")
    here.land("grn", late)  # the first is behind what has gone out, the second is before the one that waits
    here.close()
    here.land("pov", pov.limit(0))
    out = here.run()
    assert [(r.sku, r.order_date, str(r.receipt_date), r.matched) for r in out.where("kind = 'late'").collect()] == [("a", None, "2020-01-05", 3)]
    assert pieces(out.where("kind = 'match'")) == [("a", "2020-01-01", "2020-01-10", 6), ("a", "2020-01-01", "2020-03-18", 4), ("a", "2020-03-01", "2020-03-20", 2)]


class Counted:
    """A state in memory that counts its calls."""

    calls = 0

    def __init__(self):
        self.value = []

    def _call(self, value=None):
        Counted.calls += 1
        if value is not None:
            self.value = value
        return self.value

    def exists(self):
        return bool(self._call())

    def get(self):
        value = self._call()
        return value if isinstance(value, tuple) else iter(value)

    def update(self, value):
        self._call(value)

    def put(self, value):
        self._call(value)

    def appendList(self, value):
        self._call(self.value + value)

    def clear(self):
        self._call([])

    def getListState(self, *_):
        return Counted()

    getValueState = getListState

    def listTimers(self):
        return iter(self._call())

    def registerTimer(self, at):
        self._call(self.value + [at])

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_many_items_cost_a_few_state_calls(monkeypatch):
    """Calls from Python to the store are what a stream of many items spends its time on."""
    import pandas as pd

    from granary.streaming import fifo

    rnd, handle, p = random.Random(5), Counted(), fifo.Fifo()
    rows = [(f"s{rnd.randint(0, 300)}", rnd.random() < 0.5, rnd.randint(0, 89), "f", i, 1, None, rnd.randint(1, 9) * 1000, None) for i in range(4000)]
    df = pd.DataFrame(rows, columns=["sku", "receipt", "day", "src_file", "src_row", "line_no", "vendor", "qty", "amount"])
    p.init(handle)
    monkeypatch.setattr(Counted, "calls", 0)
    got = []
    for month in range(3):
        got += list(p.handleInputRows((1,), iter([df[df.day // 30 == month]]), handle))
        handle.watermark = (month + 1) * 30 * fifo.DAY_MS
        got += list(p.handleExpiredTimer((1,), handle, None))
    assert Counted.calls < 100  # some hundreds of items; each had a dozen a month
    want = []
    for sku in {r[0] for r in rows}:
        queues = [sorted([r[2], r[4], r[7]] for r in rows if r[0] == sku and r[1] == side) for side in (False, True)]
        while queues[0] and queues[1]:
            both = min(queues[0][0][2], queues[1][0][2])
            want.append((sku, queues[0][0][0], queues[1][0][0], both))
            for q in queues:
                q[0][2] -= both
                if not q[0][2]:
                    q.pop(0)
    out = pd.concat(got)
    assert set(out.kind) == {"match"}

    def days(pieces):
        sums = {}
        for sku, order, receipt, q in pieces:
            sums[sku, order, receipt] = sums.get((sku, order, receipt), 0) + q
        return sums

    assert days(zip(out.sku, out.ordered, out.received, out.milli, strict=True)) == days(want)
    late = df.head(1).assign(day=89)
    assert [(r.kind, r.milli) for f in p.handleInputRows((1,), iter([late]), handle) for r in f.itertuples()] == [("late", rows[0][7])]
