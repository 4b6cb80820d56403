"""Ledger files as a Spark data source: one scan of any number of files, a task a file.

    spark.read.format("ledger").option("kind", "pov").load("/exports/orders")     # after register(spark)

Options: kind; path (a file, a folder or a glob) or paths (a JSON list); look_ahead, mark, first, separator, encoding as in ``Reading``.
The scan has the ledger's columns, src_file, src_row, reason (null for good rows) and cells (of rejected rows). Conditions on
sku, the ledger's date and reason are pushed into the reader: rows they leave out are never turned into Arrow batches.

The tasks open the files themselves, by path or by a scheme that Arrow knows. For other stores the same records are
made from what Spark's binaryFile source reads, which holds a whole file in memory.
"""

from __future__ import annotations

import io
import json
import operator
from collections.abc import Iterator
from dataclasses import asdict
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from granary.sources.ledgers import LEDGERS, LedgerError, Reading, schema_of

ARROW_STORES = ("s3", "s3a", "gs", "gcs", "abfs", "abfss")
KINDS = (".csv", ".xlsx")


def check_kind(path: str) -> None:
    if path.lower().endswith(".xls"):
        raise LedgerError(f"{path}: .xls needs a reader that this installation lacks; save it as .xlsx or .csv")
    if not path.lower().endswith(KINDS):
        raise LedgerError(f"{path}: unknown kind of file")


def _local(path: str) -> str | None:
    """The path in the machine's own file system, if it is one."""
    parts = urlparse(path)
    if parts.scheme == "file":
        return unquote(parts.path)
    return path if "://" not in path else None


def opened(path: str) -> BinaryIO:
    if (local := _local(path)) is not None:
        return open(local, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return io.BufferedReader(store.open_input_file(at))


def expanded(spark: SparkSession, path: str) -> list[str]:
    """The ledger files of a folder or glob of any store that Spark reads; another path is itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(at)
    if found is None or not len(found):
        return [path]
    files = [f for x in found for f in (store.listStatus(x.getPath()) if x.isDirectory() else [x])]
    names = sorted(f.getPath().toString() for f in files)
    return [n for n in names if n.lower().endswith(KINDS)] if len(found) > 1 or found[0].isDirectory() else [path]


def listed(path: str) -> list[str]:
    """The ledger files of a path, a folder or a glob in the machine's own file system."""
    import glob
    import os

    local = _local(path)
    if local is None:
        return [path]
    if os.path.isdir(local):
        return sorted(p for p in (os.path.join(local, n) for n in os.listdir(local)) if p.lower().endswith(KINDS))
    return sorted(glob.glob(local)) if glob.has_magic(local) else [path]


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith}


class LedgerReader(DataSourceReader):
    def __init__(self, kind: str, paths: list[str], reading: Reading, schema: StructType):
        self.kind, self.paths, self.reading = kind, paths, reading
        self.names = schema.names
        self.arrow = to_arrow_schema(schema)
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        date = next(f.name for f in LEDGERS[self.kind] if f.kind == "date")
        for f in filters:
            known = type(f) in _COMPARE or isinstance(f, In | IsNull | IsNotNull)
            if known and len(f.attribute) == 1 and f.attribute[0] in ("sku", date, "reason"):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for path in self.paths for p in listed(path)]

    def keeps(self, row: tuple) -> bool:
        for f in self.pushed:
            value = row[self.names.index(f.attribute[0])]
            if isinstance(f, IsNull | IsNotNull):
                good = (value is None) == isinstance(f, IsNull)
            elif isinstance(f, In):
                good = value is not None and value in f.value
            else:
                good = value is not None and _COMPARE[type(f)](value, f.value)
            if not good:
                return False
        return True

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        from granary.sources.files import batches, records

        check_kind(partition.path)
        with opened(partition.path) as file:
            rows = records(file, partition.path, self.kind, self.reading)
            yield from batches(filter(self.keeps, rows) if self.pushed else rows, self.arrow)


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in LEDGERS:
            raise LedgerError(f"option kind must be one of {', '.join(LEDGERS)}")
        return kind

    def schema(self) -> StructType:
        return schema_of(self._kind())

    def reader(self, schema: StructType) -> LedgerReader:
        paths = json.loads(self.options["paths"]) if self.options.get("paths") else [self.options["path"]]
        given = {k: type(v if v is not None else "")(self.options[k]) for k, v in asdict(Reading()).items() if k in self.options}
        return LedgerReader(self._kind(), paths, Reading(**given), schema)


def register(spark: SparkSession) -> None:
    """Makes format "ledger" known to the session and lets it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerSource)


def scan(spark: SparkSession, kind: str, paths: list[str], reading: Reading = Reading()) -> DataFrame:
    """All files in one scan."""
    if all(_local(p) is not None or urlparse(p).scheme in ARROW_STORES for p in paths):
        register(spark)
        given = {k: v for k, v in asdict(reading).items() if v is not None}
        return spark.read.format("ledger").options(kind=kind, paths=json.dumps(paths), **given).load()
    schema = schema_of(kind)
    arrow = to_arrow_schema(schema)

    def kernel(parts):
        from granary.sources.files import batches, records

        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                yield from batches(records(io.BytesIO(content), path, kind, reading), arrow)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(kernel, schema)
