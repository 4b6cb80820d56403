"""The tables of a file, and their rows as typed record batches: what one task does with one file."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice
from typing import BinaryIO

import pyarrow as pa

from granary.sources.ledgers import LEDGERS, LedgerError, Reading, find_header
from granary.sources.values import Fault, Habits, Number, day, number
from granary.sources.xlsx import Workbook

ROWS = 4096  # of a record batch
CACHED = 1 << 16  # values of a column whose types are remembered
SEPARATORS = (",", ";", "\t", "|")
csv.field_size_limit(1 << 30)

Row = list[str | None]


@dataclass
class Table:
    name: str
    rows: Callable[[], Iterator[Row]]  # may be called again
    since_1904: bool = False


def encoding_of(file: BinaryIO) -> str:
    """By the mark of byte order, by zero bytes, else UTF-8 if the whole file is, else Windows-1252."""
    file.seek(0)
    head = file.read(1 << 16)
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    for name, zeros in (("utf-16-le", head[1::2]), ("utf-16-be", head[::2])):
        if zeros and zeros.count(0) > len(zeros) // 2:
            return name
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while head:
            decoder.decode(head)
            head = file.read(1 << 20)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8"


def _csv(file: BinaryIO, kind: str, reading: Reading) -> list[Table]:
    encoding = reading.encoding or encoding_of(file)

    def rows(separator: str) -> Iterator[Row]:
        file.seek(0)
        text = io.TextIOWrapper(file, encoding, errors="replace", newline="")
        try:
            yield from csv.reader(text, delimiter=separator, skipinitialspace=True)
        finally:
            text.detach()

    def fields(separator: str) -> int:
        try:
            return len(find_header(kind, list(islice(rows(separator), reading.look_ahead)))[1])
        except LedgerError:
            return 0

    best = reading.separator or max(SEPARATORS, key=fields)  # the first of equals
    return [Table("", lambda: rows(best))]


def tables(file: BinaryIO, path: str, kind: str, reading: Reading) -> list[Table]:
    if path.lower().endswith(".csv"):
        return _csv(file, kind, reading)
    book = Workbook(file)
    return [Table(name, lambda part=part: book.rows(part), book.since_1904) for name, part in book.sheets]


class _Typed:
    """A column's cells as values, remembering what it has seen."""

    def __init__(self, kind: str, habits: Habits, reading: Reading, since_1904: bool):
        self.kind, self.seen = kind, {}
        self.mark, self.first, self.since_1904 = habits.mark(reading.mark), habits.first(reading.first), since_1904
        self.scale = int(kind.rstrip(")").partition(",")[2]) if kind.startswith("decimal") else 0

    def __call__(self, text: str):
        if isinstance(text, Fault):
            return None
        if self.kind == "string":
            return str(text)
        key = (text, isinstance(text, Number))
        if key in self.seen:
            return self.seen[key]
        if self.kind == "date":
            value = day(text, self.first, self.since_1904)
        elif self.kind == "int":
            exact = number(text, self.mark, 3)
            value = int(exact) if exact is not None and exact == int(exact) and abs(exact) < 1 << 31 else None
        else:
            value = number(text, self.mark, self.scale)
        if len(self.seen) < CACHED:
            self.seen[key] = value
        return value


def _cell(row: Row, at: int | None) -> str | None:
    """A cell without blanks around it, of the kind it has in the file; None if empty."""
    text = row[at] if at is not None and at < len(row) else None
    if text is None:
        return None
    bare = text.strip()
    return None if not bare else text if len(bare) == len(text) else type(text)(bare)


def _body(table: Table, header: int) -> Iterator[tuple[int, Row]]:
    for at, row in enumerate(table.rows()):
        if at > header and any(c is not None and c.strip() for c in row):
            yield at, row


def records(file: BinaryIO, path: str, kind: str, reading: Reading) -> Iterator[tuple]:
    """A file's rows in the columns of a scan. Each table is read for its header, for its columns' habits, and for its values."""
    fields = LEDGERS[kind]
    found, blame = [], None
    for table in tables(file, path, kind, reading):
        head = list(islice(table.rows(), reading.look_ahead))
        try:
            found.append((table, *find_header(kind, head)))
        except LedgerError as e:
            blame = e
            found.append((table, None, [None if c is None else str(c) for c in head[0]] if head else []))
    if not any(at is not None for _, at, _ in found):
        raise LedgerError(f"{path}: {blame or 'no rows'}")
    before = 0  # rows of the sheets before, so that a row's number is its own in the file
    for table, header, index in found:
        if header is None:
            yield (*[None] * len(fields), path, before, f"sheet {table.name}: no header row", index)
            before += sum(1 for _ in table.rows())
            continue
        habits = {f.name: Habits() for f in fields}
        open_ = [(index[f.name], habits[f.name].see_date if f.kind == "date" else habits[f.name].see_number) for f in fields if f.name in index and f.kind != "string"]
        for _, row in _body(table, header):
            for at, see in open_:
                if (text := _cell(row, at)) is not None and type(text) is str:
                    see(text)
        typed = [(f, index.get(f.name), _Typed(f.kind, habits[f.name], reading, table.since_1904)) for f in fields]
        last = header
        for last, row in _body(table, header):
            values, bad = [], []
            for f, at, value_of in typed:
                text = _cell(row, at)
                value = None if text is None else value_of(text)
                values.append(value)
                if value is None and (f.required or text is not None):
                    bad.append(f.name)
            if bad:
                yield (*[None] * len(fields), path, before + last, f"missing or unreadable: {', '.join(bad)}", [None if c is None else str(c) for c in row])
            else:
                yield (*_completed(kind, values), path, before + last, None, None)
        before += last + 1


def _completed(kind: str, values: list) -> list:
    if kind == "pov":
        named = {f.name: i for i, f in enumerate(LEDGERS[kind])}
        if values[named["amount"]] is None and values[named["rate"]] is not None:
            values[named["amount"]] = (values[named["qty"]] * values[named["rate"]]).quantize(Decimal("0.01"), ROUND_HALF_UP)
    return values


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
