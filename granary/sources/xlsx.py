"""The sheets of an .xlsx workbook as streams of rows, with the standard library only.

A sheet is parsed row by row and its tree is dropped on the way, so memory holds the workbook's shared strings and one row.
Readings above words (phonetic text) are left out; numbers and errors keep their kind; the workbook says which calendar its dates use.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

from granary.sources.values import Fault, Number

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _words(item: ElementTree.Element) -> str:
    """The text of a string item: its own or that of its runs."""
    return "".join(t.text or "" for t in [*item.findall(f"{MAIN}t"), *item.findall(f"{MAIN}r/{MAIN}t")])


class Workbook:
    def __init__(self, file: BinaryIO):
        self.zip = zipfile.ZipFile(file)
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml")) if "xl/workbook.xml" in names else None
        calendar = book.find(f"{MAIN}workbookPr") if book is not None else None
        self.since_1904 = calendar is not None and calendar.get("date1904", "0").lower() in ("1", "true")
        self.sheets = self._listed(book, names) or self._unlisted(names)
        self._shared: list[str] | None = None if "xl/sharedStrings.xml" in names else []

    def _listed(self, book: ElementTree.Element | None, names: set[str]) -> list[tuple[str, str]]:
        """(name, part) of the sheets in the workbook's order."""
        if book is None or "xl/_rels/workbook.xml.rels" not in names:
            return []
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        found = []
        for sheet in book.iter(f"{MAIN}sheet"):
            target = targets.get(sheet.get(f"{LINKS}id"), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names:
                found.append((sheet.get("name", part), part))
        return found

    def _unlisted(self, names: set[str]) -> list[tuple[str, str]]:
        parts = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        return [(n.rsplit("/", 1)[-1].removesuffix(".xml"), n) for n in parts]

    def shared(self) -> list[str]:
        if self._shared is None:
            self._shared = []
            with self.zip.open("xl/sharedStrings.xml") as part:
                for _, item in ElementTree.iterparse(part):
                    if item.tag == f"{MAIN}si":
                        self._shared.append(_words(item))
                        item.clear()
        return self._shared

    def rows(self, part: str) -> Iterator[list[str | None]]:
        shared, n = self.shared(), 0
        with self.zip.open(part) as stream:
            above = None
            for event, item in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    above = item if item.tag == f"{MAIN}sheetData" else above
                elif item.tag == f"{MAIN}row":
                    number = int(item.get("r", n + 1))
                    for _ in range(number - 1 - n):  # rows that are left out are empty
                        yield []
                    n = max(n + 1, number)
                    yield self._cells(item, shared)
                    if above is not None:
                        above.clear()

    @staticmethod
    def _cells(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
        cells: list[str | None] = []
        for cell in row.iter(f"{MAIN}c"):
            at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            value, kind = cell.find(f"{MAIN}v"), cell.get("t", "n")
            text = value.text if value is not None else None
            if kind == "inlineStr":
                inline = cell.find(f"{MAIN}is")
                cells[at] = _words(inline) if inline is not None else None
            elif text is None:
                continue
            elif kind == "s":
                cells[at] = shared[int(text)]
            elif kind == "b":
                cells[at] = "TRUE" if text.strip() == "1" else "FALSE"
            else:
                cells[at] = Number(text.strip()) if kind == "n" else Fault(text) if kind == "e" else text
        return cells
