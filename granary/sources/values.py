"""Numbers and dates as people and programs write them.

A number's decimal mark, and whether a day or a month comes first, are decided by column: cells that can be read in one way only are
the evidence, and cells that could be read in two ways follow it. Where a column has no evidence, or evidence of both kinds, a
parameter decides for those; a cell that is unambiguous by itself is always read its own way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation


class Number(str):
    """The text of a cell that its file stores as a number."""


class Fault(str):
    """The text of a cell that holds an error, such as #N/A."""


# Forms of a number without spaces; group and mark are two of comma and point. A group that starts with 0 is no thousand. Groups
# of two digits before the last are lakhs. Both Python and Spark read these.
FORMS = {
    mark: rf"^[-+]?(?:[1-9][0-9]{{0,2}}(?:{group}[0-9]{{2,3}})*{group}[0-9]{{3}}{mark}[0-9]*|[1-9][0-9]{{0,2}}(?:{group}[0-9]{{2,3}})+{group}[0-9]{{3}}|[0-9]*{mark}[0-9]+|[0-9]+{mark})$"
    for mark, group in ((r"\.", ","), (",", r"\."))
}
POINT, COMMA = FORMS[r"\."], FORMS[","]
UNSURE = r"^[-+]?[1-9][0-9]{0,2}[.,][0-9]{3}$"
BLANKS = r"[\s\u00a0\u202f'\u2019]"
_POINT, _COMMA, _UNSURE, _BLANKS = (re.compile(x) for x in (POINT, COMMA, UNSURE, BLANKS))

_TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?[AaPp]\.?[Mm]\.?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?$"
_YEAR_FIRST = re.compile(r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME, re.ASCII)
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})" + _TIME, re.ASCII)
_YEAR_LAST = re.compile(r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TIME, re.ASCII)
_NAMED = re.compile(r"^(\d{1,2})[-/. ]*([A-Za-z]{3,9})[-/., ]*(\d{4}|\d{2})" + _TIME, re.ASCII)
_SERIAL = re.compile(r"^\d{5}(?:\.\d+)?$", re.ASCII)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LAST_SERIAL = 2_958_465  # 9999-12-31


def bare(text: str) -> str:
    """Without blanks and apostrophes; a trailing minus and brackets are signs."""
    t = _BLANKS.sub("", text)
    if t.startswith("(") and t.endswith(")"):
        t = "-" + t[1:-1]
    elif t.endswith("-") and t[:-1]:
        t = "-" + t[:-1]
    return t


@dataclass
class Habits:
    """What one column's unambiguous cells say."""

    marks: set[str] = field(default_factory=set)
    firsts: set[str] = field(default_factory=set)

    def see_number(self, text: str) -> None:
        t = bare(text)
        if not _UNSURE.match(t):
            if _POINT.match(t):
                self.marks.add(".")
            elif _COMMA.match(t):
                self.marks.add(",")

    def see_date(self, text: str) -> None:
        if m := _YEAR_LAST.match(text):
            a, b = int(m[1]), int(m[3])
            if a > 12 >= b:
                self.firsts.add("day")
            elif b > 12 >= a:
                self.firsts.add("month")

    def mark(self, default: str) -> str:
        return next(iter(self.marks)) if len(self.marks) == 1 else default

    def first(self, default: str) -> str:
        return next(iter(self.firsts)) if len(self.firsts) == 1 else default


def number(text: str, mark: str, scale: int, precision: int = 18) -> Decimal | None:
    """The number rounded half up to ``scale``; None if it isn't one or needs more than ``precision`` digits."""
    if not isinstance(text, Number):
        text = bare(text)
        if _UNSURE.match(text):
            pass
        elif _POINT.match(text):
            mark = "."
        elif _COMMA.match(text):
            mark = ","
        if "," in text or "." in text:
            if not (_UNSURE.match(text) or _POINT.match(text) or _COMMA.match(text) or re.fullmatch(r"[-+]?\d+[.,]\d+[eE][-+]?\d+", text, re.ASCII)):
                return None
            group = "," if mark == "." else "."
            text = text.replace(group, "").replace(mark, ".")
    if not re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text, re.ASCII):
        return None
    try:
        out = Decimal(text).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)
    except InvalidOperation:
        return None
    return out if len(out.as_tuple().digits) <= precision else None


def _year(text: str) -> int:
    y = int(text)
    return y if len(text) == 4 else y + (2000 if y < 70 else 1900)


def _date(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def serial_date(value: float, since_1904: bool) -> date | None:
    """A spreadsheet's day number; its 1900 calendar has a 29 February 1900 that never was."""
    days = int(value)
    if not 0 < days + 1462 * since_1904 <= LAST_SERIAL:
        return None
    if since_1904:
        return date(1904, 1, 1) + timedelta(days)
    return date(1899, 12, 30 if days >= 60 else 31) + timedelta(days)


def day(text: str, first: str, since_1904: bool = False) -> date | None:
    """A date, its time of day left out. A bare number is a day number if the file stores it as a number or it has five digits."""
    if isinstance(text, Number):
        value = float(text)
        if value <= LAST_SERIAL:
            return serial_date(value, since_1904)
        text = str(int(value))
    if m := _YEAR_FIRST.match(text):
        return _date(int(m[1]), int(m[3]), int(m[4]))
    if m := _COMPACT.match(text):
        return _date(int(m[1]), int(m[2]), int(m[3]))
    if m := _YEAR_LAST.match(text):
        a, b, y = int(m[1]), int(m[3]), _year(m[4])
        day_first = a > 12 or (b <= 12 and first == "day")
        return _date(y, b, a) if day_first else _date(y, a, b)
    if (m := _NAMED.match(text)) and m[2][:3].lower() in MONTHS:
        return _date(_year(m[3]), MONTHS.index(m[2][:3].lower()) + 1, int(m[1]))
    if _SERIAL.match(text):
        return serial_date(float(text), since_1904)
    return None
