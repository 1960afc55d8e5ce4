"""RFC 3339 times in whole milliseconds of UTC."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)", re.A)
_DATE = re.compile(r"(-?\d{4,})-(\d\d)-(\d\d)(Z|[+-]\d\d:\d\d)?", re.A)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse(text: str) -> int:
    """Milliseconds since 1970; leap seconds and finer fractions are errors."""
    m = _TIME.fullmatch(text)
    if not m:
        raise ValueError("not an RFC 3339 time")
    fraction = (m[7] or ".")[1:]
    if fraction[3:].strip("0"):
        raise ValueError("finer than a millisecond")
    offset = timedelta(0)
    if m[8] not in "Zz":
        hours, minutes = int(m[8][1:3]), int(m[8][4:])
        if hours > 23 or minutes > 59:
            raise ValueError("offset")
        offset = timedelta(hours=hours, minutes=minutes) * (1 if m[8][0] == "+" else -1)
    whole = datetime(*map(int, m.group(1, 2, 3, 4, 5, 6)), tzinfo=timezone.utc) - offset
    return round((whole - _EPOCH) / timedelta(milliseconds=1)) + int((fraction + "000")[:3])


def text(millis: int) -> str:
    at = _EPOCH + timedelta(milliseconds=millis)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{millis % 1000:03d}Z".rjust(24, "0")


def valid_date(spelling: str) -> bool:
    """Whether a spelling is an xsd:date: a day of the calendar, with an offset up to 14 hours."""
    m = _DATE.fullmatch(spelling)
    if not m:
        return False
    year = int(m[1])
    if year == 0 or (len(m[1].lstrip("-")) > 4 and m[1].lstrip("-")[0] == "0"):
        return False
    try:
        date(2000 + year % 400, int(m[2]), int(m[3]))
    except ValueError:
        return False
    if m[4] and m[4] != "Z":
        hours, minutes = int(m[4][1:3]), int(m[4][4:])
        return minutes < 60 and hours * 60 + minutes <= 14 * 60
    return True
