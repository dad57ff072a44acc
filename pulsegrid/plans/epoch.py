"""Run epochs: relative times and dates, and where a run's epoch is found."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

PER_SECOND = {"ps": 10**12, "ns": 10**9, "us": 10**6, "ms": 10**3, "s": 1}
STAMP = re.compile(r"(20\d\d)-?(\d\d)-?(\d\d)[T_ -]?(\d\d)[-:]?(\d\d)[-:]?(\d\d)")


@dataclass(frozen=True)
class Epoch:
    """The date of time 0 and the unit of relative times."""

    start: datetime
    unit: str = "ps"
    source: str = "manual"

    def relative(self, when: datetime) -> int:
        """Whole units since the epoch; a date without a zone is in the epoch's."""
        when = when if when.tzinfo else when.replace(tzinfo=self.start.tzinfo)
        d = when - self.start
        return (d.days * 86400 + d.seconds) * PER_SECOND[self.unit] + d.microseconds * PER_SECOND[self.unit] // 10**6

    def absolute(self, time: int) -> datetime:
        """To whole microseconds, rounded down."""
        return self.start + timedelta(microseconds=time * 10**6 // PER_SECOND[self.unit])


def stamp(text: str) -> datetime | None:
    m = STAMP.search(text)
    if not m:
        return None
    try:
        return datetime(*map(int, m.groups()), tzinfo=UTC)
    except ValueError:
        return None


def from_name(paths: list[str]) -> datetime | None:
    """The first file name that holds a date and time."""
    return next((t for p in paths if (t := stamp(p.rsplit("/", 1)[-1]))), None)


def from_header(lines: list[str]) -> datetime | None:
    """The first header line that holds a date and time."""
    return next((t for x in lines if (t := stamp(x))), None)


def from_first_event(time: int | None, unit: str) -> datetime | None:
    """The first event's time taken as time since 1970."""
    if time is None:
        return None
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=time * 10**6 // PER_SECOND[unit])


def find(paths: list[str], header: list[str] = (), first_event: int | None = None, unit: str = "ps", how: str = "auto") -> Epoch:
    """Tries file names, then the header, then the first event (or only the one asked for)."""
    if not paths:
        raise ValueError("no files to take an epoch from")
    tries = {"filename": lambda: from_name(paths), "csv_header": lambda: from_header(list(header)), "first_event": lambda: from_first_event(first_event, unit)}
    for name in tries if how == "auto" else [how]:
        start = tries[name]()
        if start:
            return Epoch(start, unit, name)
    raise ValueError("no epoch found; set one by hand")
