"""Versioned transition tables of time zones.

A table lists, for one zone, the wall-clock readings from which each offset
holds.  Tables are made once on the driver from the IANA database and sent to
the executors as a few small arrays, so every executor converts by the same
version whatever its own installation holds.
"""

from __future__ import annotations

import importlib.metadata
import zoneinfo
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np

#: No zone changes before; after 2100 the rules in force repeat with the calendar, of which the table holds one cycle.
FIRST_YEAR, LAST_YEAR = 1800, 2500
#: From this year on the database has rules and no single changes; rules change months apart.
REGULAR_YEAR = 2100
#: Seconds of the calendar's 400 years.
_CYCLE = 146_097 * 86_400
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# A day before the end, as the table is made up to the end in UTC.
_LAST_WALL = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) - 86_400


@dataclass(frozen=True)
class ZoneTable:
    name: str
    version: str
    #: wall-clock seconds since 1970 from which ``offsets[i + 1]`` applies
    walls: np.ndarray
    offsets: np.ndarray
    abbreviations: dict[str, int]

    def offset_at_wall(self, wall: np.ndarray) -> np.ndarray:
        """Offset in seconds for wall-clock seconds; of a reading shown twice the earlier instant's, of a skipped one the offset before.  Years beyond the table have the offsets of the same year of its last cycle."""
        beyond = np.maximum(-((_LAST_WALL - 1 - wall) // _CYCLE), 0)
        return self.offsets[np.searchsorted(self.walls, wall - beyond * _CYCLE, side="right")]


def database_version() -> str:
    for folder in zoneinfo.TZPATH:
        try:
            return open(f"{folder}/tzdata.zi").readline().split()[-1]
        except OSError:
            pass
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


@lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable:
    """Probe the zone, day by day as long as changes are irregular, and bisect each step in which the offset or abbreviation changes."""
    zone = zoneinfo.ZoneInfo(name)

    def at(second: int) -> tuple[int, str]:
        t = (_EPOCH + timedelta(seconds=second)).astimezone(zone)
        return int(t.utcoffset().total_seconds()), t.tzname()

    start = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    end = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    walls, offsets, names = [], [at(start)[0]], {}
    day, regular = 86400, (datetime(REGULAR_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH) // timedelta(seconds=1)
    before = at(start)
    second = start
    while second < end:
        step = day if second < regular else 7 * day
        after = at(second + step)
        if second + step > 0:
            names[after[1]] = after[0]
        if after != before:
            low, high = second, second + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == before else (low, middle)
            if after[0] != before[0]:
                walls.append(high + max(before[0], after[0]))
                offsets.append(after[0])
            before = after
        second += step
    return ZoneTable(name, database_version(), np.array(walls, dtype=np.int64), np.array(offsets, dtype=np.int64), {k.upper(): v for k, v in names.items() if k[:1].isalpha()})
