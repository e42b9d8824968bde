"""Zone transition tables with their version, from the IANA database through ``zoneinfo``."""

from __future__ import annotations

import functools
import importlib.metadata
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
FIRST, LAST = 1800, 2100  # years covered by the tables; earlier ones have no rules, later ones repeat those of 2072 to 2099
_LAST_SECOND = (datetime(LAST, 1, 1, tzinfo=UTC) - EPOCH) // timedelta(seconds=1)


def _like_before(local: np.ndarray) -> np.ndarray:
    """Times from LAST on moved to a year before it that begins on the same week day and is as long: the same rules hold."""
    late = local >= _LAST_SECOND
    if not late.any():
        return local
    year = local[late].astype("datetime64[s]").astype("datetime64[Y]").astype(np.int64) + 1970
    begin = lambda y: (y - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
    kind = lambda y: (begin(y) % 7) * 2 + (begin(y + 1) - begin(y) == 366)
    cycle = np.arange(LAST - 28, LAST)  # every kind of year is among any 28 without a century between
    same = np.zeros(14, np.int64)
    same[kind(cycle)] = cycle
    out = local.copy()
    out[late] += (begin(same[kind(year)]) - begin(year)) * 86400
    return out


@functools.cache
def version() -> str:
    """The release of the zone database that the tables come from."""
    for folder in TZPATH:
        f = Path(folder, "tzdata.zi")
        if f.exists():
            return f.open().readline().strip().removeprefix("# version ")
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """``starts[i]`` is the UTC second from which ``offsets[i]`` and ``names[i]`` hold; ``starts[0]`` is the least integer.

    ``turns[i]`` is the local second from which a wall clock is read with ``offsets[i + 1]``: the later end of the
    gap or overlap. So a local time that occurs twice is the earlier, and one that does not exist is read with the
    offset before the change.
    """

    starts: np.ndarray
    offsets: np.ndarray
    names: tuple[str, ...]
    turns: np.ndarray

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        return local - self.offsets[np.searchsorted(self.turns, _like_before(local), side="right")]

    def named_offset(self, name: str, local: np.ndarray) -> np.ndarray | None:
        """The offset that the abbreviation has in this zone: where it names several, the one in force nearest before."""
        at = np.array([i for i, n in enumerate(self.names) if n.upper() == name.upper()])
        if not len(at):
            return None
        starts, local = self.starts[at], _like_before(local)
        i = np.clip(np.searchsorted(starts, local - self.offsets[at[-1]] + 7200, side="right") - 1, 0, len(at) - 1)
        return self.offsets[at[i]]


@functools.lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable | None:
    """None for a name that the database does not have."""
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None

    def at(t: int) -> tuple[int, str]:
        d = (EPOCH + timedelta(seconds=t)).astimezone(zone)
        return int(d.utcoffset().total_seconds()), d.tzname() or ""

    begin, end = int((datetime(FIRST, 1, 1, tzinfo=UTC) - EPOCH).total_seconds()), int((datetime(LAST, 1, 1, tzinfo=UTC) - EPOCH).total_seconds())
    starts, states, t, now = [np.iinfo(np.int64).min // 4], [at(begin)], begin, at(begin)
    while t < end:
        nxt = min(end, t + 7 * 86400)
        then = at(nxt)
        if then != now:  # the second of the change, by bisection
            a, b = t, nxt
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if at(m) == now else (a, m)
            starts.append(b)
            now = at(b)
            states.append(now)
            t = b
        else:
            t = nxt
    s, o = np.array(starts, dtype=np.int64), np.array([x for x, _ in states], dtype=np.int64)
    return ZoneTable(s, o, tuple(n for _, n in states), s[1:] + np.maximum(o[1:], o[:-1]))


def transition_rows(names: list[str]) -> list[tuple[str, str, int, int, str]]:
    """(zone, version, utc_start, offset_seconds, abbreviation) of each named zone, for keeping beside results."""
    rows = []
    for n in sorted(set(names)):
        if (z := zone_table(n)) is not None:
            rows += [(n, version(), int(s), int(o), a) for s, o, a in zip(z.starts, z.offsets, z.names, strict=True)]
    return rows
