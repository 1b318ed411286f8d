"""Versioned tables of zone transitions, for vectorised conversion of wall time.

A ZoneTables value is built once on the driver from the installed time zone database and travels with the
job, so all executors convert by one version, whatever database they have themselves. Its size is bounded by
the database: some 600 zones, rules written out up to LAST_YEAR (later years map back by whole 400-year cycles).
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources

import numpy as np

LAST_YEAR = 2437
CYCLE_S = 146_097 * 86_400
_SHIFT, _HALF = 40, 1 << 39


def days_from_civil(y, m, d):
    """Days since 1970-01-01 of proleptic Gregorian dates; scalars or arrays."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(np.asarray(m) > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


CYCLE_FROM = int(days_from_civil(LAST_YEAR, 1, 1)) * 86_400


@dataclass(frozen=True)
class ZoneTables:
    version: str
    index: dict[str, int]
    keys: np.ndarray = field(repr=False)
    offsets: np.ndarray = field(repr=False)

    def zone(self, name: str) -> int:
        """Index of a zone, or -1; names count without case and outer blanks."""
        return self.index.get(name.strip().lower(), -1)

    def to_utc(self, wall_s: np.ndarray, zone: np.ndarray) -> np.ndarray:
        """UTC seconds of wall seconds: repeated wall time is the earlier moment, skipped wall time the
        moment later by the gap. Both mean the offset in force before the transition, so one search suffices."""
        back = np.maximum(0, (wall_s - CYCLE_FROM) // CYCLE_S + 1) * CYCLE_S
        at = (zone.astype(np.int64) << _SHIFT) + (wall_s - back) + _HALF
        return wall_s - self.offsets[np.searchsorted(self.keys, at, side="right") - 1]


def _names() -> list[str]:
    text = resources.files("tzdata").joinpath("zones").read_text()
    return [x for x in text.split("\n") if x]


def _tzif(data: bytes) -> tuple[np.ndarray, np.ndarray, int, str]:
    """Transition seconds, offsets after each, offset before the first, rule for the time after the last."""
    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    isut, isstd, leap, times, types, chars = counts(0)
    start = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    isut, isstd, leap, times, types, chars = counts(start)
    p = start + 44
    at = np.frombuffer(data, ">i8", times, p).astype(np.int64)
    kind = np.frombuffer(data, "u1", times, p + times * 8)
    q = p + times * 9
    utoff = np.array([struct.unpack(">l", data[q + 6 * i : q + 6 * i + 4])[0] for i in range(types)], np.int64)
    tail = data[q + types * 6 + chars + leap * 12 + isstd + isut :].strip(b"\n").decode()
    return at, utoff[kind], int(utoff[0]), tail


_RULE = re.compile(r"(?:<[^>]+>|[A-Za-z]+)([-+\d:]+)(?:(?:<[^>]+>|[A-Za-z]+)([-+\d:]*),([^,]+),(.+))?")


def _seconds(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return sign * sum(x * k for x, k in zip(parts, (3600, 60, 1)))


def _rule_days(rule: str, years: np.ndarray) -> np.ndarray:
    """Local second, as if in UTC, at which a rule such as M3.2.0/2 or J60 takes effect in each year."""
    day, _, time = rule.partition("/")
    shift = _seconds(time) if time else 7_200
    first = days_from_civil(years, 1, 1)
    if day[0] == "M":
        m, week, dow = (int(x) for x in day[1:].split("."))
        month = days_from_civil(years, m, 1)
        days = month + (dow - (month + 4)) % 7 + 7 * (week - 1)
        end = days_from_civil(years + (m == 12), m % 12 + 1, 1)
        days = np.where(days >= end, days - 7, days)
    elif day[0] == "J":
        n, leap = int(day[1:]), days_from_civil(years + 1, 1, 1) - first == 366
        days = first + n - 1 + (leap & (n >= 60))
    else:
        days = first + int(day)
    return days * 86_400 + shift


def _tail(rule: str, last: int) -> tuple[np.ndarray, np.ndarray]:
    m = _RULE.fullmatch(rule)
    if not m or not m[3]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    std = -_seconds(m[1])
    dst = -_seconds(m[2]) if m[2] else std + 3600
    years = np.arange(1970, LAST_YEAR + 401)
    at = np.concatenate([_rule_days(m[3], years) - std, _rule_days(m[4], years) - dst])
    off = np.repeat(np.array([dst, std], np.int64), len(years))
    order = np.argsort(at, kind="stable")
    at, off = at[order], off[order]
    return at[at > last], off[at > last]


@lru_cache(maxsize=1)
def zone_tables() -> ZoneTables:
    """The tables of the database that is installed where this runs, normally the driver."""
    import tzdata

    index: dict[str, int] = {}
    seen: dict[bytes, int] = {}
    keys: list[np.ndarray] = []
    offsets: list[np.ndarray] = []
    root = resources.files("tzdata.zoneinfo")
    for name in _names():
        data = root.joinpath(*name.split("/")).read_bytes()
        if data not in seen:
            at, after, before, rule = _tzif(data)
            more, off = _tail(rule, int(at[-1]) if len(at) else -(1 << 62))
            at, after = np.concatenate([at, more]), np.concatenate([after, off])
            ahead = np.concatenate([[before], after[:-1]])
            wall = np.maximum.accumulate(at + np.maximum(ahead, after)) if len(at) else at
            k = seen[data] = len(seen)
            wall = np.clip(wall, -_HALF + 1, _HALF - 1)
            keys.append((k << _SHIFT) + np.concatenate([[-_HALF], wall]) + _HALF)
            offsets.append(np.concatenate([[before], after]))
        index[name.lower()] = seen[data]
    return ZoneTables(tzdata.IANA_VERSION, index, np.concatenate(keys), np.concatenate(offsets).astype(np.int64))
