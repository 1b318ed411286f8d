"""Timestamps in mixed notations, precisions and zones to UTC microseconds.

Texts are tokenised into shape masks (digit, letter, other bytes as they are); every distinct mask is mapped
to a parser once, and all texts of one mask are then converted together on byte matrices. Wall time goes
through the versioned tables of millrace.functions.zones.

Results: outer blanks mean nothing; a zone or offset in the text holds, else the row's zone, else UTC. Texts of over
MAX_BYTES bytes are shortened first by what means nothing, digits beyond microseconds and remarks after an offset; no
notation is still longer, or shorter than 8 bytes. Null, empty or unreadable text, an unknown zone that is needed, and dates or times that do not exist
(month 13, 30 February, 24:00, a second 60) give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.zones import ZoneTables, days_from_civil, zone_tables

# Hours from UTC of zone abbreviations in a text, English month names, blanks
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
BLANKS = " \t\n\r\x0b\x0c                 　﻿"
MAX_BYTES = 96
# What can be long in a readable text: digits beyond microseconds, and a remark in brackets after an offset
_LONG = [(re.compile(r"([.,][0-9]{6})[0-9]+"), r"\1"), (re.compile(r"([+-][0-9:]{4,5})\[[^\]]*\]$"), r"\1")]

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[ord("a") : ord("z") + 1] = ord("A")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[128:] = 255
_MIX = np.random.default_rng(20240229).integers(1, 2**63, MAX_BYTES, dtype=np.uint64) | np.uint64(1)
_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])

# Masks of the notations, with the places of their parts; 9 is any digit, A any letter
_TIME = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<sign>[+-])(?P<zh>99):?(?P<zm>99)?(?:\[[^\]]*\])?|\[(?P<zone>[^\]]+)\]| ?(?P<abbr>A+))?"
_NOTATIONS = [
    re.compile(p)
    for p in (
        rf"(?P<Y>9999)-(?P<m>99)-(?P<d>99)(?:(?P<T>[A ]){_TIME}{_ZONE})?",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<T>A)(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_ZONE}",
        rf"(?P<m>9{{1,2}})/(?P<d>9{{1,2}})/(?P<Y>9999)(?: {_TIME} ?(?P<half>AA))",
        rf"(?P<m>9{{1,2}})/(?P<d>9{{1,2}})/(?P<Y>9999)(?: {_TIME}{_ZONE})?",
        rf"(?P<d>9{{1,2}})\.(?P<m>9{{1,2}})\.(?P<Y>9999)(?: {_TIME}{_ZONE})?",
        rf"(?:A{{3}}, ?)?(?P<d>9{{1,2}}) (?P<mon>AAA) (?P<Y>9999) {_TIME}{_ZONE}",
    )
]
_EPOCH = {10: 1_000_000, 13: 1_000, 16: 1}

# bytes (n x length), zone of the row (n), tables -> microseconds (n), readable (n)
Parser = Callable[[np.ndarray, np.ndarray, ZoneTables], tuple[np.ndarray, np.ndarray]]


def _number(b: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(b), np.int64)
    for k in range(*span):
        out = out * 10 + (b[:, k].astype(np.int64) - 48)
    return out


def _lookup(b: np.ndarray, span: tuple[int, int], table: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words at a place, and which are known."""
    words = np.ascontiguousarray(b[:, span[0] : span[1]] & 0xDF).view(f"S{span[1] - span[0]}").ravel()
    value, known = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
    for word, x in table.items():
        if len(word) == span[1] - span[0]:
            hit = words == word
            value[hit], known = x, known | hit
    return value, known


@lru_cache(maxsize=4096)
def parser_for(mask: bytes) -> Parser | None:
    """The parser of a mask, or None. Distinct masks are few; the cache only bounds memory against garbage."""
    shape = mask.decode("latin-1")
    if set(shape) == {"9"} and len(shape) in _EPOCH:
        scale, whole = _EPOCH[len(shape)], (0, len(shape))
        return lambda b, zone, tables: (_number(b, whole) * scale, np.ones(len(b), bool))
    found = next((m for p in _NOTATIONS if (m := p.fullmatch(shape))), None)
    if not found:
        return None
    at = {k: found.span(k) for k, v in found.groupdict().items() if v is not None}

    def parse(b: np.ndarray, zone: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
        get = lambda k: _number(b, at[k]) if k in at else np.zeros(len(b), np.int64)
        ok = np.ones(len(b), bool)
        if "T" in at and mask[at["T"][0]] == ord("A"):
            ok &= (b[:, at["T"][0]] & 0xDF) == ord("T")
        year, day, hour, minute, second = (get(k) for k in "YdHMS")
        if "mon" in at:
            month, known = _lookup(b, at["mon"], {m.upper().encode(): i + 1 for i, m in enumerate(MONTHS)})
            ok &= known
        else:
            month = get("m")
        if "half" in at:
            late, known = _lookup(b, at["half"], {b"AM": 0, b"PM": 12})
            ok &= known & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + late
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        ok &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
        ok &= day <= _MONTH_DAYS[np.where(ok, month, 0)] + (leap & (month == 2))
        ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
        month, day, hour = np.where(ok, month, 1), np.where(ok, day, 1), np.where(ok, hour, 0)
        micros = np.zeros(len(b), np.int64)
        if "f" in at:
            first = at["f"][0]
            end = min(at["f"][1], first + 6)
            micros = _number(b, (first, end)) * 10 ** (6 - (end - first))
        wall = days_from_civil(year, month, day) * 86_400 + hour * 3600 + minute * 60 + second
        if "sign" in at:
            zh, zm = get("zh"), get("zm")
            ok &= (zh <= 18) & (zm <= 59)
            away = (zh * 3600 + zm * 60) * np.where(b[:, at["sign"][0]] == ord("-"), -1, 1)
            utc = wall - away
        elif "abbr" in at:
            hours, known = _lookup(b, at["abbr"], {k.encode(): v for k, v in ABBREVIATIONS.items()})
            ok &= known
            utc = wall - hours * 3600
        else:
            if "zone" in at:
                names = np.ascontiguousarray(b[:, slice(*at["zone"])]).view(f"S{at['zone'][1] - at['zone'][0]}").ravel()
                each, back = np.unique(names, return_inverse=True)
                zone = np.array([tables.zone(x.decode("latin-1")) for x in each])[back]
            ok &= zone >= 0
            utc = tables.to_utc(wall, np.maximum(zone, 0))
        return utc * 1_000_000 + micros, ok

    return parse


def to_micros(texts: pa.Array, zones: pa.Array, tables: ZoneTables) -> pa.Array:
    """UTC microseconds of trimmed texts with the zones of their rows."""
    n = len(texts)
    out, good = np.zeros(n, np.int64), np.zeros(n, bool)
    coded = zones.dictionary_encode() if not pa.types.is_dictionary(zones.type) else zones
    utc = tables.zone("UTC")
    table = np.array([utc if x is None or not x.strip() else tables.zone(x) for x in coded.dictionary.to_pylist()] + [utc])
    row_zone = table[np.asarray(coded.indices.fill_null(len(table) - 1), dtype=np.int64)]
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    sizes = np.where(np.asarray(texts.is_valid()), sizes, 0)
    over = np.flatnonzero(sizes > MAX_BYTES)
    if len(over):  # the few long ones by themselves, shortened
        short = []
        for text in texts.take(pa.array(over)).to_pylist():
            for pattern, to in _LONG:
                text = pattern.sub(to, text)
            short.append(text if len(text.encode()) <= MAX_BYTES else None)
        own = to_micros(pa.array(short, pa.string()), coded.take(pa.array(over)).cast(pa.string()), tables)
        good[over] = np.asarray(own.is_valid())
        out[over] = np.asarray(own.fill_null(0))
    for size in np.unique(sizes):
        if not 8 <= size <= MAX_BYTES:
            continue
        rows = np.flatnonzero(sizes == size)
        b = data[offsets[rows][:, None] + np.arange(size)]
        shapes = _CLASS[b]
        coarse = shapes.astype(np.uint64) @ _MIX[:size]
        _, first, group = np.unique(coarse, return_index=True, return_inverse=True)
        if (shapes != shapes[first][group]).any():  # two masks of one sum: fall back on the masks themselves
            _, first, group = np.unique(shapes, axis=0, return_index=True, return_inverse=True)
            group = group.ravel()
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(first)))
        for k, end in enumerate(ends):
            parse = parser_for(shapes[first[k]].tobytes())
            if parse:
                own = order[ends[k - 1] if k else 0 : end]
                value, ok = parse(b[own], row_zone[rows[own]], tables)
                out[rows[own]], good[rows[own]] = value, ok
    return pa.array(out, pa.int64(), mask=~good)


def utc_micros(ts: Column | str, tz: Column | str | None = None, tables: ZoneTables | None = None) -> Column:
    """Column of UTC microseconds of a text column, given the column with the zones of the rows."""
    tables = tables or zone_tables()

    @F.arrow_udf("bigint")
    def convert(texts: pa.Array, zones: pa.Array) -> pa.Array:
        return to_micros(texts, zones, tables)

    text = F.col(ts) if isinstance(ts, str) else ts
    zone = F.lit(None).cast("string") if tz is None else F.col(tz) if isinstance(tz, str) else tz
    return convert(F.btrim(text, F.lit(BLANKS)), zone)
