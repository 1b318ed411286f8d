"""Words of texts: unbroken runs of letters and digits, accents composed (NFC), lower case."""

from __future__ import annotations

import unicodedata

import regex

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(unicodedata.normalize("NFC", text))]

