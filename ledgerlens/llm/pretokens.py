"""Splits text into the pre-tokens of the public pattern of the byte-level vocabularies."""

from __future__ import annotations

import re
from functools import lru_cache

#: On text of these characters only, Python's re sees the same letters, digits and white space as Unicode does.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]")
_PLAIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def _full():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    """All matches of public_tokenizers.PATTERN, in order; they cover the text."""
    return _full().findall(text) if _OTHER.search(text) else _PLAIN.findall(text)
