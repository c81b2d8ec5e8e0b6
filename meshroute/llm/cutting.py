"""Cutting texts into the pieces that byte-level BPE merges within."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: The usual pattern: contractions, letters, numbers, other signs, white space.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this letter the classes of the usual pattern are few ranges, and every engine has the same.
LATIN_END = "ɐ"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall


def is_latin(text: str) -> bool:
    """Whether all letters come before LATIN_END. The largest letter is looked for last, as that takes as long as a cut."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < LATIN_END
    return True


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of the pattern in a text."""
    full = regex.compile(pattern).findall
    if pattern != USUAL:
        return full
    return lambda text: _LATIN(text) if is_latin(text) else full(text)
