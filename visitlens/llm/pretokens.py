"""Splitting text into pre-tokens, as byte-level BPE does before its merges."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The letters and numbers of Latin-1, for the plain form of the pattern.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
#: Any character for which the plain form may differ from the full pattern.
BEYOND_LATIN = re.compile(r"[^\x00-\x1b\x20-\xff]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of ``pattern``, in order.

    Texts of Latin-1 characters are split by the same pattern with the classes written
    out, which the standard library runs about twice as fast; others by ``pattern``.
    """
    full = regex.compile(pattern)
    plain = re.compile(
        pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]")
        .replace(r"\p{L}", f"[{LATIN_LETTERS}]")
        .replace(r"\p{N}", f"[{LATIN_NUMBERS}]")
    )

    def split(text: str) -> list[str]:
        return (full if BEYOND_LATIN.search(text) else plain).findall(text)

    return split
