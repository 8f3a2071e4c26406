"""Words and their hashes, for Python workers that get Arrow batches."""

from __future__ import annotations

import html
import re
import sys
import types
from collections.abc import Callable

import numpy as np
import xxhash

_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[^\W_]+")
U = np.uint64
#: Odd 64-bit multipliers of the hash functions.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
CACHE = 400_000


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; tags dropped, then entities resolved."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


END = "\x01"
_WORD_OR_END = re.compile(r"[^\W_]+|\x01")


def words_of_all(texts: list[str | None]) -> list[str]:
    """The words of all texts in one list, END after each text."""
    parts = []
    for text in texts:
        text = text or ""
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
        parts.append(text.replace(END, " ") if END in text else text)
    parts.append("")
    return _WORD_OR_END.findall(f" {END} ".join(parts).lower())


class WordHash(dict):
    """word -> 64-bit hash, remembered; forgets all when it holds CACHE words, so memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * M1
    h = (h ^ (h >> U(29))) * M2
    return h ^ (h >> U(32))


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of n tokens (uint64 each)."""
    if len(tokens) < n:
        return np.empty(0, U)
    h = np.zeros(len(tokens) - n + 1, U)
    for k in range(n):
        h = (h ^ tokens[k : k + len(h)]) * M1
        h ^= h >> U(31)
    return mix(h)


def window_hashes_of(tokens: np.ndarray) -> np.ndarray:
    """``window_hashes`` of windows given as the rows of a table of tokens."""
    h = np.zeros(len(tokens), U)
    for k in range(tokens.shape[1]):
        h = (h ^ tokens[:, k]) * M1
        h ^= h >> U(31)
    return mix(h)


def once_per_worker(key, make: Callable):
    """What ``make`` gives, made once for each Python worker and ``key``; the last few are kept as long as the worker lives."""
    kept = sys.modules.setdefault("_brimfold_kept", types.ModuleType("_brimfold_kept")).__dict__.setdefault("kept", {})
    if key not in kept:
        while len(kept) >= 4:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]
