"""Words and k-word shingles of many texts at once, as exact ids or as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

# Fixed key of the word hash, so that every worker computes the same.
KEY = "0f1e2d3c4b5a6978"
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words between ASCII white space of all texts in one list, and each text's number of words."""
    lists = [t.split() for t in texts]
    return [w for ws in lists for w in ws], np.array([len(ws) for ws in lists], dtype=np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), hash_key=KEY) if words else np.empty(0, dtype=np.uint64)


def shingle_sets(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text's k-word shingles, end to end, and each text's number of them.

    A text of fewer than k words has its whole sequence as one shingle, one without words none.
    """
    words, counts = words_of(texts)
    h = word_hashes(words)
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(h):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    n = len(h)
    ends = np.cumsum(counts)
    left = ends[owner] - np.arange(n)  # words from here to the text's end
    whole = counts[owner] < k
    value = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        there = left > i
        nxt = np.zeros(n, dtype=np.uint64)
        nxt[: n - i] = h[i:]
        value = np.where(there, value * MIX + nxt, value * MIX)
    value = mixed(np.where(whole, value + counts[owner].astype(np.uint64) * MIX, value))
    first = np.append(True, owner[1:] != owner[:-1])
    keep = (left >= k) | (whole & first)
    value, owner = value[keep], owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=len(texts))


def window_ids(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact ids of k-word windows: (id, owning text, position of its first word in the joined word list).

    Windows with equal ids are the same k words; windows stay inside their text.
    """
    words, counts = words_of(texts)
    n = len(words)
    if n < k:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(n - k + 1)
    code = ids[: n - k + 1]
    for i in range(1, k):
        # Pairs of small ids fit into 64 bits; they are numbered anew after each word.
        code = pd.factorize(code * np.int64(n) + ids[i : n - k + 1 + i])[0].astype(np.int64)
    inside = owner[: n - k + 1] == owner[k - 1 :]
    return code[inside], owner[: n - k + 1][inside], at[inside]
