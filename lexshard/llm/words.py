"""Words of texts as arrays, for tasks: a batch of texts becomes one array of word hashes with the texts' bounds.

Words are hashed to 64 bits; each task remembers the hashes of the words that it met, up to MEMO of them.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash

MEMO = 200_000
#: ASCII letters lower-cased, other ASCII characters but digits as spaces; other bytes stay.
_ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TEXT_WORD = re.compile(r"\w+")


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.translate(_ALNUM).split()


def lower_words(text: bytes) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of characters other than ASCII white space."""
    return text.split()


def text_words(text: bytes) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _TEXT_WORD.findall(text.decode("utf-8", "replace").lower())


class _Memo(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_memo = _Memo()
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def hashes(words: Iterable) -> np.ndarray:
    """uint64 hashes of words."""
    return np.fromiter(map(_memo.__getitem__, words), np.uint64)


def tidy() -> None:
    """Give memory back at the end of a task: Spark keeps the worker for tasks of other stages."""
    _memo.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column of strings, null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def batch_hashes(column: pa.Array, split: Callable[[bytes], list]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch's texts one after the other, and where each text's begin and the last's end."""
    parts = [hashes(split(t)) for t in texts(column)]
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), ends


#: Odd 64-bit factors of the rolling hashes, one for each place in a gram.
_FACTORS = (np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread hashes over all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; none where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _FACTORS[0]
    for i in range(1, k):
        out += h[i : i + n] * _FACTORS[i]
    return mix64(out)
