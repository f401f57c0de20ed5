"""Canonical Huffman codes of limited length for token ids, and blocks that decode on their own.

A block holds up to BLOCK ids: their codes in one bit string, and the bit offset of every EVERY-th id. Decoding looks up the
next max_bits bits in a table of (id, length), for all checkpoints of a block side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, EVERY = 1 << 16, 64
MAX_BITS = 16


def lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code lengths (uint8, 0 for ids that don't occur) of least total size, none over max_bits: package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kept = leaves, []
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")  # of equal weights, leaves come first
        kept.append(at < len(leaves))
        level = both[at]
    need, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(kept):
        n = int(is_leaf[:need].sum())
        depth[:n] += 1
        need = 2 * (need - n)
    depth[:need] += 1
    out[order] = depth
    return out


def codes(lens: np.ndarray) -> np.ndarray:
    """Canonical codes: in the order of length, then id."""
    out, code, at = np.zeros(len(lens), np.uint32), 0, 0
    for bits in range(1, int(lens.max(initial=0)) + 1):
        ids = np.flatnonzero(lens == bits)
        code <<= bits - at
        at = bits
        out[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code += len(ids)
    return out


def _bits(code: np.ndarray, n: np.ndarray, together: int) -> bytes:
    """Codes of n bits each as one bit string. So many codes together have 64 bits at most."""
    while together > 1:
        if len(n) % 2:
            code, n = np.append(code, np.uint64(0)), np.append(n, np.uint64(0))
        code, n, together = (code[::2] << n[1::2]) | code[1::2], n[::2] + n[1::2], together // 2
    if not (size := int(n.sum())):
        return b""
    end = np.cumsum(n)
    at = end - n
    word, inside = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    left = code << (np.uint64(64) - n)  # a group has one bit at least, so no shift is by 64
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(left >> inside, first)
    over = np.flatnonzero(inside + n > np.uint64(64))  # of these no two go over into one word
    out[word[over] + 1] |= left[over] << (np.uint64(64) - inside[over])
    return out.astype(">u8").tobytes()[: -(-size // 8)]


class Coder:
    def __init__(self, lens: np.ndarray):
        self.lens = lens.astype(np.int64)
        self.bits = max(1, int(lens.max(initial=0)))
        if self.bits > 24:
            raise ValueError("codes have 24 bits at most")
        self.codes = codes(lens).astype(np.uint64)
        self.table_id = np.zeros(1 << self.bits, np.uint32)
        self.table_len = np.zeros(1 << self.bits, np.uint8)
        used = np.flatnonzero(lens)
        used = used[np.lexsort((used, lens[used]))]
        spread = 1 << (self.bits - self.lens[used])
        self.table_id[: spread.sum()] = np.repeat(used, spread)
        self.table_len[: spread.sum()] = np.repeat(lens[used], spread)

    def encode(self, ids: np.ndarray) -> bytes:
        """A block of up to BLOCK ids."""
        n = self.lens[ids]
        at = np.cumsum(n) - n
        body = at[::EVERY].astype("<u4").tobytes() + _bits(self.codes[ids], n.astype(np.uint64), 4 if self.bits <= 16 else 2)
        return struct.pack("<III", len(ids), len(body), zlib.crc32(body)) + body

    def decode(self, block: bytes) -> np.ndarray:
        """The ids of a block. ValueError: it is damaged."""
        n, size, crc = struct.unpack_from("<III", block)
        body = block[12 : 12 + size]
        if len(body) != size or zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        lanes = -(-n // EVERY)
        at = np.frombuffer(body, "<u4", lanes).astype(np.int64)
        data = np.frombuffer(body[4 * lanes :] + bytes(8 + EVERY * 4), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.empty((EVERY, lanes), np.uint32)
        keep = np.uint32((1 << self.bits) - 1)
        last = len(window) - 1
        for i in range(EVERY):
            look = (window[np.minimum(at >> 3, last)] >> (32 - self.bits - (at & 7)).astype(np.uint32)) & keep
            out[i] = self.table_id[look]
            at += self.table_len[look]
        return out.T.reshape(-1)[:n]
