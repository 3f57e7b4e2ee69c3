"""Canonical length-limited Huffman codes and their blocks, in numpy.

A block is the codes of its ids in one bit string, most significant bit first. Every ``STEP`` ids
the bit offset is noted; from these checkpoints the decoder walks all stretches of a block side by
side with a table indexed by the next ``longest`` bits.
"""

from __future__ import annotations

import numpy as np

LONGEST = 16
STEP = 128


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length by id, 0 for ids that never occur: the package-merge method.

    One id alone gets length 1. ValueError where ``longest`` bits can't tell the ids apart.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} ids do not fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        is_leaf.append(rank < n)
    chosen = 2 * (n - 1)
    for level in reversed(is_leaf):
        taken = int(level[:chosen].sum())
        lengths[order[:taken]] += 1
        chosen = 2 * (chosen - taken)
    return lengths


class Code:
    """The canonical code of ``lengths``: shorter codes first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.longest = int(lengths.max(initial=1)) or 1
        widths = self.lengths[order]
        spans = np.int64(1) << (self.longest - widths)
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.int64)[: len(order)]
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = starts >> (self.longest - widths)
        self.symbols = np.zeros(1 << self.longest, np.uint32)
        self.widths = np.ones(1 << self.longest, np.int64)
        self.symbols[: spans.sum()] = np.repeat(order, spans)
        self.widths[: spans.sum()] = np.repeat(widths, spans)

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
        """The bits of ``ids`` and the bit offset (unsigned 32 bit) of every ``step``-th of them."""
        ids = ids.astype(np.int64)
        widths = self.lengths[ids]
        if len(ids) and not widths.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(widths)
        begins = ends - widths
        total = int(ends[-1]) if len(ids) else 0
        if total >= 1 << 32:
            raise ValueError("a block of over 2^32 bits")
        # Each code lies in three bytes; no two codes share a bit, so sums are unions.
        at = begins >> 3
        bits = self.codes[ids] << (24 - widths - (begins & 7))
        size = (total + 7) // 8
        out = np.zeros(size + 3)
        for k in range(3):
            out += np.bincount(at + k, weights=(bits >> (16 - 8 * k)) & 255, minlength=size + 3)
        return out[:size].astype(np.uint8).tobytes(), begins[::step].astype("<u4").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int, step: int = STEP) -> np.ndarray:
        """The ``n`` ids of a block; all stretches between checkpoints at once."""
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        if len(at) != -(-n // step):
            raise ValueError("a block without all its checkpoints")
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        last, shift, mask = len(window) - 1, 32 - self.longest, (1 << self.longest) - 1
        out = np.empty((step, len(at)), np.uint32)
        for k in range(min(step, n)):
            seen = (window[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.symbols[seen]
            at += self.widths[seen]
        return out.T.reshape(-1)[:n]
