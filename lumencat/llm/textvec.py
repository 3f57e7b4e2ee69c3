"""Words of a batch of texts as 64-bit hashes, computed over the bytes of the batch in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 5
_WORD = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2^64."""
    def run(base: int) -> np.ndarray:
        out = np.full(n, base % _WORD, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, _WORD))


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = separators(b" \t\n\v\f\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (and the last ends); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def stretches(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in runs of at most ``most`` bytes, or of one longer text: what is hashed at a time."""
    _, begins = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + most, side="right")) - 1)
        yield column.slice(first, last - first)
        first = last


def _cut(separated: np.ndarray, begins: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where no word goes on: a separator or the start of a text."""
    n = len(separated)
    start = int(begins[np.searchsorted(begins, at)]) if at < n else n
    while at < start:
        found = np.flatnonzero(separated[at : min(at + 4096, start)])
        if len(found):
            return at + int(found[0])
        at += 4096
    return start


def word_hashes(
    column: pa.Array, separated: np.ndarray = WHITE, segment: int = SEGMENT, heads: tuple[int, ...] = (),
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, index of the first word of each text and one past the last).

    With ``heads``, the hashes are rows: the word, then its first so many bytes for each of ``heads``.
    Works through the bytes in segments, so beside the hashes its memory does not grow with a text.
    """
    data, begins = text_bytes(column)
    apart = separated[data]
    hashes, places, s = [], [], 0
    while s < len(data):
        e = _cut(apart, begins, min(s + segment, len(data)))
        inside = ~apart[s:e]
        before = np.concatenate([[False], inside[:-1]])
        borders = begins[np.searchsorted(begins, s) : np.searchsorted(begins, e)] - s
        before[borders] = False
        after = np.concatenate([inside[1:], [False]])
        after[borders[borders > 0] - 1] = False
        first = np.flatnonzero(inside & ~before)
        last = np.flatnonzero(inside & ~after) + 1
        power, inverse = _powers(max(segment, e - s))
        sums = np.zeros(e - s + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data[s:e]]] * power[: e - s], out=sums[1:])
        cuts = [last, *(np.minimum(first + n, last) for n in heads)]
        hashes.append(np.stack([
            mix((sums[cut] - sums[first]) * inverse[first] + (cut - first + 1000 * k).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            for k, cut in enumerate(cuts)
        ]))
        places.append(first + s)
        s = e
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    rows = np.concatenate(hashes, axis=1) if hashes else np.zeros((1 + len(heads), 0), np.uint64)
    return rows if heads else rows[0], np.searchsorted(place, begins)
