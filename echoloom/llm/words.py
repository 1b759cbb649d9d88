"""Words of whole Arrow batches as numpy arrays of byte positions and 64-bit hashes.

A batch of texts is one UTF-8 buffer; all steps here run over that buffer at once, in slices of bounded size, so that a
task's memory does not follow its number of rows. A single text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes worked on at once.
SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, for exponents below ``n`` at least."""
    if len(_powers["up"]) < n:
        for name, base in (("up", int(_ODD)), ("down", _inverse(int(_ODD)))):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def ascii_lower() -> np.ndarray:
    """Byte table that lower-cases A to Z and leaves all else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def letter_digit_bytes() -> np.ndarray:
    """Bytes of words of letters and digits: 0-9, a-z (A-Z too, for they are lower-cased) and all beyond ASCII."""
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    return keep


def non_space_bytes() -> np.ndarray:
    """Bytes of words between the six white-space characters."""
    keep = np.ones(256, bool)
    keep[[32, *range(9, 14)]] = False
    return keep


class Slice:
    """Some consecutive texts: row numbers ``first`` to ``first + n_rows``, their bytes and offsets."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n_rows = first, data, offsets, len(offsets) - 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A text column in slices; null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words:
    """Words of a slice: byte ``start`` and ``end``, ``row`` (within the slice), ``hash``; ``bounds`` are each row's first word."""

    def __init__(self, part: Slice, keep: np.ndarray, fold: np.ndarray | None = None):
        data = part.data
        n = len(data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = keep[data]
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        # A word never runs on from one text into the next.
        cuts = part.offsets[1:-1]
        if len(cuts) and n:
            cuts = cuts[(cuts > 0) & (cuts < n)]
            cuts = np.unique(cuts[keep[data[cuts]] & keep[data[cuts - 1]]])
            if len(cuts):
                starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.start, self.end = starts, ends
        self.bounds = np.searchsorted(starts, part.offsets)
        self.count = np.diff(self.bounds)
        self.row = np.repeat(np.arange(part.n_rows), self.count)
        folded = data if fold is None else fold[data]
        self.folded = folded
        up, down = power_table(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hash = mixed((sums[ends] - sums[starts]) * down[starts])


    def strong_hash(self, seed: int) -> np.ndarray:
        """Hashes that are no polynomials of the letters: each byte counts as a mix of the eight bytes from it on, up to the word's end.

        ``hash`` is linear, and whoever writes a text can make two words of one hash. Different seeds give independent hashes.
        """
        n = len(self.folded)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        padded = np.concatenate((self.folded, np.zeros(8, np.uint8)))
        windows = np.ndarray((n,), "<u8", padded.data, strides=(1,)).copy()
        begins = np.zeros(n, np.int32)
        begins[self.start] = 1
        left = np.append(self.end, 0)[np.cumsum(begins, dtype=np.int32) - 1] - np.arange(n)
        windows &= _WINDOW[np.clip(left, 0, 8)]
        up, down = power_table(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(windows + mixed(np.array([seed], np.uint64))) * up[:n], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start] + np.uint64(seed))


#: Masks of the lowest 0 to 8 bytes.
_WINDOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hash(word: str) -> int:
    """The hash that :class:`Words` gives to ``word``."""
    data = np.frombuffer(word.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    up, _ = power_table(len(data) + 1)
    return int(mixed(np.array([np.sum(data * up[: len(data)], dtype=np.uint64)], np.uint64))[0])


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words, one for each position at which ``n`` words follow."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _ODD + hashes[i : i + m]
    return mixed(out)
