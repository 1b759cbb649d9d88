"""Token ids of pieces of text, found once per distinct piece and put together for whole slices of texts."""

from __future__ import annotations

from itertools import chain

import numpy as np

from echoloom.llm import words as W

#: Bytes of distinct pieces, their ids and their entries that a worker remembers before it starts anew.
REMEMBERED_BYTES = 64 << 20
#: What an entry takes beside its letters and ids.
ENTRY_BYTES = 150


class PieceIds:
    """Remembers the ids of distinct pieces. Pieces are told apart by their texts, so no two of them are ever taken for one."""

    def __init__(self, encode_many, remembered: int = REMEMBERED_BYTES):
        """``encode_many``: list of pieces to list of id lists."""
        self.encode_many, self.remembered = encode_many, remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.offsets, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.bytes = 0

    def _learn(self, pieces: list[str]) -> None:
        lists = self.encode_many(pieces)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        ends = self.offsets[-1] + np.cumsum([len(ids) for ids in lists])
        self.bytes += ENTRY_BYTES * len(pieces) + sum(map(len, pieces)) + 4 * int(ends[-1] - len(self.pool))
        self.offsets = np.concatenate((self.offsets, ends))
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(lists), np.int32, ends[-1] - len(self.pool))))

    def of(self, whole: str, points: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of ``whole``, whose code points are ``points``; pieces begin at ``starts``, texts at ``rows``."""
        if self.bytes > self.remembered:
            self._forget()
        first, number = same_pieces(points, starts)
        ends = np.append(starts[1:], len(points))[: len(starts)]
        pieces = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.known.get
        entry = list(map(known, pieces))
        if None in entry:
            self._learn(list(dict.fromkeys([piece for piece, found in zip(pieces, entry, strict=True) if found is None])))
            entry = list(map(known, pieces))
        entry = np.array(entry, np.int64)
        begin = self.offsets[entry][number]
        length = self.offsets[entry + 1][number] - begin
        total = np.concatenate(([0], np.cumsum(length)))
        ids = self.pool[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, rows)])


def same_pieces(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of which each stands for all that are equal to it, and for every piece the place of the one that stands for it).

    Pieces are gathered by a hash and then compared, letter by letter, with the first of their hash. Those that differ from it
    stand for themselves, so a collision costs time and nothing else. Pieces lie side by side and cover ``points``.
    """
    n = len(points)
    lengths = np.diff(np.append(starts, n))[: len(starts)]
    up, down = W.power_table(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n])))
    h = W.mixed((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    stands = first[number]
    place = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    place += np.repeat((starts[stands] - starts).astype(place.dtype), lengths)
    differs = points.take(place, mode="clip") != points
    other = lengths[stands] != lengths
    if differs.any():
        other |= np.diff(np.concatenate(([0], np.cumsum(differs)))[np.append(starts, n)]) > 0
    alone = np.flatnonzero(other)
    if len(alone):
        number = number.copy()
        number[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate((first, alone))
    return first, number


def code_points(part: W.Slice) -> tuple[str, np.ndarray, np.ndarray]:
    """(text, its code points, where each text starts and the last one ends) of a slice."""
    whole = part.data.tobytes().decode("utf-8")
    before = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
    return whole, np.frombuffer(whole.encode("utf-32-le"), np.uint32), before[part.offsets]
