"""SentencePiece encoding and decoding of merge-type models by a table of prefixes.

For every prefix of a text, the last token of the prefix's encoding is unique. So one pass over the text fills a
table: an automaton reports all pieces that end at a position, and of them exactly one is compatible with the last token of the prefix
before it. Two tokens are compatible if merging their joint text alone gives just these two. The ids are then
recovered backwards, from the last token of the whole text.

Texts are first cut where no merge can ever cross, that is between characters that stand side by side in no piece of the
vocabulary. The tables of all distinct stretches of a slice are filled together, position by position, with numpy; what is
known of stretches and of pairs is remembered per worker, in bounded tables.

Encoding adds no begin or end ids. Characters outside the vocabulary become byte tokens. Null and empty texts have no ids and
decode to the empty text. Byte tokens that are no valid UTF-8 decode to U+FFFD, one for each such byte.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from echoloom.llm import words as W
from echoloom.llm.common import annotated
from echoloom.llm.distinct import PieceIds, code_points

BLANK = "▁"
#: Bytes of distinct stretches, and pairs of tokens, that a worker remembers.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 32 << 20, 250_000
_NORMAL, _CONTROL, _BYTE = 1, 3, 6


def merged(text: str, rank: dict[str, float]) -> list[str]:
    """What merging gives: of all neighbours that join to a piece, the best score first, then the leftmost."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = rank.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def load_model(path: str) -> dict:
    """What the tasks need of a model file; read once, by the driver."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        content = file.read()
    proto.ParseFromString(content)
    spec, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if kind != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only merge-type models with byte fallback and without a normalisation table are supported")
    names = [p.piece for p in proto.pieces]
    kinds = [p.type for p in proto.pieces]
    if set(kinds) - {_NORMAL, 2, _CONTROL, _BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    return {"key": zlib.crc32(content), "names": names, "scores": [p.score for p in proto.pieces], "kinds": kinds, "prefix": spec.add_dummy_prefix}


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        import ahocorasick

        self.names, self.prefix = model["names"], model["prefix"]
        normal = [i for i, kind in enumerate(model["kinds"]) if kind == _NORMAL]
        self.id_of = {self.names[i]: i for i in normal}
        self.rank = {self.names[i]: model["scores"][i] for i in normal}
        self.bytes = [i for i, kind in enumerate(model["kinds"]) if kind == _BYTE]
        self.size = np.array([len(name) for name in self.names], np.int64)
        letters = {c for name in self.rank for c in name}
        self.gap = next(chr(i) for i in range(1, 0x110000) if chr(i) not in letters)
        self.automaton = ahocorasick.Automaton()
        for name, i in self.id_of.items():
            # A piece that merging never makes of its own text never occurs.
            if len(name) == 1 or merged(name, self.rank) == [name]:
                self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self._bonds(letters)
        self.pairs: dict[int, bool] = {}
        self.pieces = PieceIds(self._encode_many, REMEMBERED_BYTES)
        first = self.bytes[0] if self.bytes else 0
        self.shown = [name.replace(BLANK, " ") if kind == _NORMAL else " ⁇ " if kind == 2 else "" for name, kind in zip(self.names, model["kinds"], strict=True)]
        for i in self.bytes:
            self.shown[i] = chr(i - first) if i - first < 128 else ""
        self.high = np.zeros(len(self.names), bool)
        self.high[self.bytes[128:]] = True
        self.silent = [kind == _CONTROL for kind in model["kinds"]]
        self.byte_value = {i: i - first for i in self.bytes}

    def _bonds(self, letters: set[str]) -> None:
        """Which characters stand side by side in some piece, as a bit table over numbered characters."""
        self.number = np.zeros(0x110000, np.int64)
        for i, c in enumerate(sorted(c for c in letters if c in self.id_of), start=1):
            self.number[ord(c)] = i
        n = int(self.number.max()) + 1
        self.width = n
        bond = np.zeros(n * n, bool)
        for name in self.rank:
            for a, b in zip(name, name[1:], strict=False):
                bond[self.number[ord(a)] * n + self.number[ord(b)]] = True
        bond.reshape(n, n)[0, :] = bond.reshape(n, n)[:, 0] = False
        self.bond = np.packbits(bond)

    def _fits(self, pair: int) -> bool:
        left, right = self.names[pair // len(self.names)], self.names[pair % len(self.names)]
        return merged(left + right, self.rank) == [left, right]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, number = np.unique(left * len(self.names) + right, return_inverse=True)
        known = self.pairs
        if len(known) > REMEMBERED_PAIRS:
            known.clear()
        answers = []
        for pair in pairs.tolist():
            answer = known.get(pair)
            if answer is None:
                answer = known[pair] = self._fits(pair)
            answers.append(answer)
        return np.array(answers, bool)[number]

    def _encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of stretches: each is one character outside the vocabulary, or all its characters are inside."""
        out: list[list[int]] = [[] for _ in texts]
        known = []
        for i, text in enumerate(texts):
            if text[0] in self.id_of:
                known.append(i)
            else:
                out[i] = [self.bytes[b] for b in text.encode("utf-8")]
        if not known:
            return out
        joined = self.gap.join(texts[i] for i in known)
        lengths = np.array([len(texts[i]) for i in known], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, token = found[:, 0], found[:, 1]
        start = end - self.size[token] + 1
        owner = np.searchsorted(begin, end, "right") - 1
        place = end - begin[owner]
        order = np.argsort(place, kind="stable")
        end, token, start, first = end[order], token[order], start[order], (start == begin[owner])[order]
        last = np.full(len(joined), -1, np.int64)
        bounds = np.searchsorted(place[order], np.arange(int(lengths.max()) + 1))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            fits = first[low:high].copy()
            inner = low + np.flatnonzero(~fits)
            if len(inner):
                fits[inner - low] = self._compatible(last[start[inner] - 1], token[inner])
            chosen = low + np.flatnonzero(fits)
            last[end[chosen]] = token[chosen]
        at, unit = begin + lengths - 1, np.arange(len(known))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            made = last[at]
            steps.append((unit, made))
            at = at - self.size[made]
            more = at >= begin[unit]
            at, unit = at[more], unit[more]
        for unit, made in reversed(steps):
            for u, t in zip(unit.tolist(), made.tolist(), strict=True):
                out[known[u]].append(t)
        return out

    def encode(self, part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, number of ids of each)."""
        whole, points, rows = code_points(part)
        whole = whole.replace(" ", BLANK)
        points = np.where(points == 32, ord(BLANK), points).astype(np.uint32)
        if self.prefix:
            lengths = np.diff(rows)
            full = (lengths > 0).astype(np.int64)
            whole = "".join(BLANK + whole[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True) if b > a)
            rows = np.concatenate(([0], np.cumsum(lengths + full)))
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        number = self.number[points]
        pair = number[:-1] * self.width + number[1:]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = (self.bond[pair >> 3] >> (7 - (pair & 7)).astype(np.uint8) & 1) == 0
        cut[rows] = True
        return self.pieces.of(whole, points, np.flatnonzero(cut[: len(points)]), rows)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids."""
        shown = self.shown
        if not self.high[ids].any():
            text = "".join([shown[i] for i in ids.tolist()])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids.tolist():
                value = self.byte_value.get(i)
                if value is None:
                    if run:
                        parts.append(_utf8(run))
                        run = bytearray()
                    parts.append(shown[i])
                else:
                    run.append(value)
            parts.append(_utf8(run))
            text = "".join(parts)
        # The blank put before the text is taken off its first token that shows anything.
        visible = next((i for i in ids.tolist() if not self.silent[i]), 0) if self.prefix else 0
        return text[1:] if self.names[visible].startswith(BLANK) else text


def _utf8(run: bytearray) -> str:
    """Bytes as text; every byte that is part of no valid character becomes U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + n]).decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            at += n
        return "".join(out)


_codecs: dict[int, Codec] = {}


def codec(model: dict) -> Codec:
    """One codec per worker and model."""
    if model["key"] not in _codecs:
        _codecs[model["key"]] = Codec(model)
    return _codecs[model["key"]]


def _id_lists(counts: list[np.ndarray], ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, model_path: str, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns ``carry``, default all) with ``ids`` and ``decoded``, the text that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def work(texts: pa.Array) -> list[pa.Array]:
        made = codec(shared.value)
        all_ids, all_counts, decoded = [], [], []
        for part in W.slices(texts):
            ids, counts = made.encode(part)
            ends = np.cumsum(counts)
            all_ids.append(ids)
            all_counts.append(counts)
            decoded += [made.decode(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        return [_id_lists(all_counts, all_ids), pa.array(decoded, pa.string())]

    return annotated(docs, work, "ids array<int>, decoded string", carry)
