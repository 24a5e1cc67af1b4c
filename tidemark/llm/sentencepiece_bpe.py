"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking.

A piece sequence is what merging would give exactly when each piece merges to itself and each adjacent pair, merged
again from characters, falls into that same pair.  So a unit is covered from the left with the longest piece the
Aho-Corasick automaton finds at a position; a piece that doesn't go with its neighbour, or that ends where covering
has failed before (a bit per position), gives way to its next shorter prefix, and then the position before it to its
own.  Units end where no piece can reach over: between characters that are neighbours in no piece.  Pieces that
share a score break the rule that scores order merges, so units that hold one are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Fixed values of the model file: piece types, and the model type of BPE.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED, BPE = 1, 2, 3, 4, 6, 5, 2
_CODECS: dict[str, Codec] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + n])[0]
            at += n


class Codec:
    """A model file.  Models that normalise, hold user-defined or unused pieces or put the space last are refused."""

    def __init__(self, path: str, limit: int = 250_000):
        import ahocorasick

        pieces, self.limit, self.prefix = [], limit, True
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for k, v in _fields(open(path, "rb").read()):
            if k == 1:
                f = dict(_fields(v))
                pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
        # field numbers: trainer 3 model_type, 24 treat_whitespace_as_suffix; normaliser 2 charsmap, 3 dummy prefix, 4 extra spaces
        kinds = {t for _, _, t in pieces}
        if trainer.get(3) != BPE or trainer.get(24) or normal.get(2) or normal.get(4, 1) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only plain merge-type models without normalisation are supported")
        self.prefix = bool(normal.get(3, 1))
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        self.known = {c for p in self.ids for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece reaches over a space")
        merged = {p: s for p, s in self.score.items() if len(p) > 1}
        shared = {s for s, n in Counter(merged.values()).items() if n > 1}
        self.tied = [p for p, s in merged.items() if s in shared]
        self.tie = re.compile("|".join(map(re.escape, sorted(self.tied, key=len)))) if self.tied else None
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.names = [str(i) for i in range(len(pieces))]
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.automaton = ahocorasick.Automaton()
        for p in {*self.ids, *self.known}:
            if len(p) == 1 or (p not in self.tied and self.merge(p) == [p]):
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, str, str | None]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Merging as such: always the best score, the leftmost first."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        score, heap = self.score, []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part):
                joined = part[i] + part[j]
                if joined in score:
                    heapq.heappush(heap, (-score[joined], i, j, joined))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if part[i] and part[j] and after[i] == j and part[i] + part[j] == joined:
                part[i], part[j] = joined, ""
                after[i] = after[j]
                if after[i] < len(part):
                    before[after[i]] = i
                offer(before[i], i)
                offer(i, after[i])
        return [p for p in part if p]

    def _goes(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            got = self.pairs[a, b] = a + b not in self.score and self.merge(a + b) == [a, b]
        return got

    def _next(self, piece: str) -> str | None:
        """The longest shorter piece that begins ``piece``."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.automaton), None)
        return self.shorter[piece]

    def cover(self, text: str) -> list[str]:
        """Pieces of a text of known characters."""
        if self.tie and self.tie.search(text):
            return self.merge(text)
        n = len(text)
        longest: list[str] = [""] * n
        for end, (p, k) in self.automaton.iter(text):  # ends rise, so the last found at a start is the longest
            longest[end - k + 1] = p
        open_ = (1 << n + 1) - 1  # a bit per position: covering can still succeed from here
        out: list[str] = []
        at, piece = 0, longest[0]
        while at < n:
            end = at + len(piece)
            if open_ >> end & 1 and (not out or self._goes(out[-1], piece)):
                out.append(piece)
                at = end
                piece = longest[at] if at < n else ""
                continue
            less = self._next(piece)
            while less is None:
                open_ &= ~(1 << at)
                last = out.pop()
                at -= len(last)
                less = self._next(last)
            piece = less
        return out

    def _part_ids(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.cover(part) if part[0] in self.known else [part]:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        if len(self.parts) > self.limit:
            self.parts.clear()
        self.parts[part] = got = tuple(out)
        return got

    def unit_ids(self, unit: str) -> list[int]:
        """ids of a unit, cut further where two neighbouring characters are together in no piece."""
        joints, at, out = self.joints, 0, []
        for i in [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in joints] + [len(unit)]:
            part = unit[at:i]
            got = self.parts.get(part)
            out += self._part_ids(part) if got is None else got
            at = i
        return out

    def units(self, text: str) -> list[str]:
        text = text.replace(" ", SPACE)
        return self.unit.findall(SPACE + text if self.prefix and text else text)

    def encode(self, text: str | None) -> list[int]:
        """ids of a text; a null is empty."""
        return [i for u in self.units(text or "") for i in self.unit_ids(u)]

    def _surface(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes that are no UTF-8 become U+FFFD, and the prefixed space goes."""
        text = self._surface(ids).decode("utf-8", "replace")
        return text[1:] if self.prefix and ids and self.pieces[ids[0]][0].startswith(SPACE) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text), each distinct word worked out once.

        Each distinct unit's ids are decoded when they are made.  Where they give the unit itself, which is remembered
        with them, the decoded text takes the unit's own characters; elsewhere what the ids decode to.
        """
        text = (text or "").replace(SPACE, " ")
        if not text:
            got = []
        else:
            words = text.split(" ")
            keys = words if self.prefix and "" not in words and "\0" not in text else self.units(text)
            if keys is not words:
                keys = [k[1:] if k[0] == SPACE and k[1:2] not in ("", SPACE, "\0") else "\0" + k for k in keys]
            cache = self.cache
            got = list(map(cache.get, keys))
            if None in got:
                if len(cache) > 2 * self.limit:
                    cache.clear()
                for i, g in enumerate(got):
                    if g is None:
                        k = keys[i]
                        g = cache.get(k)
                        if g is None:
                            unit = k[1:] if k[0] == "\0" else SPACE + k
                            ids = self.unit_ids(unit)
                            back, same = self._surface(ids).decode("utf-8", "replace"), unit.replace(SPACE, " ")
                            # None: the ids decode to the very unit, which then needs no copy
                            g = cache[k] = len(ids), ",".join([self.names[x] for x in ids]), None if back == same else back
                        got[i] = g
        if any([g[2] is not None for g in got]):
            own = [" " + k for k in words] if keys is words else [u.replace(SPACE, " ") for u in self.units(text)]
            decoded = "".join([u if g[2] is None else g[2] for g, u in zip(got, own)])
        else:
            decoded = " " + text if self.prefix else text
        decoded = decoded[1:] if self.prefix and decoded[:1] == " " else decoded
        return sum([g[0] for g in got]), hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with the column ``ids``; a null text has none, as an empty one.  A column ``ids`` is replaced."""
    ids = F.pandas_udf(lambda s: s.map(lambda t: codec(model).encode(t)), "array<int>")
    return docs.withColumn("ids", ids(F.col(text)))


def decode(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``decoded``; null ids give an empty text.  A column ``decoded`` is replaced."""
    back = F.pandas_udf(lambda s: s.map(lambda x: codec(model).decode([] if x is None else list(x))), "string")
    return docs.withColumn("decoded", back(F.col(ids)))


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; a null text is empty; empty table, no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            made = [own.digest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
