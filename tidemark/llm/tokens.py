"""Word-cached encoding with public tokenizers: each distinct word of a task is encoded once."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordTable:
    """ids of words as one flat array; forgets everything beyond ``limit`` words (that costs time, never results)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], end: list[int], limit: int = 500_000):
        self.encode_words, self.end, self.limit = encode, end, limit
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {b"": 0}  # the end of a text; no word is empty
        self.names = [b""]
        self.flat = np.zeros(1 << 16, np.int32)
        self.flat[: len(self.end)] = self.end
        self.first = np.zeros(1 << 16, np.int64)
        self.first[1] = len(self.end)

    def _learn(self, words: list[bytes]) -> None:
        words = list(dict.fromkeys(words))
        ids, size = self.encode_words(words)
        n, at = len(self.index), int(self.first[len(self.index)])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[at : at + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(words)] = at + np.cumsum(size)
        self.index.update(zip(words, range(n, n + len(words))))
        self.names += words

    def lookup(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.limit:
            self.reset()
        get = self.index.get
        where = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(where < 0)
        if len(missing):
            self._learn([words[i] for i in missing.tolist()])
            where[missing] = [get(words[i]) for i in missing.tolist()]
        return where

    def encode(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, ids, ids of each word, words of each text), each text with its end.

        Words are split and told apart in Arrow, so Python sees each distinct word of a call once.
        """
        words, which, at = split_words(pa.array(texts, pa.large_binary()).cast(pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts, ""))
        where = np.insert(self.lookup(words.to_numpy(zero_copy_only=False).tolist())[which], at[1:], 0)
        return where, *laid_out(self.flat, self.first, where), np.diff(at) + 1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of the texts, where the words of each text begin and the last end)."""
    split = pc.ascii_split_whitespace(texts)
    words = pc.dictionary_encode(split.flatten().cast(pa.large_binary()))
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy().astype(np.int64))))
    which, kinds = words.indices.to_numpy(), words.dictionary
    none = pc.index(kinds, pa.scalar(b"", kinds.type)).as_py()
    if none >= 0:  # white space at either end of a text leaves an empty string, which is no word
        real = which != none
        at = np.concatenate(([0], np.cumsum(real)))[at]
        which = which[real]
        which = which - (which > none)
        kinds = pa.concat_arrays([kinds[:none], kinds[none + 1 :]])
    return kinds, which, at


def laid_out(flat: np.ndarray, first: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words ``where``, one after another, how many each has); those of word k are flat[first[k] : first[k + 1]]."""
    start = first[where]
    n = first[where + 1] - start
    # one step of 1 inside a word, a jump to the next word's ids between words; some words have no ids
    start, size = (start, n) if n.all() else (start[n > 0], n[n > 0])
    stop = np.cumsum(size)
    step = np.ones(stop[-1] if len(stop) else 0, first.dtype)
    step[:1] = start[:1]
    step[stop[:-1]] += start[1:] - start[:-1] - size[:-1]
    return flat[np.cumsum(step)], n


def slices(texts: list[str | None], size: int = 1 << 20):
    """Runs [i, j) of texts of about ``size`` characters; a longer text is a run of its own."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        n = len(t or "") + 1
        if j > i and held + n > size:
            yield i, j
            i, held = j, 0
        held += n
    if i < len(texts):
        yield i, len(texts)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """Byte-pair merges of many short strings at once: in each round every string merges its leftmost pair of lowest rank."""

    LAST = np.int64(1 << 40)

    def __init__(self, pairs: list[tuple[int, int, int]], size: int):
        """(left, right, merged) ids in order of rank, of ``size`` ids."""
        self.size, bits = size, max(4, int(np.ceil(np.log2(max(1, len(pairs))))) + 2)
        self.down, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        left, right, to = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        keys = left * size + right
        self.keys, self.rank, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.LAST), np.zeros(1 << bits, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # open addressing: of those that want a free slot the last gets it, the others try the next
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            own = self.keys[at] == keys[todo]
            self.rank[at[own]], self.to[at[own]] = todo[own], to[todo[own]]
            todo, at = todo[~own], at[~own] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.down).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; those that do not merge have the rank LAST."""
        keys = left * self.size + right
        at = self._slot(keys)
        found = self.keys[at]
        odd = np.flatnonzero((found != keys) & (found != -1))
        while len(odd):
            at[odd] = at[odd] + 1 & self.mask
            found = self.keys[at[odd]]
            odd = odd[(found != keys[odd]) & (found != -1)]
        return self.rank[at], self.to[at]

    def __call__(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids after all merges, how many each string has) of strings of ``size`` ids each, none empty."""
        owner, x = np.repeat(np.arange(len(size)), size), ids.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, to = np.full(len(x), self.LAST), np.zeros(len(x), np.int64)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        rank[at], to[at] = self.pairs(x[at], x[at + 1])
        while len(x):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            length = np.diff(first, append=len(x))
            least = np.minimum.reduceat(rank, first)
            live = least < self.LAST
            if not live.all():
                stay = np.repeat(live, length)
                done.append((owner[~stay], x[~stay]))
                x, owner, rank, to, least, length = x[stay], owner[stay], rank[stay], to[stay], least[live], length[live]
                if not len(x):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            hit = hit[np.diff(owner[hit], prepend=-1) != 0]
            x[hit] = to[hit]
            keep = np.ones(len(x), bool)
            keep[hit + 1] = False
            x, owner, rank, to = x[keep], owner[keep], rank[keep], to[keep]
            hit -= np.arange(len(hit))
            rank[hit] = self.LAST
            near = np.concatenate([hit[hit > 0] - 1, hit[hit < len(x) - 1]])
            near = near[owner[near] == owner[near + 1]]
            rank[near], to[near] = self.pairs(x[near], x[near + 1])
        owner, x = (np.concatenate(c) for c in zip(*done)) if done else (owner, x)
        return x[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(size))


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of ASCII bytes (1 letter, 2 digit, 3 mark, 0 none of these) and of the byte after C3 (1 letter)."""
    own, after = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for b in range(33, 127):
        own[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 0 if chr(b) == "'" else 3
    for b in range(0x80, 0xC0):
        after[b] = chr(0x40 + b).isalpha()
    return own, after


class WordBpe:
    """ids of white-space separated words under a lower-casing, white-space dropping BPE of the tokenizers library.

    Words of Latin-1 letters, digits and ASCII marks are cut into runs of letters, runs of marks and single digits, as
    the library cuts them, and merged all at once; every other or longer word goes through the library's encoder.
    """

    LONGEST = 48

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, model = Tokenizer.from_file(path), json.load(open(path))["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], len(vocab))
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab[letters[b] + e] for b in range(256)]) for e in ("", end))
        self.own, self.after = _byte_classes()

    def spread(self, data: np.ndarray, at: np.ndarray) -> pa.Array:
        """Texts (bytes and offsets) of the same ids with fewer different words: A-Z lowered, spaces between letters or
        digits and marks.  What stands before a byte beyond ASCII, which may combine with it, stays, and so do texts
        near a special token.
        """
        part, at = data[at[0] : at[-1]], at - at[0]
        n = len(part)
        if n and not (part[:-1][part[1:] == ord("|")] == ord("<")).any():
            kind = self.own[part]
            plain = np.append(part[1:] < 0x80, True)
            part = part + ((part >= 65) & (part <= 90) & plain).view(np.uint8) * np.uint8(32)
            c3 = np.flatnonzero(part[:-1] == 0xC3)
            kind[c3[self.after[part[c3 + 1]] == 1] + 1] = 1
            mark = kind == 3
            gap = np.flatnonzero((kind[1:] != 0) & (kind[:-1] != 0) & (mark[1:] != mark[:-1]) & plain[1:]) + 1
            part = np.insert(part, gap, 32)
            at = at + np.searchsorted(gap, at)  # a space at a text's border is no word
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(part)))

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of ``words``; -1 for the size of those that only the library knows to cut."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, word = np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), size)
        kind = self.own[data]
        c3 = np.flatnonzero((data[:-1] == 0xC3) & (word[:-1] == word[1:]))
        letter = c3[self.after[data[c3 + 1]] == 1]
        kind[letter] = kind[letter + 1] = 1
        odd = np.bincount(word[kind == 0], minlength=len(words)) > 0
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        odd[word[special]] = True
        odd |= size > self.LONGEST
        keep = ~odd[word]
        data, word, kind, two = data[keep], word[keep], kind[keep], np.zeros(len(data), bool)
        two[letter + 1] = True
        two = two[keep]
        if not len(data):
            return np.zeros(0, np.int32), np.where(odd, -1, 0)
        # A-Z and the capitals after C3 are 32 below their small letters
        capital = (data >= 65) & (data <= 90) & (kind == 1) | two & (data >= 0x80) & (data <= 0x9E)
        data = data + (capital * 32).astype(np.uint8)
        begins = np.ones(len(data), bool)
        begins[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        ends = np.append(begins[1:], True)
        first = np.flatnonzero(begins)
        ids, n = self.merges(np.where(ends, self.last[data], self.inner[data]), np.diff(first, append=len(data)))
        return ids, np.where(odd, -1, np.bincount(word[first], weights=n, minlength=len(words)).astype(np.int64))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        ids, n = self._plain(words)
        odd = np.flatnonzero(n < 0)
        if not len(odd):
            return ids, n
        text = self.whole.encode_batch_fast([words[i].decode("utf-8", "replace") for i in odd.tolist()], add_special_tokens=False)
        each = [np.array(e.ids, np.int32) for e in text]
        n[odd] = 0
        at = np.repeat((np.cumsum(n) - n)[odd], [len(e) for e in each])
        n[odd] = [len(e) for e in each]
        return np.insert(ids, at, np.concatenate(each)), n
