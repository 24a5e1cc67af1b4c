"""A causal self-attention language model in numpy on subword ids, and a smoothed unigram base.

The model.  A text is its words and an end, spelled in subword ids of a public byte-level tokenizer (a word with the
space before it), so ids determine words.  At each position one head attends, with a bias per distance, to the
positions of its window up to itself; the state chooses among ``MIX`` distributions over ids, so a probability over
the whole vocabulary costs MIX products.  Ids beyond the most frequent share one class, inside which they have their
smoothed corpus frequency.  Probabilities are proper over id sequences.

Windows hold 2 * STRIDE positions and overlap by STRIDE: every position is scored once, as a query of the second half
of its window, with at least STRIDE positions before it where the text has them.  Texts are spelled once; counting,
learning and scoring read their ids.

The probability of a word is the attention's, interpolated with the corpus: a word seen c times in N training tokens
has (1 - SHARE) c / N + SHARE * attention(word | what precedes).

Learning.  Counts of words and ids cover all training texts.  The weights start on a bounded sample
(pieces of about ``start_texts`` rows drawn by hash, read again until ``start_positions`` are trained), then every
position of every training text takes part: each lane trains from the common weights on all windows of its texts, and
the weights are averaged by trained positions, in two levels.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _LOWER, chunks, fan_in, materialise, mix, powers, utf8
from tidemark.llm.language import fold
from tidemark.llm.tokens import WordTable, laid_out, split_words

STRIDE, KEY, STATE, MIX, TOP = 8, 8, 16, 16, 2047
SHARE = 0.8
#: Windows that a step works on at once: what they need stays in a core's cache.
BLOCK = 512
_TABLES: dict[str, WordTable] = {}


class Subwords:
    """ids of words, each with the space before it, by the ranks of a byte-level BPE."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.size = max(ranks.values()) + 2  # the last is the end
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        self.starts = np.zeros(self.size, bool)
        self.starts[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def __call__(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); a space begins each word's first id and no other."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
        data, at = utf8(words)
        text = np.insert(data[at[0] : at[-1]], at[:-1] - at[0], 32).tobytes().decode("utf-8", "replace")
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        first = np.flatnonzero(self.starts[ids])
        if len(first) == len(words):
            return ids, np.diff(first, append=len(ids))
        # a word with unusual space in it
        each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words.to_pylist()]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each])


def _table(path: str, pattern: str) -> WordTable:
    if path not in _TABLES:
        sub = Subwords(path, pattern)
        _TABLES[path] = WordTable(sub, [sub.size - 1], 250_000)
    return _TABLES[path]


# ---------------------------------------------------------------- the model

class Attention:
    """Weights and the forward and backward passes.  Local ids: 0..n-1 the frequent ids, n all others.

    ``e`` holds a row per local id: its query, key, value and own state beside each other, so a position is gathered
    once.  ``r`` is the bias per distance, ``w`` and ``b`` make the state choose, ``g`` are the distributions.
    """

    NAMES = ("e", "r", "w", "b", "g")

    def __init__(self, counts: np.ndarray, seed: int = 7):
        """``counts`` of all ids in the training texts."""
        rng = np.random.default_rng(seed)
        top = np.argsort(-counts, kind="stable")[: min(TOP, len(counts) - 1)]
        n = len(top) + 1
        self.local = np.full(len(counts), n - 1, np.int32)
        self.local[top] = np.arange(n - 1)
        smooth = counts + 0.5
        rest = np.ones(len(counts), bool)
        rest[top] = False
        self.inner = np.where(rest, np.log(smooth / smooth[rest].sum()), 0.0).astype(np.float32)
        mass = np.append(smooth[top], smooth[rest].sum())
        draw = lambda *shape, s=0.1: rng.normal(0, s, shape).astype(np.float32)
        self.p = {
            "e": np.concatenate([draw(n, 2 * KEY), draw(n, 2 * STATE, s=0.3)], 1), "r": np.zeros(2 * STRIDE, np.float32),
            "w": draw(STATE, MIX, s=0.3), "b": np.zeros(MIX, np.float32), "g": np.log(mass / mass.sum()).astype(np.float32)[:, None] + draw(n, MIX, s=0.5),
        }
        i, j = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None]
        self.distance, self.causal = np.clip(i - j, 0, 2 * STRIDE - 1), i >= j
        self.step, self.m1, self.m2 = 0, {}, {}

    def layout(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(local ids, text of each, place of each given id): each text begins on the grid of windows.

        So no window holds two texts, and no text's score hangs on those beside it.  A stride of nothing stands before
        the first window and an id behind the last.
        """
        first = np.flatnonzero(np.diff(text, prepend=-1))
        size = np.diff(first, append=len(text))
        room = -(-size // STRIDE) * STRIDE
        place = STRIDE + np.arange(len(text)) + np.repeat(np.cumsum(room) - room - first, size)
        x, owner = np.zeros(STRIDE + int(room.sum()) + 1, np.intp), np.full(STRIDE + int(room.sum()) + 1, -1, np.int64)
        owner[:STRIDE] = -2
        x[place], owner[place] = self.local[ids], text
        return x, owner, place

    def chances(self) -> np.ndarray:
        """Probability of each local id (row) in each distribution (column)."""
        g = np.exp(self.p["g"] - self.p["g"].max(0))
        return g / g.sum(0)

    def clipped(self) -> tuple[bool, bool]:
        """Whether exponents of the attention and of the choice need clipping: not where the weights bound them."""
        p, size = self.p, lambda w: float(np.sqrt((w * w).sum(1).max()))
        far = size(p["e"][:, :KEY]) * size(p["e"][:, KEY : 2 * KEY]) + float(np.abs(p["r"]).max()) > 40
        return far, float((np.abs(p["w"]).sum(0) + np.abs(p["b"])).max()) > 60

    def ready(self, windows: int) -> tuple:
        """What all blocks of up to ``windows`` windows read of the weights: queries (scaled), keys, values and own states
        by id, the bias of each key (row) for each position (column), and what needs clipping."""
        e = self.p["e"]
        query, key, value, own = (np.ascontiguousarray(c) for c in np.split(e, [KEY, 2 * KEY, 2 * KEY + STATE], 1))
        query *= e.dtype.type(KEY**-0.5)
        return query, key, value, own, np.tile(np.where(self.causal, self.p["r"][self.distance], e.dtype.type(-1e9)).T, (1, windows)), self.clipped()

    @staticmethod
    def _columns(rows: int, m: int, dtype: np.dtype) -> np.ndarray:
        """A column per position; rows lie at no power of two, at which they would push each other out of the cache."""
        return np.empty((rows, m + 16), dtype)[:, :m]

    @staticmethod
    def _by_window(columns: np.ndarray) -> np.ndarray:
        """A view of columns of positions as one matrix a window."""
        return columns.reshape(len(columns), -1, STRIDE).transpose(1, 0, 2)

    def forward(self, x: np.ndarray, owner: np.ndarray, i: int, m: int, chance: np.ndarray, ready: tuple | None = None) -> tuple:
        """Of the ``m`` positions from ``i`` of a layout: (queries, keys and values by window, attention with a column per
        position, state, choice times its sum, that sum, choice times its sum and chance of the next id, probability of the
        next id)."""
        p = self.p
        query, key, value, own, bias, clip = ready or self.ready(m // STRIDE)
        at, dtype = x[i + STRIDE : i + STRIDE + m], bias.dtype
        window = np.ndarray((m // STRIDE, 2 * STRIDE), x.dtype, x, i * x.itemsize, (STRIDE * x.itemsize, x.itemsize))
        q, k, v = query.take(at, 0), key.take(window, 0), value.take(window, 0)
        turned, a = self._columns(KEY, m, dtype), self._columns(2 * STRIDE, m, dtype)
        turned[:] = q.T
        np.matmul(k, self._by_window(turned), out=self._by_window(a))
        a += bias[:, :m]
        if clip[0]:
            np.minimum(a, 40, out=a)
        np.exp(a, out=a)
        begins = owner[i + STRIDE : i + STRIDE + m : STRIDE] != owner[i : i + m : STRIDE]
        a.reshape(2 * STRIDE, -1, STRIDE)[:STRIDE, np.flatnonzero(begins)] = 0
        a *= 1 / a.sum(0)
        z = (self._by_window(a).transpose(0, 2, 1) @ v).reshape(m, STATE)
        z += own.take(at, 0)
        np.tanh(z, out=z)
        mix = z @ p["w"]
        mix += p["b"]
        if clip[1]:
            np.minimum(mix, 60, out=mix)
        np.exp(mix, out=mix)
        each, ones = chance.take(x[i + STRIDE + 1 : i + STRIDE + 1 + m], 0), np.ones(MIX, dtype)
        each *= mix
        whole = mix @ ones
        return (q, k, v), a, z, mix, whole, each, (each @ ones) / whole

    def log10(self, ids: np.ndarray, text: np.ndarray, chance: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """log10 probability of the id after each position; 0 where a text ends."""
        x, owner, place = self.layout(ids, text)
        n = len(x) - STRIDE - 1
        ready = self.ready(min(block, n // STRIDE))
        prob = np.concatenate([np.zeros(STRIDE, np.float32), *(self.forward(x, owner, i, min(block * STRIDE, n - i), chance, ready)[-1] for i in range(0, n, block * STRIDE))])
        out = np.log(np.maximum(prob[place], 1e-30)).astype(np.float64)
        out[:-1] += self.inner[ids[1:]]
        out[:-1] *= text[1:] == text[:-1]
        out[-1:] = 0
        return out / np.log(10)

    @staticmethod
    def _add(sums: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        """Adds each row to the sums of its id; two columns at a time, as one complex number."""
        for out, column in zip(sums, np.ascontiguousarray(rows.view(sums.dtype).T)):
            np.add.at(out, at, column)

    def learn(self, x: np.ndarray, owner: np.ndarray, i: int, m: int, rate: float, block: int = BLOCK) -> tuple[float, int]:
        """One Adam step on the ``m`` positions from ``i`` of a layout: (the mean loss in nats, positions foretold).

        Gradients add up over blocks of windows, which a core's cache holds; they are of the weights before the step.
        """
        p, chance, ready, n_rows, dtype = self.p, self.chances(), self.ready(min(block, m // STRIDE)), len(self.p["e"]), self.p["e"].dtype
        own = owner[i + STRIDE : i + STRIDE + m + 1]
        counted = (own[1:] == own[:-1]) & (own[:-1] >= 0)
        seen, loss = int(counted.sum()), 0.0
        weights, w_turned = (counted / np.float32(max(1, seen))).astype(np.float32), np.ascontiguousarray(p["w"].T)
        grad, by_place = {k: np.zeros_like(p[k]) for k in ("w", "b")}, np.zeros((2 * STRIDE, STRIDE), dtype)
        pair = np.result_type(dtype, np.complex64)
        # sums by id: of queries, of keys and values, of own states, of chances
        d_q, d_read, d_h, d_g = np.zeros((KEY // 2, n_rows), pair), np.zeros(((KEY + STATE) // 2, n_rows), pair), np.zeros((STATE, n_rows), dtype), np.zeros((MIX // 2, n_rows), pair)
        places = np.tile(np.eye(STRIDE, dtype=dtype), (min(block, m // STRIDE), 1))
        for at in range(0, m, block * STRIDE):
            n = min(block * STRIDE, m - at)
            (q, k, v), a, z, mix, whole, each, prob = self.forward(x, owner, i + at, n, chance, ready)
            weight, ones, prob, here = weights[at : at + n], np.ones(n, dtype), np.maximum(prob, 1e-30), x[i + STRIDE + at : i + STRIDE + at + n]
            loss -= float((np.log(prob) * counted[at : at + n]).sum())
            each *= (weight / (prob * whole))[:, None]
            self._add(d_g, x[i + STRIDE + 1 + at : i + STRIDE + 1 + at + n], each)
            mix *= (weight / whole)[:, None]
            mix -= each
            grad["w"] += z.T @ mix
            grad["b"] += ones @ mix
            d_state = mix @ w_turned
            z *= z
            np.subtract(1, z, out=z)
            d_state *= z
            turned, d_a = self._columns(STATE, n, dtype), self._columns(2 * STRIDE, n, dtype)
            turned[:] = d_state.T
            for out, column in zip(d_h, turned):
                np.add.at(out, here, column)
            np.matmul(v, self._by_window(turned), out=self._by_window(d_a))
            d_a *= a
            d_a -= a * d_a.sum(0)
            by_place += d_a @ places[:n]
            d_a = self._by_window(d_a)
            self._add(d_q, here, (d_a.transpose(0, 2, 1) @ k).reshape(n, KEY))
            d, read = np.empty((n // STRIDE, 2 * STRIDE, KEY + STATE), dtype), np.zeros((n + STRIDE, KEY + STATE), dtype)
            np.matmul(d_a, q.reshape(-1, STRIDE, KEY), out=d[:, :, :KEY])
            np.matmul(self._by_window(a), d_state.reshape(-1, STRIDE, STATE), out=d[:, :, KEY:])
            read[:n] = d[:, :STRIDE].reshape(n, KEY + STATE)
            read[STRIDE:].reshape(-1, STRIDE, KEY + STATE)[:] += d[:, STRIDE:]
            self._add(d_read, x[i + at : i + at + n + STRIDE], read)
        q, read, g = (np.ascontiguousarray(d.T).view(dtype) for d in (d_q, d_read, d_g))
        q *= dtype.type(KEY**-0.5)
        grad |= {"e": np.concatenate([q, read, d_h.T], 1), "g": chance * g.sum(0) - g, "r": np.bincount(self.distance.T.ravel(), by_place.ravel(), 2 * STRIDE).astype(dtype)}
        self._adam(grad, rate)
        return loss / max(1, seen), seen

    def _adam(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        fix1, fix2 = 1 - 0.9**self.step, 1 - 0.99**self.step
        for name, g in grad.items():
            if name not in self.m1:
                self.m1[name], self.m2[name] = np.zeros_like(g), np.zeros_like(g)
            m1, m2 = self.m1[name], self.m2[name]
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            g *= g
            g *= 0.01
            m2 += g
            np.sqrt(m2, out=g)
            g *= fix2**-0.5
            g += 1e-8
            np.divide(m1, g, out=g)
            g *= -rate / fix1
            self.p[name] = self.p[name] + g

    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n


# ---------------------------------------------------------------- texts as ids

class Spelling:
    """What ids alone tell: where words begin, and a 64-bit number of each word (ids determine words)."""

    def __init__(self, path: str, pattern: str):
        sub = Subwords(path, pattern)
        if sub.size > 1 << 16:
            raise ValueError("ids of more than two bytes")
        self.size, self.end, self.starts = sub.size, sub.size - 1, sub.starts.copy()
        self.starts[self.end] = True
        self.number = mix(np.arange(1, sub.size + 1, dtype=np.uint64))

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first position, number) of each word; the end of a text is a word."""
        first = np.flatnonzero(self.starts[ids])
        size = np.diff(first, append=len(ids))
        if not len(first):
            return first, np.zeros(0, np.int64)
        place = np.arange(len(ids)) - np.repeat(first, size)
        values = self.number[ids] * powers(int(size.max()))[place]
        return first, mix(np.add.reduceat(values, first) + size.astype(np.uint64)).view(np.int64)


_SPELLING: dict[str, Spelling] = {}


def _spelling(path: str, pattern: str) -> Spelling:
    if path not in _SPELLING:
        _SPELLING[path] = Spelling(path, pattern)
    return _SPELLING[path]


def _spell(path: str, pattern: str, size: int = 1 << 24):
    """Spells runs of rows of about ``size`` bytes; of such a run each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path, pattern)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in chunks(at, size):
                offsets = np.ascontiguousarray(at[i : j + 1] - at[i])
                # lowered here: Arrow's own kernel gave other bytes for slices of long columns
                words, which, place = split_words(pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[at[i] : at[j]]])))
                ids, n = table.encode_words(words)
                flat, first = np.concatenate([table.end, ids]).astype("<u2"), np.concatenate([[0], np.cumsum(np.append(1, n))])
                for k, end in chunks(offsets):
                    here = place[k : end + 1] - place[k]
                    own, n = laid_out(flat, first, np.insert(which[place[k] : place[end]] + 1, here[1:], 0))
                    stop = np.cumsum(n)[np.cumsum(np.diff(here) + 1) - 1] * 2
                    spelled = pa.BinaryArray.from_buffers(pa.binary(), end - k, [None, pa.py_buffer(np.append(0, stop).astype(np.int32)), pa.py_buffer(own)])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i + k, end - k) for c in ("uid", "doc_id", "held_out")), spelled], names=["uid", "doc_id", "held_out", "ids"])

    return run


def spelled(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` (uid, doc_id, held_out, text) with ``ids`` (two bytes each, the end last) in place of the text, written
    to the shared folder: words are looked up once for all that follows."""
    return materialise(rows.mapInArrow(_spell(path, pattern), "uid long, doc_id long, held_out boolean, ids binary"), "ids")


def _ids_of(batch: pa.RecordBatch, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, ids, how many each has) of runs of rows of about ``size`` ids."""
    column = batch.column("ids").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, "<u2") if data is not None and data.size else np.zeros(0, np.uint16)
    for i, j in chunks(at, 2 * size):
        yield i, j, flat[at[i] // 2 : at[j] // 2].astype(np.int32), np.diff(at[i : j + 1]) // 2


def _after_ends(ids: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with an end before each text, text of each)."""
    return np.insert(ids, np.cumsum(size) - size, end), np.repeat(np.arange(len(size)), size + 1)


def _trainer(state: bytes, path: str, pattern: str, rate: float, least: int = 0, windows: int = 256):
    """Trains from ``state`` on every window of the texts of a task, again and again until ``least`` are trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end, seen = pickle.loads(state), _spelling(path, pattern).end, 0
        for batch in batches:
            while True:
                before = seen
                for _, _, ids, size in _ids_of(batch):
                    x, owner, _ = model.layout(*_after_ends(ids, size, end))
                    n = len(x) - STRIDE - 1
                    for i in range(0, n, windows * STRIDE):
                        # the rate falls as 1 / sqrt of the steps so far
                        seen += model.learn(x, owner, i, min(windows * STRIDE, n - i), rate / (1 + model.step / 200) ** 0.5)[1]
                if seen >= least or seen == before:
                    break
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["weights", "seen"])

    return run


def _average(table: pa.Table) -> pa.Table:
    """The weights' mean by trained positions, added in the order of the lanes."""
    table, total, n = table.sort_by("at"), 0.0, 0
    for w, s in zip(table.column("weights").to_pylist(), table.column("seen").to_pylist()):
        total, n = total + np.frombuffer(w, np.float32).astype(np.float64) * s, n + s
    return pa.table({"weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "seen": [n], "at": pa.array([table.column("at")[0].as_py()], pa.int32())})


# ---------------------------------------------------------------- corpus counts

def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted words, occurrences of each) of several such pairs."""
    words, n = (np.concatenate(c) for c in zip(*counts))
    order = np.argsort(words)
    words, n = words[order], n[order]
    first = np.flatnonzero(np.diff(words, prepend=words[:1] - 1))
    return words[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(texts: DataFrame, path: str, pattern: str, hold: int = 800_000) -> DataFrame:
    """(word, n) over all rows of ``texts`` (ids): the number of each word, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, held, more = _spelling(path, pattern), [], 0
        for batch in batches:
            for _, _, ids, _ in _ids_of(batch):
                held.append(np.unique(spelling.words(ids)[1], return_counts=True))
                more += len(held[-1][0])
                if more > hold:  # runs are added up once there are that many words in them, not each by itself
                    held = [_added(held)]
                    # the words found so far leave once they take most of the room
                    if len(held[0][0]) > hold // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["word", "n"])
                    more = sum(len(words) for words, _ in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(held)], names=["word", "n"])

    return texts.select("ids").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(texts: DataFrame, path: str, pattern: str) -> np.ndarray:
    """Occurrences of every id in ``texts`` (ids)."""
    size = _spelling(path, pattern).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, ids, _ in _ids_of(batch):
                total += np.bincount(ids, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"counts": pa.array([sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()).tobytes()], pa.binary())})

    part = texts.select("ids").mapInArrow(run, "counts binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(fan_in(texts.rdd.getNumPartitions()))))
    rows = part.groupBy("lane").applyInArrow(add, "counts binary").groupBy(F.lit("all")).applyInArrow(add, "counts binary").collect()
    return np.frombuffer(rows[0][0], np.int64) if rows else np.zeros(size, np.int64)


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted numbers, counts) of the most frequent words, ``most`` at most: those whose count is above a power of
    2 ** 0.25 beyond which there are no more than that."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):  # 256 steps at most
        left -= r["count"]
        if left < 0:
            break
        least = r.s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(step >= least).toArrow()
    words, n = got.column("word").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def start_pieces(texts: DataFrame, n: int, start_texts: int, size: int = 6_000) -> DataFrame:
    """About ``start_texts`` of the ``n`` rows (ids, h), all if there are no more, and a piece of ``size`` ids of each,
    in the order of their hash."""
    rows = texts.where(F.pmod("h", F.lit(n)) < start_texts) if n > start_texts else texts
    at = F.pmod(F.xxhash64("h"), F.greatest(F.octet_length("ids") / 2 - size, F.lit(0)).cast("long") + 1) * 2 + 1
    return rows.select("h", F.substring("ids", at.cast("int"), F.lit(2 * size)).alias("ids")).repartition(1).sortWithinPartitions("h", "ids").select("ids")


#: Texts of a lane, in which the pass over all texts trains one after another, and the most lanes there are.
LANE_TEXTS, LANES = 4_000, 65_536


def train(texts: DataFrame, path: str, pattern: str, start_texts: int = 3_000, start_positions: int = 5_000_000, rate: float = 0.015) -> Attention:
    """The model of the rows of ``texts`` (doc_id, ids).  No rows leave it untrained, but proper.

    Rows are dealt to lanes, and ordered in them, by a hash of identifier and ids, and the number of lanes follows
    from the number of rows: the result does not hang on how the table lies in partitions.  ``trained`` is the number
    of positions in the pass over all texts.
    """
    model = Attention(id_counts(texts, path, pattern))
    model.trained = 0
    schema = "weights binary, seen long"
    n = texts.count()
    if not n:
        return model
    rows = texts.select("ids", F.xxhash64(F.col("doc_id").cast("string"), "ids").alias("h"))
    got = start_pieces(rows, n, start_texts).mapInArrow(_trainer(pickle.dumps(model), path, pattern, rate, start_positions), schema).collect()
    if got:
        model.put(np.frombuffer(got[0].weights, np.float32))
    model.step, model.m1, model.m2 = 0, {}, {}
    lanes = min(LANES, -(-n // LANE_TEXTS))
    dealt = rows.repartition(lanes, "h").sortWithinPartitions("h", "ids").select("ids")
    part = dealt.mapInArrow(_trainer(pickle.dumps(model), path, pattern, rate * 0.2, windows=4096), schema).withColumn("at", F.spark_partition_id())
    part = part.withColumn("lane", F.pmod("at", F.lit(fan_in(lanes))))
    got = part.groupBy("lane").applyInArrow(_average, f"{schema}, at int").groupBy(F.lit("all")).applyInArrow(_average, f"{schema}, at int").collect()
    model.put(np.frombuffer(got[0].weights, np.float32))
    model.trained = got[0].seen
    model.m1, model.m2 = {}, {}
    return model


# ---------------------------------------------------------------- scoring

class Unigram:
    """Corpus counts of words: N tokens, V kinds; the smoothed base and the interpolation."""

    def __init__(self, n: int, v: int):
        self.total, self.share = n + 0.5 * (v + 1), SHARE if n else 1.0
        self.own = (1 - self.share) / max(n, 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / self.total)

    def mixed(self, c: np.ndarray, attention: np.ndarray) -> np.ndarray:
        both = np.log10(np.maximum(c * self.own, 1e-300) + self.share * 10.0 ** np.maximum(attention, -300))
        return np.where(c * self.own > 0, both, np.log10(self.share) + attention)


_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("mixed", pa.float64()), ("attention", pa.float64()), ("word", pa.int64())])
_SCORES = "uid long, doc_id long, held_out boolean, n long, known long, base double, mixed double, attention double, word long"


def _scorer(sent, path: str, pattern: str):
    """A row per text with what its frequent words give, and a row per occurrence of any other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (hot, hot_n), unigram = sent.value
        spelling, chance = _spelling(path, pattern), model.chances()
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for i, j, ids, size in _ids_of(batch):
                position = model.log10(*_after_ends(ids, size, spelling.end), chance)
                owner = np.repeat(np.arange(j - i), size)
                # the id at k of text t was foretold from position k + t
                each = position[np.arange(len(ids)) + owner]
                first, word = spelling.words(ids)
                attention, owner = np.add.reduceat(each, first), owner[first]
                kinds, inverse = np.unique(word, return_inverse=True)
                at = np.minimum(np.searchsorted(hot, kinds), max(0, len(hot) - 1))
                c = np.where(hot[at] == kinds, hot_n[at], -1)[inverse] if len(hot) else np.full(len(word), -1)
                here = c >= 0
                add = lambda x, of=slice(None): np.bincount(owner[of], weights=x, minlength=j - i)  # noqa: E731, B023
                longs = lambda x: pa.array(x.astype(np.int64))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), part.column("held_out"), longs(np.bincount(owner, minlength=j - i)), longs(np.bincount(owner[here], minlength=j - i)),
                     pa.array(add(unigram.base(c[here]), here)), pa.array(add(unigram.mixed(c[here], attention[here]), here)), pa.array(add(attention)), pa.nulls(j - i, pa.int64())],
                    schema=_ARROW,
                )
                rare = np.flatnonzero(~here)
                empty = [pa.nulls(len(rare), f.type) for f in list(_ARROW)[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array(uid[i:j][owner[rare]]), *empty, pa.array(attention[rare]), pa.array(word[rare])], schema=_ARROW)

    return run


def score(docs: DataFrame, held_out: Column, path: str, pattern: str, hot_words: int = 500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score of every row of ``docs``.

    Rows (doc_id, text) that are not held out are learned from.  A null text is empty: its only token is the end.
    Repeated rows are scored each.  With no training rows every token is unknown; an empty table gives no rows; other
    columns are not read.  Words are told apart by 64-bit numbers of their ids.  Counts of the most frequent words, at
    most ``hot_words`` (16 bytes each), are broadcast; those of all other words are joined.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    texts = spelled(rows, path, pattern)
    learned = texts.where("not held_out")
    counts = materialise(word_counts(learned, path, pattern), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unigram = Unigram(n, v)
    sent = spark.sparkContext.broadcast((train(learned, path, pattern), frequent(counts, hot_words), unigram))
    both = materialise(texts.mapInArrow(_scorer(sent, path, pattern), _SCORES), "scores")
    joined = both.where("word is not null").select("uid", "word", "attention").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    own = c * F.lit(unigram.own)
    mixed = F.when(own > 0, F.log10(own + unigram.share * F.pow(F.lit(10.0), F.greatest(F.col("attention"), F.lit(-300.0))))).otherwise(float(np.log10(unigram.share)) + F.col("attention"))
    rest = joined.groupBy("uid").agg(F.sum(F.log10((c + 0.5) / F.lit(unigram.total))).alias("more_base"), F.sum(mixed).alias("more_mixed"), F.sum((c > 0).cast("long")).alias("more_known"))
    out = both.where("word is null").drop("word").join(rest, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), plus("known", "more_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("mixed", "more_mixed").alias("score"), F.col("attention").alias("attention_score"))


def score_documents(docs: DataFrame, path: str, pattern: str, folds: int = 5, held: int = 1) -> DataFrame:
    """``score`` with the fold ``held`` of ``folds`` held out, by the checksum of the identifier (null: empty)."""
    return score(docs, fold(folds) == held, path, pattern)
