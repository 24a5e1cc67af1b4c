"""N-gram Jaccard join on prefix trees.

1. Every text becomes the sorted set of its distinct n-gram hashes (64 bit).  Equal sets are one class.
2. Candidates, exactly: two linked sets of a size class differ in at most k elements, so of any k + 1 parts of a
   partition of the hash space one is the same in both.  A part weighs as many rare elements as it has, by a sketch of
   all counts; a set emits a signature of each of its parts that weigh at least as much as its (k+1)-th heaviest, for
   its own size class and the next, which loses no pair and keeps common passages from tying documents together.
   Signatures travel packed, after each task has tied together its own equal ones, and only a star (member to
   smallest member) leaves a group of equal signatures: never all its pairs.
3. Components of candidate stars are joined in tries.  Sets are ordered globally inside the group (frequent first, so
   that paths are shared), stored in a path-compressed trie, and a probe walks it level by level with the partial
   overlap of each node, pruning subtrees whose remaining length cannot reach the overlap that is needed.  A component
   larger than a task's budget is cut in chunks: chunks are first joined with pivots.  Components that are still apart
   are parted by signatures of other parts, weighed by their own sets alone, and only what is then larger than a
   budget and apart goes through the grid of chunk pairs.

A threshold is ``num / den``: linked when den * |x & y| >= num * |x | y|.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, connected_components, discard, fan_in, materialise, mix, shingles, stars, utf8, words_of

_ONE = np.uint64(1)


def set_id(s: np.ndarray) -> int:
    """64-bit identity of a set of hashes; 0 only for the empty set."""
    if not len(s):
        return 0
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) or 1


def _sets(batch: pa.RecordBatch, n: int):
    """(row of batch, set) for every row, whole texts."""
    data, at = utf8(batch.column("text"))
    for i, j in chunks(at):
        h, row, _, _ = words_of(data, at[i : j + 1], True)
        for k, s in enumerate(shingles(h, row, j - i, n)):
            yield i + k, s


def _text_sets(n: int):
    return lambda batch: _sets(batch, n)


def _kept_sets(batch: pa.RecordBatch):
    """(row of batch, set) of sets that are there as bytes."""
    return ((i, np.frombuffer(g, np.uint64)) for i, g in enumerate(batch.column("grams").to_pylist()))


class Threshold:
    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, x, y):
        """Least overlap that links sets of sizes x and y: ceil(num (x + y) / (num + den))."""
        return -(-(self.num * (x + y)) // (self.num + self.den))

    def size_class(self, n: int) -> tuple[int, list[int]]:
        """Class of a size and the largest sizes of this class and the next."""
        c, top = 0, 1
        while top < n:
            c, top = c + 1, (top + 1) * self.den // self.num
        return c, [top, (top + 1) * self.den // self.num]

    def most_apart(self, top: int) -> int:
        """Most elements in which two linked sets of at most ``top`` elements differ."""
        return (self.den - self.num) * 2 * top // (self.num + self.den)


SKETCH_BITS = 22
#: Times that large components which are still apart are parted anew before their chunk pairs are joined.
ROUNDS = 2
#: Sets a task remembers as done; others are only done again.
SEEN = 200_000


def slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signatures(s: np.ndarray, t: Threshold, rare: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
    """Signatures of which two linked, different sets share at least one.

    ``rare`` tells by ``slot`` which elements count in a part's weight; without it all do.  Weights depend on a part's
    content alone, so of any k + 1 heaviest parts the one that is the same in both sets is emitted by both.  Each ``salt`` makes other parts, for which
    the same holds.
    """
    n, out = len(s), []
    count = np.ones(n) if rare is None else rare[slot(s)].astype(float)
    own, tops = t.size_class(n)
    for c, top in zip((own, own + 1), tops):
        k = t.most_apart(top)
        if k < 1:
            continue  # linked sets of this class are equal
        p = max(k + 1, int(1.15 * (k + 1)))
        seed = mix(np.array([c + 1 + (salt << 32)], np.uint64))[0]
        h = mix(s + seed)
        part = ((h >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64)
        weight = np.bincount(part, weights=count, minlength=p)
        low = np.bincount(part, weights=(h & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=p)
        g = mix(h ^ seed) >> np.uint64(32)
        high = np.bincount(part, weights=g.astype(np.float64), minlength=p)
        chosen = np.flatnonzero(weight >= np.partition(weight, p - k - 1)[p - k - 1])
        sig = low[chosen].astype(np.uint64) ^ mix(high[chosen].astype(np.uint64) + mix(chosen.astype(np.uint64) + seed))
        out.append(mix(sig))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of equal signatures the smallest node stands for all: (signatures, their nodes, star members, star centres)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(first)
    centre = np.repeat(node[at], np.diff(at, append=len(sig)))
    apart = np.flatnonzero(node != centre)
    member, centre = node[apart], centre[apart]
    order = np.lexsort((centre, member))
    member, centre = member[order], centre[order]
    fresh = np.ones(len(member), bool)
    fresh[1:] = (member[1:] != member[:-1]) | (centre[1:] != centre[:-1])
    return sig[at], node[at], member[fresh], centre[fresh]


_PACKED = "bucket int, sig binary, node binary, member binary, centre binary"


def _emit_signatures(sets, t: Threshold, buckets: int, sent, salt: int = 0, hold: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, held, seen = [], [], 0, set()

        def flush():
            sig, node, member, centre = _stars(np.concatenate(sigs), np.concatenate(nodes))
            where = (sig >> np.uint64(33)).astype(np.int64) * buckets >> 31
            order = np.argsort(where, kind="stable")
            sig, node = sig[order], node[order]
            cut = np.searchsorted(where[order], np.arange(buckets + 1))
            to = (mix(member.view(np.uint64)) >> np.uint64(33)).astype(np.int64) * buckets >> 31
            rows = []
            for b in np.union1d(np.unique(where), np.unique(to)).tolist():
                k, m = slice(cut[b], cut[b + 1]), to == b
                rows.append((b, sig[k].tobytes(), node[k].tobytes(), member[m].tobytes(), centre[m].tobytes()))
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "sig", "node", "member", "centre"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "sig", "node", "member", "centre"])

        for batch in batches:
            for _, s in sets(batch):
                me = set_id(s)
                if not me or me in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(me)  # only spares work
                sig = signatures(s, t, sent.value, salt)
                if len(sig):
                    sigs.append(sig)
                    nodes.append(np.full(len(sig), me, np.int64))
                    held += len(sig)
                if held >= hold:
                    yield from flush()
                    sigs, nodes, held = [], [], 0
        if held:
            yield from flush()

    return run


def _join_signatures(table: pa.Table) -> pa.Table:
    join = lambda c, ty: np.frombuffer(b"".join(table.column(c).to_pylist()), ty)
    _, _, member, centre = _stars(join("sig", np.uint64), join("node", np.int64))
    # a set shares many of its signatures, each with a centre of its own: an edge a set says as much
    a, b = stars(np.concatenate([member, join("member", np.int64)]), np.concatenate([centre, join("centre", np.int64)]))
    return pa.table({"a": a, "b": b})


def rare_slots(rows: DataFrame, sets) -> np.ndarray:
    """Which of 2^22 slots hold no frequent element: counts over all rows, summed in two levels, against their noise.

    A fixed 4 MB whatever the input.  More input drowns the less frequent elements; that costs selectivity, no links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(1 << SKETCH_BITS, np.int64), []
        for batch in batches:
            for _, s in sets(batch):
                held.append(slot(s))
                if len(held) >= 2000:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        parts = 64
        # a task's own counts are small: half the bytes to shuffle
        few = np.minimum(total, 2**31 - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in np.split(few, parts)], pa.binary())], names=["part", "counts"])

    def add(kind: type, to: type) -> object:
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, kind).astype(np.int64) for x in table.column("counts").to_pylist())
            total = np.minimum(total, np.iinfo(to).max).astype(to)
            return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

        return run

    schema = "part int, counts binary"
    lane = F.pmod(F.spark_partition_id(), F.lit(fan_in(rows.rdd.getNumPartitions())))
    # each task sends 64 parts of its counters, so no task gathers all of them
    sums = rows.mapInArrow(count, schema).withColumn("lane", lane).groupBy("part", "lane").applyInArrow(add(np.int32, np.int64), schema).groupBy("part").applyInArrow(add(np.int64, np.int32), schema)
    got = sums.collect()
    if not got:
        return np.ones(1 << SKETCH_BITS, bool)
    counts = np.concatenate([np.frombuffer(r.counts, np.int32) for r in sorted(got, key=lambda r: r.part)])
    noise = counts.mean()
    return counts <= noise + 4 * noise**0.5 + 4


def candidate_components(rows: DataFrame, sets, t: Threshold, total: int, task_signatures: int, salt: int = 0) -> DataFrame:
    """(node, component) over equal signatures of the sets of ``rows``, which have ``total`` elements; no link is lost."""
    apart = 2 * (t.den - t.num) / (t.den + t.num) * t.den / t.num
    buckets = int(np.clip(np.ceil(2 * apart * total / task_signatures), 1, 1 << 22))
    sent = rows.sparkSession.sparkContext.broadcast(rare_slots(rows, sets))
    packed = rows.mapInArrow(_emit_signatures(sets, t, buckets, sent, salt), _PACKED)
    return connected_components(packed.groupBy("bucket").applyInArrow(_join_signatures, "a long, b long"))


# ---------------------------------------------------------------- the trie

class Trie:
    """A path-compressed trie of ascending integer sets that are sorted lexicographically."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        starts, ends, depth, parent, leaf = [], [], [], [], []
        flat: list[np.ndarray] = []
        at = 0
        stack: list[int] = []  # nodes on the path of the last set

        def add(run: np.ndarray, d: int, up: int) -> int:
            nonlocal at
            starts.append(at)
            ends.append(at + len(run))
            flat.append(run)
            at += len(run)
            depth.append(d + len(run))
            parent.append(up)
            leaf.append([])
            return len(starts) - 1

        last = np.zeros(0, np.int64)
        for i, s in enumerate(sets):
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            shared = int(differ[0]) if len(differ) else m
            top = None
            while stack and depth[stack[-1]] > shared:
                top = stack.pop()
            base = depth[stack[-1]] if stack else 0
            if top is not None and shared > base:  # cut the edge of top in two
                cut = shared - base
                mid = add(np.zeros(0, np.int64), shared, parent[top])
                starts[mid], ends[mid] = starts[top], starts[top] + cut
                starts[top] += cut
                parent[top] = mid
                stack.append(mid)
            if len(s) > shared or not stack:
                stack.append(add(s[shared:], shared, stack[-1] if stack else -1))
            leaf[stack[-1]].append(i)
            last = s
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.start, self.end, self.depth = (np.array(x, np.int64) for x in (starts, ends, depth))
        n, par = len(starts), np.array(parent, np.int64)
        size = np.array([len(s) for s in sets], np.int64)
        low, high = np.full(n, 1 << 60, np.int64), np.zeros(n, np.int64)
        for v in range(n):
            for i in leaf[v]:
                low[v], high[v] = min(low[v], size[i]), max(high[v], size[i])
        for v in np.argsort(-self.depth, kind="stable"):
            if par[v] >= 0:
                low[par[v]], high[par[v]] = min(low[par[v]], low[v]), max(high[par[v]], high[v])
        self.low, self.high, self.size = low, high, size
        order = np.argsort(par, kind="stable")
        first = np.searchsorted(par[order], np.arange(-1, n + 1))
        self.children, self.first = order, first  # children of v: children[first[v+1]:first[v+2]]
        count = np.array([len(x) for x in leaf], np.int64)
        self.leaf_first = np.concatenate(([0], np.cumsum(count)))
        self.leaves = np.array([i for x in leaf for i in x], np.int64)

    @staticmethod
    def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, index) of all i in [a, b) of each owner."""
        n = b - a
        owner = np.repeat(np.arange(len(a)), n)
        return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)

    def probe(self, x: np.ndarray, member: np.ndarray, t: Threshold) -> np.ndarray:
        """Sets linked with ``x``; member is a scratch array of zeros over the elements."""
        member[x] = 1
        found = []
        node, overlap = self.children[self.first[0] : self.first[1]], None
        overlap = np.zeros(len(node), np.int64)
        while len(node):
            owner, i = self._ranges(self.start[node], self.end[node])
            overlap = overlap + np.bincount(owner, weights=member[self.flat[i]], minlength=len(node)).astype(np.int64)
            deepest = np.where(self.end[node] > self.start[node], self.flat[np.maximum(self.end[node] - 1, 0)], -1)
            left = len(x) - np.searchsorted(x, deepest, "right")
            reach = overlap + np.minimum(self.high[node] - self.depth[node], left)
            ok = reach >= t.need(len(x), self.low[node])
            node, overlap = node[ok], overlap[ok]
            if not len(node):
                break
            owner, i = self._ranges(self.leaf_first[node], self.leaf_first[node + 1])
            if len(i):
                sets = self.leaves[i]
                found.append(sets[overlap[owner] >= t.need(len(x), self.size[sets])])
            owner, i = self._ranges(self.first[node + 1], self.first[node + 2])
            node, overlap = self.children[i], overlap[owner]
        member[x] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def parity(s: np.ndarray, bits: int = 2048) -> np.ndarray:
    """Bit j: whether an odd number of elements fall on j.  Where two differ, so do the sets: a bound, never a guess."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def trie_components(sets: list[np.ndarray], t: Threshold) -> np.ndarray:
    """Smallest position linked, over links, with each set (positions in ``sets``)."""
    m = len(sets)
    root = np.arange(m)
    if m < 2:
        return root
    kinds, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(kinds), np.int64)
    place[np.lexsort((kinds, -count))] = np.arange(len(kinds))  # frequent first
    cut = np.cumsum([len(s) for s in sets])[:-1]
    local = [np.sort(x) for x in np.split(place[inverse], cut)]
    order = sorted(range(m), key=lambda i: local[i].astype(">u4").tobytes())
    trie = Trie([local[i] for i in order])
    member = np.zeros(len(kinds), np.int8)
    size, sketch = np.array([len(x) for x in local], np.int64), np.stack([parity(x) for x in sets])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # Links are symmetric: once all sets that have not probed are in one component, no link can be missing.  So the
    # sets outside the largest component probe first, the set of middle size before all.
    open_ = [int(np.argsort([len(x) for x in local], kind="stable")[m // 2])]
    left = set(range(m))
    while open_:
        most = None
        for k, i in enumerate(open_):
            if most is not None and find(i) == most:
                continue
            left.discard(i)
            # most sets of a loose component have no other within reach, which their sketches prove
            far = np.bitwise_count(sketch ^ sketch[i]).sum(1, dtype=np.int64)
            near = (far <= size + size[i] - 2 * t.need(size, size[i])) & (t.num * size <= t.den * size[i]) & (t.num * size[i] <= t.den * size)
            if np.count_nonzero(near) < 2:  # itself
                continue
            for j in trie.probe(local[i], member, t).tolist():
                a, b = find(i), find(order[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
            if k % 64 == 0:
                most = Counter(map(find, left)).most_common(1)[0][0] if left else None
            elif most is not None:
                most = find(most)
        if not left:
            break
        most = Counter(map(find, left)).most_common(1)[0][0]
        open_ = [i for i in sorted(left) if find(i) != most]
    return np.array([find(i) for i in range(m)])


def _join_groups(t: Threshold):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        cell, node = table.column("cell").to_numpy(), table.column("node").to_numpy()
        data = table.column("grams").to_pylist()
        a, b, edge = [], [], np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            ids, keep = np.unique(node[i:j], return_index=True)  # a class can come from more than one task
            if len(ids) > 1:
                root = trie_components([np.frombuffer(data[i + k], np.uint64) for k in keep.tolist()], t)
                a.append(ids)
                b.append(ids[root])
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


# ---------------------------------------------------------------- a bounded filter of ids

BLOOM_WORDS = 1 << 20


def bloom(ids: DataFrame) -> np.ndarray:
    """8 MB of bits at most, whatever the number of ids: three bits for each ``id``."""
    hashed = ids.select(F.explode(F.array(*[F.xxhash64(F.lit(i), "id") for i in range(3)])).alias("h"))
    words = hashed.groupBy(F.pmod("h", F.lit(BLOOM_WORDS)).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(h, 40), 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(BLOOM_WORDS, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def _grams_of(n: int, bits) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = bits.value, set()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in ("h0", "h1", "h2"):
                h = batch.column(c).to_numpy()
                keep &= (words[h % BLOOM_WORDS] >> ((h >> 40) % 64) & 1).astype(bool)
            batch = batch.filter(pa.array(keep))
            node, grams = [], []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(grams, pa.binary())], names=["node", "grams"])

            for _, s in _sets(batch, n):
                me = set_id(s)
                if me and me not in seen:
                    if len(seen) < SEEN:
                        seen.add(me)
                    node.append(me)
                    grams.append(s.tobytes())
                    if len(grams) >= 1000:
                        yield out()
                        node, grams = [], []
            if node:
                yield out()

    return run


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, task_grams: int = 2_000_000, task_signatures: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id over links) for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have an empty set and link with nothing, so each is its own component.  Rows with
    equal texts are one class.  A null doc_id takes part but names no component unless all in it are null.  An empty
    table gives no rows; columns besides doc_id and text are not read.
    """
    spark, t = docs.sparkSession, Threshold(num, den)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(s), set_id(s)) for _, s in _sets(batch, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int64())], names=["doc_id", "n_shingles", "node"])

    classes = materialise(rows.mapInArrow(ids, "doc_id long, n_shingles long, node long"), "classes")
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    candidates = materialise(candidate_components(rows.select("text"), _text_sets(n), t, total, task_signatures), "candidates")

    reps = classes.join(candidates, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"))
    reps = materialise(reps.join(candidates, "node"), "reps")
    bits = spark.sparkContext.broadcast(bloom(reps.select("id")))
    hashes = [F.xxhash64(F.lit(i), F.col("doc_id")).alias(f"h{i}") for i in range(3)]
    grams = rows.select("text", *hashes).mapInArrow(_grams_of(n, bits), "node long, grams binary")
    size = reps.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("nodes"))
    size = size.where("nodes > 1").withColumn("parts", F.ceil(F.col("total") / task_grams).cast("int"))
    member = grams.join(reps.select("node", "component"), "node").join(size.drop("nodes"), "component")
    member = materialise(member.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), "grams")

    all_grams = size.agg(F.sum("total")).first()[0] or 0
    groups = int(np.clip(np.ceil(all_grams / task_grams), 1, 1 << 20))

    def join(cells: DataFrame) -> DataFrame:
        cells = cells.select(F.xxhash64("component", "i", "j").alias("cell"), "node", "grams")
        return cells.groupBy(F.pmod("cell", F.lit(max(groups, 24))).alias("group")).applyInArrow(_join_groups(t), "a long, b long").where("a <> b")

    # first pass: each chunk with the pivots of its component (its smallest node of each chunk would grow with the
    # chunks, so the pivots are those of a fixed number of chunks)
    pivots = member.where("parts > 1 and part < 8").groupBy("component", "part").agg(F.min_by("grams", "node").alias("grams"), F.min("node").alias("node"), F.first("parts").alias("parts"))
    pivots = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("component", "i", F.col("i").alias("j"), "node", "grams")
    diagonal = member.select("component", F.col("part").alias("i"), F.col("part").alias("j"), "node", "grams")
    links = materialise(join(diagonal.union(pivots)), "links")
    if size.where("parts > 1").limit(1).count():
        so_far = connected_components(links)
        joined = so_far.withColumnRenamed("component", "joined")
        own = F.coalesce("joined", "node")

        def still_apart(names: DataFrame) -> DataFrame:
            open_ = names.join(joined, "node", "left").groupBy("component").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi")
            return materialise(names.join(open_, "component", "left_semi"), "apart")

        # What is still apart is mostly held together by passages that all rows together drown and these alone show to be
        # frequent.  Other parts, weighed by these sets alone, lose no link either, so linked sets share both components.
        sets = member.where("parts > 1").select("node", "grams", F.expr("octet_length(grams) div 8").alias("n"))
        names = still_apart(member.where("parts > 1").select("node", "component").distinct())
        for salt in range(1, ROUNDS + 1):
            mine = sets.join(names.select("node"), "node", "left_semi")
            again = candidate_components(mine.select("grams"), _kept_sets, t, mine.agg(F.sum("n")).first()[0] or 0, task_signatures, salt)
            before, names = names, names.join(again.withColumnRenamed("component", "again"), "node").select("node", F.xxhash64("component", "again").alias("component"))
            names = still_apart(names)
            discard(before)
            size = sets.select("node", "n").distinct().join(names, "node").groupBy("component").agg(F.ceil(F.sum("n") / task_grams).cast("int").alias("parts"))
            if not size.where("parts > 1").limit(1).count():
                break
        # a chunk pair is joined only where the component is still apart
        grid = sets.join(names, "node").join(size, "component").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        grid = grid.select("component", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "node", "grams")
        links = so_far.select(F.col("node").alias("a"), F.col("component").alias("b")).union(materialise(join(grid), "grid"))
    joined = connected_components(links)

    # component ids are smallest doc_ids: equal sets first, then links
    by_class = classes.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = joined.join(by_class, "node")
    lowest = named.groupBy("component").agg(F.min("least").alias("low"))
    named = named.join(lowest, "component").select("node", "low")
    by_class = by_class.join(named, "node", "left").select("node", F.coalesce("low", "least").alias("component_id"))
    empty = classes.where("node = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return classes.where("node <> 0").join(by_class, "node").select("doc_id", "n_shingles", "component_id").union(empty)
