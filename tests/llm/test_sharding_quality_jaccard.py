import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 700}x{i}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(200))
ODD = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.replace("w7 ", "zz "), "en", None, 1), (4, None, "en", "a", None), (5, "", None, "b", 0),
    (6, " \t\n\v ", "en", "b", 1), (7, "one two", "en", "b", 1), (8, "ONE two", "en", "b", 1), (9, LONG, "en", "a", 1), (10, LONG + " end", "en", "a", 1), (None, "x y z \x85 é", "en", "a", 1),
    (11, "a\nb b b b\na\n\na \n" * 3 + "#*é$" * 4, "en", "b", 1), (11, "a\nb", "en", "b", 1), (11, "a\nb", "en", "b", 1), (12, "A B C d e f g h i j " * 6, "en", "a", 1),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300).tolist()]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shard(F.col("k"), 16).alias("a"), sharding.jump_shard(F.col("k"), 17).alias("b"), sharding.jump_shard(F.col("k"), 1).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(jump(r.k, 16), jump(r.k, 17), 0) for r in got]


def test_shards(spark, sf):
    for df in (spark.createDataFrame(ODD, DOCS), spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([], DOCS)):
        rows, docs = sharding.shard_documents(df.withColumn("slot", F.lit("clash"))).collect(), df.collect()
        assert len(rows) == len(docs)
        text = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
        assert text == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
        for s in range(16):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in rows)


def xxhash64(n):
    """Spark's hash of a long with its default seed 42."""
    import xxhash

    return xxhash.xxh64_intdigest(int(n).to_bytes(8, "little", signed=True), 42)


def test_shard_of_a_document_is_the_jump_of_its_hash(spark, sf):
    rows = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert all((r.shard, r.grown_shard) == (jump(xxhash64(r.doc_id), 16), jump(xxhash64(r.doc_id), 17)) for r in rows) and len({r.shard for r in rows}) == 16


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_counts(spark, sf):
    for df in (spark.createDataFrame(ODD, DOCS), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = quality.quality_documents(df).collect()
        want = Counter((d.doc_id, *base(d.text)) for d in df.collect())
        assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_removes_frequent_lines(spark):
    line = "Subscribe to our  newsletter 12 " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(91))
    rows = [(i, (line.upper() if i % 2 else line.replace("12", "99")) + "\n" + " ".join(f"u{i}x{j}" for j in range(20 if i < 30 else 90)), "en", "a" if i < 40 else None, 1) for i in range(60)]
    rows += [(100 + i, line, "en", "z", 1) for i in range(50)]  # copies count once
    out = quality.quality(spark.createDataFrame(rows, DOCS), min_docs=25, share=0.1).collect()
    by = {r.doc_id: r for r in out}
    assert [by[i].kept for i in range(60)] == [i >= 30 for i in range(60)]
    assert by[0].n_removed_words == 96 and by[50].n_removed_words == 0  # 20 documents of the null host
    assert all(by[100 + i].n_removed_words == 0 for i in range(50))


def letters(i):
    """Numbers differ by their letters; digits all count as 0 in a line."""
    return "".join(chr(97 + int(c)) for c in str(i))


def test_cleaned_texts_are_handed_on(spark, sf):
    import corpus_pipeline as pipe

    line = "Subscribe to  our newsletter 12 é"
    body = lambda i: " ".join(f"u{letters(i)}x{letters(j)}" for j in range(90))
    rows = [(i, f"{line.upper() if i == 3 else line}\n\nhead {letters(i)}q\n{line.replace('12', '99')}\n{body(i)}\n", "en", "a", 7) for i in range(120)]
    rows += [(500, "\n".join([line] * 30) + "\n" + body(500)[:300], "en", "a", 1), (501, f"{line}\n{body(501)}", "en", "b", 1), (502, f"{body(502)}\n{line}", "en", None, 1), (500, f"{body(9)}x", "en", "a", 1), (503, "few", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.union(docs.where("doc_id = 3"))  # a repeated row
    got = pipe.quality_rules(spark, docs, sf).collect()
    # É is no A-Z and is not lowered, so the upper-case line is another and stays
    cleaned = {i: (f"{line.upper()}\n" if i == 3 else "") + f"\nhead {letters(i)}q\n{body(i)}\n" for i in range(120)}
    want = Counter((i, t, len(t)) for i, t in [*cleaned.items(), (3, cleaned[3])])
    want.update([(501, rows[121][1], 1), (502, rows[122][1], 1), (500, rows[123][1], 1)])
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == want
    counts = {(r.doc_id, r.n_words): r for r in quality.quality(docs).collect()}
    n = len(rows[4][1].split())
    assert counts[4, n].n_removed_words == n - len(cleaned[4].split()) == 12 and counts[3, n].n_removed_words == n - len(cleaned[3].split()) == 6
    by = {r.doc_id: r for r in got}
    assert all(r.n_words - r.n_removed_words == len(by[i].text.split()) for (i, _), r in counts.items() if i < 500)
    assert [r.kept for k, r in counts.items() if k[0] in (500, 503)].count(False) == 2


def test_small_hosts_lose_frequent_lines_too(spark, sf):
    import corpus_pipeline as pipe

    sizes = {"tiny": 12, "small": 60, "large": 500}
    line = "all rights reserved by the host"
    rows = [(1000 * k + i, (f"{line}\n" if i < 10 else "") + " ".join(f"{h}{letters(i)}x{letters(j)}" for j in range(60)), "en", h, 1) for k, (h, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(9000 + i, f"{line}\n" + " ".join(f"few{letters(i)}x{letters(j)}" for j in range(60)), "en", "chance", 1) for i in range(5)]  # no more than chance
    got = pipe.quality_rules(spark, spark.createDataFrame(rows, DOCS), sf).collect()
    assert len(got) == len(rows) and Counter(r.source for r in got if line in r.text) == {"chance": 5}


def brute(docs, n, num, den):
    def shingles(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()

    sets = [shingles(d.text) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and num * max(len(x), len(y)) <= den * min(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(docs):
        if d.doc_id is not None:
            least[find(i)] = min(d.doc_id, least.get(find(i), d.doc_id))
    return Counter((d.doc_id, len(sets[i]), least.get(find(i))) for i, d in enumerate(docs))


@pytest.mark.parametrize("n,num,den,task", [(4, 85, 100, 2_000_000), (5, 4, 5, 2_000_000), (4, 85, 100, 500)])
def test_components_are_those_of_all_pairs(spark, sf, n, num, den, task):
    rng = np.random.default_rng(5)
    near = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in rng.permutation(60 + 40 * g)]
        for c in range(25):
            w = list(words)
            for p in rng.integers(0, len(w), rng.integers(0, 2 + g)):
                w[p] = f"e{rng.integers(0, 50)}"
            near.append((1000 + 100 * g + c, " ".join(w), "en", "a", 1))
    made = spark.createDataFrame(ODD + near, DOCS).withColumn("node", F.lit(1)).withColumn("component", F.lit("x"))
    for df in (made, spark.read.parquet(f"{sf}/documents.parquet"))[: 1 + (num == 85 and task > 500)]:
        got = jaccard.jaccard_components(df, n, num, den, task_grams=task, task_signatures=3000).collect()
        assert Counter(map(tuple, got)) == brute(df.collect(), n, num, den)


def test_no_rows(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_components_leave_one_table(spark):
    from pathlib import Path

    from tidemark.storage import shared_dir

    folders = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("cc-*"))
    before = folders()
    found = common.connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
    assert found.count() == 31 and len(folders() - before) == 1


@pytest.mark.parametrize("salt", [0, 1, 2])
def test_other_parts_lose_no_link(spark, salt):
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 4, 9, 40, 200):
        for _ in range(8):
            x = rng.integers(1, 2**63, n).astype(np.uint64)
            sets += [np.unique(x), np.unique(np.concatenate([x[: n - n // 12], rng.integers(1, 2**63, n // 20).astype(np.uint64)]))]
    t = jaccard.Threshold(4, 5)
    rows = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "grams binary")
    got = {r.node: r.component for r in jaccard.candidate_components(rows, jaccard._kept_sets, t, sum(map(len, sets)), 3000, salt).collect()}
    linked = [(jaccard.set_id(x), jaccard.set_id(y)) for x in sets for y in sets if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))]
    assert sum(x != y for x, y in linked) > 20 and all(x == y or got[x] == got[y] for x, y in linked)


def test_a_bucket_leaves_an_edge_a_set():
    """Near copies share many signatures, whose smallest sets differ: not an edge for each of these."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    node, sig = (x.ravel() for x in np.meshgrid(rng.permutation(60) * 7 - 100, np.arange(40)))
    here = rng.random(len(sig)) < 0.4
    none = np.zeros(0, np.int64).tobytes()
    table = pa.table({"bucket": [0], "sig": [sig[here].astype(np.uint64).tobytes()], "node": [node[here].astype(np.int64).tobytes()], "member": [none], "centre": [none]})
    got = jaccard._join_signatures(table)
    assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist())) == [(-100, int(i)) for i in np.unique(node)[1:]]


@pytest.mark.parametrize("most", [0, 100, 1_000_000])
def test_components_write_no_more_rounds_than_they_need(spark, monkeypatch, most):
    written, write = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(common, "TASK_EDGES", most)
    rng = np.random.default_rng(9)
    edges = [tuple(map(int, x)) for x in rng.integers(-150, 150, (220, 2))] + [(200 + i, 201 + i) for i in range(60)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    least = {x: x for a, b in edges if a != b for x in (a, b)}
    while any(least[a] != least[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least and (most < 1000 or len(written) == 2)
    written.clear()
    star = [(i // 10 * 10, i) for i in range(200)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(star, "a long, b long")).collect()))
    assert got == {i: a for a, i in star} and len(written) == 1 + (most > 180)
