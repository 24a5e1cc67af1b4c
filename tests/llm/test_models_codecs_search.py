import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language, lm, packing, sentencepiece_bpe, topk, warc
from tidemark.llm.common import utf8
from tidemark.llm.tokens import WordBpe, WordTable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = P.path("word_bpe_49k.json")
ODD = [
    (1, "The cat, the <|endoftext|> hat.", "en", "a", 1), (2, None, "en", "a", 1), (3, "", None, "b", 1), (4, " \t\n ", "de", "b", 1), (None, "é x y z　w ▁ \x00 日本", None, None, None),
    (4, "1234 !!", "en", "a", 1), (7, "wort " * 9000, "de", "a", 1), (7, "wort " * 9000, "de", "a", 1), (8, "a  b\r\n;\rc ", "en", "a", 1), (9, "x" * 3000, "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("clash")).withColumn("piece", F.lit(0))


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())


# ------------------------------------------------ language model

def test_language_model(spark, sf, odd):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        docs, got = df.collect(), lm.score_documents(df, *args).collect()
        split = lambda t: (t or "").encode().lower().split() + [b""]
        count = Counter(w for d in docs if crc(d.doc_id) % 5 != 1 for w in split(d.text))
        n, v = sum(count.values()), len(count)
        want = sorted(((d.doc_id or -1), crc(d.doc_id) % 5 == 1, len(w := split(d.text)), sum(count[x] > 0 for x in w), n, round(sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d in docs)
        assert sorted(((r.doc_id or -1), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(spark.createDataFrame([], DOCS), *args).count() == 0


def test_attention_sums_to_one_and_learns():
    rng = np.random.default_rng(0)
    lm_ids, model = 40, lm.Attention(rng.integers(1, 99, 40).astype(float))
    ids = np.tile(np.arange(10), 60)
    text = np.repeat(np.arange(6), 100)
    total = np.zeros(1)
    for last in range(lm_ids):  # every id that could come next
        total = total + 10.0 ** model.log10(np.array([3, 5, 7, last]), np.zeros(4, int), model.chances())[2]
    assert abs(total[0] - 1) < 1e-4
    before = model.log10(ids, text, model.chances()).sum()
    x, owner, _ = model.layout(ids, text)
    n = len(x) - lm.STRIDE - 1
    seen = [model.learn(x, owner, 0, n, 0.02)[1] for _ in range(200)]
    after = model.log10(ids, text, model.chances())
    assert after.sum() > 0.3 * before and (after[99::100] == 0).all() and set(seen) == {6 * 99}


def plain_score(model, ids):
    """log10 of each next id of one text: every window alone, with a plain softmax."""
    p, chance, x, logs = model.p, model.chances(), model.local[np.array(ids)], []
    q, k, v, h = np.split(p["e"], [lm.KEY, 2 * lm.KEY, 2 * lm.KEY + lm.STATE], 1)
    for t in range(len(ids) - 1):
        keys = np.arange(max(0, t // lm.STRIDE * lm.STRIDE - lm.STRIDE), t + 1)
        a = k[x[keys]] @ q[x[t]] * lm.KEY**-0.5 + p["r"][t - keys]
        a = np.exp(a - a.max())
        z = np.tanh(h[x[t]] + (a / a.sum()) @ v[x[keys]])
        m = z @ p["w"] + p["b"]
        m = np.exp(m - m.max())
        logs.append((np.log((m / m.sum()) @ chance[x[t + 1]]) + model.inner[ids[t + 1]]) / np.log(10))
    return logs


def test_windows_are_those_of_each_text():
    model = lm.Attention(np.arange(1.0, 13.0))
    rng = np.random.default_rng(3)
    ids, size = rng.integers(0, 12, 700), [1, 40, 300, 16, 15, 17, 311]
    got = model.log10(ids, np.repeat(np.arange(7), size), model.chances(), 3)
    for a, n in zip(np.cumsum(size) - size, size):
        assert np.allclose(got[a : a + n - 1], plain_score(model, ids[a : a + n].tolist()), atol=1e-4) and got[a + n - 1] == 0


ARGS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def spelled(docs):
    return lm.spelled(docs.selectExpr("monotonically_increasing_id() uid", "doc_id", "false held_out", "text"), *ARGS)


def test_words_are_told_by_their_ids(spark):
    texts = ["", " \t ", None, "a b  A\nb", "x\u3000y \u3000 z \x85 \u00a0 q", "日本 \u3000 \u3000 e", "<|endoftext|> end", "w" * 5000, "a\u2028b \x1c"]
    rows = spelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    spelling, numbers = lm._spelling(*ARGS), {}
    for text, r in zip(texts, rows):
        words = (text or "").encode().lower().split() + [b""]
        first, number = spelling.words(np.frombuffer(bytes(r.ids), "<u2").astype(np.int32))
        assert len(number) == len(words)
        for w, k in zip(words, number.tolist()):
            assert numbers.setdefault(w, k) == k
    assert len(set(numbers.values())) == len(numbers)


def test_each_word_of_a_run_is_encoded_once(monkeypatch):
    table, asked = lm._table(*ARGS), []
    texts = [" ".join(f"word{i * j % 293}" for j in range(1, 1500)) for i in range(1, 260)] + [None, "", " a\u3000b ", "\t"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], names=["uid", "doc_id", "held_out", "text"]).slice(1)
    split = [(t or "").encode().split() for t in texts[1:]]
    want = [b"".join(table.encode([w])[1][:-1].astype("<u2").tobytes() for w in words) + np.uint16(table.end[0]).tobytes() for words in split]
    table.reset()
    encode = table.encode_words
    monkeypatch.setattr(table, "limit", 100)
    monkeypatch.setattr(table, "encode_words", lambda words: asked.append(len(words)) or encode(words))
    got = list(lm._spell(*ARGS)(iter([rows])))
    assert len(got) > 1 and [i for b in got for i in b.column("ids").to_pylist()] == want
    assert [i for b in got for i in b.column("uid").to_pylist()] == list(range(1, len(texts)))
    assert sum(asked) == len({w for words in split for w in words})


def test_counts_are_whole_however_little_is_held(spark, odd):
    texts = spelled(odd.unionAll(odd)).repartition(2)
    a, b = ({r.word: r.n for r in lm.word_counts(texts, *ARGS, hold=h).collect()} for h in (4, 10**6))
    assert a == b and sum(a.values()) == 2 * sum(len((d.text or "").encode().lower().split()) + 1 for d in odd.collect())


def test_score_is_recomputed(spark, odd):
    """Every window of every text, one at a time; words interpolated with the corpus."""
    docs, learned = odd.collect(), odd.where(language.fold(5) != 1)
    model, counts = lm.train(spelled(learned), *ARGS), Counter()
    split = lambda t: (t or "").encode().lower().split() + [b""]
    for d in learned.collect():
        counts.update(split(d.text))
    total, table = sum(counts.values()), lm._table(*ARGS)

    def text_score(text):
        words = split(text)
        own = [table.encode([w])[1][:-1].tolist() if w else [table.end[0]] for w in words]
        logs, out = plain_score(model, [table.end[0]] + [i for x in own for i in x]), 0.0
        for w, x in zip(words, own):
            attention, logs = sum(logs[: len(x)]), logs[len(x) :]
            out += np.log10((1 - lm.SHARE) * counts[w] / total + lm.SHARE * 10**attention) if counts[w] else np.log10(lm.SHARE) + attention
        return out

    want = Counter(((d.doc_id or -1), round(text_score(d.text), 2)) for d in docs if len(d.text or "") < 5000)
    for hot in (500_000, 1):  # words that are joined count as those that are broadcast
        got = Counter(((r.doc_id or -1), round(r.score, 2)) for r in lm.score(odd, language.fold(5) == 1, *ARGS, hot_words=hot).collect())
        assert all(got[k] == n for k, n in want.items()) and len(want) > 6


def test_scores_do_not_hang_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = ({r.doc_id: r.score for r in lm.score_documents(d, *ARGS).collect()} for d in (docs.repartition(1), docs.repartition(5)))
    assert a == pytest.approx(b, rel=1e-5)


def test_all_positions_are_trained(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 97}" for j in range(n))) for i, n in enumerate([3000, 700, 1, 0, 1200])] + [(None, None)], "doc_id long, text string")
    texts = spelled(docs)
    assert lm.train(texts, *ARGS, start_positions=1000).trained == lm.id_counts(texts, *ARGS).sum() > 4900


def test_long_texts_train_and_start(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 97}" for j in range(30_000))) for i in (1, 2)], "doc_id long, text string")
    texts = spelled(docs)
    model = lm.train(texts, *ARGS, start_positions=1000)
    assert model.trained == lm.id_counts(texts, *ARGS).sum() > 60_000
    assert [len(r.ids) for r in lm.start_pieces(texts.withColumn("h", F.xxhash64("ids")), 2, 3000).collect()] == [12_000] * 2
    rows = spark.range(0, 8000, 1, 8).selectExpr("cast(concat(if(id < 4000, 'aa', 'bb'), id) as binary) ids", "xxhash64(id) h")
    got = [bytes(r.ids) for r in lm.start_pieces(rows, 8000, 800).collect()]
    assert 600 < len(got) < 1000 and min(sum(t[:1] == c for t in got) for c in (b"a", b"b")) > 250


def test_attention_gradients():
    model = lm.Attention(np.arange(1.0, 13.0))
    rng = np.random.default_rng(2)
    x, owner, _ = model.layout(rng.integers(0, 12, 70), np.repeat([0, 1], [30, 40]))
    n = len(x) - lm.STRIDE - 1
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    own = owner[lm.STRIDE :]
    counted = (own[1:] == own[:-1]) & (own[:-1] >= 0)
    loss = lambda: -(np.log(model.forward(x, owner, 0, n, model.chances())[-1]) * counted).sum() / counted.sum()
    start = {k: v.copy() for k, v in model.p.items()}
    model.learn(x, owner, 0, n, 0.0)
    columns = {"e": (0, lm.KEY, 2 * lm.KEY + 1, 2 * lm.KEY + lm.STATE + 3)}
    for name in model.NAMES:
        for column in columns.get(name, (0,)):
            at = tuple(rng.integers(0, m) for m in start[name].shape)
            if name in ("e", "g"):
                at = (int(x[lm.STRIDE + 3]), column if name == "e" else at[1])
            model.p = {k: v.copy() for k, v in start.items()}
            model.p[name][at] += 1e-4
            up = loss()
            model.p[name][at] -= 2e-4
            assert (up - loss()) / 2e-4 == pytest.approx(10 * model.m1[name][at], abs=2e-4), (name, at)


# ------------------------------------------------ language ID

def test_a_step_is_the_same_in_blocks():
    rng = np.random.default_rng(11)
    counts = rng.integers(1, 90, 60)
    ids, text = rng.integers(0, 60, 700), np.repeat(np.arange(14), 50)
    made = []
    for block in (1, 5, 10_000):
        model = lm.Attention(counts)
        x, owner, _ = model.layout(ids, text)
        made.append((*[v for _ in range(3) for v in model.learn(x, owner, 0, len(x) - lm.STRIDE - 1, 0.02, block)], model.weights()))
    assert [m[1] for m in made] == [700 - 14] * 3
    for m in made[:2]:
        assert np.allclose(m[:6], made[2][:6], rtol=1e-4) and np.abs(m[6] - made[2][6]).max() < 2e-3


def test_a_step_holds_no_more_than_a_block():
    """What a step needs beside its positions stays in a core's cache, however many windows it has."""
    import tracemalloc

    rng, peak = np.random.default_rng(12), []
    for windows in (1024, 4096):
        model = lm.Attention(rng.integers(1, 90, 60))
        x, owner, _ = model.layout(rng.integers(0, 60, windows * lm.STRIDE), np.zeros(windows * lm.STRIDE, int))
        tracemalloc.start()
        model.learn(x, owner, 0, windows * lm.STRIDE, 0.02)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < peak[0] + 32 * 4096 * lm.STRIDE


def test_steps_add_up_each_id_and_place():
    """The gradients of a step in many blocks, of ids that come often, are those of its windows one at a time."""
    rng = np.random.default_rng(13)
    ids, text = rng.zipf(1.4, 900).clip(0, 39), np.repeat(np.arange(3), [500, 390, 10])
    model = lm.Attention(np.bincount(ids, minlength=40).astype(float))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, owner, _ = model.layout(ids, text)
    start, sums, seen = {k: v.copy() for k, v in model.p.items()}, {}, 0
    for i in range(0, len(x) - lm.STRIDE - 1, lm.STRIDE):
        one = model.learn(x, owner, i, lm.STRIDE, 0.0)[1]
        for k, g in model.m1.items():
            sums[k] = sums.get(k, 0) + g * one
        model.m1, seen = {}, seen + one
    model.learn(x, owner, 0, len(x) - lm.STRIDE - 1, 0.0, 7)
    assert seen == 897 and all((model.p[k] == start[k]).all() for k in start)
    for k, g in model.m1.items():
        assert np.allclose(g * seen, sums[k], atol=1e-6), k


def test_language(spark, sf, odd):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {d.doc_id: d for d in df.collect()}
    got = language.language_documents(df).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    out = language.language_documents(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ODD)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.lang_pred, r.score))
    assert by[2] == by[3] == [("und", 0.0)] and sorted(by[4]) == [("und", 0.0)] * 2 and by[7][0][0] == "de"
    assert language.language_documents(spark.createDataFrame([(1, "abc", None, "s", 1)], DOCS)).first().lang_pred == "und"
    assert language.language_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_language_is_naive_bayes(spark, sf):
    """Counts, log probabilities and scores one gram at a time, over the same hashed buckets."""
    docs = [d for d in spark.read.parquet(f"{sf}/documents.parquet").collect() if d.doc_id < 60]
    grams = {}
    for d in docs:
        two, three, start, stop = language.grams([d.text])
        grams[d.doc_id] = [int(g[i]) for i in range(start[0], stop[0]) for g in (two, three)]
    count, total, seen = defaultdict(Counter), Counter(), Counter()
    for d in docs:
        if crc(d.doc_id) % 3 != 1 and d.lang is not None:
            seen[d.lang] += 1
            count[d.lang].update(grams[d.doc_id])
            total[d.lang] += len(grams[d.doc_id])
    got = {r.doc_id: r for r in language.language_documents(spark.createDataFrame([tuple(d) for d in docs], DOCS)).collect()}
    for d in docs:
        r, own = got[d.doc_id], grams[d.doc_id]
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {k: np.log(seen[k] / sum(seen.values())) + sum(np.log((count[k][g] + 0.1) / (total[k] + 0.1 * 2**language.BITS)) for g in own) for k in seen}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(np.exp(min(0, v - logs[best])) for v in logs.values()), abs=1e-3)
    with pytest.raises(ValueError, match="languages"):
        language.train(spark.range(40).selectExpr("cast(id as string) lang", "'abc' text"), most=30)


# ------------------------------------------------ SentencePiece

def test_sentencepiece(spark, sf, odd):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.codec(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rng, pieces = random.Random(3), list(own.ids)
    texts = ["", " ", "  a", "a\nb", "▁a", "a▁b", "\x00x", "a" * 500, " " * 100, ";\r\n {\r", "\r\r;\r;", " " * 33 + "x", "日本語 ﬁ ①　x <s> <0x0A> ⁇"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdeth nioser  .,\n\r;{}") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x250, 0xD7FF), rng.randint(0x10000, 0x1FFFF), 32, 101])) for _ in range(rng.randint(1, 20))) for _ in range(800)]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids)
        assert own.digest(t) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    for _ in range(300):  # ids that no encoder makes
        ids = [rng.choice([rng.randrange(3, 32000), 13, 200, 130]) for _ in range(6)]
        assert own.decode([i for i in ids if i > 258]) == library.decode([i for i in ids if i > 258])
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        want = Counter((d.doc_id, len(i := library.encode(d.text or "")), sha(",".join(map(str, i))), sha(library.decode(i))) for d in df.collect())
        assert Counter(map(tuple, sentencepiece_bpe.digest_documents(df, path).collect())) == want
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(odd, path), path).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)


# ------------------------------------------------ packing

def test_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    library, table, rng = Tokenizer.from_file(WORDS), WordTable(WordBpe(WORDS), [0], 500), random.Random(1)
    texts = ["", "a", "<|endoftext|> x<|startoftext|>y", "it's we'll DON'T", "ÀÉÎ ÿ ß ẞ İ ŉ", "á é", "x y z　w\x1cq\x85r", "１２ ①", "ﬁ Σας ΟΔΟΣ", "a\x00b", "== --- ... !!! #$%", "x..Σ y.Σ zΣ. A\u0301B\u0331 H\u0331,e=\u0338", "don't.'s x'-'t (É.È) é'É 1.2a3", "Ab<|endoftext|>Cd", "x" * 300 + "." * 99]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x250, 0xD7FF), 32, 10, 101, 39, 46, 44])) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for i in range(0, len(texts), 50):
        own = texts[i : i + 50]
        for given in ([t.encode() for t in own], table.encode_words.spread(*utf8(pa.array(own)))):
            _, ids, n, words = table.encode(given)
            stop = np.cumsum(n)[np.cumsum(words) - 1]
            for t, a, b in zip(own, np.concatenate(([0], stop[:-1])), stop):
                assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids + [0]


def test_packing(spark, sf, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows, want = packing.pack_documents(df, WORDS).collect(), Counter()
        for d in df.collect():
            ids = np.array(library.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
            for k, s in enumerate(range(0, len(ids), 2048)):
                want[d.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
        assert Counter(tuple(r)[:5] for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= sum(r.length for r in rows) / 2048 * 1.02 + 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS), WORDS).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    lengths = np.random.default_rng(4).integers(1, 101, 3000)
    cap = packing.Capacity(100, 3, 6000 + 100 * 100, (1.0, 0.5, 0.5), rule)
    where, offset = packing.best_fit(lengths, cap)
    for b in range(where.max() + 1):
        own = lengths[where == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 16000
        assert sorted(offset[where == b]) == sorted(np.cumsum(np.concatenate(([0], own[np.argsort(offset[where == b])][:-1]))))


def neighbours(lengths, where):
    """The next larger piece in the bin of each: bins have other numbers under another rule."""
    last, out = {}, {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        out[i], last[where[i]] = last.get(where[i]), i
    return out


def test_weights_steer_the_choice_and_cost_no_sequence():
    lengths = np.clip(np.random.default_rng(5).lognormal(5.3, 1.1, 8192).astype(int), 1, 2047)
    own, _ = packing.best_fit(lengths, packing.Capacity())
    scalar, _ = packing.best_fit(lengths, packing.Capacity(weights=(1.0, 0.0, 0.0)))
    a, b = neighbours(lengths, own), neighbours(lengths, scalar)
    assert own.max() == scalar.max() <= -(-lengths.sum() // 2048) and sum(a[i] != b[i] for i in a) > 0.03 * len(a)


@pytest.mark.parametrize("tight", [{"tokens": 90}, {"documents": 2}, {"attention": 8_200}])
def test_each_capacity_binds(tight):
    from dataclasses import replace

    lengths = np.random.default_rng(6).integers(1, 91, 2000)
    loose = packing.Capacity(120, 6, 12_000)
    more, _ = packing.best_fit(lengths, replace(loose, **tight))
    fewer, _ = packing.best_fit(lengths, loose)
    cap, bins = replace(loose, **tight), range(more.max() + 1)
    use = np.array([(lengths[more == b].sum(), (more == b).sum(), (lengths[more == b] ** 2).sum()) for b in bins])
    assert (use <= (cap.tokens, cap.documents, cap.attention)).all() and more.max() > fewer.max()


# ------------------------------------------------ top-k

def test_top_k_is_brute_force(spark, sf):
    import math

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, None), (2001, [1.0, None]), (2002, [math.inf] * 12), (2100, [math.nan]), (None, [1.0]), (2200, []), (2300, [0.0] * 12), (2400, [0.5] * 5), (100, rows[100][1]), (3000, [1e6] * 12), (3001, [-7.5] * 12)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ints", F.lit("clash"))
    for df, cut in ((made, (100, 7)), (spark.read.parquet(f"{sf}/embeddings.parquet"), (8192, 1024))):
        clean = {}
        for r in df.collect():
            if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
                clean.setdefault(r.vec_id, []).append([math.floor(1024 * float(x)) for x in r.embedding])
        want = {}
        for q, vs in clean.items():
            if q % 100 == 0:
                scored = [(-sum(a * b for a, b in zip(vs[0], v)), i) for i, own in clean.items() if i != q for v in own]
                want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:10])]
        ints = topk.integers(df)
        got = defaultdict(list)
        for r in topk.top_k(ints, ints.where("vec_id % 100 = 0"), 10, *cut).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert topk.search_embeddings(made.where("false")).count() == 0


# ------------------------------------------------ WARC

def test_archives(spark, sf):
    pages = [(1, "http://a/é x", "<p>ü</p>"), (2, None, "<p>ü</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>ü</p>"), (None, "v", "alone"), (9, "u", "big" * 100000), (9, "u", "big" * 100000), (10, "u", "HTTP/1.1 200\r\n\r\nx"), (5, "u", "a\r\n\r\nWARC/1.1\n1 2 3")]
    made = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("origin", F.lit("clash")).withColumn("key", F.lit(0))
    for df in (made, spark.read.parquet(f"{sf}/pages.parquet")):
        rows = df.collect()
        best = {}
        for r in rows:
            if r.page_id is not None:
                best[r.html or ""] = max(r.page_id, best.get(r.html or "", r.page_id))
        want = Counter()
        for r in rows:
            body = (r.html or "").encode()
            to = best.get(r.html or "")
            to = None if to == r.page_id else to
            want[r.page_id, len(body), warc.digest(body), "response" if to is None else "revisit", to] += 1
        for version in (1, 2):
            out = warc.read_archives(warc.write_archives(df, version, segment=2000)).collect()
            assert Counter(tuple(r)[:5] for r in out) == want
    assert warc.archive_pages(made.where("false")).count() == 0


def test_arc_lines():
    body = b"HTTP/1.0 404 Not Found\r\nA: b\r\n\r\nhello\n\n"
    for version in (1, 2):
        data = warc.arc_head(version, "f.arc", "20010203") + b"\n" + warc.arc_record(version, "http://x/a b", "1.2.3.4", "20010203040506", "text/html", body) + warc.arc_record(version, None, "0.0.0.0", "2001", "text/dns", b"")
        (fields, got), (last, none) = warc.read_arc(data)
        assert fields["URL"] == "http://x/a%20b" and got == body and none == b"" and last["URL"] == "-"
        (head, block), (bare, _) = warc.read_warc(warc.to_warc(fields, got) + warc.to_warc(last, none))
        assert head["WARC-Type"] == "response" and head["WARC-Date"] == "2001-02-03T04:05:06Z" and block == body
        assert head["WARC-Payload-Digest"] == "sha1:" + warc.digest(b"hello\n\n") and bare["WARC-Type"] == "resource"
        for bad in (data[:-4], data.replace(b" 200", b""), b"x y\n"):
            if bad != data:
                with pytest.raises(ValueError):
                    list(warc.read_arc(bad))


# ------------------------------------------------ chat

def test_tool_calls(spark):
    tool = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c)) for c in calls]})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", tool(("b", "add", {"y": 2, "x": 1}, ["a"]), ("a", "add", {"x": 1.5, "y": 1}, []))), (1, 2, "tool", '{"tool_call_id":"a","content":"say \\"é\\"\\n"}'),
        (1, 3, "tool", '{"tool_call_id":"a","content":"again"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"lost"}'), (1, 5, "assistant", tool(("c", "add", {"x": "1"}, ["b", "a", "gone"]), ("d", "nope", {}, None))),
        (2, 0, "assistant", tool(("p", "add", {"x": 1, "y": -1}, ["q"]), ("q", "add", [1], ["p"]))), (2, 1, "assistant", "plain"), (2, None, None, None), (None, 1, "assistant", tool(("a", "add", {"x": 1, "y": 0}, []))),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(9))
    schemas = spark.createDataFrame([("add", "x", "integer", True, None), ("add", "y", "number", True, 0.0)], chat.SCHEMA)
    calls, results = chat.parse_messages(messages)
    got = {(r.conv_id, r.call_id): r for r in chat.link(calls, results, schemas).collect()}
    at = lambda c: (got[1, c].level, got[1, c].position, got[1, c].error, got[1, c].n_results)
    assert at("a") == (0, 0, "x is no integer", 2) and at("b") == (1, 2, None, 0) and at("d") == (0, 1, "unknown tool", 0) and at("c") == (2, 3, "x is no integer", 0)
    assert got[2, "p"].level is None and got[2, "p"].error == "y is below its minimum" and got[2, "q"].error == "arguments are no object" and got[None, "a"].error is None
    assert got[1, "b"].call_json == '{"arguments":{"x":1,"y":2},"id":"b","name":"add"}' and got[1, "a"].result_json == '{"content":"say \\"é\\"\\n","tool_call_id":"a"}'
    assert [r.call_id for r in chat.orphans(calls, results).collect()] == ["zz"]
    assert chat.format_conversations(messages.where("false")).count() == 0


def test_conversations_without_an_identifier_are_like_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(None, 4, "assistant", "one two"), (None, 70, "assistant", "x"), (None, 5, "user", "no result"), (None, 200, "assistant", None), (3, 1, "assistant", "a b"), (3, 2, "user", "c"), (3, 3, "assistant", "d e"), (None, None, "assistant", "f")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["op8_chat_tool_linking"])
    got = entry.queries()["op8_chat_tool_linking"](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ------------------------------------------------ pipeline

def test_pipeline(spark, sf):
    import corpus_pipeline as pipe
    from test_sharding_quality_jaccard import base, brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipe.STAGES)
    good = stages["quality_rules"](spark, docs.withColumn("uid", F.lit(1)).withColumn("kept", F.lit(False)), sf).collect()
    assert Counter(good) == Counter(d for d in docs.select(*pipe.COLUMNS).collect() if not base(d.text)[-1])  # no line is frequent here
    known = stages["language_id"](spark, spark.createDataFrame(good, DOCS), sf).collect()
    assert Counter(known) == Counter(d for d in good if re.search(r"[^\W\d_]", d.text))
    once = stages["near_duplicates"](spark, spark.createDataFrame(known + known[:3], DOCS), sf).collect()
    groups = brute(known, pipe.WORDS, pipe.NUM, pipe.DEN)
    assert Counter(d.doc_id for d in once) == Counter(i for i, _, c in groups if i == c)
    packed = pipe.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {d.doc_id for d in once}


def test_language_stage_rejects_what_is_not_of_its_language(spark, sf):
    import corpus_pipeline as pipe

    rng = random.Random(8)
    docs = [d for d in spark.read.parquet(f"{sf}/documents.parquet").select(*pipe.COLUMNS).collect() if len((d.text or "").split()) >= 50]
    clean = {d.doc_id for d in pipe.language_id(spark, spark.createDataFrame(docs, DOCS), sf).collect()}
    assert clean == {d.doc_id for d in docs}
    by = defaultdict(list)
    for d in docs:
        by[d.lang].append(d.text.split())
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa " * 4
    half = lambda a, b: " ".join(x for pair in zip(max(by[a], key=len)[:300], max(by[b], key=len)[:300]) for x in pair)
    bad = [(-1, " ".join(letters() for _ in range(200)), "en", "a", 1), (-2, polish, None, "a", 1), (-3, half("en", "de"), "en", "a", 1), (-4, half("fr", "es"), None, "a", 1), (-5, " ".join(max(by["de"], key=len)[:300]), "fr", "a", 1)]
    good = [(-6, " ".join(max(by["de"], key=len)[:300]), None, "a", 1), (-7, " ".join(max(by["es"], key=len)[:60]), "es", "a", 1)]
    got = pipe.language_id(spark, spark.createDataFrame([*map(tuple, docs), *bad, *good], DOCS), sf).collect()
    assert Counter(d.doc_id for d in got) == Counter([*clean, -6, -7])


@pytest.mark.parametrize("stage", ["quality_rules", "language_id", "near_duplicates", "best_fit_packing"])
def test_stages_take_odd_tables(spark, sf, stage):
    import corpus_pipeline as pipe

    run, clash = dict(pipe.STAGES)[stage], [F.lit(7).alias(c) for c in ("uid", "component", "lang_pred", "score", "kept", "piece", "__left", "host", "node")]
    for rows in ([], [(i, None, None, None, None) for i in (1, 1, None)], ODD):
        docs = spark.createDataFrame(rows, DOCS).select("*", *clash)
        got = run(spark, docs, sf).collect()
        if stage == "best_fit_packing":
            assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
        elif stage == "near_duplicates":  # one row of each distinct text but those without words, which all stay
            words = [(i, (t or "").lower().split()) for i, t, *_ in rows]
            kinds = {" ".join(w) for _, w in words if w}
            assert len(got) == len(kinds) + sum(not w for _, w in words) and set(got) <= {tuple(r) for r in rows}
        elif stage == "language_id":
            assert Counter(map(tuple, got)) - Counter(rows) == Counter() and all(r.text and any(c.isalpha() for c in r.text) for r in got if any(x[2] for x in rows))
        else:
            assert Counter(map(tuple, got)) == Counter(r for r in rows if not base_of(r[1]))


def base_of(text):
    from test_sharding_quality_jaccard import base

    return base(text)[-1]


# ------------------------------------------------ registration

def test_registered_and_like_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    names, sql, sf = entry.queries(), entry.oracle_sql(), "/root/testdata/sf0.001"
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in [n for n in sql if re.match(r"op\d+_", n)]:
        got, want = names[name](spark, sf), con.sql(sql[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[c] for c in columns) for r in rows), name
