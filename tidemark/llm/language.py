"""Language identification: multinomial naive Bayes over hashed character bigrams and trigrams.

Letters are lowered and everything else is a space.  Counts of all training documents are summed per language in two
levels; the matrix of log probabilities (buckets x languages, so bounded by the languages) is broadcast, and batches
are scored by gathering and summing its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fan_in
from tidemark.llm.tokens import slices

BITS = 16
_LETTERS: list[np.ndarray] = []


def _plain(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters, and 32 for the rest."""
    if not _LETTERS:
        lut = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                lut[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(lut)
    out = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        kinds, inverse = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in kinds.tolist()], np.uint32)[inverse]
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of bigrams, of trigrams, and first and last position of each text); a text without letters has none."""
    size = np.array([len(t or "") for t in texts], np.int64)
    codes = np.frombuffer(("  " + "  ".join(t or "" for t in texts) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
    a = _plain(codes)
    start = 1 + np.concatenate(([0], np.cumsum(size + 2)[:-1]))  # the space before the text
    stop = start + size + 1
    letters = np.concatenate(([0], np.cumsum(a != 32)))
    stop = np.where(letters[stop] > letters[start], stop, start)
    two = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77))
    three = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    down = np.uint32(32 - BITS)
    fold = lambda h: ((h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> down
    return fold(two), fold(three), start, stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for i, j in slices(texts):
            two, three, start, stop = grams(texts[i:j])
            kinds, code = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
            n = stop - start
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)
            lane = np.repeat(code, n) << BITS
            own = np.bincount(lane + two[at], minlength=len(kinds) << BITS) + np.bincount(lane + three[at], minlength=len(kinds) << BITS)
            for k, lang in enumerate(kinds.tolist()):
                held[lang] = held.get(lang, 0) + own[k << BITS : (k + 1) << BITS]
                docs[lang] = docs.get(lang, 0) + int((code == k).sum())
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in held.values()], pa.binary()), pa.array([docs[x] for x in held], pa.int64())], names=["lang", "counts", "docs"])


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << BITS, np.int64)
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary()), "docs": [sum(table.column("docs").to_pylist())]})


class Model:
    """Languages, their log priors, and log probabilities by language and bucket."""

    def __init__(self, rows: list, alpha: float = 0.1):
        rows = sorted(rows, key=lambda r: r.lang)
        self.langs = [r.lang for r in rows]
        counts = [np.frombuffer(r.counts, np.int64) for r in rows]
        self.logp = [np.log((c + alpha) / (c.sum() + alpha * len(c))).astype(np.float32) for c in counts]
        docs = np.array([r.docs for r in rows], float)
        self.prior = np.log(docs / docs.sum()) if len(rows) else docs
        #: what a position (a bigram and a trigram) of a language's own texts has on average
        self.own = np.array([2 * float((np.exp(p.astype(float)) * p).sum()) for p in self.logp])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, and what does not grow with a text's length: ``fit``, the log probability a position in
        the language above that of its own texts, and ``margin``, that above the next language (inf without one).
        """
        two, three, start, stop = grams(texts)
        has = stop > start
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        fit, margin = np.full(len(texts), -np.inf), np.zeros(len(texts))
        if self.langs and has.any():
            cuts = np.stack([start[has], stop[has]], 1).ravel()
            total = np.empty((int(has.sum()), len(self.langs)))
            size = (stop - start)[has]
            for k, p in enumerate(self.logp):
                both = np.add.reduceat(p[two].astype(np.float64) + p[three], cuts)[::2]
                total[:, k] = both + self.prior[k]
            each = (total - self.prior) / size[:, None]
            best = total.argmax(1)
            odds = np.exp(total - total.max(1, keepdims=True))
            lang[has] = np.array(self.langs, object)[best]
            score[has] = odds.max(1) / odds.sum(1)
            top = each[np.arange(len(each)), best]
            each[np.arange(len(each)), best] = -np.inf
            fit[has], margin[has] = top - self.own[best], top - each.max(1)
        return lang.tolist(), score, fit, margin


def train(docs: DataFrame, alpha: float = 0.1, most: int = 512) -> Model:
    """Counts over all rows of ``docs`` (text, lang) that have a language.

    A language takes 512 KB of counts, so more than ``most`` are refused: such a column is no language.
    """
    rows = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = "lang string, counts binary, docs long"
    part = rows.mapInArrow(_count, schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(fan_in(rows.rdd.getNumPartitions()))))
    found = part.groupBy("lang", "lane").applyInArrow(_sum, schema).groupBy("lang").applyInArrow(_sum, schema).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    return Model(found, alpha)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, measures: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if none are named; ``text`` must be there) and lang_pred, score; with
    ``measures`` also fit and margin.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if no language was learned.
    Columns of those names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = ["lang_pred", "score", "fit", "margin"][: 4 if measures else 2]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    keep = keep or docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts):
                lang, *numbers = sent.value.predict(texts[i:j])
                own = [batch.column(c).slice(i, j - i) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), *map(pa.array, numbers[: len(made) - 1])], names=[*keep, *made])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in made[1:])])
    return docs.mapInArrow(run, schema)


def fold(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def language_documents(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Predictions for every row of ``docs`` (doc_id, text, lang); documents of the held-out fold are not learned from.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no row to learn from has a
    language.  A null doc_id counts as an empty one for the fold; repeated rows count and are predicted each; of
    languages that are equally likely the first by name wins; other columns are not read.
    """
    model = train(docs.where(fold(folds) != held).select("text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model, ["doc_id", "held_out"])
