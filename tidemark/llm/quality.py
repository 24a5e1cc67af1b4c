"""Quality rules with cross-document line frequency.

A line is normalised (A-Z lowered, white space collapsed, digits made 0) and hashed.  A line that stands in more than
``max(min_docs, share of the host's distinct documents)`` distinct documents of one host is boilerplate there and is
removed from every document of it (``clean``); a document that keeps too few of its words is depleted and rejected.
Documents are distinct by their text: rows of equal text are one document however many identifiers it has, or every
text that is copied often enough would be rejected with all of its copies, which the near-duplicate stage reduces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import _LOWER, _SPACE, chunks, materialise, mix, runs_hash, utf8, words_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_PLAIN = _LOWER.copy()
_PLAIN[48:58] = 48

#: Documents of a host a line may stand in however small the host is; beyond, the share of the host's documents decides.
MIN_DOCS = 5

FEATURES = "doc_id long, host string, text_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"


def _repeat_words(h: np.ndarray, row: np.ndarray, n_rows: int, width: int = 3) -> np.ndarray:
    """Per row: words that lie in windows of ``width`` words which occur twice or more in the row."""
    full = len(h) - width + 1
    if full <= 0:
        return np.zeros(n_rows, np.int64)
    same = row[:full] == row[width - 1 :]
    g = mix(row[:full].astype(np.uint64) + np.uint64(1))
    for j in range(width):
        g = mix(g + h[j : j + full])
    at = np.flatnonzero(same)
    order = at[np.argsort(g[at], kind="stable")]
    s = g[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    hit = np.zeros(len(h), bool)
    for j in range(width):
        hit[order[twin] + j] = True
    return np.bincount(row[hit], minlength=n_rows)


def _line_hashes(part: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the non-empty lines of rows: start (with a byte before each row), row, exact and normalised hash."""
    n = len(rel) - 1
    spaced = np.insert(part, rel[:-1], 10)
    ls, _, exact = runs_hash(spaced, spaced != 10)
    line_row = np.searchsorted(rel[:-1] + np.arange(n), ls, "right") - 1
    plain, prow, pstart, _ = words_of(_PLAIN[part], rel, False)
    pin = np.searchsorted(ls, pstart + prow + 1, "right") - 1
    words = np.bincount(pin, minlength=len(ls))
    first = np.concatenate(([0], np.cumsum(words)[:-1])) if len(words) else np.zeros(0, np.int64)
    rank = (np.arange(len(plain)) - first[pin]).astype(np.uint64) if len(plain) else np.zeros(0, np.uint64)
    normal = np.zeros(len(ls), np.uint64)
    np.add.at(normal, pin, mix(plain + mix(rank)))
    return ls, line_row, exact, normal


def _chunk(data: np.ndarray, at: np.ndarray) -> dict:
    n, base = len(at) - 1, at[0]
    part = data[base : at[-1]]
    rel = at - base
    h, row, start, _ = words_of(data, at, False)
    per_byte = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[rel])
    n_words = np.bincount(row, minlength=n)
    chars = per_byte(~_SPACE[part] & ~_TAIL[part])
    symbols = per_byte(_SYMBOL[part])
    # lines: exact hashes for repeats inside the document, normalised hashes across documents
    ls, line_row, exact, normal = _line_hashes(part, rel)
    in_line = np.searchsorted(ls, start + row + 1, "right") - 1
    words = np.bincount(in_line, minlength=len(ls))
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_repeat_words": _repeat_words(h, row, n), "n_dup_lines": [], "line_hash": [], "line_words": []}
    bound = np.searchsorted(line_row, np.arange(n + 1))
    for i in range(n):
        k = slice(bound[i], bound[i + 1])
        has = words[k] > 0
        own = exact[k][has]
        out["n_dup_lines"].append(len(own) - len(np.unique(own)))
        kinds, inverse = np.unique(normal[k][has], return_inverse=True)
        out["line_hash"].append(kinds.view(np.int64))
        out["line_words"].append(np.bincount(inverse, weights=words[k][has], minlength=len(kinds)).astype(np.int32))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, j in chunks(at):
            f = _chunk(data, at[i : j + 1])
            flat = lambda k, t: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in f[k]]))).astype(np.int32)), pa.array(np.concatenate(f[k]), t))
            longs = lambda k: pa.array(np.asarray(f[k], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), batch.column("host").slice(i, j - i).cast(pa.string()), batch.column("text_id").slice(i, j - i),
                 longs("n_words"), longs("word_chars"), longs("n_symbols"), longs("n_dup_lines"), longs("n_repeat_words"), flat("line_hash", pa.int64()), flat("line_words", pa.int32())],
                names=["doc_id", "host", "text_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
            )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of ``__lines``; ``__left`` counts the words that stay, and is null where no line goes."""
    for batch in batches:
        text, gone = batch.column("text").cast(pa.string()).to_pylist(), batch.column("__lines")
        left: list[int | None] = [None] * len(text)
        hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        if len(hit):
            data, at = utf8(batch.column("text").take(pa.array(hit)))
            for i, j in chunks(at):
                rel = at[i : j + 1] - at[i]
                _, line_row, _, normal = _line_hashes(data[at[i] : at[j]], rel)
                bound = np.searchsorted(line_row, np.arange(j - i + 1))
                for k in range(j - i):
                    row = int(hit[i + k])
                    drop = iter(np.isin(normal[bound[k] : bound[k + 1]].view(np.int64), np.array(gone[row].as_py(), np.int64)).tolist())
                    stay = b"\n".join(x for x in data[at[i + k] : at[i + k + 1]].tobytes().split(b"\n") if not (x and next(drop)))
                    text[row], left[row] = stay.decode("utf-8", "replace"), len(stay.split())
        at_text = batch.schema.get_field_index("text")
        out = batch.set_column(at_text, "text", pa.array(text, pa.string())).drop_columns(["__lines"])
        yield out.append_column("__left", pa.array(left, pa.int64()))


_KEY = ["__id", "__host", "__text"]


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """Rows of the same identifier, host and text are judged and cleaned alike."""
    return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__host": F.col(host).cast("string"), "__text": F.xxhash64(F.col("text").cast("string"))})


def _same(a: str, b: str):
    on = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in _KEY]
    return on[0] & on[1] & on[2]


def _stripped(rows: DataFrame) -> DataFrame:
    schema = T.StructType([*(T.StructField("text", T.StringType()) if f.name == "text" else f for f in rows.schema if f.name != "__lines"), T.StructField("__left", T.LongType())])
    return rows.mapInArrow(_strip, schema)


def _judged(docs: DataFrame, host: str, min_docs: int, share: float, min_words: int, max_repeat: float) -> tuple[DataFrame, DataFrame]:
    """Counts of each row with ``base_failed``, and its lines to remove (row_id, key, line, words)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_id"))
    feats = materialise(rows.mapInArrow(_features, FEATURES).withColumn("row_id", F.monotonically_increasing_id()), "quality")
    lines = feats.select("row_id", "doc_id", "host", "text_id", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("row_id", "doc_id", "host", "text_id", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    hosts = feats.select("host", "text_id").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    seen = lines.select("host", "line", "text_id").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    frequent = seen.alias("s").join(hosts.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host"))).where(F.col("n") > F.greatest(F.lit(min_docs), F.col("texts") * share)).select(F.col("s.host").alias("fhost"), F.col("line").alias("fline"))
    gone = lines.join(frequent, F.col("host").eqNullSafe(F.col("fhost")) & (F.col("line") == F.col("fline")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return feats.drop("line_hash", "line_words").withColumn("base_failed", failed), gone


def quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = 0.005, keep_share: float = 0.3, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``n_removed_words`` and ``kept``.

    A null text counts as none (no words, so it fails); a null host is a host of its own; repeated rows and repeated
    doc_ids are each judged alone; an empty table gives no rows; other columns are not read.  ``n_removed_words`` is
    what the text that ``clean`` hands on has fewer; it is summed from the lines, so no text is moved for it.
    """
    feats, gone = _judged(docs, host, min_docs, share, min_words, max_repeat)
    removed = gone.groupBy("row_id").agg(F.sum("words").alias("n_removed_words"))
    out = feats.join(removed, "row_id", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_removed_words") < keep_share * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = 0.005, keep_share: float = 0.3, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, without the frequent lines of their host; all columns stay.

    A null text fails the base rules and goes; a null host is a host of its own; rows of the same identifier, host and
    text are judged alike and each stay or go; an empty table stays empty.  A line goes with its line break.
    ``n_chars``, where there is one, is counted anew for a text that lost a line.
    """
    feats, gone = _judged(docs, host, min_docs, share, min_words, max_repeat)
    judged = feats.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("text_id").alias("__text"), "base_failed", "n_words").distinct()
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("text_id").alias("__text")).agg(F.collect_set("line").alias("__lines"))
    verdict = judged.alias("j").join(gone.alias("g"), _same("j", "g"), "left").select("j.*", "__lines").where(F.col("base_failed") | F.col("__lines").isNotNull())
    verdict = verdict.withColumnsRenamed({"base_failed": "__failed", "n_words": "__words"})
    rows = _keyed(docs, host).alias("d").join(verdict.alias("v"), _same("d", "v"), "left").where(~F.coalesce("__failed", F.lit(False)))
    out = _stripped(rows.select(*(F.col(f"d.`{c}`") for c in docs.columns), "__words", "__lines"))
    out = out.where(F.col("__left").isNull() | (F.col("__left") >= keep_share * F.col("__words")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__left").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_documents(docs: DataFrame) -> DataFrame:
    """The counts and the verdict of ``quality`` with its defaults, by the ``source`` of a document."""
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")
