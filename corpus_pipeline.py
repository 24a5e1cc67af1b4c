"""Documents to packed sequences: quality rules, language ID, near duplicates, best-fit packing.

Each stage takes what its predecessor kept, as documents (doc_id, text, lang, source, n_chars), and all but the last
return the kept rows with those columns.  No stage reads more of sf_dir than the documents it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.language import predict, train
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import clean

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Nats a position (a bigram and a trigram): a document is rejected whose best language is less than MARGIN above the
#: next or whose text is more than FIT below that language's own, and so is one without a letter.
MARGIN, FIT = 2.0, -5.0
#: Texts of a host a line may stand in however small the host is; beyond, the share of the host's texts decides.
MIN_DOCS = 5
#: Near duplicates share four fifths of their five-word shingles.
WORDS, NUM, DEN = 5, 4, 5

#: Neither merges of a tokenizer nor learned models have an SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are not depleted, without the boilerplate lines of their host.

    A null text fails; a null source is a host of its own; repeated rows stay or go alike; no rows, none kept.
    """
    return clean(docs.select(*COLUMNS), min_docs=MIN_DOCS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is certain and is the one they state, if any; learned from all rows that state one.

    Nothing goes where none does, so neither from an empty table nor from one without languages; elsewhere a null text
    and one without a letter go.  Repeated rows count each.
    """
    model = train(docs)
    if not model.langs:
        return docs.select(*COLUMNS)
    certain = (F.col("lang_pred") != "und") & (F.col("margin") >= MARGIN) & (F.col("fit") >= FIT)
    stated = F.coalesce(F.col("lang_pred") == F.col("lang"), F.lit(True))
    return predict(docs.select(*COLUMNS), model, measures=True).where(certain & stated).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id.

    Rows are told apart by their place in ``docs``, which must be a table that is read the same each time, as what a
    stage has written is.  Rows without words (null, empty, blank) link with nothing and all stay; of repeated rows one
    stays; a row without a doc_id stays only for a group that has none.
    """
    rows = docs.select(*COLUMNS).withColumn("uid", F.monotonically_increasing_id())
    groups = jaccard_components(rows.select(F.col("uid").alias("doc_id"), "text"), WORDS, NUM, DEN).select(F.col("doc_id").alias("uid"), F.col("component_id").alias("component"))
    first = rows.select("uid", "doc_id").join(groups, "uid").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("uid"))
    return rows.join(first, "uid", "left_semi").select(*COLUMNS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2048 tokens; a row without text is one piece, its end."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; columns beside COLUMNS are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
