"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 16)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import search_embeddings

    return search_embeddings(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import language_documents

    return language_documents(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality_documents

    return quality_documents(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.sentencepiece_bpe import digest_documents

    return digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_chat_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import format_conversations

    return format_conversations(_table(spark, sf_dir, "conversations"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_bit_sliced_topk": op4_bit_sliced_topk,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_chat_tool_linking": op8_chat_tool_linking,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc": op10_warc,
}

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(regexp_split_to_array({0}, '" + _SPACE + "'), lambda w: w <> '')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"
_TEXT = "coalesce(text, '')"

#: Hashing, tokenizers and learned models have no SQL form: those queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format(_TEXT))} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM s LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id) USING (doc_id)""",
    "op4_bit_sliced_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS i FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.i, v.i), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 10""",
    "op6_quality_rules": f"""WITH d AS (SELECT doc_id, source, {_TEXT} AS t, {_WORDS.format(_TEXT)} AS w FROM documents),
        k AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d), g AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL), h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
        l AS (SELECT doc_id, source, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        u AS (SELECT doc_id, source, t, {_WORDS.format(_PLAIN.format("x"))} AS p FROM (SELECT doc_id, source, t, unnest(l) AS x FROM l)),
        f AS (SELECT source, p FROM (SELECT source, p, count(DISTINCT t) AS n FROM u GROUP BY source, p) JOIN (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source) USING (source) WHERE n > greatest(5, 0.005 * texts)),
        m AS (SELECT doc_id, sum(len(p)) AS n FROM u JOIN f USING (source, p) GROUP BY doc_id),
        b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words, coalesce(m.n, 0) AS n_removed_words
          FROM d JOIN (SELECT doc_id, l FROM l) l USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CAST(n_removed_words AS BIGINT) AS n_removed_words, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM b""",
    "op8_chat_tool_linking": f"""WITH m AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, {_TEXT} AS t, {_WORDS.format(_TEXT)} AS w FROM conversations WHERE turn IS NOT NULL),
        a AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS root, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, 'call-' || turn AS call_id FROM m WHERE role = 'assistant'), u AS (SELECT conv_id, turn, t FROM m WHERE role = 'user')
        SELECT a.conv_id, call_id, a.turn, CAST(a.turn > root AS INTEGER) AS level, CAST(position AS BIGINT) AS position, 'reply' AS name, length(a.t) >= 1 AND len(w) >= 2 AS valid, CASE WHEN length(a.t) < 1 THEN 'chars is below its minimum' WHEN len(w) < 2 THEN 'words is below its minimum' END AS error,
        u.turn AS result_turn, CAST(u.turn IS NOT NULL AS BIGINT) AS n_results, '{{"arguments":{{"chars":' || length(a.t) || ',"first":' || CAST(to_json(coalesce(w[1], '')) AS VARCHAR) || ',"words":' || len(w) || '}},"id":"' || call_id || '","name":"reply"}}' AS call_json,
        CASE WHEN u.turn IS NOT NULL THEN '{{"content":' || CAST(to_json(u.t) AS VARCHAR) || ',"tool_call_id":"' || call_id || '"}}' END AS result_json FROM a LEFT JOIN u ON a.conv_id = u.conv_id AND u.turn = a.turn + 1""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(t), CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
        CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM p""",
}
