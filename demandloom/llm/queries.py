"""The registered corpus queries, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.attention_lm import score_documents
from demandloom.llm.byte_bpe import encode_documents
from demandloom.llm.chat import format_conversations
from demandloom.llm.divergence import source_divergence
from demandloom.llm.exact_dedup import exact_dedup
from demandloom.llm.filter_audit import filter_audit
from demandloom.llm.jaccard import jaccard_components
from demandloom.llm.mixture import pack_mixture
from demandloom.llm.near_vectors import near_vectors
from demandloom.llm.packing import pack_documents
from demandloom.llm.pii import find_pii
from demandloom.llm.quality import score_quality
from demandloom.llm.shared import read_documents
from demandloom.llm.toxicity import fit_toxicity, score_toxicity

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn

    return add


@register("op1_exact_dedup", """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
     equal AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM texts JOIN equal USING (body)
""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read_documents(spark, folder))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_documents(spark, folder)
    model = fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score_toxicity(docs, model)


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@register("op10_pii")
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(read_documents(spark, folder))


@register("op4_chat_formatting", r"""
WITH given AS (SELECT conv_id, turn, role, text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
               UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
     written AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS text_chars,
                        length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS role_chars
                 FROM plain)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_chars + 2 + text_chars + 9) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
""")
def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return format_conversations(spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra))


@register("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(read_documents(spark, folder))


@register("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(read_documents(spark, folder), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op2_embedding_near_dedup")
def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


@register("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(read_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@register("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The source is the host, and its part in one language the path below it."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return score_quality(read_documents(spark, folder), labels, F.col("source"), F.col("lang"))


@register("op13_mixture_packing")
def op13_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Without targets: every sequence holds the sources in their shares of all tokens."""
    return pack_mixture(read_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@register("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM d),
     f AS (SELECT doc_id, part, [x FOR x IN [
             CASE WHEN len(words) < 200 THEN 'A' END,
             CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
             CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
             CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
             CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END] IF x IS NOT NULL] AS fails FROM w),
     l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
     m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
           FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
     o AS (SELECT [a.c, b.c, c.c, d.c, e.c] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
     s AS (SELECT o, step, o[step] AS own, o[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
     r AS (SELECT *, list_contains(fails, own) AS here, list_has_any(fails, earlier) AS gone FROM m, s),
     a AS (SELECT part, o, step, own, sum(n) FILTER (NOT here AND NOT gone) AS kept, sum(n) FILTER (here AND NOT gone) AS removed,
                  sum(n) FILTER (here AND gone) AS redundant, sum(n) FILTER (fails = [own]) AS unique_fails,
                  sum(n_good) FILTER (here AND NOT gone) AS good_lost, sum(n_toxic) FILTER (here AND NOT gone) AS toxic_lost
           FROM r GROUP BY 1, 2, 3, 4)
SELECT part, array_to_string(o, '') AS filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM a
""")
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(read_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@register("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
     w AS (SELECT id, lang, source, unnest(regexp_extract_all(
             translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
     v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
     t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
     p AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS BIGINT) AS p,
                  CAST(1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS BIGINT) AS q
           FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
     f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
""")
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(read_documents(spark, folder))
