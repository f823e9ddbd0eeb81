"""The registered queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, hmm, language_id, license_scan, quotes, similarity_join, token_counts, topk, toxicity, viterbi
from .language_id import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2))
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return language_id.detect(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op2_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontamination.find(docs.select("doc_id", "text"), bench)
    hit, items = decontamination.n_hit(F.col("bench_hits")), decontamination.items(F.col("bench_hits"))
    found = found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, s + 1, s + 10) AS win, least(len(w), 10) AS k
       FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
p AS (SELECT r, k, list_slice(w, s + 1, s + k) AS win, s
      FROM (SELECT r, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS s FROM d, k)),
h AS (SELECT p.r, p.s, p.k, bw.item_id FROM p JOIN bw ON p.win = bw.win),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS x FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""



def piece_model() -> str:
    """The SentencePiece model that these queries take; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, piece_model()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return viterbi.encode(docs, piece_model(), columns=("n_ids", "ids_crc32", "round_trip"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.as_chat(quotes.conversations(_table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "role", "parent_turn", "by_quote", "depth", "thread", "position", F.sha2("chat", 256).alias("chat_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), license_scan.notices(spark))
    return found.select("doc_id", "template", F.col("shared").cast("long").alias("shared"), F.round("containment", 6).alias("containment"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    model, counts = hmm.fit(docs.where(crc_mod("doc_id", 7) != 2))
    return hmm.score(docs, model, counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_similarity_join": op2_similarity_join,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quotes": op8_quotes,
    "op9_license_scan": op9_license_scan,
    "op10_hmm": op10_hmm,
}
ORACLE_SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op5_topk": OP5_SQL}
