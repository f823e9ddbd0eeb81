"""A corpus pipeline of five of the operators, each stage written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atomspan.llm import decontamination, language_id, similarity_join, toxicity, viterbi
from atomspan.llm._shared import stored
from atomspan.llm.language_id import crc_mod
from atomspan.llm.queries import piece_model

#: Below this score no language is clearly nearer than the next.
LEAST_LANGUAGE_SCORE = 0.51


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with names that no operator gives to a column of its own."""
    return docs.toDF(*[f"__doc_{c}" for c in docs.columns])


def _back(docs: DataFrame) -> list:
    """The columns of ``docs`` out of :func:`_apart`, in their order and with their names."""
    return [F.col(f"`__doc_{c}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; those without a letter or near to no language go."""
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = language_id.detect(_apart(docs), model, "__doc_text", keep_text=True)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*_back(docs))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, doesn't take for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return toxicity.score(_apart(docs), model, "__doc_text", keep_text=True).where("tox_score < 0.5").select(*_back(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of Jaccard 0.8 or more on five-word shingles connect."""
    return similarity_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with an item of ``benchmark``."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids and ids of each document."""
    return viterbi.encode(docs.select("doc_id", "lang", "source", "text"), piece_model(), columns=("n_ids", "ids"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Trained models and Viterbi ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
