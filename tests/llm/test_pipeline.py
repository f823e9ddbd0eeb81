import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_text_operators import brute_hits, brute_join, words_of  # noqa: E402

from atomspan.llm import language_id, viterbi  # noqa: E402
from atomspan.llm._shared import stored  # noqa: E402
from atomspan.llm.queries import piece_model  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_duplicates", "decontamination", "sentencepiece"]
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SMALL), name)
        if name != "sentencepiece":
            assert docs.columns == before.columns
            kept.append({r.doc_id: r.text for r in docs.collect()})
            assert kept[-1].items() <= kept[-2].items()
    start, spoken, clean, single, fresh = kept
    # Documents in some language stay; labelled toxic ones go, labelled clean ones stay, but for a few.
    assert len(spoken) >= 0.97 * len(start)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    wrong = sum((i in clean) == bool(t) for i, t in toxic.items() if i in spoken)
    assert wrong <= 0.1 * len(toxic)
    groups = brute_join(list(clean.items()))
    assert set(single) == {groups.get(i, (i, 0))[0] for i in clean}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(fresh) == {i for i, t in single.items() if not brute_hits(t, items)[1]}
    back = viterbi.decode(docs, piece_model())
    assert {r.doc_id: r.text for r in back.select("doc_id", "text").collect()} == {i: t.replace("▁", " ") for i, t in fresh.items()}


EXTRA = ("lang_pred", "lang_score", "lang_bits", "tox_score", "tox_lang", "n_words", "bench_hits", "class_id", "k", "t", "text_")


def folder_of(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(5000, None), (5001, ""), (5002, "  \n 123 ..."), (None, "0 1 2"), (5003, "y")]
    plain = [r for r in docs.orderBy("doc_id").collect() if r.text and 200 < len(r.text) < 2000][:2]
    odd += [(6000, plain[0].text), (6001, "".join(c.upper() if c.isascii() else c for c in plain[0].text)), (7000, "word " * 30000), (None, plain[1].text)]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    every = docs.unionByName(docs.where(F.col("doc_id") == plain[1].doc_id)).unionByName(more)
    for c in EXTRA:
        every = every.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    place = folder_of(spark, tmp_path, every)
    now = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stored(stage(spark, before, place), name)
        assert now.columns == before.columns
        rows, known = now.collect(), {tuple(r) for r in before.collect()}
        assert {tuple(r) for r in rows} <= known and rows
        assert all(r[c] == c + str("null" if r.doc_id is None else r.doc_id) for r in rows for c in EXTRA)
        if name == "language_id":
            assert not {5000, 5001, 5002} & {r.doc_id for r in rows}
        if name == "near_duplicates":
            # Copies in other cases, repeated rows and a null key are one document.
            sets = [tuple(words_of(r.text)) for r in rows]
            assert len(sets) == len(set(sets))
            assert sum(r.doc_id in (6000, 6001, plain[0].doc_id) for r in rows) <= 1
    out = corpus_pipeline.STAGES[-1][1](spark, now, place).collect()
    assert len(out) == now.count() and all(r.n_ids == len(r.ids) > 0 for r in out)


def test_an_empty_corpus(spark, tmp_path):
    place = folder_of(spark, tmp_path, spark.read.parquet(f"{SMALL}/documents.parquet").limit(0))
    assert corpus_pipeline.run(spark, place).collect() == []


def test_texts_near_to_no_language_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    r = random.Random(22)
    junk = [(8000 + k, "".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(600)), None, None, None) for k in range(20)]
    every = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {x.doc_id for x in corpus_pipeline.identify_language(spark, every, SMALL).select("doc_id").collect()}
    scores = {x.doc_id: x for x in language_id.detect(every, language_id.fit(every.where(language_id.crc_mod("doc_id", 4) != 2))).collect()}
    assert kept == {i for i, x in scores.items() if x.lang_pred != "und" and x.lang_score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    own = {x.doc_id for x in docs.where("text is not null").collect()}
    assert len(own & kept) >= 0.97 * len(own) and sum(i in kept for i, *_ in junk) < len(junk) / 2
