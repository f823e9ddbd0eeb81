import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atomspan.llm import _pieces, _text, decontamination, hmm, language_id, license_scan, quotes, similarity_join, token_counts, topk, toxicity, viterbi
from atomspan.llm import queries as llm_queries
from atomspan.llm._text import ALNUM, NON_SPACE, blocks, split_words

try:
    import sentencepiece as spm
    from public_tokenizers import path as _path

    PATH = _path("piece_bpe_32k.model")
except ImportError:
    spm = PATH = None
needs_model = pytest.mark.skipif(PATH is None, reason="there is no tokenizer model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "  a  b ", "\n\n", "a" * 300, "Été—ça va? 語😀", "▁x▁", "\x00\x01", "word " * 3000]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("table", [ALNUM, NON_SPACE])
def test_words_of_blocks(table):
    texts = ODD + ["One two", "two ONE"]
    got = []
    for _, _, data, offsets in blocks(pa.array([*texts, None]), 64):
        w = split_words(data, offsets, table)
        got += [[data[a:b].tobytes() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    pattern = rb"[0-9A-Za-z\x80-\xff]+" if table is ALNUM else rb"[^\x20\x09-\x0d]+"
    assert got == [re.findall(pattern, (t or "").encode()) for t in [*texts, None]]


def parse(text, train):
    n = i = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        i, n = i + max(k, 1), n + 1
    return n


def test_cross_parsing_equals_brute_force():
    r = random.Random(1)
    squeeze = lambda t: re.sub(" +", " ", t).strip()
    train = {k: squeeze("".join(r.choice(a) for _ in range(400))) for k, a in (("a", "abc "), ("b", "abd "))}
    model = language_id.Model(train)
    for _ in range(200):
        t = squeeze("".join(r.choice("abcdx ") for _ in range(60)))
        raw = np.frombuffer(t.encode(), np.uint8)
        assert list(model.phrases(raw, np.array([0, len(raw)]))[0][:, 0]) == [parse(t, train[k]) for k in "ab"]


def test_long_texts_are_parsed_in_lanes():
    r = random.Random(20)
    squeeze = lambda t: re.sub(" +", " ", t).strip()
    train = {k: squeeze("".join(r.choice(a) for _ in range(3000))) for k, a in (("a", "abcd "), ("b", "abdé "))}
    model, t = language_id.Model(train), squeeze("".join(r.choice("abcdé ") for _ in range(5 * language_id.LANE + 77)))
    raw = np.frombuffer(t.encode(), np.uint8)
    want = [sum(parse(t[i : i + language_id.LANE], train[k]) for i in range(0, len(t), language_id.LANE)) for k in "ab"]
    assert list(model.phrases(raw, np.array([0, len(raw)]))[0][:, 0]) == want


def test_letters_without_a_column_are_parsed_alike():
    r = random.Random(9)
    # Letters far more than columns, Zipf-like, some of them in both languages.
    say = lambda lo, n: "".join(" " if r.random() < 0.1 else chr(lo + min(int(r.paretovariate(0.6)), 1500)) for _ in range(n)).strip()
    squeeze = lambda t: re.sub(" +", " ", t).strip()
    train = {"han": squeeze(say(0x4E00, 3000)), "hangul": squeeze(say(0xAC00, 3000)), "mixed": squeeze(say(0x5000, 3000) + " the dog")}
    assert all(len(set(t)) > 2 * language_id._CLASSES for t in train.values())
    model = language_id.Model(train)
    for lo, name in ((0x4E00, "han"), (0xAC00, "hangul"), (0x5000, "mixed")):
        texts = [squeeze(say(lo, 60)) for _ in range(30)]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        got = model.phrases(data, offsets)[0]
        assert got.T.tolist() == [[parse(t, train[k]) for k in model.langs] for t in texts]
        assert set(model.predict(data, offsets)[0]) == {name}


def test_language_of_odd_rows(spark):
    rows = docs(spark, [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "en"), (4, "der hund", None), (None, "the cat", "en"), (2, "the dog and the cat", "en"), *[(10 + i, t, None) for i, t in enumerate(ODD)]])
    clash = rows.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(0))
    out = language_id.detect(clash, language_id.fit(rows)).collect()
    assert len(out) == rows.count() and all(0 <= r.lang_score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[4].lang_pred == "de" and by[3].lang_pred == by[10].lang_pred == by[13].lang_pred == "und"
    assert [r.lang_pred for r in out if r.doc_id == 2] == ["en", "en"]
    nothing = language_id.fit(rows.limit(0))
    assert {r.lang_pred for r in language_id.detect(rows, nothing).collect()} == {"und"}
    assert language_id.detect(rows.limit(0), nothing).count() == 0


def test_long_rows_copies_and_short_training_texts(spark):
    r = random.Random(10)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randrange(2, 7)))
    vocabulary = {k: [word(a) for _ in range(60)] for k, a in (("long", "abcdefgh"), ("copied", "abcdwxyz"), ("plain", "efghijkl"))}
    say = lambda k, n: " ".join(r.choice(vocabulary[k]) for _ in range(n))
    rows = [(say("long", 3000), "long") for _ in range(8)] + [(say("plain", 60), "plain") for _ in range(40)]
    rows += [(say("copied", 60), "copied") for _ in range(40)] + [("abcd wxyz", "copied")] * 6000
    rows += [("0" * 9000 + "ok", "short"), ("1 2 3", "none")]
    model = language_id.fit(docs(spark, [(i, t, k) for i, (t, k) in enumerate(rows)]))
    size = dict(zip(model.langs, map(len, model.texts), strict=True))
    assert set(size) == {"long", "plain", "copied", "short"}
    assert size["long"] >= 4 * language_id.TRAIN_ROW_CHARS - 4 and size["copied"] == sum(len(t) + 1 for t, _ in set(x for x in rows if x[1] == "copied")) - 1
    held = [(k, say(k, 20)) for k in vocabulary for _ in range(20)] + [("short", "ok ok OK")]
    found = language_id.detect(docs(spark, [(i, t, None) for i, (_, t) in enumerate(held)]), model).collect()
    assert [x.lang_pred for x in sorted(found, key=lambda x: x.doc_id)] == [k for k, _ in held]


def test_held_out_language_accuracy(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(t.where(language_id.crc_mod("doc_id", 4) != 2))
    out = language_id.detect(t.where(language_id.crc_mod("doc_id", 4) == 2), model)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_toxicity(spark):
    r = random.Random(2)
    plain = lambda: " ".join(r.choice(["sun", "rain", "tree", "house", "river", "stone"]) for _ in range(20))
    rows = [(i, plain() + (" vilest" if i % 3 == 0 else ""), "en") for i in range(300)]
    table = docs(spark, [*rows, (None, None, None), (900, "", None)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, labels.where("doc_id % 5 != 0 or doc_id is null"))
    out = {x.doc_id: x for x in toxicity.score(table.withColumn("tox_score", F.lit("x")), model).collect()}
    held = [i for i in range(300) if i % 5 == 0]
    assert np.mean([(out[i].tox_score >= 0.5) == (i % 3 == 0) for i in held]) > 0.95
    assert 0 <= out[900].tox_score < 0.5 and 0 <= out[None].tox_score < 0.5
    empty = toxicity.fit(table, labels.limit(0))
    assert toxicity.score(table, empty).where("tox_score >= 0.5").count() == 0
    assert toxicity.score(table.limit(0), empty).count() == 0


def small_model(r):
    size = toxicity.BUCKETS
    embedding = np.zeros((size, toxicity.DIM), np.float32)
    embedding[1:60] = r.normal(size=(59, toxicity.DIM))
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    filters = [r.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    return toxicity.Model(embedding, filters, [r.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], r.normal(size=n), 0.3, [], np.zeros((1, 0), np.float32), np.zeros(0), np.zeros(1))


def brute_logit(model, ids):
    """Every window of every width, its filters, a rectifier and the largest of a text."""
    x = [model.embedding[row].astype(float).sum(0) for row in ids]
    pooled = []
    for width, kernel, bias in zip(toxicity.WIDTHS, model.filters, model.bias, strict=True):
        places = range(len(x) - width + 1) if len(x) >= width else [0]
        z = [sum((x[a + k] @ kernel[k].astype(float) for k in range(width) if a + k < len(x)), np.zeros(toxicity.FILTERS)) + bias for a in places]
        pooled += [max(0.0, *(v[f] for v in z)) if len(z) > 1 else max(0.0, z[0][f]) for f in range(toxicity.FILTERS)]
    return np.array(pooled) @ model.weight + model.offset


def test_convolution_and_gradients_equal_brute_force():
    r = np.random.default_rng(17)
    model = small_model(r)
    ids = [r.integers(0, 60, (n, 1 + len(toxicity.HEADS))).astype(np.int32) for n in (1, 2, 3, 7, 20)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    pooled = np.concatenate([np.maximum.reduceat(z, first[:-1], axis=0) for z in model.convolve(np.concatenate(ids), first)], axis=1)
    assert pooled @ model.weight + model.offset == pytest.approx([brute_logit(model, x) for x in ids], rel=1e-4, abs=1e-4)
    y, weigh = np.array([0.0, 1, 0, 1, 1]), np.array([0.7, 1.6])
    loss = lambda: sum(weigh[int(t)] * np.log1p(np.exp(-z if t else z)) for t, z in zip(y, (brute_logit(model, x) for x in ids), strict=True)) / len(y)
    grads, by_offset, rows, by_row = toxicity.gradients(model, ids, y, weigh)

    def slope(array, index, h=2e-3):
        old = array[index]
        array[index] = old + h
        up = loss()
        array[index] = old - h
        down = loss()
        array[index] = old
        return (up - down) / (2 * h)

    for array, grad in zip([*model.filters, *model.bias, model.weight], grads, strict=True):
        for index in [tuple(r.integers(0, n) for n in array.shape) for _ in range(12)]:
            assert grad[index] == pytest.approx(slope(array, index), abs=3e-3)
    for k in r.choice(len(rows), 15, replace=False):
        d = int(r.integers(toxicity.DIM))
        if rows[k]:
            assert by_row[k, d] == pytest.approx(slope(model.embedding, (rows[k], d)), abs=3e-3)
    shift = [brute_logit(model, x) for x in ids]
    assert by_offset == pytest.approx(sum((1 / (1 + np.exp(-z)) - t) * weigh[int(t)] for t, z in zip(y, shift, strict=True)) / 5, abs=1e-5)


def test_thresholds_do_not_depend_on_the_size_of_the_sample():
    r = np.random.default_rng(18)
    clean, toxic = r.normal(-1, 1, 4000), r.normal(1, 1, 400)
    cut = lambda c, t, w: toxicity._best_cut(np.concatenate([c, t]), np.concatenate([np.zeros(len(c)), np.ones(len(t))]), np.concatenate([np.full(len(c), w), np.ones(len(t))]))
    assert cut(clean[::10], toxic, 10.0) == pytest.approx(cut(clean, toxic, 1.0), abs=0.3)
    assert cut(clean[::10], toxic, 10.0) > cut(clean[::10], toxic, 1.0) + 0.3


def test_toxicity_of_long_and_repeated_texts(spark):
    r = random.Random(19)
    plain_ = lambda n: " ".join(r.choice(["sun", "rain", "tree", "house", "river"]) for _ in range(n))
    rows = [(i, plain_(20) + (" vilest" if i % 2 else ""), "en") for i in range(160)]
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame([(i, 1, i % 2) for i in range(160)], "doc_id long, quality int, toxic int"))
    long = plain_(300_000)
    odd = docs(spark, [(1, long, None), (2, f"{long} vilest {long}", None), (3, rows[1][1], None), (3, rows[1][1], None), (4, rows[1][1].upper(), None)])
    out = toxicity.score(odd, model).collect()
    got = {x.doc_id: x.tox_score for x in out}
    assert len(out) == 5 and got[1] < 0.5 <= got[2] and got[3] == got[4] >= 0.5


def brute_hits(text, items):
    w = words_of(text)
    hit, found = set(), set()
    for name, it in items:
        v = words_of(it)
        for s in range(max(1, len(v) - 9)) if v else ():
            win = v[s : s + 10]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    found |= {str(name)} if name is not None else set()
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(["a", "b", "CC", "dé", "e1"]) for _ in range(n))
    items = [(1, say(14)), (2, say(3)), (3, None), (4, "..."), (12, say(10)), (None, say(11)), (12, "b b")]
    texts = [say(40) for _ in range(20)] + ["x " + items[0][1].upper() + "; y", items[5][1], None, *ODD, items[0][1], items[0][1]]
    corpus = docs(spark, [(i if i != 3 else None, t, None) for i, t in enumerate(texts)]).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find(corpus, bench)
    got = sorted((r.n_words, r.h, r.i) for r in found.select("n_words", decontamination.n_hit(F.col("bench_hits")).alias("h"), decontamination.items(F.col("bench_hits")).alias("i")).collect())
    assert got == sorted(brute_hits(t, items) for t in texts)
    kept = decontamination.remove_documents(corpus, bench)
    assert kept.columns == corpus.columns and kept.count() == sum(brute_hits(t, items)[1] == 0 for t in texts)
    assert decontamination.find(corpus, bench.limit(0)).where("size(bench_hits) > 0").count() == 0
    assert decontamination.find(corpus.limit(0), bench).count() == 0
    one = docs(spark, [(1, f"keep this {items[0][1]} end", None)])
    assert decontamination.remove_spans(one, bench.where("item_id = 1")).first().text == "keep this end"


def test_long_items_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "TABLE_WINDOWS", 25)
    monkeypatch.setattr(decontamination, "PIECE", 7)
    r = random.Random(16)
    item = [f"w{r.randrange(40)}" for _ in range(90)]
    texts = [" ".join(["no", *item[a : a + n], "more"]) for a in range(0, 70, 3) for n in (9, 10, 20)]
    items = [(1, " ".join(item)), (2, " ".join(item[:11])), (3, "w1 w2")]
    corpus = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).withColumns({"n_words": F.lit("mine"), "bench_hits": F.lit("too"), "items": F.lit("x"), "w": F.lit("y")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.h, x.i) for x in decontamination.find(corpus, bench).select("doc_id", "n_words", decontamination.n_hit(F.col("bench_hits")).alias("h"), decontamination.items(F.col("bench_hits")).alias("i")).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = decontamination.remove_documents(corpus, bench).collect()
    assert sorted(x.doc_id for x in kept) == [i for i, t in enumerate(texts) if not brute_hits(t, items)[1]]
    spans = decontamination.remove_spans(corpus, bench).collect()
    assert len(spans) == len(texts) and {(x.n_words, x.bench_hits, x["items"], x.w) for x in [*kept, *spans]} == {("mine", "too", "x", "y")}


def test_several_tables_of_windows(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(6)]
    corpus = docs(spark, [(k, f"start {t} stop", None) for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "TABLE_WINDOWS", 5)
    out = decontamination.find(corpus, bench).select("doc_id", decontamination.items(F.col("bench_hits")).alias("i")).collect()
    assert sorted((r.doc_id, r.i) for r in out) == [(k, [str(k)]) for k in range(6)]


def brute_join(rows):
    sets = {}
    for key, t in rows:
        w = words_of(t)
        s = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
        sets.setdefault(s, []).append(key)
    sets.pop(None, None)
    names = list(sets)
    root = {s: s for s in names}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    n = dict.fromkeys(names, 0)
    for i, a in enumerate(names):
        for b in names[:i]:
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    group = {}
    for s in names:
        group.setdefault(find(s), []).extend(sets[s])
    return {k: (min(v), n[s]) for v in [*group.values()] for s in names for k in sets[s] if k in v}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity_join, "BLOCK_ROWS", block)
    r = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{r.randrange(999)}" for _ in range(60)]
        for k in range(1 + 2 * g):
            w = list(base)
            if k % 3:
                w[r.randrange(3) * 20] = f"new{k}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "short text"), (904, "Short, text!")]
    table = docs(spark, [(i, t, None) for i, t in rows] + [(1, rows[0][1], "en")]).withColumn("class_id", F.lit("clash"))
    out = similarity_join.near_duplicates(table).collect()
    assert len(out) == len(rows) + 1
    want = brute_join(rows)
    assert {x.doc_id: (x.class_id, x.n_links) for x in out} == {i: want.get(i, (i, 0)) for i, _ in rows}
    kept = similarity_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({want.get(i, (i, 0))[0] for i, _ in rows})


def test_near_duplicates_at_a_lower_threshold(spark):
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(64)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:44] + [f"g{g}x{k}" for k in range(20)]))]
    a, b = (set(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows[:2])
    assert 0.5 <= len(a & b) / len(a | b) < 0.55
    out = similarity_join.near_duplicates(docs(spark, [(i, t, None) for i, t in rows]), threshold=0.5).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in out} == {i: (i - i % 2, 1) for i, _ in rows}


@pytest.mark.parametrize("block", [2048, 4])
def test_a_chain_of_near_duplicates_equals_brute_force(spark, monkeypatch, block):
    """A component of many small subtrees, and another in which all texts are alike."""
    monkeypatch.setattr(similarity_join, "BLOCK_ROWS", block)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(40)]
    rows += [(100 + i, " ".join([f"same{k}" for k in range(80)] + [f"end{i}"])) for i in range(15)]
    out = similarity_join.near_duplicates(docs(spark, [(i, t, None) for i, t in rows])).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in out} == brute_join(rows)


def test_recall_near_the_threshold(spark):
    """Of 1500 pairs between 0.8 and 0.84, at least the target share is linked, and of pairs below none."""
    rows, near = [], 0
    for g in range(1500):
        n = 104
        base = [f"g{g}w{k}" for k in range(n)]
        cut = 11 if g % 5 else 14  # new words at the end: J = (100 - cut) / (100 + cut)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: n - cut] + [f"g{g}x{k}" for k in range(cut)]))]
        near += cut == 11
    out = {x.doc_id: x for x in similarity_join.near_duplicates(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert 0.8 <= 89 / 111 < 0.81 and 86 / 114 < 0.8
    found = [out[2 * g + 1].class_id == 2 * g for g in range(1500)]
    assert sum(found) >= near * similarity_join.RECALL - 4 and not any(found[g] for g in range(0, 1500, 5))


def test_a_sample_can_shorten_prefixes(spark, monkeypatch):
    sig = np.random.default_rng(1).integers(0, 65536, (300, similarity_join.TREES, similarity_join.DEPTH)).astype(np.uint16)
    twin = sig.copy()
    twin[:, 1:, 2] += 1  # alike but for one value of each prefix
    table = lambda x: spark.createDataFrame([(bytearray(r.astype(">u2").tobytes()),) for r in x], "sig binary")
    monkeypatch.setattr(similarity_join, "FIT_ROWS", 600)
    assert similarity_join.fitted_length(table(np.concatenate([sig, sig])), 0.8, 600) == similarity_join.prefix_length(0.8) == 5
    assert similarity_join.fitted_length(table(np.concatenate([sig, twin])), 0.8, 600) == 2
    assert similarity_join.fitted_length(table(sig).limit(0), 0.8, 0) == 5


def test_near_duplicates_of_nothing_and_of_null_keys(spark):
    none = docs(spark, [(None, "a b c d e f", None), (None, "a b c d e f", None), (3, "a b c d e f", None)])
    assert {x.class_id for x in similarity_join.near_duplicates(none).collect()} == {3}
    assert similarity_join.keep_one(none).count() == 1
    assert similarity_join.near_duplicates(none.limit(0)).count() == 0


def test_components_with_hubs_equal_brute_force(spark, monkeypatch):
    from atomspan.llm import _shared, components

    monkeypatch.setattr(_shared, "HOT_ROWS", 3)
    r = random.Random(21)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(45)] + [(300, 300), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges[:-1]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.root for x in out} == {x: find(x) for x in root} and len(out) == len(root)
    assert components.connected_components(spark.createDataFrame(edges, "a long, b long").limit(0)).count() == 0


def test_common_shingles_both_ways():
    r = np.random.default_rng(0)
    for spread in (40, 100000):
        sets = [np.unique(r.integers(0, spread, 30).astype(np.uint64)) for _ in range(25)]
        assert (similarity_join.common(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


@needs_model
def test_token_counts_equal_the_library(spark):
    r = random.Random(5)
    texts = [*ODD, None, *["".join(r.choice(" ▁ab\né語😀  ") for _ in range(14)) for _ in range(300)], "common words " * 50]
    table = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).withColumn("n_tokens", F.lit("clash"))
    sp = spm.SentencePieceProcessor(model_file=PATH)
    for x in token_counts.count_tokens(table, PATH).collect():
        t = texts[x.doc_id] or ""
        assert (x.n_bytes, x.n_tokens) == (len(t.encode()), len(sp.encode(t)))
    assert token_counts.count_tokens(table.limit(0), PATH).count() == 0


@needs_model
def test_viterbi_equals_the_library_in_unigram_mode(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:  # scores that the library's single precision can add up
        p.score = max(p.score, -60000)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    sp = spm.SentencePieceProcessor(model_file=path)
    r = random.Random(6)
    texts = [t for t in ODD if len(t) < 1000] + ["".join(r.choice(" ▁theing\né語😀  ") for _ in range(r.randrange(50))) for _ in range(400)]
    for _, _, data, offsets in blocks(pa.array(texts)):
        ids, first = viterbi.encode_block(data, offsets, path)
        for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
            assert ids[a:b].tolist() == sp.encode(t) == viterbi.encode_stream(t, path)


def thue_morse(a, b, n=1024):
    """Two words that hashes by a polynomial modulo 2**64 do not tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@needs_model
def test_words_of_colliding_patterns_are_told_apart(spark):
    sp = spm.SentencePieceProcessor(model_file=PATH)
    one, two = thue_morse("a", "b")
    for k in (8, 16, 40):
        assert len({h for w in thue_morse("a", "b", k) for h in split_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash.tolist()}) == 2
    texts = [f"{one} x {one} x", f"{two} x {two} x", one, two]
    table = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).coalesce(1)
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(table, PATH).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(texts)}
    out = viterbi.encode(table, PATH, columns=("ids", "round_trip")).collect()
    assert all(x.round_trip and x.ids == viterbi.encode_stream(texts[x.doc_id], PATH) for x in out)
    assert {x.class_id for x in similarity_join.near_duplicates(table.where("doc_id > 1")).collect()} == {2, 3}
    model, counts = hmm.fit(table.where("doc_id = 2"))
    assert {x.doc_id: x.n_known for x in hmm.score(table, model, counts).collect()}[3] == 1


@needs_model
def test_chunks_of_one_hash_are_told_apart(spark, monkeypatch):
    """With hashes that all collide, results stay what the library gives."""
    short = lambda data, numbers, start, end, wide=False: ((end - start).astype(np.uint64) % np.uint64(3), None)
    monkeypatch.setattr(_text, "hash_ranges", short)
    monkeypatch.setattr(token_counts, "_cache", {})
    monkeypatch.setattr(viterbi, "_seen", {})
    r = random.Random(12)
    texts = ODD + [" ".join("".join(r.choice("abé ") for _ in range(r.randrange(1, 20))) for _ in range(30)) for _ in range(20)]
    for _ in range(2):
        for _, _, data, offsets in blocks(pa.array(texts), 300):
            ids, first = viterbi.encode_block(data, offsets, PATH)
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                assert ids[first[k] : first[k + 1]].tolist() == viterbi.encode_stream(data[a:b].tobytes().decode().replace("▁", " "), PATH)
    chunks = _pieces.chunk_bounds(*(lambda raw: (np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))(" ".join(w for t in texts for w in t.split()).encode()))
    table = _pieces.ChunkTable()
    rows, back, _, odd = _pieces.distinct(chunks, np.arange(len(chunks.key)))
    table.add(chunks, rows, np.arange(len(rows)))
    at, ok = table.find(chunks, np.arange(len(chunks.key)))
    words = chunks.texts(np.arange(len(chunks.key)))
    assert len(odd) and set(odd) == set(np.flatnonzero(~ok))
    assert all(words[rows[table.values[at[i], 0]]] == words[i] for i in np.flatnonzero(ok))


@needs_model
def test_long_texts_without_spaces():
    import time

    text = "".join(random.Random(13).choice("漢字かな交じり文を読むabc") for _ in range(60000))
    began = time.time()
    ids = viterbi.encode_stream(text, PATH)
    assert time.time() - began < 5
    raw = np.frombuffer(text.encode(), np.uint8)
    got, first = viterbi.encode_block(raw, np.array([0, len(raw)]), PATH)
    assert got.tolist() == ids and viterbi.decode_block(got, first, PATH)[0].tobytes() == text.encode()


@needs_model
def test_decoding_odd_ids(spark):
    v = _pieces.vocabulary(PATH)
    e = [int(v.byte_ids[b]) for b in "é".encode()]
    rows = [(1, [e[0]]), (2, [e[1]]), (3, None), (4, []), (5, e), (6, [v.ids["▁a"]])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    sp = spm.SentencePieceProcessor(model_file=PATH)
    for part in (df, df.where("doc_id > 2")):
        assert all(x.text == (None if dict(rows)[x.doc_id] is None else sp.decode(dict(rows)[x.doc_id])) for x in viterbi.decode(part, PATH).collect())
    with pytest.raises(Exception, match="an id is null"):
        viterbi.decode(spark.createDataFrame([(1, [None])], "doc_id long, ids array<int>"), PATH).collect()


@needs_model
def test_stream_holds_a_window():
    stream = viterbi.Stream(PATH)
    for c in "▁this▁is▁a▁text" * 200:
        stream.feed(c)
    assert stream.most < 64


@needs_model
def test_encoding_and_decoding_return_the_text(spark):
    texts = [*ODD, None]
    table = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    out = viterbi.encode(table.withColumn("ids", F.lit(0)), PATH, columns=("ids", "n_ids", "ids_crc32", "round_trip"))
    back = {x.doc_id: x for x in viterbi.decode(out, PATH).collect()}
    for i, t in enumerate(texts):
        assert back[i].text == (t or "").replace("▁", " ") and back[i].round_trip
    for x in out.collect():
        assert x.n_ids == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, np.int32))


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(7)
    v = r.integers(-3, 4, (120, 6)).astype(float)
    v[40:80] = v[0]  # ties and a group of copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [1.0] * 4), (None, [9.0] * 6), (550, [1e300] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("score", F.lit("clash"))
    whole = [(i, np.floor(256 * np.array(x))) for i, x in rows[: len(v)]]
    out = topk.top_k(df.where("vec_id < 550 or vec_id is null"), F.col("vec_id") % 25 == 0).collect()
    want = []
    for q, a in whole:
        if q % 25 == 0:
            s = sorted((-int(a @ b), i) for i, b in whole if i != q)[:5]
            want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert max(x.score for x in topk.top_k(df, F.col("vec_id") == 550).collect()) <= 2**63 - 1
    assert topk.top_k(df.limit(0), F.col("vec_id") % 25 == 0).count() == 0


def sql_rows(sql, tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    return con.execute(sql).fetchall()


def test_top_k_of_repeated_rows(spark):
    r = np.random.default_rng(5)
    base = [(i, r.normal(size=5).round(2).tolist()) for i in range(7)] + [(7, [5.0] * 5)]
    rows = base + [base[7]] * 5 + [base[0]] + [(50, [9.0, 9.0, 1.0, 0.0, 0.0])] * 2 + [(i, x) for i, (_, x) in enumerate(base[:3], 100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted((q, k, v, s) for q, k, v, s in sql_rows("SELECT query_id, rank, vec_id, score FROM (" + llm_queries.OP5_SQL + ")", {"embeddings": df}))
    for n in (1, 6):
        out = topk.top_k(df.repartition(n), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, out.collect())) == want
    assert max(sum(v == 7 for q, _, v, _ in want if q == x) for x in (0, 50, 100)) >= 5


def test_cutoffs_skip_work():
    r = np.random.default_rng(6)
    centres = r.normal(size=(20, 64))
    x = np.floor(256 * (centres[r.integers(0, 20, 2000)] + 0.1 * r.normal(size=(2000, 64))))
    vec, q = np.arange(2000), topk.Queries(np.arange(0, 2000, 50), x[::50])
    (a, _, s), first = topk.gather(q, vec, x, 5)
    cut = np.array([np.sort(s[a == n])[-5] for n in q.names])
    (a, v, s), second = topk.resolve(q, cut, vec, x)
    brute = len(q.names) * 2000 * 64
    assert first < 0.3 * brute and second < 0.5 * brute
    full = (x[::50] @ x.T).astype(np.int64)
    want = {(n, w) for i, n in enumerate(q.names) for w in vec if w != n and full[i, w] >= cut[i]}
    assert set(zip(a.tolist(), v.tolist(), strict=True)) == want and all(full[n // 50, w] == k for n, w, k in zip(a, v, s, strict=True))


def test_top_k_in_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, -float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    want = sorted((q, k, v, s) for q, k, v, s in sql_rows("SELECT query_id, rank, vec_id, score FROM (" + llm_queries.OP5_SQL.replace("% 50", "% 10") + ")", {"embeddings": df}))
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect())) == want


def test_hidden_markov_model(spark):
    r = random.Random(8)
    say = lambda k: " ".join(f"{k}{min(int(r.expovariate(0.1)), 60)}" for _ in range(80))
    texts = [say("ab"[i % 2]) for i in range(60)] + [None, "", "A0 a0", "never seen"]
    table = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).withColumn("score", F.lit("clash"))
    train = table.where("doc_id % 7 != 2")
    model, counts = hmm.fit(train)
    out = {x.doc_id: x for x in hmm.score(table, model, counts).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0d]+", low(t)), None] for i, t in enumerate(texts)}
    from collections import Counter

    c = Counter(w for i, ws in tokens.items() if i % 7 != 2 for w in ws)
    total, distinct = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert out[i].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (total + distinct + 1)) for w in ws))
    held = [i for i in range(60) if i % 7 == 2]
    assert sum(out[i].score for i in held) > sum(out[i].base_score for i in held)
    # The recursion sums over all paths: compared on a short text.
    raw = np.frombuffer(b"a1 b2", np.uint8)
    symbols, first, *_ = model.symbols(raw, np.array([0, len(raw)]))
    import itertools

    paths = itertools.product(range(hmm.STATES), repeat=len(symbols))
    p = sum(model.start[s[0]] * model.emit[symbols[0], s[0]] * np.prod([model.move[a, b] * model.emit[o, b] for a, b, o in zip(s[:-1], s[1:], symbols[1:], strict=True)]) for s in paths)
    assert hmm._likelihood(model, symbols, first)[0] == pytest.approx(np.log10(p))
    none, no_counts = hmm.fit(train.limit(0))
    assert all(x.score == x.base_score for x in hmm.score(table, none, no_counts).collect())


def naive_counts(model, docs_):
    """Expected counts and log10 likelihoods by the plain recursion."""
    out, logs = hmm._nothing(model), []
    for o in docs_:
        e = model.emit[o]
        alphas, scales = [], []
        a = model.start * e[0]
        for t in range(len(o)):
            a = (alphas[-1] @ model.move) * e[t] if t else a
            scales.append(a.sum())
            alphas.append(a / a.sum())
        b = np.ones(hmm.STATES)
        for t in range(len(o) - 1, -1, -1):
            g = alphas[t] * b
            out["emit"][o[t]] += g
            if t:
                out["move"] += model.move * np.outer(alphas[t - 1], e[t] * b / scales[t])
                b = model.move @ (e[t] * b) / scales[t]
        out["start"] += g
        logs.append(np.log10(scales).sum())
    return out, logs


def test_runs_change_nothing(monkeypatch):
    monkeypatch.setattr(hmm, "RUN", 7)
    monkeypatch.setattr(hmm, "RUNS", 3)
    r = np.random.default_rng(3)
    n = 20
    emit = r.dirichlet(np.ones(n) * 0.3, hmm.STATES).T + 1e-9
    model = hmm.Model(None, r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit, 1, 1, 1, np.ones(1))
    docs_ = [r.integers(0, n, k).astype(np.int32) for k in (1, 7, 8, 50, 3, 14, 101)]
    first = np.concatenate([[0], np.cumsum([len(o) for o in docs_])])
    want, logs = naive_counts(model, docs_)
    got = hmm._nothing(model)
    hmm._expect(model, np.concatenate(docs_), first, got)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12)
    assert hmm._likelihood(model, np.concatenate(docs_), first) == pytest.approx(logs, rel=1e-12)


def test_a_text_of_a_million_tokens():
    import time

    r = np.random.default_rng(4)
    emit = r.dirichlet(np.ones(50), hmm.STATES).T
    model = hmm.Model(None, r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit, 1, 1, 1, np.ones(1))
    o = r.integers(0, 50, 1_000_000).astype(np.int32)
    began, got = time.time(), hmm._nothing(model)
    hmm._expect(model, o, np.array([0, len(o)]), got)
    assert time.time() - began < 60 and got["emit"].sum() == pytest.approx(len(o)) and got["move"].sum() == pytest.approx(len(o) - 1)


def test_quotations(spark):
    rows = [(1, 0, "user", "Hello there\n\nHow are you?"), (1, 1, "bot", "> How are  YOU?\nFine."), (1, 2, "user", ">> How are you?\n> Fine.\nGood to hear"), (1, 3, "user", "> Hello there\nlate reply"), (1, 4, None, None), (2, 5, "user", "> nothing known\nhi"), (None, 0, "u", "a"), (2, 5, "user", "again"), (2, 3000, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit("clash"))
    out = quotes.conversations(df).collect()
    assert len(out) == len(rows)
    got = {(x.conv_id, x.turn): (x.text, x.parent_turn, x.by_quote, x.depth, x.thread, x.position) for x in out if x.conv_id == 1}
    assert got == {(1, 0): ("Hello there\n\nHow are you?", None, False, 0, 0, 0), (1, 1): ("Fine.", 0, True, 1, 0, 1), (1, 2): ("Good to hear", 1, True, 2, 0, 2), (1, 3): ("late reply", 0, True, 1, 3, 3), (1, 4): (None, 3, False, 2, 3, 4)}
    assert [(x.parent_turn, x.position) for x in out if x.conv_id is None] == [(None, None)]
    assert [x.parent_turn for x in out if x.turn == 3000] == [5]
    assert quotes.as_chat(quotes.conversations(df)).where("chat is null").count() == 0
    assert quotes.conversations(df.limit(0)).count() == 0


def plain(t):
    return " ".join(re.sub(r"(?m)^[ \t]*(?:>[ \t]*)+", "", t).lower().split())


def brute_parents(turns):
    """Parent by quotation of each turn of one conversation, {turn: text}, by the rules in words."""
    depth = lambda line: len(re.match(r"[ \t]*(?:>[ \t]*)*", line)[0].replace(" ", "").replace("\t", ""))
    own = {t: "\n".join(x for x in text.split("\n") if not depth(x)).strip() for t, text in turns.items()}
    passages = {t: {plain(p) for p in [x, *re.split(r"\n\s*\n", x), *x.split("\n")]} - {""} for t, x in own.items()}
    out = {}
    for t, text in turns.items():
        blocks_, run = [], []
        for line in [*text.split("\n"), "end"]:
            if depth(line):
                run.append((depth(line), plain(line)))
            elif run:
                blocks_.append(run)
                run = []
        hits = {}
        for block in blocks_:
            pieces = [[x for x in block if x[0] == k] for k in dict.fromkeys(k for k, _ in block)]
            for new in (lambda x, y: x[0] != y[0], lambda x, y: x[0] != y[0] or not x[1] or not y[1], lambda x, y: True):
                parts = [[block[0]]]
                for x, y in zip(block[1:], block, strict=False):
                    if new(x, y):
                        parts.append([])
                    parts[-1].append(x)
                pieces += parts
            for piece in pieces:
                whole = " ".join(x for _, x in piece if x)
                first = min((u for u in turns if whole in passages[u]), default=None) if whole else None
                if first is not None and first < t:
                    hits.setdefault((piece[0][0], first), set()).update(x for _, x in piece if x)
        if hits:
            out[t] = min(hits, key=lambda k: (k[0], -sum(map(len, hits[k])), -k[1]))[1]
    return own, out


def test_reading_order_equals_brute_force(spark):
    r = random.Random(15)
    rows, want = [], {}
    for c in range(25):
        turns = {}
        for t in sorted(r.sample(range(200), 1 + 2 * c)):
            say = "\n\n".join("\n".join(" ".join(f"{r.choice('abc')}{r.randrange(30)}" for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 3))) for _ in range(r.randrange(1, 3)))
            quote = ""
            if turns and r.random() < 0.6:
                source = r.choice([u for u in turns])
                lines_ = turns[source].split("\n")
                a = r.randrange(len(lines_))
                quote = "\n".join(r.choice(["> ", ">"]) + x for x in lines_[a : a + r.randrange(1, 6)]) + "\n"
            turns[t] = quote + say
        own, quoted = brute_parents(turns)
        order = sorted(turns)
        parent = {t: quoted.get(t, order[i - 1] if i else None) for i, t in enumerate(order)}
        depth, place = {}, {}

        def read(t):
            place[t], depth[t] = len(place), 0 if parent[t] is None else depth[parent[t]] + 1
            for u in order:
                if parent[u] == t:
                    read(u)

        read(order[0])
        rows += [(c, t, "user", x) for t, x in turns.items()]
        want |= {(c, t): (own[t], parent[t], t in quoted, depth[t], place[t]) for t in turns}
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("position", F.lit("clash"))
    got = {(x.conv_id, x.turn): (x.text, x.parent_turn, x.by_quote, x.depth, x.position) for x in quotes.conversations(df).collect()}
    assert got == want and sum(v[2] for v in want.values()) > 100
    chat = [(x.conv_id, x.position) for x in quotes.chats(df).collect()]
    assert chat == sorted(chat)


def test_quotations_of_parts_and_levels(spark):
    one, two = "The first paragraph is\nabout rivers.", "The second is about\nstones and trees."
    rows = [(1, 0, f"{one}\n\n{two}\n\nThe third is short."), (1, 1, "Nothing quoted"), (1, 2, "Nor here\nin two lines"), (1, 3, "> The first\n> paragraph is about rivers.\n>\n> The second is about stones\n> and trees.\nI agree")]
    # Levels in turn: of ">" the second message is quoted, re-wrapped and parted by ">>" lines.
    rows += [(2, 0, "alpha beta gamma\n\ndelta epsilon zeta"), (2, 1, "eta theta\niota kappa"), (2, 2, "filler"), (2, 3, ">> alpha beta\n>> gamma\n> eta theta iota\n> kappa\n>> delta epsilon\n>> zeta\n> lambda mu\nyes")]
    # Each quoted letter counts once: turn 0 is quoted by a longer line than turn 1 by its paragraph and its lines.
    rows += [(3, 0, "a line of some forty letters or a few more"), (3, 1, "a first short line\na second one\n\nan end"), (3, 2, "filler"), (3, 3, "> a first short line\n> a second one\n>\n> a line of some forty letters or a few more\nso")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): (x.parent_turn, x.by_quote) for x in quotes.conversations(df).collect() if x.turn == 3}
    assert got == {(1, 3): (0, True), (2, 3): (1, True), (3, 3): (0, True)}


def test_license_notices(spark):
    filler = " ".join(f"w{i}" for i in range(90))
    rows = [(1, f"{filler} Released under the MIT License. {filler}", None), (2, filler, None), (3, None, None), (4, "", None), (5, "licensed under the APACHE license version 2 0", None), (5, "licensed under the APACHE license version 2 0", None), (6, "released under the MIT", None), (None, "Licensed under CC BY-NC 4.0.", None), *[(10 + i, t, None) for i, t in enumerate(ODD)]]
    table = docs(spark, rows).withColumns({"template": F.lit("clash"), "start": F.lit("x"), "containment": F.lit(2), "h": F.lit("mine"), "n": F.lit(5), "w": F.lit(6), "band": F.lit(7), "id": F.lit(8)})
    found = license_scan.scan(table, license_scan.notices(spark))
    assert set(found.columns) == {"doc_id", "lang", "source", "n_chars", "h", "n", "w", "band", "id", "template", "start", "shared", "containment"}
    out = found.collect()
    assert sorted((str(x.doc_id), x.template) for x in out) == [("1", "MIT"), ("5", "Apache-2.0"), ("5", "Apache-2.0"), ("None", "CC-BY-NC-4.0")]
    assert {(x.h, x.n, x.w, x.band, x.id) for x in out} == {("mine", 5, 6, 7, 8)}
    assert license_scan.scan(table.limit(0), license_scan.notices(spark)).count() == 0
    assert license_scan.scan(table, license_scan.notices(spark).limit(0)).count() == 0


def license_sets(t, width=5):
    w = words_of(t)
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def brute_licenses(text, templates):
    """Template: best containment over the operator's windows, where it reaches the share."""
    out = {}
    for name, t in templates:
        want = set(license_sets(t))
        if not want or name is None:
            continue
        places = license_sets(text, min(5, len(words_of(t))))
        step = 1 << (len(words_of(t)) - 1).bit_length()
        best = max((len(want & set(places[k : k + 2 * step])) / len(want) for k in range(0, max(1, len(places)), step)), default=0)
        if best >= license_scan.CONTAINMENT:
            out[name] = round(best, 6)
    return out


@pytest.mark.parametrize("limit", [200_000, 70])
def test_license_scan_equals_brute_force(spark, monkeypatch, limit):
    """All windows that hold a template are found, those of altered texts and of tables in several parts too."""
    monkeypatch.setattr(license_scan, "TABLE_SHINGLES", limit)
    r = random.Random(14)
    templates = license_scan.NOTICES + license_scan.LICENSES + [("tiny", "All rights kept"), ("none", "..."), (None, "x y z")]
    filler = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    texts = [None, "", filler(50)]
    for _, t in templates[:-2]:
        for changed in (0, 0.02, 0.06):
            w = [x if r.random() >= changed else "other" for x in t.split()]
            texts.append(f"{filler(r.randrange(80))} {' '.join(w)} {filler(r.randrange(80))}")
    texts += [" ".join(r.choice(templates[:-2])[1] for _ in range(5)) for _ in range(12)]
    if limit < 1000:
        texts = texts[::6]
    found = license_scan.scan(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), spark.createDataFrame(templates, "template string, text string"))
    got: dict = {i: {} for i in range(len(texts))}
    for x in found.collect():
        got[x.doc_id][x.template] = round(x.containment, 6)
    want = {i: brute_licenses(t, templates) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 10 and got == want
