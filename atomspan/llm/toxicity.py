"""Toxicity scores from a convolutional text classifier, trained and run in numpy.

Words (A-Z lower-cased runs of letters, digits and non-ASCII characters) are hashed into ``BUCKETS`` rows of an
embedding table; a word's vector is the sum of its own row and of the rows of its first bytes (``HEADS``), so that
inflected forms share what is learnt of their stem. Filters of each width in ``WIDTHS`` slide over a text's words, a rectifier and the maximum over the
whole text follow, then one linear unit. The embedding starts from each bucket's log odds of the label, so that
training refines a sensible start.

Thresholds are calibrated by language. The language of a text is guessed from the text itself by a naive Bayes table
over the same buckets; ``lang`` of the training rows is only used to fit that table. Scores are shifted so that 0.5 is
the threshold that gave the best F1 on a calibration part of the training rows, for each language. There, rows weigh as
much as the labelled rows that they were drawn for, so the size of the sample doesn't move the thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import in_batches
from ._text import blocks, split_words, worker_cache

BUCKETS, DIM, FILTERS, WIDTHS, HEADS = 1 << 20, 8, 8, (1, 2, 3), (4, 5, 6)
#: Rows of each label that are taken for training at most (in expectation), and characters of all of them.
TRAIN_ROWS, TRAIN_CHARS = 3000, 24_000_000
#: A language gets a threshold of its own if the calibration part has so many rows of each label in it.
CALIBRATE_ROWS = 20
#: Rows of the language table.
LANG_BUCKETS = 1 << 16
_SALT = np.uint64(0x5851F42D4C957F2D)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's rows of the embedding table (0: none), and each document's range of words."""
    words, heads = split_words(data, offsets, heads=HEADS)
    ids = [((h * _SALT) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32) for h in (words.hash, *heads)]
    return np.stack(ids, axis=1), words.first


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    langs: list[str]
    lang_table: np.ndarray  # (LANG_BUCKETS, languages)
    lang_prior: np.ndarray
    cut: np.ndarray  # by language, then for all others: the logit of the threshold

    def convolve(self, ids: np.ndarray, first: np.ndarray, embedded: np.ndarray | None = None) -> list[np.ndarray]:
        """By width, each word's activations of the window that begins there; 0 where it would pass the text's end.

        A text shorter than a window has, at its first word, the window filled up with zeros.
        """
        x = self.embedding[ids].sum(1) if embedded is None else embedded
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(ids))
        begins = np.zeros(len(ids), bool)
        begins[first[:-1]] = True
        out = []
        for width, kernel, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            z = x @ kernel[0]
            for k in range(1, width):
                z[:-k] += np.where((left > k)[:-k, None], x[k:] @ kernel[k], np.float32(0))
            z += bias
            np.maximum(z, 0, out=z)
            z[(left < width) & ~begins] = 0
            out.append(z)
        return out

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents in a block: logit less its threshold's, and the index of the language guessed."""
        ids, at = _features(data, offsets)
        count = np.diff(at)
        full = np.flatnonzero(count)
        pooled = np.zeros((len(count), FILTERS * len(WIDTHS)), np.float32)
        guess = np.full(len(count), len(self.langs))
        if len(full):
            first = np.append(at[:-1][full], len(ids))
            pooled[full] = np.concatenate([np.maximum.reduceat(z, first[:-1], axis=0) for z in self.convolve(ids, first)], axis=1)
            if self.langs:
                guess[full] = (np.add.reduceat(self.lang_table[ids[:, 0] % LANG_BUCKETS], first[:-1], axis=0) + self.lang_prior).argmax(1)
        raw = pooled.astype(np.float64) @ self.weight + self.offset
        return raw - self.cut[guess], guess


def _train(ids: list[np.ndarray], y: np.ndarray, langs: list[str | None], weights: tuple[float, float] = (1.0, 1.0), epochs: int = 12, rate: float = 0.01, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    n = len(ids)
    part = np.arange(n) % 5 == 4  # calibration
    names = sorted({x for x in langs if x is not None})
    table = np.full((LANG_BUCKETS, len(names)), 0.1)
    prior = np.full(len(names), 0.5)
    seen = np.full((2, BUCKETS), 0.5)
    for i, (words, lang) in enumerate(zip(ids, langs, strict=True)):
        if lang is not None:
            np.add.at(table[:, names.index(lang)], words[:, 0] % LANG_BUCKETS, 1)
            prior[names.index(lang)] += 1
        if not part[i]:
            seen[int(y[i])][np.unique(words)] += 1
    table = np.log(table / table.sum(0)).astype(np.float32) if names else table.astype(np.float32)
    share = np.array([max(1, (y[~part] == k).sum()) for k in (0, 1)], float)
    odds = np.log(np.minimum(seen[1] / (share[1] + 1), 0.999)) - np.log(np.minimum(seen[0] / (share[0] + 1), 0.999))
    odds *= np.minimum(1, seen.sum(0) / 10)  # rare buckets say little
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -4, 4)
    embedding[0] = 0
    filters = [rng.normal(0, 0.2 / width, (width, DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
    for kernel in filters:
        kernel[0, 0, : FILTERS // 2] += 0.5
    model = Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.05), -1.0, names, table, np.log(prior / prior.sum()) if names else prior, np.zeros(len(names) + 1))
    train = np.flatnonzero(~part)
    if len(np.unique(y[train])) == 2:
        _descend(model, ids, y, train, epochs, rate, rng)
    _calibrate(model, ids, y, np.flatnonzero(part) if len(np.unique(y[part])) == 2 else train, weights)
    return model


def _descend(model: Model, ids: list[np.ndarray], y: np.ndarray, train: np.ndarray, epochs: int, rate: float, rng: np.random.Generator) -> None:
    """Adam on the cross entropy, both labels weighted alike; the embedding takes sparse Adagrad steps."""
    params = [*model.filters, *model.bias, model.weight]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    heat = np.zeros(BUCKETS, np.float32)
    step, m_off, v_off = 0, 0.0, 0.0
    weigh = len(train) / (2 * np.maximum(1, np.bincount(y[train].astype(int), minlength=2)))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            grads, g0, touched, g_ = gradients(model, [ids[i] for i in batch], y[batch], weigh)
            step += 1
            for p_, g, (m, v) in zip(params, grads, moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p_.dtype)
            m_off += 0.1 * (g0 - m_off)
            v_off += 0.01 * (g0 * g0 - v_off)
            model.offset -= rate * m_off / (1 - 0.9**step) / (np.sqrt(v_off / (1 - 0.99**step)) + 1e-8)
            heat[touched] += (g_ * g_).mean(1)
            model.embedding[touched] -= np.where(touched > 0, 0.05, 0)[:, None] * g_ / (np.sqrt(heat[touched])[:, None] + 1e-6)


def gradients(model: Model, ids: list[np.ndarray], y: np.ndarray, weigh: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the mean cross entropy, labels weighted by ``weigh``: by filters, biases and weight; by the offset; and by rows of
    the embedding, with the rows."""
    flat = np.concatenate(ids)
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    x = model.embedding[flat].sum(1)
    acts = model.convolve(flat, first, x)
    tops = [np.maximum.reduceat(z, first[:-1], axis=0) for z in acts]
    pooled = np.concatenate(tops, axis=1).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weight + model.offset, -30, 30)))
    err = (p - y) * weigh[y.astype(int)] / len(y)
    grads_f, grads_b = [np.zeros_like(k) for k in model.filters], [np.zeros_like(b) for b in model.bias]
    rows, values = [np.zeros(0, flat.dtype)], [np.zeros((0, DIM), np.float32)]
    for w, (z, top, width) in enumerate(zip(acts, tops, WIDTHS, strict=True)):
        back = (err[:, None] * model.weight[w * FILTERS : (w + 1) * FILTERS]).astype(np.float32)
        doc, f = np.nonzero(top > 0)
        if not len(doc):
            continue
        hit = z == np.repeat(top, np.diff(first), axis=0)
        at = _first_hit(hit, first)[doc, f]
        g = back[doc, f]
        np.add.at(grads_b[w], f, g)
        for k in range(width):
            ok = at + k < first[1:][doc]
            a, ff, gg = at[ok] + k, f[ok], g[ok]
            np.add.at(grads_f[w][k].T, ff, gg[:, None] * x[a])
            rows.append(flat[a].ravel())
            values.append(np.repeat(gg[:, None] * model.filters[w][k].T[ff], flat.shape[1], axis=0))
    touched, place = np.unique(np.concatenate(rows), return_inverse=True)
    by_row = np.zeros((len(touched), DIM), np.float32)
    np.add.at(by_row, place.ravel(), np.concatenate(values))
    return [*grads_f, *grads_b, pooled.T @ err], float(err.sum()), touched, by_row


def _first_hit(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First true row of each document and column (one at least is true where it is used)."""
    at = np.where(hit, np.arange(len(hit))[:, None], len(hit))
    return np.minimum.reduceat(at, first[:-1], axis=0)


def _calibrate(model: Model, ids: list[np.ndarray], y: np.ndarray, rows: np.ndarray, weights: tuple[float, float]) -> None:
    if not len(rows):
        return
    raw, guess = np.empty(len(rows)), np.empty(len(rows), int)
    for k, i in enumerate(rows):
        first = np.array([0, len(ids[i])])
        pooled = np.concatenate([z.max(0) for z in model.convolve(ids[i], first)])
        raw[k] = pooled @ model.weight + model.offset
        guess[k] = (model.lang_table[ids[i][:, 0] % LANG_BUCKETS].sum(0) + model.lang_prior).argmax() if model.langs else 0
    weigh = np.array(weights)[y[rows].astype(int)]
    model.cut[:] = _best_cut(raw, y[rows], weigh)
    for g in range(len(model.langs)):
        own = guess == g
        if min((y[rows][own] == 1).sum(), (y[rows][own] == 0).sum()) >= CALIBRATE_ROWS:
            model.cut[g] = _best_cut(raw[own], y[rows][own], weigh[own])


def _best_cut(raw: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> float:
    """Midway between the two neighbouring logits that part the labels with the best F1; among equals the widest gap."""
    if len(np.unique(y)) < 2:
        return 0.0
    order = np.argsort(-raw, kind="stable")
    r, t, w = raw[order], y[order], weigh[order]
    hits = np.cumsum(t * w)
    f1 = 2 * hits / (np.cumsum(w) + (t * w).sum())
    gap = np.append(r[:-1] - r[1:], 0)
    f1[gap <= 0] = -1
    if f1.max() < 0:
        return 0.0
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-9), key=lambda i: gap[i])
    return float((r[best] + r[best + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang") -> Model:
    """A model from the documents that ``labels`` has a label of 0 or 1 for; other rows are left out.

    Takes a sample of at most TRAIN_ROWS rows a label (in expectation, drawn by a hash of the key) and TRAIN_CHARS
    characters of their texts; copies of a text count once. The sample is drawn from ``labels``, so that no text but those in
    it leaves its task. Without rows of both labels the model scores every text below 0.5. Two labels of one key are two
    rows; null keys, texts and labels are left out.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("y") == k, F.lit(min(1.0, TRAIN_ROWS / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 40)) < share * (1 << 40)).distinct()
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang")).where("text is not null")
    # About 2 * TRAIN_ROWS keys and labels, whatever the size of the tables.
    sample = texts.join(F.broadcast(drawn), "k").withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"])
    ids, y, langs, used = [], [], [], 0
    for r in sample.orderBy("h", "y").toLocalIterator():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        found, _ = _features(raw, np.array([0, len(raw)]))
        if len(found) and used < TRAIN_CHARS:
            ids.append(found)
            y.append(r["y"])
            langs.append(r["lang"])
            used += len(r["text"])
    drawn_of = lambda k: max(1.0, counts.get(k, 0) / TRAIN_ROWS)
    return _train(ids, np.array(y, float), langs, (drawn_of(0), drawn_of(1)))


def score(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df``, its ``text`` last or left out, with tox_score (0 to 1) and tox_lang; one row for each row.

    tox_score >= 0.5 marks a text as toxic under its language's threshold. Null and empty texts and texts without a
    word get the score of no evidence. Very long texts are scored whole, as blocks of their own; rows with the same text
    get the same score. Columns of ``df`` called tox_score or tox_lang are replaced.
    """
    made = ["tox_score", "tox_lang"]
    df = df.drop(*made)
    names = [c for c in df.columns if c != text]
    kept = df.select(*[F.col(f"`{n}`") for n in names])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        worker_cache("toxicity", {})
        m = sent.value
        langs = np.array([*m.langs, None], object)
        for batch in batches:
            passed = batch.columns if keep_text else batch.columns[:-1]
            for i, j, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                z, guess = m.logits(data, offsets)
                columns = [*[c.slice(i, j - i) for c in passed], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.array(langs[guess], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*schema.names])

    schema = (df.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias(text)) if keep_text else kept).schema.add("tox_score", "double").add("tox_lang", "string")
    return in_batches(df.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias("__text")), run, schema)
