"""A hidden Markov language model over words.

Tokens are runs of bytes other than white space, A-Z lower-cased, then one end per text. A state emits a symbol: one of the
SYMBOLS most frequent tokens, the end, or a class of other tokens (by their last bytes). A token of a class has the
probability (c + 1) / (N + V + 1) within it, with c its count, N and V the class's tokens and distinct tokens in the
training texts; the one more is for tokens that are not among them.

Training is by Baum-Welch. It starts from a few rounds on a bounded sample, then ROUNDS rounds go over all training texts:
tasks run the scaled forward-backward recursion over whole texts and hand over expected counts, which are summed by
symbol. The likelihood of a text is computed by the scaled forward recursion over all of it.

Texts of more than RUN tokens are cut into runs that are worked on side by side: the product of a run's transition
matrices, weighted by what it emits, carries the forward state from the end of one run to the next and the backward
state the other way, so that cuts change nothing but rounding, and a text costs steps for its runs and not its tokens.

Counts of tokens stay distributed, by two hashes of 64 bits each. Each text's tokens beyond the COMMON most frequent ones
are joined to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import in_batches, stored
from ._text import NON_SPACE, blocks, mix, split_words

STATES, SYMBOLS, CLASSES, COMMON = 8, 1 << 14, 256, 1 << 16
ROUNDS, RUN = 2, 512
#: Runs whose forward states are held at once.
RUNS = 512
#: Texts (in expectation) and rounds of the start.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_ROUNDS = 1500, 8_000_000, 12
#: Distinct tokens that a task counts before it hands them over.
TASK_TOKENS = 1 << 19


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and classes of a block's words, and the documents' ranges of them."""
    words = split_words(data, offsets, NON_SPACE, wide=True)
    tail = data[words.end - 1].astype(np.uint64) << np.uint64(8)
    two = words.end - words.start > 1
    tail[two] += data[words.end[two] - 2]
    return words.hash, words.second, (mix(tail) % np.uint64(CLASSES)).astype(np.int32), words.first


def _distinct(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct pair of hashes, and each row's place among them."""
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    if (h2 != h2[at][back]).any():  # first hashes collide
        order = np.lexsort((h2, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        at, back = order[new], np.empty(len(h), np.int64)
        back[order] = np.cumsum(new) - 1
    return at, back


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, h2, g, c): hashes, class and count of each distinct token of the column ``text``."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def rows():
            h, h2, g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            at, back = _distinct(h, h2)
            n = np.bincount(back, weights=n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(g[at], pa.int32()), pa.array(n)], names=["h", "h2", "g", "c"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                h, h2, g, _ = _tokens(data, offsets)
                at, back = _distinct(h, h2)
                held.append((h[at], h2[at], g[at], np.bincount(back, minlength=len(at))))
                size += len(at)
                if size > TASK_TOKENS:
                    yield (out := rows())
                    held, size = [], 0
                    del out
        if held:
            yield rows()

    return in_batches(texts, run, "h long, h2 long, g int, c long").groupBy("h", "h2").agg(F.first("g").alias("g"), F.sum("c").alias("c"))


@dataclass
class Lookup:
    """The COMMON most frequent tokens: sorted hashes, second hashes, counts, and symbols (-1: their class)."""

    hash: np.ndarray
    second: np.ndarray
    count: np.ndarray
    symbol: np.ndarray

    def find(self, h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, counts and whether a token is here."""
        if not len(self.hash):
            return np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        known = (self.hash[at] == h) & (self.second[at] == h2)
        return np.where(known, self.symbol[at], -1), np.where(known, self.count[at], 0), known


@dataclass
class Model:
    lookup: Lookup
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states): words, classes, end
    ends: int
    tokens: int  # N
    distinct: int  # V
    class_size: np.ndarray  # N + V + 1 of each class

    @property
    def end(self) -> int:
        return SYMBOLS + CLASSES

    def symbols(self, data: np.ndarray, offsets: np.ndarray):
        """Of a block: symbols with ends, documents' ranges of them, then of its words: hashes, class, symbol or -1, count, whether the count is known, and the documents' ranges."""
        h, h2, g, first = _tokens(data, offsets)
        s, c, known = self.lookup.find(h, h2)
        n = len(first) - 1
        to = first + np.arange(n + 1)
        out = np.full(to[-1], self.end, np.int32)
        inner = np.ones(len(out), bool)
        inner[to[1:] - 1] = False
        out[inner] = np.where(s >= 0, s, SYMBOLS + g)
        return out, to, h, h2, g, s, c, known, first


def _lanes(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of lanes by falling size, and how many are longer than each step."""
    order = np.argsort(-size, kind="stable")
    most = int(size.max(initial=0))
    return order, np.searchsorted(-size[order], -np.arange(most), "left")


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of RUN tokens that documents fall into, a document's one after the other: document, number in it, begin, length."""
    size = np.diff(first)
    count = -(-size // RUN)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][doc] + nth * RUN
    return doc, nth, begin, np.minimum(RUN, first[1:][doc] - begin)


def _forward(model: Model, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of ranges that start a text, and the state's shares at their ends."""
    order, running = _lanes(begin, size)
    begin = begin[order]
    total, last = np.zeros(len(order)), np.empty((len(order), STATES))
    alpha = np.tile(model.start, (len(order), 1))
    for t, n in enumerate(running):
        if t:
            alpha = alpha[:n] @ model.move
        alpha = alpha[:n] * model.emit[symbols[begin[:n] + t]]
        scale = alpha.sum(1)
        total[:n] += np.log10(scale)
        alpha /= scale[:, None]
        last[:n] = alpha
    out, ends = np.empty(len(order)), np.empty_like(last)
    out[order], ends[order] = total, last
    return out, ends


def _products(model: Model, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges within a text, the product of all steps' moves times emissions, (ranges, states, states), as numbers
    around 1 and log10 of what they lack."""
    order, running = _lanes(begin, size)
    begin = begin[order]
    product, logs = np.tile(np.eye(STATES), (len(order), 1, 1)), np.zeros(len(order))
    for t, n in enumerate(running):
        step = (product[:n].reshape(-1, STATES) @ model.move).reshape(-1, STATES, STATES)
        product[:n] = step * model.emit[symbols[begin[:n] + t]][:, None, :]
        if t % 8 == 7 or t == len(running) - 1:
            most = product[:n].max((1, 2))
            product[:n] /= most[:, None, None]
            logs[:n] += np.log10(most)
    out, lack = np.empty_like(product), np.empty_like(logs)
    out[order], lack[order] = product, logs
    return out, lack


def _links(model: Model, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """log10 of each document's probability; by run, the state's shares before its first token (of a first run: none)
    and the backward state at its last; the runs."""
    doc, nth, begin, size = runs = _runs(first)
    at = np.flatnonzero(nth == 0)
    total, state = np.zeros(len(first) - 1), np.empty((len(first) - 1, STATES))
    total[doc[at]], state[doc[at]] = _forward(model, symbols, begin[at], size[at])
    enter, leave = np.zeros((len(doc), STATES)), np.ones((len(doc), STATES))
    later = np.flatnonzero(nth > 0)
    if len(later):
        product, logs = _products(model, symbols, begin[later], size[later])
        by = later[np.argsort(nth[later], kind="stable")]
        cuts = np.searchsorted(nth[by], np.arange(1, nth.max() + 2))
        place = np.empty(len(doc), np.int64)
        place[later] = np.arange(len(later))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = by[a:b]
            enter[now] = state[doc[now]]
            after = (enter[now][:, None, :] @ product[place[now]])[:, 0]
            scale = after.sum(1)
            state[doc[now]] = after / scale[:, None]
            total[doc[now]] += np.log10(scale) + logs[place[now]]
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            now = by[a:b]
            before = (product[place[now]] @ leave[now][:, :, None])[:, :, 0]
            leave[now - 1] = before / before.sum(1, keepdims=True)
    return total, enter, leave, runs


def _likelihood(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of each document's probability, by the scaled forward recursion."""
    return _links(model, symbols, first)[0]


def _expect(model: Model, symbols: np.ndarray, first: np.ndarray, counts: dict[str, np.ndarray]) -> None:
    """Adds expected counts of documents, by the scaled forward-backward recursion."""
    _, enter, leave, (_, nth, begin, size) = _links(model, symbols, first)
    for i in range(0, len(nth), RUNS):
        _expect_runs(model, symbols, *(x[i : i + RUNS] for x in (nth, begin, size, enter, leave)), counts)


def _expect_runs(model: Model, symbols: np.ndarray, nth: np.ndarray, begin: np.ndarray, size: np.ndarray, enter: np.ndarray, leave: np.ndarray, counts: dict[str, np.ndarray]) -> None:
    order, running = _lanes(begin, size)
    nth, begin, enter, leave = nth[order], begin[order], enter[order], leave[order]
    later = nth > 0
    alpha = np.where(later[:, None], enter @ model.move, model.start)
    alphas, scales = [], []
    for t, n in enumerate(running):
        if t:
            alpha = alphas[-1][:n] @ model.move
        alpha = alpha[:n] * model.emit[symbols[begin[:n] + t]]
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        alphas.append(alpha)
        scales.append(scale)
    beta = np.ones((0, STATES))
    seen, weights = [], []
    for t in range(len(running) - 1, -1, -1):
        n, m = running[t], len(beta)
        own = np.empty((n, STATES))
        own[m:] = leave[m:n] / (alphas[t][m:] * leave[m:n]).sum(1, keepdims=True)
        if m:
            ahead = model.emit[symbols[begin[:m] + t + 1]] * beta / scales[t + 1][:, None]
            own[:m] = ahead @ model.move.T
            counts["move"] += model.move * (alphas[t][:m].T @ ahead)
        beta = own
        gamma = alphas[t] * beta
        seen.append(symbols[begin[:n] + t])
        weights.append(gamma)
        if t == 0:
            counts["start"] += gamma[~later].sum(0)
            ahead = model.emit[symbols[begin]] * beta / scales[0][:, None]
            counts["move"] += model.move * (enter[later].T @ ahead[later])
    seen, weights = np.concatenate(seen), np.concatenate(weights)
    for s in range(STATES):
        counts["emit"][:, s] += np.bincount(seen, weights=weights[:, s], minlength=len(model.emit))


def _nothing(model: Model) -> dict[str, np.ndarray]:
    return {"start": np.zeros(STATES), "move": np.zeros((STATES, STATES)), "emit": np.zeros((len(model.emit), STATES))}


def _update(model: Model, counts: dict[str, np.ndarray], base: np.ndarray) -> None:
    """New parameters from expected counts; a little of the words' overall shares keeps every symbol possible."""
    model.start = (counts["start"] + 1) / (counts["start"].sum() + STATES)
    model.move = (counts["move"] + 1) / (counts["move"].sum(1, keepdims=True) + STATES)
    emit = counts["emit"] + 10 * base[:, None]
    model.emit = emit / emit.sum(0)


def fit(texts: DataFrame, text: str = "text", seed: int = 11) -> tuple[Model, DataFrame]:
    """A model of the texts, and its counts: (h, h2, g, c) of each distinct token. Null texts count as empty."""
    texts = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ends = texts.count()
    counts = stored(count_tokens(texts), "counts")
    sums = counts.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows at most
    top = counts.orderBy(F.desc("c"), "h", "h2").limit(COMMON).toArrow()
    h, h2 = (top[n].to_numpy().view(np.uint64) for n in ("h", "h2"))
    g, c = top["g"].to_numpy(), top["c"].to_numpy()
    symbol = np.where(np.arange(len(h)) < SYMBOLS, np.arange(len(h)), -1)
    size_n, size_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums:
        size_n[r["g"]], size_v[r["g"]] = r["n"], r["v"]
    tokens, distinct = int(size_n.sum()) + ends, int(size_v.sum()) + (ends > 0)
    head = symbol >= 0
    size_n -= np.bincount(g[head], weights=c[head], minlength=CLASSES).astype(np.int64)
    size_v -= np.bincount(g[head], minlength=CLASSES)
    base = np.zeros(SYMBOLS + CLASSES + 1)
    base[: head.sum()] = c[head]
    base[SYMBOLS : SYMBOLS + CLASSES] = size_n + 1
    base[-1] = ends + 1
    base /= base.sum()
    order = np.argsort(h)
    rng = np.random.default_rng(seed)
    emit = base[:, None] * rng.uniform(0.5, 1.5, (len(base), STATES))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    model = Model(Lookup(h[order], h2[order], c[order], symbol[order]), np.full(STATES, 1 / STATES), move, emit / emit.sum(0), ends, tokens, distinct, size_n + size_v + 1)
    if not ends:
        return model, counts
    share, most = min(1.0, SAMPLE_TEXTS / ends), SAMPLE_CHARS // 100
    # Of a longer text a piece from anywhere in it starts the training; the rounds that follow take whole texts.
    at = F.pmod(F.xxhash64("x"), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int") + 1
    drawn = texts.withColumn("x", F.xxhash64("text")).where(F.pmod("x", F.lit(1 << 40)) < share * (1 << 40))
    sample, used = [], 0
    for r in drawn.select("x", F.col("text").substr(at, F.lit(most)).alias("text")).distinct().orderBy("x", "text").limit(2 * SAMPLE_TEXTS).toLocalIterator():
        if used < SAMPLE_CHARS:
            sample.append(r["text"])
            used += len(r["text"])
    ready = [model.symbols(data, offsets)[:2] for _, _, data, offsets in blocks(pa.array(sample, pa.string()))]
    for _ in range(SAMPLE_ROUNDS):
        found = _nothing(model)
        for symbols, first in ready:
            _expect(model, symbols, first, found)
        _update(model, found, base)
    for _ in range(ROUNDS):
        _update(model, _round(texts, model), base)
    return model, counts


def _round(texts: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Expected counts over all texts: summed in each task, then by row of the parameters."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(STATES)]

    def run(batches):
        m = sent.value
        found = _nothing(m)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                symbols, first, *_ = m.symbols(data, offsets)
                _expect(m, symbols, first, found)
        rows = np.concatenate([found["emit"], found["move"], found["start"][None]])
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(rows[used, i]) for i in range(STATES)]], names=["row", *names])

    summed = in_batches(texts, run, "row long, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    rows = np.zeros((len(model.emit) + STATES + 1, STATES))
    rows[summed["row"].to_numpy()] = np.stack([summed[n].to_numpy() for n in names], axis=1)
    return {"emit": rows[: len(model.emit)], "move": rows[len(model.emit) : -1], "start": rows[-1]}


def score(df: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with n_tokens, n_known, train_tokens (long), base_score and score, log10 of probabilities.

    base_score: every token's (c + 1) / (N + V + 1). A null text counts as empty: an end only. A row for each row, whatever
    its other columns; those of the new names are replaced. Without training texts score is base_score.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    df = df.drop(*made)
    names = [c for c in df.columns if c != text]
    sent = df.sparkSession.sparkContext.broadcast(model)
    new = ["__n", "__known", "__base", "__score", "__rare", "__rare2", "__times"]

    def run(batches):
        m = sent.value
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(batch.num_columns - 1), 4 << 20):
                symbols, to, h, h2, g, s, c, known, first = m.symbols(data, offsets)
                logs = np.log10(c + 1.0)
                within = np.where(s >= 0, 0.0, logs - np.log10(m.class_size[g]))
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (logs, within, known & (c > 0))]
                base, inner, here = (x[first[1:]] - x[first[:-1]] for x in sums)
                doc = np.repeat(np.arange(j - i), np.diff(first))[~known]
                rare, rare2 = h[~known], h2[~known]
                order = np.lexsort((rare2, rare, doc))
                rare, rare2, doc = rare[order], rare2[order], doc[order]
                new_ = np.ones(len(rare), bool)
                new_[1:] = (rare[1:] != rare[:-1]) | (rare2[1:] != rare2[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new_)
                times = np.diff(np.append(at, len(rare)))
                cuts = pa.array(np.searchsorted(doc[at], np.arange(j - i + 1)), pa.int32())
                n = np.diff(to)
                base += np.log10(m.ends + 1.0) - n * np.log10(m.tokens + m.distinct + 1.0)
                inner += _likelihood(m, symbols, to)
                columns = [pa.array(n), pa.array(here + (m.ends > 0)), pa.array(base), pa.array(inner), *[pa.ListArray.from_arrays(cuts, pa.array(x[at].view(np.int64))) for x in (rare, rare2)], pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*[x.slice(i, j - i) for x in batch.columns[:-1]], *columns], names=[*batch.schema.names[:-1], *new])

    plain = df.select(*[F.col(f"`{n}`") for n in names])
    fields = ", ".join(["__n long", "__known long", "__base double", "__score double", "__rare array<long>", "__rare2 array<long>", "__times array<int>"])
    schema = plain.schema
    for f in df.sparkSession.createDataFrame([], fields).schema:
        schema = schema.add(f)
    first = in_batches(df.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias("__text")), run, schema)
    first = stored(first.withColumn("__row", F.monotonically_increasing_id()), "scores")
    rare = first.select("__row", F.explode(F.arrays_zip("__rare", "__rare2", "__times")).alias("e")).select("__row", F.col("e.__rare").alias("h"), F.col("e.__rare2").alias("h2"), F.col("e.__times").alias("t"))
    met = rare.join(counts.select("h", "h2", "c"), ["h", "h2"]).groupBy("__row").agg(F.sum("t").alias("__k"), F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("__l"))
    out = first.drop("__rare", "__rare2", "__times").join(met, "__row", "left")
    more = F.coalesce("__l", F.lit(0.0))
    final = F.lit(model.ends > 0)
    return out.select(*[F.col(f"`{n}`") for n in names], F.col("__n").alias("n_tokens"), (F.col("__known") + F.coalesce("__k", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("__base") + more).alias("base_score"), F.when(final, F.col("__score") + more).otherwise(F.col("__base") + more).alias("score"))
