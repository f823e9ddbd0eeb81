"""Language identification by cross-parsing.

A text is parsed, against the training text of each language, into the longest phrases that occur in that training
text (Ziv-Merhav cross-parsing). The number of phrases times log2 of the training length, over the text's length,
estimates the cross entropy in bits a letter; the language with the smallest estimate wins. A phrase costs no less than
log2 of the number of letters that all languages have, and a letter that the training text lacks costs as much again, so
that a short training text is not cheap.

Longest matches come from a suffix automaton of each language's training text. A phrase always starts at the
automaton's root, so the automaton is stored as one dense table whose missing transitions already hold the restart:
a parse is one table look-up a letter, and many parses advance together in numpy lanes. Every letter of a training text
is a symbol of its own: the most frequent ones of the language have a column, transitions by the others are found in a
sorted list. Long texts are cut into lanes of ``LANE`` letters; a cut ends a phrase, alike for every language.

Texts are lower-cased letter by letter; a run of anything else counts as one space.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import in_batches
from ._text import blocks, worker_cache

#: Letters of training text a language, of all languages together, and rows a language from which they are taken.
TRAIN_CHARS, TRAIN_CHARS_ALL, TRAIN_ROWS = 1 << 15, 1 << 19, 300
#: Of longer rows a piece of this length is taken for training, so that a sample holds several rows.
TRAIN_ROW_CHARS = 8192
LANE = 512
UNDETERMINED = "und"

_PAD, _SPACE, _OTHER, _FIRST = 0, 1, 2, 3
#: Columns of a table at most; further letters of a language have sparse transitions.
_CLASSES = 64
_SHIFT = 29


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower case (itself if that is no single letter)."""
    size = 0x110000
    alpha, lower = np.zeros(size, bool), np.arange(size, dtype=np.int32)
    for c in range(size):
        s = chr(c)
        if s.isalpha():
            alpha[c] = True
            if len(t := s.lower()) == 1:
                lower[c] = ord(t)
    return alpha, lower


class Automaton(NamedTuple):
    """Parsing table of a text's suffix automaton, whose rows have ``width`` columns.

    Row s, column c: next state times ``width``, plus 2**29 for each phrase that ends by reading c in state s. Letters
    without a column are numbered from 0 to ``n_rare``; ``keys`` holds state * n_rare + letter of their transitions in
    order, ``values`` the next state times ``width``, and ``restart`` for each letter the value where there is none.
    """

    width: int
    table: np.ndarray
    n_rare: int
    keys: np.ndarray
    values: np.ndarray
    restart: np.ndarray

    def rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Values of reading letters without a column in states, given as state times ``width``."""
        key = state.astype(np.int64) // self.width * self.n_rare + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.restart[letter])


def automaton(codes: list[int], width: int) -> Automaton:
    """Of a text in columns below ``width`` and, from there on, letters without a column."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    order = np.argsort(np.array(length), kind="stable")  # states near the root lie together
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.repeat(place, [len(d) for d in nxt])
    letter = np.fromiter((c for d in nxt for c in d), np.int64)
    target = place[np.fromiter((v for d in nxt for v in d.values()), np.int64)]
    dense = letter < width
    table = np.full((len(nxt), width), -1, np.int32)
    table[rows[dense], letter[dense]] = target[dense]
    root = table[0].copy()
    known = table >= 0
    restart = np.where(root >= 0, root * width + (1 << _SHIFT), 1 << _SHIFT)
    unknown = root < 0
    table *= width
    np.copyto(table, (restart + np.where(unknown, 1 << _SHIFT, 0)).astype(np.int32), where=~known)
    table[0] = np.where(known[0], table[0], restart)
    table[:, _PAD] = np.arange(len(nxt)) * width
    # Every letter of the text leaves the root, so one without a column ends at most the phrase before it.
    n_rare = int(max(letter, default=0)) + 1 - width if not dense.all() else 0
    keys = rows[~dense] * n_rare + letter[~dense] - width
    order = np.argsort(keys)
    values = (target[~dense] * width).astype(np.int32)[order]
    first = values[:n_rare] + np.int32(1 << _SHIFT)
    return Automaton(width, table.ravel(), n_rare, keys[order], values, first)


class Model:
    """Training texts by language; automata are built once in each process."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.texts = [texts[k] for k in self.langs]
        self.key = hashlib.sha256(repr(list(zip(self.langs, self.texts, strict=True))).encode()).hexdigest()

    def tables(self) -> tuple[np.ndarray, list[tuple[Automaton, np.ndarray]], np.ndarray, float]:
        """Symbol of each code point; each language's automaton and its column for each symbol; bits of a phrase in each,
        and of a letter that a training text lacks."""
        if worker_cache("language", _built).get("key") != self.key:
            alpha, lower = _letters()
            points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in self.texts]
            seen = np.unique(np.concatenate([lower[p[alpha[p]]] for p in points] or [np.zeros(0, np.int32)]))
            of = np.full(0x110000, _OTHER, np.min_scalar_type(_FIRST + len(seen)))
            of[seen] = np.arange(_FIRST, _FIRST + len(seen))
            symbols = np.where(alpha, of[lower], of.dtype.type(_SPACE))
            automata, sizes = [], []
            for p in points:
                codes = symbols[p]
                codes = codes[(codes != _SPACE) | (np.concatenate([[0], codes[:-1]]) != _SPACE)]
                own, times = np.unique(codes[codes >= _FIRST], return_counts=True)
                own = own[np.argsort(-times, kind="stable")]
                column = np.full(_FIRST + len(seen), _OTHER, np.int32)
                column[[_PAD, _SPACE]] = _PAD, _SPACE if (codes == _SPACE).any() else _OTHER
                column[own] = np.arange(_FIRST, _FIRST + len(own))
                automata.append((automaton(column[codes].tolist(), min(_CLASSES, _FIRST + len(own))), column))
                sizes.append(len(codes))
            least = len(seen) + 2  # the letters, the space and any other letter
            _built.update(key=self.key, tables=(symbols, automata, np.log2(np.maximum(sizes, least)), math.log2(least)))
        return _built["tables"]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents in a block: phrases by language, letters and spaces read, whether there is a letter, and by language
        the letters and spaces that its training text lacks."""
        symbols, automata, *_ = self.tables()
        n = len(offsets) - 1
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=at[1:])
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        codes, first = symbols[points], at[offsets]
        keep = codes != _SPACE
        keep[1:] |= codes[:-1] != _SPACE
        keep[first[:-1][first[:-1] < len(codes)]] = True
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        lettered = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(codes != _SPACE, out=lettered[1:])
        has_letter = lettered[first[1:]] > lettered[first[:-1]]
        codes, first = codes[keep], kept[first]
        size = np.diff(first)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(n), lanes)
        start = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(start + LANE, first[1:][doc])
        total, lacking = np.zeros((2, len(automata), n), np.int64)
        if len(doc):
            steps = np.arange(LANE)
            order = np.argsort(start - stop, kind="stable")  # longest first
            start, stop, doc = start[order], stop[order], doc[order]
            running = np.searchsorted(start - stop, -steps, "left")  # lanes longer than each step
            padded = np.concatenate([codes, np.zeros(LANE, codes.dtype)])
            letters = [padded[start[: running[t]] + t] for t in range(LANE) if running[t]]
            mask = np.int32((1 << _SHIFT) - 1)
            for k, (auto, column) in enumerate(automata):
                state, count = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)
                own = column[codes]
                lacking[k] = np.bincount(np.searchsorted(first, np.flatnonzero(own == _OTHER), "right") - 1, minlength=n)
                beyond = auto.n_rare > 0 and bool((own >= auto.width).any())
                for c in letters:
                    c = column[c]
                    far = np.flatnonzero(c >= auto.width) if beyond else ()
                    if len(far):
                        found = auto.rare(state[far], c[far] - auto.width)
                        c[far] = _OTHER
                    v = auto.table[state[: len(c)] + c]
                    if len(far):
                        v[far] = found
                    count[: len(c)] += v >> _SHIFT
                    state[: len(c)] = v & mask
                total[k] = np.bincount(doc, weights=count + (state > 0), minlength=n)
        return total, size, has_letter, lacking

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a letter of each document in a block."""
        n = len(offsets) - 1
        if not self.langs or not len(data):
            return [UNDETERMINED] * n, np.zeros(n), np.full(n, np.nan)
        total, size, has_letter, lacking = self.phrases(data, offsets)
        _, _, phrase, literal = self.tables()
        bits = (total * phrase[:, None] + lacking * literal) / np.maximum(size, 1)
        best = bits.argmin(0)  # ties: the first language in alphabetical order
        low = bits.min(0)
        rest = bits.copy()
        rest[best, np.arange(n)] = np.inf
        second = rest.min(0)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / np.maximum(low + second, 1e-300))
        langs = [self.langs[b] if h else UNDETERMINED for b, h in zip(best, has_letter, strict=True)]
        return langs, np.where(has_letter, score, 0.0), np.where(has_letter, low, np.nan)


_built: dict = {}


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from rows with a text and a language.

    Takes a sample of at most TRAIN_ROWS distinct texts a language (in expectation; drawn by a hash of the text, so copies
    count once), and from it at most TRAIN_CHARS characters a language, TRAIN_CHARS_ALL together; of a text longer than
    TRAIN_ROW_CHARS a piece from anywhere in it. Rows whose language or text is null or that have no letter are left out.
    A table without such rows gives a model that answers ``und``.
    """
    letter = r"\p{L}"
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null").where(F.col("text").rlike(letter)).withColumn("x", F.xxhash64("text"))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("x").alias("n")).collect()}
    if not counts:
        return Model({})
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, TRAIN_ROWS / n)) for k, n in counts.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").withColumn("h", F.pmod("x", F.lit(1 << 40))).where(F.col("h") < F.col("share") * (1 << 40))
    at = F.pmod(F.xxhash64("x"), F.length("text") - TRAIN_ROW_CHARS + 1).cast("int") + 1
    piece = F.col("text").substr(at, F.lit(TRAIN_ROW_CHARS))
    piece = F.when(piece.rlike(letter), piece).otherwise(F.regexp_extract("text", rf"(?s){letter}.{{0,{TRAIN_ROW_CHARS - 1}}}", 0))
    sample = drawn.select(F.when(F.length("text") <= TRAIN_ROW_CHARS, F.col("text")).otherwise(piece).alias("text"), "lang", "h").distinct()
    budget = min(TRAIN_CHARS, max(1024, TRAIN_CHARS_ALL // len(counts)))
    texts: dict[str, list[str]] = {}
    used: Counter = Counter()
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        if used[r["lang"]] < budget:
            texts.setdefault(r["lang"], []).append(t := r["text"][: budget - used[r["lang"]]])
            used[r["lang"]] += len(t) + 1
    return Model({k: " ".join(v) for k, v in texts.items()})


def detect(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df``, its ``text`` last or left out, with lang_pred, lang_score (0 to 1) and lang_bits; for each row, one row.

    A null text and one without a letter give ``und``, score 0 and null bits. Equal scores go to the first language by
    name. Very long texts are parsed whole, in lanes; rows with the same text get the same answer. Columns of ``df`` called lang_pred, lang_score or lang_bits are replaced.
    """
    made = ["lang_pred", "lang_score", "lang_bits"]
    df = df.drop(*made)
    kept = [f for f in df.schema.fields if f.name != text]
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = [f.name for f in kept]

    def run(batches):
        m = sent.value
        for batch in batches:
            passed = batch.columns if keep_text else batch.columns[:-1]
            for i, j, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                langs, scores, bits = m.predict(data, offsets)
                columns = [*[c.slice(i, j - i) for c in passed], pa.array(langs, pa.string()), pa.array(scores), pa.array(bits, mask=np.isnan(bits))]
                yield pa.RecordBatch.from_arrays(columns, names=[*schema.names])

    back = [F.col(f"`{n}`") for n in names] + ([F.col(text).cast("string").alias(text)] if keep_text else [])
    schema = df.select(*back).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_bits", "double")
    return in_batches(df.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias("__text")), run, schema)


def crc_mod(column: str, m: int):
    """crc32 of a column as text, modulo m; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def bits_of_chance(model: Model) -> float:
    """Bits a letter beyond which a text is parsed no better than letter by letter."""
    return float(max(model.tables()[2], default=0.0))
