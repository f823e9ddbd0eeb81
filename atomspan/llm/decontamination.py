"""Benchmark decontamination with DataFrame expressions only.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Every run of ``N`` words of a benchmark item is a
window; an item of fewer words, but not none, is one window. The windows form a hash set that is broadcast as values
of scalar subqueries. A text is scanned in place, so
neither texts nor words are shuffled and each row of the corpus keeps to itself, whatever its id:

1. A bit table of each window's longest word drops most places as soon as their one word is hashed.
2. The windows around a place that is left are hashed and looked up in a bit table of all windows' hashes.
3. What is left is looked up in the hash table, and counts once its words equal the window's.

The benchmark is small against the corpus, but that is checked: more than ``TABLE_WINDOWS`` windows are dealt into several
tables, each of them used in a pass of its own; a long item goes in pieces of PIECE windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import stored

N = 10
#: Windows in one table, at about 50 bytes each.
TABLE_WINDOWS, PIECE = 100_000, 10_000
#: Slots of the bit table and of the hash table.
BITS, SLOTS = 1 << 18, 1 << 15

_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z only; null for null."""
    return F.regexp_extract_all(F.translate(text, _A_Z, _a_z), F.lit(_WORD), F.lit(0))


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (id, w) of the items with a word."""
    return benchmark.select(F.col(item).cast("string").alias("id"), words(F.col(text).cast("string")).alias("w")).where(F.size("w") > 0).distinct()


def _pieces(items: DataFrame, n: int) -> DataFrame:
    """Items of more than PIECE windows as several, which overlap so that they have the same windows."""
    more = F.greatest(F.size("w") - n, F.lit(0)) / PIECE
    return items.select("id", "w", F.explode(F.sequence(F.lit(0), F.floor(more).cast("int"))).alias("k")).select("id", F.slice("w", F.col("k") * PIECE + 1, PIECE + n - 1).alias("w"))


def _starts(n: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """Distinct windows (array of words) with the sorted ids, as strings, of the items they are of; no null ids.

    Null texts and texts without words have none.
    """
    return _items(benchmark, item, text).select("id", F.explode(F.transform(_starts(n), lambda s: F.slice("w", s + 1, n))).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("id")).alias("items"))


def _hash(array: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(array, at + F.lit(k)) for k in range(length)])


def _places(h: Column) -> list[Column]:
    """Two places of a hash in a bit table."""
    return [F.pmod(x, F.lit(BITS)).cast("int") for x in (h, F.shiftright(h, 24))]


def _bit_table(hashes: DataFrame) -> Column:
    """Scalar subquery: the bits at the places of the column h, 64 to a number."""
    found = hashes.select(F.explode(F.array(*_places(F.col("h")))).alias("p")).groupBy(F.shiftright("p", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, p & 63))").alias("v"))
    return _in_places(found, BITS // 64, F.coalesce("v", F.lit(0)))


def _in_places(rows: DataFrame, size: int, value: Column) -> Column:
    """Scalar subquery: an array of ``size`` values, at place k that of the row with this k."""
    every = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("k")).join(rows, "k", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]).alias("t")).scalar()


def _in_table(table: str, h: Column) -> Column:
    a, b = _places(h)
    bit = lambda p: F.getbit(F.get(F.col(table), F.shiftright(p, 6)), p.bitwiseAND(63)) == 1
    return bit(a) & bit(b)


def _scan(corpus: DataFrame, bench: DataFrame, lengths: list[int], n: int, w: str, into: str) -> DataFrame:
    """``corpus`` with the windows of ``bench`` that occur in the words ``w`` appended to the array ``into``."""
    listed = bench.agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("items"))
    each = listed.select(F.posexplode("items").alias("i", "x")).select("i", F.col("x.w").alias("w")).select("i", "w", F.explode(_starts(n)).alias("s"), F.least(F.size("w"), F.lit(n)).alias("len"))
    h = F.coalesce(*[F.when(F.col("len") == k, _hash(F.col("w"), F.col("s"), k)) for k in lengths])
    each = each.select("i", "s", h.alias("h"), F.array_max(F.transform(F.slice("w", F.col("s") + 1, n), lambda x: F.struct(F.octet_length(x).alias("l"), x.alias("x"))))["x"].alias("anchor"))
    slots = each.groupBy(F.pmod("h", F.lit(SLOTS)).cast("int").alias("k")).agg(F.collect_list(F.struct("i", "s")).alias("v"))

    shortest = each.agg(F.min(F.octet_length("anchor"))).first()[0]
    marked = lambda i: (F.octet_length(F.get(F.col(w), i)) >= shortest) & _in_table("__bits", F.xxhash64(F.get(F.col(w), i)))
    near = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), marked)).otherwise(F.array().cast("array<int>"))
    out = corpus.withColumn("__bits", _bit_table(each.select(F.xxhash64("anchor").alias("h")))).withColumn("__near", near).drop("__bits")

    def likely(length: int) -> Column:
        """Start, length and hash of the windows of one length around marked words that are in the bit table."""
        last = F.size(w) - F.lit(length)
        starts = F.flatten(F.transform(F.filter("__near", lambda i: i - F.lit(length - 1) <= last), lambda i: F.sequence(F.greatest(i - F.lit(length - 1), F.lit(0)), F.least(i, last))))
        found = F.transform(F.array_distinct(starts), lambda s: F.struct(s.alias("s"), F.lit(length).alias("len"), _hash(F.col(w), s, length).alias("h")))
        return F.when(last >= 0, F.filter(found, lambda x: _in_table("__bits", x["h"]))).otherwise(F.array())

    some = F.size("__near") > 0
    none = F.array().cast("array<struct<s:int,len:int,h:bigint>>")
    out = out.withColumn("__bits", F.when(some, _bit_table(each.select("h")))).withColumn("__near", F.when(some, F.concat(*[likely(k) for k in lengths])).otherwise(none)).drop("__bits")

    # Only rows with such windows carry the table.
    some = F.size("__near") > 0
    out = out.withColumn("__slots", F.when(some, _in_places(slots, SLOTS, F.col("v")))).withColumn("__items", F.when(some, listed.scalar()))
    equal = lambda x: F.filter(F.get(F.col("__slots"), F.pmod(x["h"], F.lit(SLOTS)).cast("int")), lambda e: F.slice(F.get(F.col("__items"), e["i"])["w"], e["s"] + 1, x["len"]) == F.slice(w, x["s"] + 1, x["len"]))
    exact = F.transform("__near", lambda x: F.struct(x["s"].alias("start"), (x["s"] + x["len"]).alias("stop"), F.array_distinct(F.transform(F.coalesce(equal(x), F.array()), lambda e: F.get(F.col("__items"), e["i"])["id"])).alias("items")))
    none = F.array().cast(_HITS)
    return out.withColumn(into, F.concat(into, F.when(some, F.filter(exact, lambda x: F.size(x["items"]) > 0)).otherwise(none))).drop("__near", "__slots", "__items")


_HITS = "array<struct<start:int,stop:int,items:array<string>>>"


def find(corpus: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """Each row of ``corpus`` as it is, with what its text shares with the benchmark.

    n_words (long), bench_hits: array of (start, stop, items) of the windows that occur, as 0-based word ranges with stop
    excluded; a null id stands as null among items. A null or empty text has 0 words and no hits; very long texts are
    scanned whole, and rows that repeat give rows that repeat. Columns of ``corpus`` of these names are replaced.
    """
    made = ["n_words", "bench_hits"]
    kept = [F.col(f"`{c}`") for c in corpus.columns if c not in made]
    return _find(corpus, benchmark, text, item, item_text, n).select(*kept, F.col("__n").alias("n_words"), F.col("__hits").alias("bench_hits"))


def _find(corpus: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """All columns of ``corpus``, with __n and __hits."""
    bench = _pieces(_items(benchmark, item, item_text), n)
    sizes = bench.groupBy(F.least(F.size("w"), F.lit(n)).alias("k")).agg(F.sum(F.size(_starts(n))).alias("n")).collect()  # n rows at most
    lengths, total = sorted(r["k"] for r in sizes), sum(r["n"] for r in sizes)
    w, into = "__words", "__hits"
    out = corpus.withColumn(w, words(F.col(f"`{text}`").cast("string")))
    out = out.withColumn("__n", F.greatest(F.coalesce(F.size(w), F.lit(0)), F.lit(0)).cast("long")).withColumn(into, F.array().cast(_HITS))
    parts = -(-total // TABLE_WINDOWS)
    for part in range(parts):
        own = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("id", "w"), F.lit(parts)) == part)
        out = _scan(out, own, lengths, n, w, into)
        if part + 1 < parts:  # a pass for each table
            out = stored(out, "bench")
    return out.drop(w)


def n_hit(hits: Column) -> Column:
    """Words inside any of the hits."""
    ordered = F.array_sort(F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(ordered, zero, lambda a, x: F.struct((a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["stop"]).alias("to")))["n"]


def items(hits: Column) -> Column:
    """Distinct ids of the items that occur, sorted as strings."""
    return F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["items"])))))


def remove_documents(corpus: DataFrame, benchmark: DataFrame, text: str = "text", max_hit: int = 0) -> DataFrame:
    """Rows of ``corpus`` with at most ``max_hit`` words inside windows of the benchmark; columns as in ``corpus``."""
    # Rows go by an empty array to explode: a filter would be pushed into the scan and repeat its expressions.
    kept = F.when(n_hit(F.col("__hits")) <= max_hit, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return _find(corpus, benchmark, text).withColumn("__kept", F.explode(kept)).select(*[F.col(f"`{c}`") for c in corpus.columns])


def remove_spans(corpus: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``corpus`` whose texts lack the words inside windows; a text with hits becomes its other words, a space between.

    Texts without hits stay as they are, to the byte; all other columns do.
    """
    found = _find(corpus, benchmark, text).withColumn("__words", F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(r"[0-9A-Za-z\x80-\x{10FFFF}]+"), F.lit(0)))
    kept = F.filter("__words", lambda x, i: ~F.exists("__hits", lambda h: (h["start"] <= i) & (i < h["stop"])))
    clean = F.when(F.size("__hits") > 0, F.array_join(kept, " ")).otherwise(F.col(f"`{text}`"))
    return found.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in corpus.columns])
