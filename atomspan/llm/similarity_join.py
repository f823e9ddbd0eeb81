"""Near duplicates by an n-gram Jaccard join: a MinHash LSH forest, then exact verification.

A text is the set of its runs of five words. Texts of the same set are one class from the start. Each class has TREES
signatures of DEPTH MinHash values. A tree is the trie of its signatures; two classes are candidates if they share a
prefix of the matched length in some tree, that is, lie in one subtree at that depth, which a grouping by prefix finds.
The matched prefixes start whole and are shortened, a value at a time, until a pair at the threshold meets in some
tree with the target recall and the similar pairs of a sample of classes do so as well (:func:`fitted_length`); more
similar pairs meet more surely. Below a threshold of about 0.33 even prefixes of one value miss the target, and the
shorter the prefixes, the larger the subtrees to be verified.

Candidates are verified on the sets themselves. The components that shared prefixes link are units of work if they
have at most BLOCK_ROWS classes and BLOCK_SET_BYTES of sets, and all their pairs are verified. Of a larger one, either every pair
of its blocks is a unit, or every pair of blocks of each of its subtrees, a pair of classes counting in the first tree in
which they meet: whichever copies fewer sets. Units return counts of links and a spanning forest, never pairs, so their
output has a row for each class in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import hot_join, in_batches, stored
from ._text import blocks, mix, shingles, split_words, worker_cache
from .components import connected_components

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH = 16, 8
RECALL = 0.998
#: Classes, and bytes of their sets, in a block.
BLOCK_ROWS, BLOCK_SET_BYTES = 2048, 16 << 20
#: Rows of a unit's matrix that are compared at once.
STRIP = 256
#: Classes (in expectation; twice as many at most) whose similar pairs check the length of prefixes.
FIT_ROWS = 1000
#: Bits of the filter through which texts pass that are read again, at least and at most. A full filter keeps no text back.
FILTER_BITS = (1 << 16, 1 << 26)

_rng = np.random.default_rng(20)
_A = (_rng.integers(1, 1 << 32, TREES * DEPTH, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with probability ``recall``; 1 at least."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def _met(sig: np.ndarray, pairs: np.ndarray, length: int) -> np.ndarray:
    """Whether pairs of rows of (classes, trees, DEPTH) share a prefix in some tree."""
    return (sig[pairs[:, 0], :, :length] == sig[pairs[:, 1], :, :length]).all(2).any(1)


def fitted_length(classes: DataFrame, threshold: float, count: int) -> int:
    """The length of matched prefixes: :func:`prefix_length`, or less if pairs of a sample miss each other more often.

    The sample is of the classes whose first value in the first tree falls into a range, so that similar classes are
    in it together; FIT_ROWS of them are expected and twice as many taken at most. Their pairs of estimated similarity
    over the threshold are looked at in the other trees.
    """
    length = prefix_length(threshold)
    some = max(1, count // FIT_ROWS)
    first = F.conv(F.hex(F.substring("sig", 1, 2)), 16, 10).cast("int")
    rows = [r["sig"] for r in classes.where(first < 65536 // some + 1).limit(2 * FIT_ROWS).select("sig").collect()]
    if len(rows) < 2:
        return length
    sig = np.frombuffer(b"".join(map(bytes, rows)), ">u2").astype(np.uint16).reshape(-1, TREES, DEPTH)[:, 1:]
    flat, found = sig.reshape(len(sig), -1), []
    for i in range(len(sig) - 1):
        like = (flat[i + 1 :] == flat[i]).mean(1) >= threshold
        found.append(np.stack([np.full(like.sum(), i), i + 1 + np.flatnonzero(like)], axis=1))
    pairs = np.concatenate(found)
    missed = len(pairs) * (1 - RECALL)
    while length > 1 and (~_met(sig, pairs, length)).sum() > missed + 3 * missed**0.5 + 1:
        length -= 1
    return length


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each, of documents that all have a shingle: (documents, TREES * DEPTH)."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, TREES * DEPTH), np.uint16)
    for k in range(TREES * DEPTH):
        low = np.minimum.reduceat(short * _A[k] + _B[k], first[:-1])
        out[:, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, and the documents' ranges of them."""
    hashes, first = shingles(split_words(data, offsets), width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(first) - 1))])


def _digests(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set; none for an empty one."""
    one, two = mix(hashes), mix(hashes + np.uint64(0x1F83D9ABFB41BD6B))
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[first] for x in (one, two)]
    pairs = np.stack([s[1:] - s[:-1] for s in sums], axis=1)
    return [pairs[i].tobytes() if n else None for i, n in enumerate(np.diff(first))]


def sketch(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, th: hash of the text, cls: the set's digest, size of the set, sig: signatures, two bytes a value)."""

    def run(batches):
        worker_cache("join", {})
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(2)):
                hashes, first = _sets(data, offsets, width)
                full = np.flatnonzero(np.diff(first))
                sig = [None] * (j - i)
                if len(full):
                    for k, row in zip(full.tolist(), signatures(hashes, np.append(first[full], len(hashes))).astype(">u2"), strict=True):
                        sig[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(_digests(hashes, first), pa.binary()), pa.array(np.diff(first)), pa.array(sig, pa.binary())], names=["key", "th", "cls", "size", "sig"])

    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    kind = dict(df.dtypes)[key]
    return in_batches(rows, run, f"key {kind}, th long, cls binary, size long, sig binary")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, as a matrix of whole numbers in single precision, which holds them exactly."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 1:
        return size[:, None].astype(np.float32)
    values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    keep = df[column] > 1
    row, column = row[keep], column[keep]
    used, column = np.unique(column, return_inverse=True)
    df = df[used].astype(np.int64)
    out = np.zeros((m, m), np.float32)
    if len(used) and (df**2).sum() * 12e-9 < m * m * len(used) * 2e-10 + 1e-3:
        # Few texts share a shingle: count the pairs of each shingle's list.
        order = np.argsort(column, kind="stable")
        row, at = row[order], np.cumsum(df) - df
        n = 0
        while n < len(df):
            stop = max(n + 1, int(np.searchsorted(np.cumsum(df[n:] ** 2), 4 << 20)) + n)
            d, a = df[n:stop], at[n:stop]
            rows_of = row[a[0] : a[-1] + d[-1]]
            left = np.repeat(rows_of, np.repeat(d, d))
            base = np.repeat(a - a[0], d**2)
            right = rows_of[base + (np.arange(len(base)) - np.repeat(np.cumsum(d**2) - d**2, d**2)) % np.repeat(d, d**2)]
            at_, often = np.unique(left * m + right, return_counts=True)
            out.ravel()[at_] += often
            n = stop
    else:
        wide = max(1, (4 << 20) // m)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, len(used), wide):
            lo, hi = np.searchsorted(column, [a, a + wide])
            part = np.zeros((m, min(wide, len(used) - a)), np.float32)
            part[row[lo:hi], column[lo:hi] - a] = 1
            out += part @ part.T
    np.fill_diagonal(out, size)
    return out


def verify(sets: list[np.ndarray], side: np.ndarray | None, threshold: float, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set within the unit, and the first set of its component. side: if given, pairs are of both sides;
    earlier: if given, each set's prefixes in the trees before this one, and pairs that share one don't count."""
    size = np.array([len(s) for s in sets])
    both = common(sets)
    linked = np.empty(both.shape, bool)
    strips = [slice(i, i + STRIP) for i in range(0, len(sets), STRIP)]  # what is worked on at once
    for at in strips:
        own = both[at].astype(np.float64)
        linked[at] = own >= threshold * (size[at, None] + size[None, :] - own) - 1e-9
        if side is not None:
            linked[at] &= side[at, None] != side[None, :]
        for prefix in () if earlier is None else earlier.T:
            linked[at] &= prefix[at, None] != prefix[None, :]
    del both
    np.fill_diagonal(linked, False)
    root = np.arange(len(sets))
    while True:
        low = np.minimum(root, np.concatenate([np.where(linked[at], root[None, :], len(sets)).min(1) for at in strips]))
        low = low[low]
        if (low == root).all():
            return linked.sum(1), root
        root = low


def _units(df: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, root) of the rows (unit, cls, side, two, tree, prefixes, set) that are sorted by unit within partitions."""

    def run(batches):
        unit, held = None, []

        def done():
            held.sort(key=lambda h: h[0])
            names = [h[0] for h in held]
            side = np.array([h[1] for h in held]) if held[0][2] else None
            earlier = np.array([h[4][: held[0][3]] for h in held], np.int64) if held[0][3] else None
            links, root = verify([np.frombuffer(h[5], np.uint64) for h in held], side, threshold, earlier)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links, pa.int64()), pa.array([names[r] for r in root], pa.binary())], names=["cls", "links", "root"])

        for batch in batches:
            for u, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit and held:
                    yield done()
                    held = []
                unit = u
                held.append(row)
        if held:
            yield done()

    return in_batches(df, run, "cls binary, links long, root binary")


def _filter_table(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits at two places of each of n hashes (column h); of a fixed size at most, whatever their number."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * n).bit_length()))
    places = F.array(*[F.pmod(x, F.lit(bits)) for x in (F.col("h"), F.shiftright("h", 27))])
    words = hashes.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["k"].to_numpy()] = words["v"].to_numpy()
    return table


def _in_filter(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for x in (h, h >> 27):
        p = x % (64 * len(table))
        out &= table[p >> 6] >> (p & 63) & 1 == 1
    return out


def _sets_again(df: DataFrame, key: str, text: str, width: int, wanted: DataFrame, n: int) -> DataFrame:
    """(__key, __th, set) of the n rows of ``df`` that are wanted (columns k, t), and of a few more. Texts stay in their tasks."""
    table = df.sparkSession.sparkContext.broadcast(_filter_table(wanted.select(F.xxhash64("k", "t").alias("h")), n))

    def run(batches):
        for batch in batches:
            for part in [batch.filter(pa.array(_in_filter(table.value, batch.column(2).to_numpy())))]:
                for i, j, data, offsets in blocks(part.column(3)):
                    hashes, first = _sets(data, offsets, width)
                    sets = pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), part.column(1).slice(i, j - i), sets], names=["__key", "__th", "set"])

    rows = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).cast("string").alias("text")).select("k", "t", F.xxhash64("k", "t").alias("h"), "text")
    return in_batches(rows, run, f"__key {dict(df.dtypes)[key]}, __th long, set binary")


def _blocks_of(n, size):
    return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SET_BYTES)).cast("long")


def _join(df: DataFrame, key: str, text: str, threshold: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows' classes (key, th, cls), classes' components (cls, rep, at, n, root), and classes' links (cls, n_links)."""
    base = stored(sketch(df, key, text, width), "sketches")
    have = base.where("cls is not null")
    classes = stored(have.groupBy("cls").agg(F.min("key").alias("rep"), F.min(F.struct(F.col("key").isNull(), "key", "th")).alias("at"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.count("*").alias("n")), "classes")
    known = classes.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    length, count = fitted_length(classes, threshold, known["n"]), known["n"]
    # Subtrees that hold two classes or more.
    trees = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 2 * DEPTH * t + 1, 2 * length)) for t in range(TREES)])
    forest = classes.select("cls", F.posexplode(trees).alias("tree", "prefix"))
    subtrees = stored(forest.groupBy("prefix").agg(F.count("*").alias("n"), F.min("cls").alias("lead")).where("n > 1"), "subtrees")
    widest = subtrees.agg(F.max("n")).first()[0] or 0
    shared = hot_join(forest, subtrees, "prefix", "n", TREES * count, largest=widest)
    groups = connected_components(shared.select("cls", "lead"), "cls", "lead")
    members = stored(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")).join(classes.select("cls", "at", "size", trees.alias("trees")), "cls"), "members")
    # Components in one block; of the others, what either way of cutting copies.
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), _blocks_of(F.count("*"), F.sum(F.col("size") * 8)).alias("nb"))
    found = sizes.agg(F.sum("n").alias("n"), F.max("nb").alias("nb"), F.max("n").alias("most")).first()
    whole = hot_join(members, sizes, "grp", "n", found["n"] or 0, largest=found["most"] or 0).withColumns({"tree": F.lit(0), "unit": F.col("grp")})
    if (found["nb"] or 0) > 1:
        within = members.join(sizes.where("nb > 1"), "grp")
        leaf = within.select("cls", "grp", "size", F.col("n").alias("all"), F.col("nb").alias("grp_nb"), F.posexplode("trees").alias("tree", "prefix"))
        leaves = leaf.groupBy("grp", "grp_nb", "all", "tree", "prefix").agg(F.count("*").alias("m"), _blocks_of(F.count("*"), F.sum(F.col("size") * 8)).alias("nb")).where("m > 1")
        by_leaf = leaves.groupBy("grp", "grp_nb", "all").agg(F.sum(F.col("m") * F.col("nb")).alias("copies")).where(F.col("copies") < F.col("all") * F.col("grp_nb")).select("grp")
        by_leaf = stored(by_leaf, "by_leaf")
        whole = whole.join(by_leaf, "grp", "left_anti")
        own = leaves.join(by_leaf, "grp", "left_semi").select("grp", "tree", "prefix", "nb")
        leafy = members.join(by_leaf, "grp", "left_semi").select("cls", "at", "trees", "grp", F.posexplode("trees").alias("tree", "prefix")).join(own, ["grp", "tree", "prefix"])
        leafy = leafy.withColumn("unit", F.encode(F.concat(F.col("tree").cast("string"), F.lit(":"), F.col("prefix").cast("string")), "utf-8"))
        both = ["cls", "at", "trees", "tree", "unit", "nb"]
        whole = whole.select(*both).unionByName(leafy.select(*both))
    placed = whole.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    active = placed.select(F.col("at.key").alias("k"), F.col("at.th").alias("t"), "cls", "unit", "nb", "b", "tree", F.when(F.col("tree") > 0, F.col("trees")).alias("prefixes"))
    sets = _sets_again(df, key, text, width, members.select(F.col("at.key").alias("k"), F.col("at.th").alias("t")), found["n"] or 0)
    met = sets.join(active, sets["__key"].eqNullSafe(active["k"]) & (sets["__th"] == active["t"]))
    other = F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1)).alias("o")
    units = met.select("cls", "unit", "b", "tree", "prefixes", "set", other).select(F.concat("unit", F.encode(F.format_string("/%d,%d", F.least("b", "o"), F.greatest("b", "o")), "utf-8")).alias("unit"), "cls", "b", (F.col("b") != F.col("o")).alias("two"), "tree", "prefixes", "set")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = units.repartition(n, "unit").dropDuplicates(["unit", "cls"]).sortWithinPartitions("unit", "cls").select("unit", "cls", "b", "two", "tree", "prefixes", "set")
    linked = stored(_units(once, threshold), "links")
    links = linked.groupBy("cls").agg(F.sum("links").alias("n_links"))
    roots = connected_components(linked.select("cls", "root").where("cls != root"), "cls", "root").select(F.col("node").alias("cls"), "root")
    named = classes.select("cls", "rep", "at", "n").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return base, stored(named, "roots"), links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(key, class_id, rep_id, n_links), a row for each row of ``df``.

    class_id: the smallest key of all rows that links of at least ``threshold`` connect to this one; rep_id: the smallest
    key of the rows with the same set of shingles; n_links: how many other sets are linked to this row's set. A text of
    fewer words than ``width`` is one shingle of all its words. A text without words, or null, is linked to none: its
    class_id and rep_id are its own key. Rows may repeat, and keys may be null or repeat; null keys count as largest. Very
    long texts count whole. Other columns of ``df`` don't matter.
    """
    base, named, links = _join(df, key, text, threshold, width)
    low = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("many"))
    known = hot_join(named, low, "root", "many", named.count()).join(links, "cls", "left").select("cls", "n", "class_id", F.col("rep").alias("rep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = hot_join(base.select("key", "cls"), known, "cls", "n", base.count(), "left")
    mine = lambda c: F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col(c)).alias(c)
    return rows.select(F.col("key").alias(key), mine("class_id"), mine("rep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Rows of ``df``, columns as they are, of which one is kept of each class of :func:`near_duplicates`.

    That is the row with the smallest key (then the smallest hash of its text). Rows without words are all kept.
    """
    base, named, _ = _join(df, key, text, threshold, width)
    first = named.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.key").alias("__key"), F.col("at.th").alias("__th"), F.lit(True).alias("__worded"))
    bare = base.where("cls is null").select(F.col("key").alias("__key"), F.col("th").alias("__th"), F.lit(False).alias("__worded")).distinct()
    # One hash of both, so that joining and dropping repeats share a shuffle.
    both = lambda k, t: F.xxhash64(F.col(k), F.col(k).isNull(), F.col(t))
    rows = df.withColumns({"__k": F.col(key), "__t": F.coalesce(F.xxhash64(F.col(text)), F.lit(0))}).withColumn("__h", both("__k", "__t"))
    kept = first.unionByName(bare).withColumn("__g", both("__key", "__th"))
    met = rows.join(kept.hint("shuffle_hash"), (rows["__h"] == kept["__g"]) & rows["__k"].eqNullSafe(kept["__key"]) & (rows["__t"] == kept["__th"]))
    # Rows that repeat a kept key and text are one document of the class as well; those without words stay apart.
    apart = F.when(F.col("__worded"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return met.withColumn("__u", apart).dropDuplicates(["__h", "__k", "__t", "__u"]).select(*[F.col(f"`{c}`") for c in df.columns])
