"""Conversations in the order of replies, from the quotations in their messages; DataFrame expressions only.

A conversation is a tree of replies. Its reading order is depth first: a message, then those that answer it, earlier ones
first, each with all that follows from it. Chains of messages that answer the turn before are runs, and are read in one
piece; only the tree of runs is walked, by list ranking on its tour (each round doubles the length of the steps). What has
to be known of the row before, in the order of turns or of replies, is found in partitions by range and handed on between
them, so that one conversation may be of any size.

A line that begins with '>' signs is a quotation, and their number is its level. Passages are hashed without regard to
case and white space: of a message, its own text (all lines of level 0), each paragraph and each line of it; of a
quotation, the lines of a level within a block of quoted lines: all together, each run of them without a line of another
level between, each paragraph of a run, as blank quoted lines part it, and each line. A quoted passage is joined, within its
conversation, to the first message that has it as a passage of its own in an earlier turn. A message answers the one of
which it quotes most letters at the lowest level that is found, a line that is in several passages counted once; one without
a quotation that is found answers the turn before it. Joins are on hashes whose one side is unique, so common passages make no more rows than there are quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import forget, hot_join, stored

_PREFIX = r"^[ \t]*(?:>[ \t]*)+"
_BLOCK = r"(?m)(?:^[ \t]*>[^\n]*(?:\n|\z))+"

def level(line: Column) -> Column:
    """Quote level of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    """A passage without quote signs, lower-cased, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "(?m)" + _PREFIX, "")), r"\s+", " "))


def own_text(text: Column) -> Column:
    """A message without its quotations, blank lines at the ends taken off; null for null."""
    kept = F.filter(F.split(text, "\n"), lambda x: level(x) == 0)
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def _hashed(passages: Column) -> Column:
    """Distinct (hash, length) of passages that are not empty."""
    clean = F.filter(F.transform(passages, normal), lambda x: x != "")
    return F.transform(F.array_distinct(clean), lambda x: F.struct(F.sha2(x, 256).alias("h"), F.length(x).alias("n")))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _runs(lines: Column, begins) -> Column:
    """Lines cut into arrays where ``begins(line, line before)`` holds."""
    at = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | begins(x, F.get(lines, i - 1)), i)), lambda i: i.isNotNull())
    return _let(at, lambda starts: F.transform(starts, lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s)))


def _quoted(text: Column) -> Column:
    """(level, hash, lines) of quoted passages; lines are (hash, length)."""
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))

    def of(lines):
        whole = F.transform(F.array_distinct(F.transform(lines, lambda x: x["l"])), lambda k: F.filter(lines, lambda x: x["l"] == k))
        runs = _runs(lines, lambda x, y: x["l"] != y["l"])
        paragraphs = _runs(lines, lambda x, y: (x["l"] != y["l"]) | (x["x"] == "") | (y["x"] == ""))
        return F.concat(whole, runs, paragraphs, F.transform(lines, lambda x: F.array(x)))

    def lines(block):
        return F.transform(F.filter(F.split(block, "\n"), lambda x: level(x) > 0), lambda x: F.struct(level(x).alias("l"), normal(x).alias("x")))

    def passage(p):
        full = F.filter(p, lambda x: x["x"] != "")
        own = F.array_distinct(F.transform(full, lambda x: F.struct(F.xxhash64(x["x"]).alias("h"), F.length(x["x"]).alias("n"))))
        return F.struct(p[0]["l"].alias("l"), F.array_join(F.transform(full, lambda x: x["x"]), " ").alias("x"), own.alias("own"))

    found = F.array_distinct(F.transform(F.flatten(F.transform(blocks, lambda b: _let(lines(b), of))), passage))
    return F.transform(F.filter(found, lambda p: p["x"] != ""), lambda p: F.struct(p["l"].alias("l"), F.sha2(p["x"], 256).alias("h"), p["own"].alias("own")))


def _in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` stored in partitions by range, numbered in the given order by ``__part``, and its rows by ``__no``."""
    cut = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    inside = cut.withColumn("__no", F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long"))
    sizes = cut.groupBy("__part").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(before), "__part").withColumn("__no", F.col("__no") + F.col("__before")).drop("__before")


def _last(df: DataFrame, value: Column, name: str, to: int = 0) -> DataFrame:
    """With ``name``: the last value that is not null of the rows up to this one, or with ``to`` -1 before it, in the
    order of ``__no``."""
    df = df.withColumn("__v", value)
    own = F.last("__v", ignorenulls=True).over(Window.partitionBy("__part").orderBy("__no").rowsBetween(Window.unboundedPreceding, to))
    ends = df.where(F.col("__v").isNotNull()).groupBy("__part").agg(F.max_by("__v", "__no").alias("v"))
    parts = df.select("__part").distinct().join(ends, "__part", "left")
    handed = parts.select("__part", F.last("v", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__handed"))
    return df.withColumn("__own", own).join(F.broadcast(handed), "__part").withColumn(name, F.coalesce("__own", "__handed")).drop("__v", "__own", "__handed")


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, parent, quoted, before): for each turn of a conversation the turn it answers, whether a quotation says
    so, and the turn before; in the order of :func:`_in_order`.

    The first turn answers none. Rows of the same conversation and turn are one message in several parts. Rows without a
    conversation or turn are left out. Turns are numbers.
    """
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(text).cast("string").alias("x")).where("c is not null and t is not null")
    own = own_text(F.col("x"))
    mine = rows.select("c", "t", F.explode(_hashed(F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n")))).alias("p"))
    origin = mine.groupBy("c", F.col("p.h").alias("h")).agg(F.min("t").alias("parent"))
    quotes = rows.where(F.col("x").contains(">")).select("c", "t", F.explode(_quoted(F.col("x"))).alias("p")).select("c", "t", "p.l", "p.h", "p.own")
    met = quotes.join(origin, ["c", "h"]).where("parent < t").groupBy("c", "t", "l", "parent").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    met = met.withColumn("n", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    chosen = met.groupBy("c", "t").agg(F.min_by("parent", F.struct("l", -F.col("n"), -F.col("parent"))).alias("by_quote"))
    turns = _last(_in_order(rows.select("c", "t").distinct(), F.col("c"), F.col("t")), F.struct("c", "t"), "prior", -1)
    before = F.when(F.col("prior.c") == F.col("c"), F.col("prior.t"))
    linked = turns.select("c", "t", "__part", "__no", before.alias("before")).join(chosen, ["c", "t"], "left")
    return linked.select(F.col("c").alias("conv"), F.col("t").alias("turn"), F.coalesce("by_quote", "before").alias("parent"), F.col("by_quote").isNotNull().alias("quoted"), "before", "__part", "__no")


def _rank(runs: DataFrame) -> DataFrame:
    """(conv, run, start, base): of runs (conv, run, n: turns; up, at: the turn answered and its run and place there) the
    number of turns read before, and the depth of the first turn."""
    order = [F.col("conv"), F.col("up.run"), F.col("up.turn").desc(), F.col("run")]
    replies = _last(_in_order(runs.where("up is not null").select("conv", "run", "up"), *order), F.struct("conv", "up.run", F.col("run").alias("reply")), "prior", -1)
    older = replies.select("conv", "run", F.when((F.col("prior.conv") == F.col("conv")) & (F.col("prior.run") == F.col("up.run")), F.col("prior.reply")).alias("older"))
    final = replies.groupBy("conv", F.col("up.run").alias("run")).agg((-F.min(F.struct(F.col("up.turn").alias("t"), (-F.col("run")).alias("r")))["r"]).alias("final"))
    known = runs.join(older, ["conv", "run"], "left").join(final, ["conv", "run"], "left")
    # The tour enters a run (side 0) and leaves it (side 1); each event but the first of a conversation has one before it.
    entry = F.struct(F.lit(0).alias("side"), F.when(F.col("older").isNotNull(), F.struct(F.col("older").alias("run"), F.lit(1).alias("side"))).otherwise(F.when(F.col("up").isNotNull(), F.struct(F.col("up.run").alias("run"), F.lit(0).alias("side")))).alias("prior"), F.col("n").alias("read"), F.coalesce(F.col("up.place") + 1, F.lit(0)).cast("long").alias("down"))
    leave = F.struct(F.lit(1).alias("side"), F.when(F.col("final").isNotNull(), F.struct(F.col("final").alias("run"), F.lit(1).alias("side"))).otherwise(F.struct(F.col("run").alias("run"), F.lit(0).alias("side"))).alias("prior"), F.lit(0).cast("long").alias("read"), (-F.coalesce(F.col("up.place") + 1, F.lit(0))).cast("long").alias("down"))
    now = stored(known.select("conv", "run", "n", F.explode(F.array(entry, leave)).alias("e")).select("conv", "run", "n", "e.*"), "tour")
    while now.where("prior is not null").limit(1).count():
        done, going = now.where("prior is null"), now.where("prior is not null")
        above = now.select("conv", F.struct("run", "side").alias("prior"), F.col("prior").alias("p2"), F.col("read").alias("r2"), F.col("down").alias("d2"))
        met = going.join(above, ["conv", "prior"])  # events before are all different, so no key is hot
        after = stored(done.unionByName(met.select("conv", "run", "n", "side", F.col("p2").alias("prior"), (F.col("read") + F.col("r2")).alias("read"), (F.col("down") + F.col("d2")).alias("down"))), "tour")
        forget(now)
        now = after
    return now.where("side = 0").select("conv", "run", (F.col("read") - F.col("n")).alias("start"), F.col("down").alias("base"))


def threads(links: DataFrame) -> DataFrame:
    """``links`` with ``thread``, the first turn of the run of replies that a turn is in; ``depth``, its distance from the
    conversation's first turn; and ``position``, its place in reading order, from 0."""
    begins = F.col("before").isNull() | (F.col("parent") != F.col("before"))
    turns = _last(links, F.when(begins, F.struct(F.col("turn").alias("run"), F.col("__no").alias("first"))), "own")
    turns = stored(turns.select("conv", "turn", "parent", "quoted", F.col("own.run").alias("run"), (F.col("__no") - F.col("own.first")).alias("place")), "turns")
    total = turns.count()
    starts = turns.where("turn = run").select("conv", "run", F.struct("conv", F.col("parent").alias("turn")).alias("key"), "parent")
    sizes = starts.where("parent is not null").groupBy("key").agg(F.count("*").alias("many"))
    answered = sizes.join(turns.select(F.struct("conv", "turn").alias("key"), F.struct("run", "turn", "place").alias("up")), "key")
    lengths = turns.groupBy("conv", "run").agg(F.count("*").alias("n"))
    runs = stored(hot_join(starts, answered, "key", "many", starts.count(), "left").select("conv", "run", "up").join(lengths, ["conv", "run"]), "runs")
    ranked = _rank(runs).join(lengths, ["conv", "run"]).select(F.struct("conv", "run").alias("key"), "start", "base", "n")
    found = hot_join(turns.withColumn("key", F.struct("conv", "run")), ranked, "key", "n", total)
    return found.select("conv", "turn", "parent", "quoted", F.col("run").alias("thread"), (F.col("base") + F.col("place")).alias("depth"), (F.col("start") + F.col("place")).alias("position"))


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``df`` with quotations taken out of ``text``, and parent_turn, by_quote, depth, thread, position.

    Ordered by conversation and position, rows read as conversations without quotes in which what answers a message
    follows it. Rows without a conversation or turn have nulls in the new columns; columns of the new names are replaced.
    Null texts stay null, empty ones empty, and very long ones are parsed whole; they quote nothing if no line begins
    with '>'. Rows of the same conversation and turn, repeated or not, share their links and position.
    """
    made = ["parent_turn", "by_quote", "depth", "thread", "position"]
    found = threads(link(df, conv, turn, text)).select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), F.col("parent").alias("parent_turn"), F.col("quoted").alias("by_quote"), "depth", "thread", "position")
    rows = df.drop(*made).withColumns({text: own_text(F.col(text).cast("string")), "__k": F.col(conv), "__u": F.col(turn)})
    placed = rows.where("__k is not null and __u is not null").join(found, (F.col("__k") == F.col("__c")) & (F.col("__u") == F.col("__t")), "left").drop("__k", "__u", "__c", "__t")
    apart = rows.where("__k is null or __u is null").drop("__k", "__u")
    return placed.unionByName(apart, allowMissingColumns=True)


def as_chat(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``df`` with ``chat``: each message in a plain chat template."""
    return df.withColumn("chat", F.concat(F.lit("<|"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")), F.lit("|>\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n<|end|>\n")))


def chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """:func:`conversations` with ``chat``, sorted by conversation and position over all partitions: written out as it is, the
    column ``chat`` is every conversation in reading order, one after the other."""
    return as_chat(conversations(df, conv, turn, text), role, text).orderBy(conv, "position")
