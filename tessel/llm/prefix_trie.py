"""The prefix trie of conversations by collapse of whole sequences.

Every conversation is rebuilt first: it takes the first turns of the conversation that heads its group of
twenty, then its own. Then

* identical rebuilt conversations are grouped into one weighted sequence with its list of ends;
* a sequence that equals a proper prefix of another one is no leaf: an anti join drops it;
* the prefixes of all sequences, weighted, are aggregated into nodes.

A prefix is known by 120 bits, the exclusive or of a digest of each turn with its place, so prefixes are running
aggregates. These and running numbers are worked out in blocks of BLOCK places with the totals of the blocks before,
and conversations are dealt by ranges of their turns, so no conversation, however long, has to be one task. The sums over a subtree
are sums over its leaves: each node is counted for one leaf below it, and each leaf has, for each depth, the sum from there to its end.

Cases: rows without conv_id belong to no conversation and are left out; null roles and texts are empty; rows of
one turn follow each other by role and text, null turns come first; repeated rows are turns of their own; a conversation that heads
no rows gives none to others; an empty table has no root; long texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import keep

GROUP, MOST_SHARED = 20, 4
#: Places of a sequence that one task takes at once.
BLOCK = 4096
KEY = ["a", "b"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, n, a, b, words: each turn with its number in its conversation, its digest and the words of its text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # the row's place in its partition is the low part of this id
    made = ranged.select("conv", F.monotonically_increasing_id().alias("__id"), digest.alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    made = keep(made.select("conv", F.shiftright("__id", 33).alias("part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "digest", "words"))
    spans = made.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return made.join(spans, ["conv", "part"]).select("conv", (F.col("place") + F.col("shift")).alias("n"), "digest", "words")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the head of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, size; their turns: conv, pos, digest, words)."""
    sizes = turns.groupBy("conv").agg(F.max("n").alias("own"))
    heads = sizes.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("head"), F.col("own").alias("of_head"))
    convs = sizes.select("conv", "own", (F.col("conv") - F.col("conv") % GROUP).alias("head"), shared_turns(F.col("conv")).alias("h")).join(heads, "head", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("of_head", F.lit(0)))).select("conv", "head", "own", "h", "taken")
    convs = keep(convs.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    early = turns.where((F.col("n") < MOST_SHARED) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "head")
    lent = convs.where("taken > 0").select("conv", "head", "taken").join(early, "head").where("n <= taken").select("conv", F.col("n").alias("pos"), "digest", "words")
    kept = turns.join(convs.select("conv", "h", "taken"), "conv").where("n > h").select("conv", (F.col("n") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return convs.select("conv", "size"), lent.unionByName(kept)


def running(df: DataFrame, key: list[str], pos: str, makes: dict[str, tuple[str, object, object]], backwards: bool = False) -> DataFrame:
    """df with running aggregates over pos within key: name: (column, aggregate, how two of its values are joined).

    Long runs are cut into blocks; what the blocks before add is joined, which is nothing for runs of one block.
    """
    block = F.floor(F.col(pos) / BLOCK).cast("long")
    order = F.desc(pos) if backwards else F.asc(pos)
    rows = df.withColumn("__block", block)
    inner = Window.partitionBy(*key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*key, "__block").agg(*[agg(c).alias(f"__{n}") for n, (c, agg, _) in makes.items()])
    line = Window.partitionBy(*key).orderBy(F.desc("__block") if backwards else F.asc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*key, "__block", *[agg(f"__{n}").over(line).alias(f"__{n}") for n, (_, agg, _) in makes.items()])
    earlier = earlier.where(F.col(f"__{next(iter(makes))}").isNotNull())
    out = rows.withColumns({n: agg(c).over(inner) for n, (c, agg, _) in makes.items()}).join(earlier, [*key, "__block"], "left")
    return out.withColumns({n: join(F.col(n), F.coalesce(f"__{n}", F.lit(0))) for n, (_, _, join) in makes.items()}).drop("__block", *[f"__{n}" for n in makes])


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv, pos, words, a, b and pa, pb: the key of the prefix that ends with each turn, and of the one before it."""
    placed = F.sha2(F.concat("digest", F.lit(":"), F.col("pos").cast("string")), 256)
    half = lambda at: F.conv(F.substring("__placed", at, 15), 16, 10).cast("long")
    rows = turns.withColumn("__placed", placed).select("conv", "pos", "words", half(1).alias("x"), half(16).alias("y"))
    both = lambda p, q: p.bitwiseXOR(q)
    rows = running(rows, ["conv"], "pos", {"a": ("x", F.bit_xor, both), "b": ("y", F.bit_xor, both)})
    return rows.select("conv", "pos", "words", "a", "b", both(F.col("a"), F.col("x")).alias("pa"), both(F.col("b"), F.col("y")).alias("pb"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (a, b, size, conv) a row for each sequence: the hash of its ends is fed as they come, so no list is held."""
    last, first, n, hashed = None, None, 0, None
    row = lambda: pa.RecordBatch.from_pydict({"a": [last[0]], "b": [last[1]], "size": [last[2]], "conv": [first], "weight": [n], "ends_sha256": [hashed.hexdigest()]})
    for batch in batches:
        done = []
        for a, b, size, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (a, b, size) != last:
                if last is not None:
                    done.append(row())
                last, first, n, hashed = (a, b, size), conv, 0, hashlib.sha256()
            hashed.update(f",{conv}".encode() if n else str(conv).encode())
            n += 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if last is not None:
        yield row()


def sequences(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """a, b, size, conv (the smallest of its conversations), weight, ends_sha256 of each distinct rebuilt conversation."""
    whole = convs.join(prefixes.select("conv", F.col("pos").alias("size"), *KEY), ["conv", "size"], "left")
    whole = whole.select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "size", "conv")
    return whole.repartition("a", "b", "size").sortWithinPartitions("a", "b", "size", "conv").mapInArrow(_ends, "a long, b long, size long, conv long, weight long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: a, b, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuild(_turns(conversations))
    prefixes = keep(_prefixes(turns))
    found = keep(sequences(convs, prefixes))
    # the prefixes of one conversation of each sequence, with the root
    rows = prefixes.withColumnRenamed("pos", "depth").join(found.select("conv", "size", "weight"), "conv")
    root = found.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b")], *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")], "size", "weight")
    rows = keep(rows.select(*root.columns).unionByName(root))
    inner = rows.where("depth < size").select("a", "b", F.col("depth").alias("size"))
    leaves = keep(found.join(inner, ["a", "b", "size"], "left_anti").select("conv"))
    node = ["a", "b", "depth"]
    nodes = rows.groupBy(*node).agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    below = rows.join(leaves, "conv", "left_semi").select(*node, F.col("conv").alias("leaf"))
    owner = below.groupBy(*node).agg(F.min("leaf").alias("leaf"), F.count("*").alias("n_leaves"))
    nodes = keep(nodes.join(owner, node).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    worth = below.join(nodes.select(*node, "leaf", "saved"), [*node, "leaf"], "left").withColumn("saved", F.coalesce("saved", F.lit(0)))
    sums = running(worth, ["leaf"], "depth", {"left": ("saved", F.sum, lambda p, q: p + q)}, backwards=True)
    saved = sums.groupBy(*node).agg(F.sum("left").alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    ends = found.select("a", "b", F.col("size").alias("depth"), "ends_sha256")
    out = nodes.join(saved, node).join(children, node, "left").join(ends, node, "left").join(parents, ["pa", "pb", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*node, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op12(conversations: DataFrame) -> DataFrame:
    return trie(conversations.select("conv_id", "turn", "role", "text")).drop(*KEY)
