"""Sharding by vector bin packing.

Rows of equal text form a group; the groups are placed on the shards so that bytes, tokens and
rows are balanced jointly: each is placed where the dot product of its vector with the shard's
residual capacity is highest, large ones first.

Rows are summed to groups before anything is placed, so a group is one row whatever its size. Groups that are a notable part of a shard come
first; there are at most three dimensions * shards * LARGE of them, so one place can put them. All other groups are dealt by hash into parts of
about PART_GROUPS groups, and each part puts its groups, one by one and by the same rule, into its share of the capacity that
the large ones leave. The shards of groups are then joined to their rows. Equal texts stay together, except that a group larger than half a
shard is cut by running number into equal pieces of about that size, so that one text that is a third of all
rows does not fill a shard. Texts themselves are read once and never shuffled.

Tokens are counted as the words that an encoder splits a text into before it merges bytes; a column with
other counts, as bpe.encode() gives them, can be named.

Cases: a null text counts as empty and has only the fixed size of a row; repeated rows are rows of
their own; a null id is an id like others; ties go to the first shard; long texts are only measured and hashed; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import keep

#: The part of a shard from which a group comes first, pieces in a shard of a larger group, groups of a part, and rows that are numbered together.
LARGE, PIECES, PART_GROUPS, RUN_ROWS = 64, 2, 20_000, 100_000
#: Letters, digits or other signs in a row: what is merged on its own.
WORD = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
ROW_BYTES = 16
#: How bytes, tokens and rows count in the dot product: bytes are to be near equal, whatever the others allow.
WEIGHTS = (1.0, 0.05, 0.05)


def pack(vectors: np.ndarray, residual: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each vector (rows: groups; columns: bytes, tokens, rows). residual: what each shard can still take; it is used up."""
    scale = np.maximum(residual.clip(0).sum(axis=0) / len(residual), 1e-9)
    w = np.asarray(weights) / scale**2
    out = np.zeros(len(vectors), np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -vectors[:, 0])):
        s = int(np.argmax(residual @ (vectors[i] * w)))
        out[i] = s
        residual[s] -= vectors[i]
    return out


def _pack_part(left: np.ndarray):
    """Places the groups of a part; left: the part of the small groups that each shard takes, by dimension."""

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        vectors = np.stack([table[c].to_numpy() for c in ("b", "t", "n")], axis=1).astype(float)
        return pa.table({"g": table["g"], "shard": pa.array(pack(vectors, left * vectors.sum(axis=0)), pa.int32())})

    return place


def _numbered(rows: DataFrame, by: list[str], runs: Column) -> DataFrame:
    """rows with number, from 0 in each by, in runs of about RUN_ROWS rows: a key with most rows is no single task."""
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), runs).cast("int"))
    sizes = rows.groupBy(*by, "run").agg(F.count("*").alias("n"))
    before = sizes.select(*by, "run", (F.sum("n").over(Window.partitionBy(*by).orderBy("run")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy(*by, "run").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("own", number).join(before, [*by, "run"]).withColumn("number", (F.col("before") + F.col("own") - 1).cast("long")).drop("run", "own", "before")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """For each row its id, size, text_crc32, n_tokens, shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(WORD))
    rows = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
            tokens.cast("long").alias("n_tokens"),
        )
    )
    sums = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("n")]
    groups = keep(rows.groupBy("g").agg(*sums))
    total = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", "n_tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    part_of_shard = F.greatest(*[F.col(c) * (shards / max(1, total[c])) for c in ("b", "t", "n")])
    large = groups.where(part_of_shard > 1 / LARGE).withColumn("pieces", F.ceil(part_of_shard * PIECES).cast("int")).orderBy("g").collect()
    # a piece has its share of the rows, and so of all that rows of one text have
    units = [(u["g"], p, u["n"] * p // u["pieces"], u["n"] * (p + 1) // u["pieces"], u) for u in large for p in range(u["pieces"])]
    vectors = [[u["b"] / u["n"] * (b - a), u["t"] / u["n"] * (b - a), b - a] for _, _, a, b, u in units]
    residual = np.ones((shards, 3)) * np.array([total["b"], total["t"], total["n"]], float) / shards
    placed = pack(np.array(vectors, float).reshape(-1, 3), residual)
    pieces = spark.createDataFrame([(g, p, a, b, int(s)) for (g, p, a, b, _), s in zip(units, placed, strict=True)], "g long, piece int, low long, high long, shard int")
    names = ["doc_id", "size", "text_crc32", "n_tokens", "shard"]
    alone = rows.join(F.broadcast(spark.createDataFrame([(u["g"], u["n"]) for u in large], "g long, of long")), "g")
    alone = _numbered(alone, ["g"], F.ceil(F.col("of") / RUN_ROWS))
    first = alone.join(F.broadcast(pieces), "g").where("number >= low and number < high").select(*names)
    left = residual.clip(1e-9)
    left /= left.sum(axis=0)
    left = np.minimum(left, left[:, :1])  # bytes come first: where they leave little room, so do the others
    parts = max(1, math.ceil(total["groups"] / PART_GROUPS))
    small = groups.where(part_of_shard <= 1 / LARGE).withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int"))
    where = small.groupBy("part").applyInArrow(_pack_part(left / left.sum(axis=0)), "g long, shard int")
    rows = keep(first.unionByName(rows.join(where, "g").select(*names)))
    return _numbered(rows, ["shard"], F.lit(max(16, math.ceil(total["n"] / (shards * RUN_ROWS))))).select(*names, F.col("number").alias("slot"))


def op9(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents on shards by the law of near-equal bytes."""
    placed = shard(docs, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
