"""Changes of tables as functions from the old state and a delta to the new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import drop, keep


def latest(delta: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key: partial maxima, so a key with many rows is no hot task."""
    rest = [c for c in delta.columns if c not in keys]
    last = delta.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in delta.columns])


def upsert(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of delta take the place of those of the same key. delta has one row a key."""
    return state.join(delta.select(*keys), keys, "left_anti").unionByName(delta.select(*state.columns))


def insert_missing(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return state.unionByName(delta.join(state.select(*keys), keys, "left_anti").select(*state.columns))


def with_ids(state: DataFrame, rows: DataFrame, order: list[str], id_col: str = "id", start: int | None = None, codec: str | None = None) -> DataFrame:
    """Rows with ids that follow the largest of state, or start, in the order of their natural key, so that a retry gives the same.

    The rows are written before they are dealt to ranges of the key, as a sample of them is drawn first: whatever made them is evaluated
    once. Ranges are sorted and written with the place of each row in them, and the first table goes; ids are these places shifted by the sizes of
    the ranges before.
    """
    kept = keep(rows, codec)
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    parts = keep(ranged, codec)
    drop(kept)
    part = F.shiftright("__place", 33)
    sizes = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    top = start if start is not None else state.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    numbered = parts.withColumn("__part", part).join(F.broadcast(before), "__part")
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = numbered.withColumn(id_col, (within + F.col("__before") + F.lit(top)).cast("long")).drop("__part", "__place", "__before")
    out._tessel_kept = parts._tessel_kept
    return out


def patch(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of delta replace those of state where they are not null."""
    changed = [c for c in delta.columns if c not in keys]
    new = delta.select(*keys, *[F.col(c).alias(f"__{c}") for c in changed])
    return state.join(new, keys, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in state.columns])


def update_where(state: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return state.withColumns({c: F.when(condition, x).otherwise(F.col(c)) for c, x in values.items()})


def delete_keys(state: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(doomed.select(*keys).distinct(), keys, "left_anti")


def set_null(state: DataFrame, doomed: DataFrame, column: str) -> DataFrame:
    """column becomes null where its value is one of doomed's; rows stay."""
    gone = doomed.select(F.col(column).alias("__gone")).distinct()
    marked = state.join(gone, F.col(column) == F.col("__gone"), "left")
    return marked.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*state.columns)


def delete_documents(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Documents (doomed: id) with their chunks, vectors and summaries; sources keep their rows without the chunk."""
    ids = doomed.select(F.col("id").alias("doc_id")).distinct()
    chunk_ids = tables["chunks"].join(ids, "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    out = dict(tables)
    out["documents"] = delete_keys(tables["documents"], doomed, ["id"])
    out["chunks"] = delete_keys(tables["chunks"], ids, ["doc_id"])
    if "vectors" in tables:
        out["vectors"] = delete_keys(tables["vectors"], chunk_ids, ["chunk_id"])
    if "summaries" in tables:
        out["summaries"] = delete_keys(tables["summaries"], ids.withColumnRenamed("doc_id", "document_id"), ["document_id"])
    if "sources" in tables:
        out["sources"] = set_null(tables["sources"], chunk_ids, "chunk_id")
    return out


def deletion_counts(tables: dict[str, DataFrame], doomed: DataFrame) -> DataFrame:
    """name, n: the rows of each table that go with these documents (id), and those of sources that lose their chunk."""
    ids = doomed.select(F.col("id").alias("doc_id")).distinct()
    chunks = tables["chunks"].join(ids, "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    own = {"documents": (ids.withColumnRenamed("doc_id", "id"), "id"), "chunks": (ids, "doc_id"), "vectors": (chunks, "chunk_id"), "summaries": (ids.withColumnRenamed("doc_id", "document_id"), "document_id"), "sources": (chunks, "chunk_id")}
    counts = [tables[n].join(keys, on, "left_semi").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, (keys, on) in own.items() if n in tables]
    return reduce(lambda a, b: a.unionByName(b), counts)


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are there more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def restricted(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents (id) that can't go as children refer to them."""
    return parents.join(children.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def backfill(child: DataFrame, parent: DataFrame, on: str, columns: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Columns of child taken from its parent (id), else its own, else a default."""
    p = parent.select(F.col("id").alias(on), *[F.col(c).alias(f"__{c}") for c in columns])
    made = {c: F.coalesce(F.col(f"__{c}"), F.col(c) if c in child.columns else F.lit(None), defaults[c]) for c in columns}
    return child.join(p, on, "left").withColumns(made).drop(*[f"__{c}" for c in columns])
