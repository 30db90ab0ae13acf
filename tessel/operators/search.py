"""Vector search: exact, over all vectors in scope.

Scores are computed where the vectors are; only the best k of each partition move. The rows of
the hits are fetched afterwards, so a search reads no text but that of its hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vector as v

from .blocks import nearest
from .scope import Scope, scoped

RESULT = ("chunk_id", "context", "content", "doc_id", "doc_name", "similarity")
DEFAULT_K, MOST_K = 5, 50


def _limit(k: int) -> int:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be 1 to {MOST_K}")
    return k


def _hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame, scope: Scope) -> DataFrame:
    """At most MOST_K hits with their chunk and document; hits without either are dropped, and so are those whose chunk or document the scope can't see."""
    chunks, documents = scoped(chunks, scope, rls=True), scoped(documents, scope, rls=True)
    of_hit = chunks.select(F.col("id").alias("chunk_id"), "context", "content", "doc_id").join(F.broadcast(hits), "chunk_id")
    return of_hit.join(documents.select(F.col("id").alias("doc_id"), "doc_name"), "doc_id")


def _of_width(query: list[float]) -> Column:
    """The stored vectors; a search with a query of another width than theirs fails."""
    return v.check_dimension(F.col("embedding"), len(query))


def search_cosine(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, query: list[float], scope: Scope, k: int = DEFAULT_K) -> DataFrame:
    """The k chunks in scope nearest by cosine; the scope is that of the chunk. Ties: the lesser chunk id."""
    own = scoped(chunks, scope).select(F.col("id").alias("chunk_id"), "doc_id")
    own = own.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    scored = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", v.cosine(_of_width(query), v.literal(query)).alias("similarity"))
    hits = own.join(scored, "chunk_id").select("chunk_id", "similarity").orderBy(F.desc_nulls_last("similarity"), "chunk_id").limit(_limit(k))
    return _hydrate(hits, chunks, documents, scope).select(*RESULT).orderBy(F.desc_nulls_last("similarity"), "chunk_id")


def search_inner_product(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, query: list[float], scope: Scope, k: int = 10) -> DataFrame:
    """The k vectors in scope of the largest inner product, then their rows: fewer than k if some have none. The scope is that of the vector."""
    if not scope.project_ids:
        vectors = vectors.where(F.lit(False))
    scored = scoped(vectors, scope).select("chunk_id", v.dot(_of_width(query), v.literal(query)).alias("similarity"))
    hits = scored.orderBy(F.desc_nulls_last("similarity"), "chunk_id").limit(_limit(k))
    return _hydrate(hits, chunks, documents, scope).select(*RESULT).orderBy(F.desc_nulls_last("similarity"), "chunk_id")


def search(metric: str, *args, **kwargs) -> DataFrame:
    """By the name of the metric: cosine or inner_product."""
    known = {"cosine": search_cosine, "inner_product": search_inner_product}
    if metric.lower() not in known:
        raise ValueError(f"unknown metric {metric}: one of {', '.join(known)}")
    return known[metric.lower()](*args, **kwargs)


def search_text(embed, metric: str, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, text: str, scope: Scope, k: int = DEFAULT_K) -> DataFrame:
    """embed(text) gives the query's vector."""
    if not text.strip():
        raise ValueError("the query is blank")
    return search(metric, chunks, vectors, documents, embed(text), scope, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, similarity, rank of the k best of each query; ties: the lesser chunk id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def batch_search(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_K, on: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """query_id, chunk_id, similarity, rank: for each of the queries (query_id, tenant_id, query) the k nearest vectors of its tenant.

    on: columns of both that must be equal. All vectors are read once, in blocks that are multiplied with blocks of queries.
    """
    return nearest(queries, vectors, k, on)


def chunks_with_embeddings(chunks: DataFrame, vectors: DataFrame, scope: Scope) -> DataFrame:
    own = scoped(chunks, scope).select(F.col("id").alias("chunk_id"), "doc_id", "chunk_order", "context", "content")
    return own.join(vectors.select("chunk_id", "embedding"), "chunk_id")
