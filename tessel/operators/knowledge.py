"""A property graph of entities and edges, with the document that an edge comes from.

Tables: entities (id, tenant_id, project_id, name, entity_type, description), edges (id,
tenant_id, project_id, source_entity_id, target_entity_id, relationship_type, description),
metadata (relationship_id, key, value).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.shared import keep

from .mutate import upsert, with_ids
from .scope import Scope, scoped

PROVENANCE = "source_document_id"
ENTITY_KEY = ["tenant_id", "project_id", "name", "entity_type"]
EDGE_KEY = ["tenant_id", "project_id", "source_entity_id", "target_entity_id", "relationship_type"]


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    edges: DataFrame
    metadata: DataFrame


def last_truthy(value: str, order: str) -> Column:
    """The last value that is neither null nor empty."""
    return F.expr(f"max_by(`{value}`, `{order}`) FILTER (WHERE `{value}` <> '')")


def last_known(value: str, order: str) -> Column:
    """The last value that isn't null; empty text counts."""
    return F.expr(f"max_by(`{value}`, `{order}`) FILTER (WHERE `{value}` IS NOT NULL)")


def endpoints(edges: DataFrame) -> DataFrame:
    """id of all entities that an edge has."""
    return edges.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).distinct()


def with_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.join(endpoints(edges), "id", "left_semi")


def without_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.join(endpoints(edges), "id", "left_anti")


def touching(edges: DataFrame, entity_id: int) -> DataFrame:
    return edges.where((F.col("source_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id))


def touching_any(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ids (id), each once: two semi joins in place of a join on OR."""
    one = edges.join(ids.select(F.col("id").alias("source_entity_id")), "source_entity_id", "left_semi")
    rest = edges.join(ids.select(F.col("id").alias("source_entity_id")), "source_entity_id", "left_anti")
    return one.unionByName(rest.join(ids.select(F.col("id").alias("target_entity_id")), "target_entity_id", "left_semi")).select(*edges.columns)


def find_edges(edges: DataFrame, sources: list[int] | None = None, targets: list[int] | None = None, kind: str | None = None) -> DataFrame:
    """Filters that are None or empty are left out."""
    if sources:
        edges = edges.where(F.col("source_entity_id").isin(sources))
    if targets:
        edges = edges.where(F.col("target_entity_id").isin(targets))
    return edges.where(F.col("relationship_type") == kind) if kind else edges


def find_entities(entities: DataFrame, kind: str | None = None) -> DataFrame:
    return entities.where(F.col("entity_type") == kind) if kind else entities


def edges_of_documents(edges: DataFrame, metadata: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Edges whose provenance is one of doc_ids (doc_id)."""
    wanted = doc_ids.select(F.col("doc_id").cast("string").alias("value"))
    own = metadata.where(F.col("key") == PROVENANCE).join(wanted, "value", "left_semi").select(F.col("relationship_id").alias("id"))
    return edges.join(own, "id", "left_semi")


def metadata_maps(metadata: DataFrame) -> DataFrame:
    """relationship_id and its metadata as a map."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return metadata.groupBy("relationship_id").agg(F.map_from_entries(pairs).alias("metadata"))


def purge(graph: Graph, doc_ids: DataFrame) -> Graph:
    """Without the edges of these documents and without the entities that lost their last edge by that."""
    doomed = keep(edges_of_documents(graph.edges, graph.metadata, doc_ids).select("id", "source_entity_id", "target_entity_id"))
    edges = graph.edges.join(doomed.select("id"), "id", "left_anti")
    metadata = graph.metadata.join(doomed.select(F.col("id").alias("relationship_id")), "relationship_id", "left_anti").select(*graph.metadata.columns)
    orphans = endpoints(doomed).join(endpoints(edges), "id", "left_anti")
    return Graph(graph.entities.join(orphans, "id", "left_anti"), edges, metadata)


def get_or_create(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entities with those of found (key, description, ord) added; a description that is there replaces the old one."""
    merged = found.groupBy(*ENTITY_KEY).agg(last_truthy("description", "ord").alias("new"))
    old = entities.join(merged, ENTITY_KEY, "left").withColumn("description", F.coalesce("new", "description")).select(*entities.columns)
    fresh = merged.join(entities.select(*ENTITY_KEY), ENTITY_KEY, "left_anti").withColumnRenamed("new", "description")
    return old.unionByName(with_ids(entities, fresh, ENTITY_KEY).select(*entities.columns))


def upsert_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges with those of found (key, description, ord) merged in: the last description that isn't null wins."""
    merged = found.groupBy(*EDGE_KEY).agg(last_known("description", "ord").alias("new"))
    old = edges.join(merged, EDGE_KEY, "left").withColumn("description", F.coalesce("new", "description")).select(*edges.columns)
    fresh = merged.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti").withColumnRenamed("new", "description")
    return old.unionByName(with_ids(edges, fresh, EDGE_KEY).select(*edges.columns))


def provenance(found: DataFrame) -> DataFrame:
    """Edge key, and as value the document that wrote it last, of found (key, doc_id, ord)."""
    return found.groupBy(*EDGE_KEY).agg(F.max_by(F.col("doc_id").cast("string"), "ord").alias("value"))


def refresh(graph: Graph, doc_ids: DataFrame, entities: DataFrame, relations: DataFrame, scope: Scope) -> Graph:
    """The graph after documents were extracted anew.

    doc_ids (doc_id): all documents of the batch; entities (doc_id, ord, name, entity_type,
    description); relations (doc_id, ord, source, target, relationship_type, description) by names.
    A name means the entity that the document names first; relations with unknown names are left out.
    A batch is as one document after the other if no two of its documents share an edge; otherwise the
    last one owns the edge, as it would then too.
    """
    graph = purge(graph, doc_ids)
    here = {"tenant_id": F.lit(scope.tenant_id), "project_id": F.lit(scope.primary)}
    named = entities.withColumns({k: v.cast(graph.entities.schema[k].dataType) for k, v in here.items()}).withColumnRenamed("ord", "n").withColumn("ord", F.struct("doc_id", "n"))
    # new ids are read more than once: they are written, so that each is given once and the next batch starts from a table
    all_entities = keep(get_or_create(graph.entities, named.select(*ENTITY_KEY, "description", "ord")))
    ids = named.join(scoped(all_entities, replace(scope, project_ids=(scope.primary,))).select(*ENTITY_KEY, F.col("id").alias("entity_id")), ENTITY_KEY)
    first = ids.groupBy("doc_id", "name").agg(F.min_by("entity_id", "n").alias("entity_id"))
    end = lambda c: first.select("doc_id", F.col("name").alias(c), F.col("entity_id").alias(f"{c}_entity_id"))
    found = relations.join(end("source"), ["doc_id", "source"]).join(end("target"), ["doc_id", "target"])
    found = found.withColumns({k: v.cast(graph.edges.schema[k].dataType) for k, v in here.items()}).withColumnRenamed("ord", "n").withColumn("ord", F.struct("doc_id", "n"))
    found = keep(found.select("doc_id", *EDGE_KEY, "description", "ord"))
    edges = keep(upsert_edges(graph.edges, found.drop("doc_id")))
    written = provenance(found).join(edges.select("id", *EDGE_KEY), EDGE_KEY)
    rows = written.select(F.col("id").alias("relationship_id"), F.lit(PROVENANCE).alias("key"), "value")
    return Graph(all_entities, edges, keep(upsert(graph.metadata, rows, ["relationship_id", "key"])))
