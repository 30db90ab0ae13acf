"""The registered queries: each reads the given tables in a folder; SQL gives the same rows where it can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import text as t
from tessel.functions.vector import hash_vector, norm
from tessel.operators import answers, chunking, index, knowledge, models, mutate, requests, resolve, search, summaries
from tessel.operators import scope as sc
from tessel.operators.ledger import Ledger
from tessel.plans import ingest, questions
from tessel.sources.policies import ScopedTables
from tessel.sources.shared import keep, shared_folder
from tessel.sources.snapshots import Store
from tessel.sources.tables import Tables, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SCOPE = sc.Scope(1, (1, 6, 11, 16, 21), "u1")
IN_SCOPE = "tenant_id = 1 and project_id in (1, 6, 11, 16, 21)"
DIM = 64


def query(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of the tables, and the SQL that gives the same."""

    def register(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return run

    return register


# ---- scopes ---------------------------------------------------------------------------------


@query(f"select id, doc_name, doc_type, tenant_id, project_id from v_documents where {IN_SCOPE}")
def scoped_documents(x: Tables) -> DataFrame:
    return sc.scoped(x.documents(), SCOPE).select("id", "doc_name", "doc_type", "tenant_id", "project_id")


@query("select id, doc_name, project_id from v_documents where tenant_id = 2")
def rls_visible_documents_empty_projects(x: Tables) -> DataFrame:
    return sc.scoped(x.documents(), sc.Scope(2), rls=True).select("id", "doc_name", "project_id")


@query(f"select case when {IN_SCOPE} then 'allowed' else 'rejected' end as verdict, count(*) as n from v_documents group by 1")
def write_check(x: Tables) -> DataFrame:
    good, bad = sc.write_check(x.documents(), SCOPE)
    return good.select(F.lit("allowed").alias("verdict")).unionByName(bad.select(F.lit("rejected").alias("verdict"))).groupBy("verdict").agg(F.count("*").alias("n"))


@query("select user_id, count(distinct tenant_id) as n_tenants, case when count(distinct tenant_id) = 1 then 'ok' else 'several tenants' end as status from v_roles group by user_id")
def user_scope_check(x: Tables) -> DataFrame:
    return sc.user_scopes(x.roles()).select("user_id", "n_tenants", "status")


@query("select user_id, string_agg(cast(project_id as varchar), ',' order by project_id) as project_ids from (select distinct user_id, project_id from v_roles) group by user_id")
def user_projects_csv(x: Tables) -> DataFrame:
    return sc.projects_csv(x.roles())


@query("select d.id, u.user_id from v_documents d join (select user_id, string_agg(cast(project_id as varchar), ',') as csv from v_roles group by user_id) u on list_contains(string_split(u.csv, ','), cast(d.project_id as varchar)) where u.user_id = 'u7'")
def documents_of_user_csv(x: Tables) -> DataFrame:
    user = sc.projects_csv(x.roles().where("user_id = 'u7'"))
    return x.documents().join(sc.csv_rows(user), "project_id").select("id", "user_id")


# ---- lookups and lists ------------------------------------------------------------------------


@query(f"select id, doc_name, doc_size from v_documents where id = 31 and {IN_SCOPE}")
def document_lookup(x: Tables) -> DataFrame:
    return sc.scoped(x.documents(), SCOPE).where("id = 31").select("id", "doc_name", "doc_size")


@query(f"select id, doc_name as name, doc_type as type from v_documents where {IN_SCOPE}")
def document_list(x: Tables) -> DataFrame:
    return sc.scoped(x.documents(), SCOPE).select("id", F.col("doc_name").alias("name"), F.col("doc_type").alias("type"))


@query("select id, chunk_order, content, cast(row_number() over (partition by doc_id order by chunk_order nulls last, id) as int) as place, doc_id from v_chunks")
def document_chunks_ordered(x: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("chunk_order"), "id"))
    return x.chunks().select("id", "chunk_order", "content", place.alias("place"), "doc_id")


@query(f"select id, nullif(content, '') as content from v_chunks where {IN_SCOPE}")
def chunk_content_or_null(x: Tables) -> DataFrame:
    return sc.scoped(x.chunks(), SCOPE).select("id", t.blank_to_null("content").alias("content"))


@query("select doc_id, cast(length(text) // 512 as bigint) as n_chunks from documents")
def approx_chunk_count(x: Tables) -> DataFrame:
    return x.documents().select(F.col("id").alias("doc_id"), t.approx_chunks("content").alias("n_chunks"))


# ---- vector search ----------------------------------------------------------------------------

_COS = "list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[]))"
_DOT = "list_dot_product(cast(v.embedding as double[]), cast(q.embedding as double[]))"
_HIT = "c.id as chunk_id, c.context, c.content, c.doc_id, d.doc_name"


def _query_vector(x: Tables) -> list[float]:
    return list(x.vectors().where("chunk_id = 1").first()["embedding"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


@query(f"select {_HIT}, round({_COS}, 6) as similarity from v_chunks c join v_vectors v on v.chunk_id = c.id join v_documents d on d.id = c.doc_id, (select embedding from v_vectors where chunk_id = 1) q where c.{IN_SCOPE.replace('project_id', 'c.project_id')} order by {_COS} desc, c.id limit 10")
def search_cosine(x: Tables) -> DataFrame:
    return _rounded(search.search_cosine(x.chunks(), x.vectors(), x.documents(), _query_vector(x), SCOPE, 10))


@query(f"with top as (select v.chunk_id, {_DOT} as s from v_vectors v, (select embedding from v_vectors where chunk_id = 1) q where v.tenant_id = 1 and v.project_id in (1, 6, 11, 16, 21) order by s desc, v.chunk_id limit 50) select {_HIT}, round(h.s, 6) as similarity from top h join v_chunks c on c.id = h.chunk_id join v_documents d on d.id = c.doc_id")
def search_inner_product_hydrated(x: Tables) -> DataFrame:
    return _rounded(search.search("Inner_Product", x.chunks(), x.vectors(), x.documents(), _query_vector(x), SCOPE, 50))


@query(f"with s as (select q.chunk_id as query_id, v.chunk_id, {_COS} as s from v_vectors q join v_vectors v on v.tenant_id = q.tenant_id where q.chunk_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by s desc nulls last, chunk_id) as rank from s) select query_id, chunk_id, round(s, 6) as similarity, cast(rank as int) as rank from r where rank <= 5")
def batch_search_topk(x: Tables) -> DataFrame:
    queries = x.vectors().where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", F.col("embedding").alias("query"))
    return _rounded(search.batch_search(queries, x.vectors(), 5))


def _asked(x: Tables) -> DataFrame:
    return x.vectors().where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", F.col("embedding").alias("query"))


@query()
def batch_search_index(x: Tables) -> DataFrame:
    """batch_search_topk by the approximate index, over all vectors."""
    return _rounded(index.search_index(index.build(x.vectors()), _asked(x), 5))


@query("select tenant_id, count(*) as n_queries, true as found_most, true as read_few from v_vectors where chunk_id % 20 = 0 group by tenant_id")
def index_recall(x: Tables) -> DataFrame:
    """For each tenant whether the index finds nine of ten of the exact hits of its queries, comparing 15 % of its vectors at most."""
    queries, rerank = keep(_asked(x)), 3
    exact = search.batch_search(queries, x.vectors(), 5).select("query_id", "chunk_id")
    found = index.search_index(index.build(x.vectors()), queries, 5, rerank=rerank).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    sizes = x.vectors().groupBy("tenant_id").agg(F.count("*").alias("n_vectors"))
    per = exact.join(found, ["query_id", "chunk_id"], "left").join(queries.select("query_id", "tenant_id"), "query_id").join(sizes, "tenant_id")
    return per.groupBy("tenant_id").agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("found_most"), (F.lit(5 * rerank) <= 0.15 * F.max("n_vectors")).alias("read_few"))


@query("select c.id as chunk_id, c.doc_id, c.chunk_order, cast(len(v.embedding) as int) as dim, round(sqrt(list_dot_product(cast(v.embedding as double[]), cast(v.embedding as double[]))), 6) as length from v_chunks c join v_vectors v on v.chunk_id = c.id where c.tenant_id = 1 and c.project_id in (1, 6, 11, 16, 21)")
def chunks_with_embeddings(x: Tables) -> DataFrame:
    rows = search.chunks_with_embeddings(x.chunks(), x.vectors(), SCOPE)
    return rows.select("chunk_id", "doc_id", "chunk_order", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("length"))


@query("""
with b as (select id, cast(i as varchar) as i, cast(('0x' || sha256(content || ':' || cast(i as varchar))[1:8]) as bigint) / 4294967295.0 * 2 - 1 as x from v_chunks, range(8) r(i)),
n as (select id, sqrt(sum(x * x)) as n from b group by id)
select b.id, cast(i as int) as place, round(x / n.n, 6) as value from b join n on n.id = b.id
""")
def hash_embedding(x: Tables) -> DataFrame:
    made = x.chunks().select("id", F.posexplode(hash_vector(F.col("content"), 8)).alias("place", "value"))
    return made.select("id", "place", F.round("value", 6).alias("value"))


# ---- text -------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select id, {_NORM.format('name')} as normalized from v_entities")
def entity_normalize(x: Tables) -> DataFrame:
    return x.entities().select("id", t.normalize("name").alias("normalized"))


@query(f"""
with n as (select id, {_NORM.format("name")} as t from v_entities),
v as (select id, t as v from n
 union select id, left(t, length(t) - 3) || 'y' from n where t like '%ies' and length(t) > 3
 union select id, left(t, length(t) - 2) from n where t like '%ses' and length(t) > 3
 union select id, left(t, length(t) - 1) from n where t like '%s' and length(t) > 2
 union select id, unnest(string_split(t, ' ')) from n)
select id, v as variant from v where v <> ''
""")
def entity_variants(x: Tables) -> DataFrame:
    return x.entities().select("id", F.explode(t.variants(t.normalize("name"))).alias("variant"))


@query(f"""
with a as (select doc_id, list_distinct(list_filter(string_split({_NORM.format("text")}, ' '), lambda x: x <> '')) as w, list_distinct(list_filter(string_split({_NORM.format("source || ' ' || lang || ' the of de la en'")}, ' '), lambda x: x <> '')) as v from documents)
select doc_id, round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 9) as similarity from a
""")
def token_jaccard(x: Tables) -> DataFrame:
    words = lambda c: t.tokens(t.normalize(c))
    other = F.concat_ws(" ", "created_by_user_id", "doc_type", F.lit("the of de la en"))
    return x.documents().select(F.col("id").alias("doc_id"), F.round(t.jaccard(words(F.col("content")), words(other)), 9).alias("similarity"))


@query(r"select id, regexp_replace(array_to_string(list_filter([context, content], lambda x: x is not null and x <> ''), ' '), '^\s+|\s+$', '', 'g') as text from v_chunks")
def embedding_text(x: Tables) -> DataFrame:
    return x.chunks().select("id", t.join_nonempty("context", "content").alias("text"))


@query("select id, context || chr(10) || chr(10) || content as text from v_chunks")
def tool_payload_content(x: Tables) -> DataFrame:
    return x.chunks().select("id", t.tool_content("context", "content").alias("text"))


@query("""
with j as (select c.id, d.content as w, c.content as p, greatest(0, c.chunk_order * 492 - 512) as f from v_chunks c join v_documents d on d.id = c.doc_id),
l as (select *, case when p = '' then null when position(p in substring(w, f + 1)) > 0 then position(p in substring(w, f + 1)) - 1 + f when position(p in w) > 0 then position(p in w) - 1 end as s from j)
select id, cast(s as int) as start, case when s is null then w else substring(w, 1, s) || '[edited]' || substring(w, s + length(p) + 1) end as text from l
""")
def chunk_span_splice(x: Tables) -> DataFrame:
    docs = x.documents().select(F.col("id").alias("doc_id"), F.col("content").alias("whole"))
    joined = x.chunks().join(docs, "doc_id").withColumn("start", t.locate_span("whole", "content", "chunk_order"))
    return joined.select("id", F.col("start").cast("int").alias("start"), t.splice("whole", F.col("start"), "content", F.lit("[edited]")).alias("text"))


@query(r"select conv_id, turn, coalesce(nullif(left(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1], 72), ''), 'Update ' || role) as message from conversations")
def commit_message_sanitize(x: Tables) -> DataFrame:
    return x["conversations"].select("conv_id", "turn", t.commit_message("text", "update", "role").alias("message"))


@query(r"select page_id, 'documents/' || cast(page_id as varchar) || '_' || coalesce(case when b in ('.', '..', '') then null else b end, 'document_' || cast(page_id as varchar) || '.txt') as path from (select page_id, regexp_extract(url, '([^/]+)/*$', 1) as b from pages)")
def safe_document_path(x: Tables) -> DataFrame:
    return x["pages"].select("page_id", t.safe_path("page_id", "url").alias("path"))


@query("select c.id, replace(replace('Chunk: {chunk} of {content}', '{chunk}', c.content), '{content}', d.content) as prompt from v_chunks c join v_documents d on d.id = c.doc_id")
def prompt_fill(x: Tables) -> DataFrame:
    docs = x.documents().select(F.col("id").alias("doc_id"), F.col("content").alias("whole"))
    return x.chunks().join(docs, "doc_id").select("id", t.fill("Chunk: {chunk} of {content}", "content", "whole").alias("prompt"))


@query(f"select project_id, count(*) as n, sum(length(doc_name)) as name_chars from v_documents where {IN_SCOPE} group by project_id")
def document_payloads(x: Tables) -> DataFrame:
    """The JSON payload of each project's documents, read back."""
    docs = sc.scoped(x.documents(), SCOPE)
    payload = docs.groupBy("project_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "doc_name")))).alias("payload"))
    read = F.from_json("payload", "array<struct<id:long,doc_name:string>>")
    chars = F.aggregate(read, F.lit(0).cast("long"), lambda s, d: s + F.length(d["doc_name"]))
    return payload.select("project_id", F.size(read).cast("long").alias("n"), chars.alias("name_chars"))


# ---- the graph --------------------------------------------------------------------------------


def _graph(x: Tables) -> knowledge.Graph:
    """The graph of the tables: an edge's id comes from its ends."""
    r = x.relationships()
    key = F.col("source_entity_id") * 10_000_000 + F.col("target_entity_id")
    edges = r.select(key.alias("id"), F.lit(0).alias("tenant_id"), F.lit(0).alias("project_id"), "source_entity_id", "target_entity_id", "relationship_type", F.lit(None).cast("string").alias("description"))
    metadata = r.select(key.alias("relationship_id"), F.lit(knowledge.PROVENANCE).alias("key"), F.col("source_document_id").alias("value"))
    return knowledge.Graph(x.entities().withColumn("description", F.lit(None).cast("string")), edges, metadata)


@query("select id, name, entity_type from v_entities where entity_type = 'Supplier'")
def entity_filter_by_type(x: Tables) -> DataFrame:
    return knowledge.find_entities(x.entities(), "Supplier").select("id", "name", "entity_type")


@query("select source_entity_id, target_entity_id from v_relationships where source_entity_id = 5 or target_entity_id = 5")
def edges_touching_entity(x: Tables) -> DataFrame:
    return knowledge.touching(x.relationships(), 5).select("source_entity_id", "target_entity_id")


@query("select source_entity_id, target_entity_id from v_relationships where source_entity_id in (select id from v_entities where tenant_id = 3) or target_entity_id in (select id from v_entities where tenant_id = 3)")
def edges_touching_tenant(x: Tables) -> DataFrame:
    return knowledge.touching_any(x.relationships(), x.entities().where("tenant_id = 3")).select("source_entity_id", "target_entity_id")


@query("select source_entity_id, target_entity_id, relationship_type from v_relationships where source_entity_id in (1, 2, 3) and relationship_type = 'SUPPLIES'")
def edges_dynamic_filter(x: Tables) -> DataFrame:
    return knowledge.find_edges(x.relationships(), [1, 2, 3], [], "SUPPLIES").select("source_entity_id", "target_entity_id", "relationship_type")


@query("select id, name from v_entities where id in (select source_entity_id from v_relationships union select target_entity_id from v_relationships)")
def entities_with_edges(x: Tables) -> DataFrame:
    return knowledge.with_edges(x.entities(), x.relationships()).select("id", "name")


@query("with r as (select * from v_relationships where source_document_id like '%77') select id, name from v_entities where id not in (select source_entity_id from r union select target_entity_id from r)")
def orphan_entities(x: Tables) -> DataFrame:
    """Entities without an edge among those of documents that end in 77."""
    return knowledge.without_edges(x.entities(), x.relationships().where(F.endswith("source_document_id", F.lit("77")))).select("id", "name")


@query("select source_entity_id * 10000000 + target_entity_id as relationship_id, source_document_id from v_relationships")
def edge_metadata_pivot(x: Tables) -> DataFrame:
    return knowledge.metadata_maps(_graph(x).metadata).select("relationship_id", F.col("metadata")[knowledge.PROVENANCE].alias("source_document_id"))


_PURGED = "select o_orderkey from orders where o_orderstatus = 'F'"


@query(f"select source_entity_id, target_entity_id from v_relationships where source_document_id not in (select cast(o_orderkey as varchar) from ({_PURGED}))")
def purge_document_edges(x: Tables) -> DataFrame:
    doomed = x["orders"].where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return knowledge.purge(_graph(x), doomed).edges.select("source_entity_id", "target_entity_id")


@query(f"with d as (select cast(o_orderkey as varchar) as k from ({_PURGED})), gone as (select * from v_relationships where source_document_id in (select k from d)), stays as (select * from v_relationships where source_document_id not in (select k from d)) select id, name from v_entities where id not in (select source_entity_id from gone union select target_entity_id from gone) or id in (select source_entity_id from stays union select target_entity_id from stays)")
def purge_document_entities(x: Tables) -> DataFrame:
    doomed = x["orders"].where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return knowledge.purge(_graph(x), doomed).entities.select("id", "name")


_FLAG = "case when l_returnflag = 'N' then null else l_returnflag end"


@query(f"with e as (select l_suppkey as s, l_partkey + 1000000 as t, l_linenumber > 1 as new, l_orderkey as o, l_linenumber as l, {_FLAG} as f from lineitem) select s as source_entity_id, t as target_entity_id, coalesce(arg_max(f, o * 100 + l) filter (where new and f is not null), case when bool_or(not new) then 'old' end) as description from e group by s, t")
def edge_upsert_last_writer(x: Tables) -> DataFrame:
    e = x["lineitem"].select(F.lit(0).alias("tenant_id"), F.lit(0).alias("project_id"), F.col("l_suppkey").alias("source_entity_id"), (F.col("l_partkey") + 1_000_000).alias("target_entity_id"), F.lit("SUPPLIES").alias("relationship_type"), F.nullif("l_returnflag", F.lit("N")).alias("description"), F.struct("l_orderkey", "l_linenumber").alias("ord"), "l_linenumber")
    key = F.col("source_entity_id") * 10_000_000 + F.col("target_entity_id")
    state = e.where("l_linenumber = 1").select(key.alias("id"), *knowledge.EDGE_KEY, F.lit("old").alias("description")).distinct()
    return knowledge.upsert_edges(state, e.where("l_linenumber > 1")).select("source_entity_id", "target_entity_id", "description")


@query("with s as (select distinct on (name, entity_type) * from (select id, tenant_id, project_id, name, entity_type from v_entities where entity_type = 'Supplier')), f as (select cast(0 as int) as tenant_id, cast(0 as int) as project_id, c_name as name, c_mktsegment as entity_type from customer group by c_name, c_mktsegment) select id, name, entity_type from s union all select (select max(id) from s) + row_number() over (order by tenant_id, project_id, name, entity_type), name, entity_type from f")
def entity_get_or_create(x: Tables) -> DataFrame:
    state = knowledge.find_entities(_graph(x).entities, "Supplier")
    found = x["customer"].select(F.lit(0).alias("tenant_id"), F.lit(0).alias("project_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"), F.lit("").alias("description"), F.col("c_custkey").alias("ord"))
    return knowledge.get_or_create(state, found).select("id", "name", "entity_type")


@query("select source_entity_id, target_entity_id, source_document_id as doc_id from v_relationships")
def edge_provenance(x: Tables) -> DataFrame:
    e = x["lineitem"].select(F.lit(0).alias("tenant_id"), F.lit(0).alias("project_id"), F.col("l_suppkey").alias("source_entity_id"), (F.col("l_partkey") + 1_000_000).alias("target_entity_id"), F.lit("SUPPLIES").alias("relationship_type"), F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("ord"))
    return knowledge.provenance(e).select("source_entity_id", "target_entity_id", F.col("value").alias("doc_id"))


# ---- changes ------------------------------------------------------------------------------------


@query("select chunk_id, case when chunk_id % 3 = 0 then 9 else tenant_id end as tenant_id, project_id from v_vectors union all select 1000000 + chunk_id, 9, project_id from v_vectors where chunk_id % 5 = 0")
def vector_upsert(x: Tables) -> DataFrame:
    state = x.vectors()
    changed = state.where("chunk_id % 3 = 0").withColumn("tenant_id", F.lit(9))
    added = state.where("chunk_id % 5 = 0").withColumns({"chunk_id": F.col("chunk_id") + 1_000_000, "tenant_id": F.lit(9)})
    return mutate.upsert(state, changed.unionByName(added), ["chunk_id"]).select("chunk_id", "tenant_id", "project_id")


@query("select chunk_id, tenant_id from v_vectors where not (chunk_id in (select id from v_chunks where content = '') and tenant_id = 1)")
def vector_delete_scoped(x: Tables) -> DataFrame:
    empty = x.chunks().where("content = ''").select(F.col("id").alias("chunk_id"), F.lit(1).alias("tenant_id"))
    return mutate.delete_keys(x.vectors(), empty, ["chunk_id", "tenant_id"]).select("chunk_id", "tenant_id")


@query("select chunk_id, tenant_id from v_vectors where chunk_id not in (select id from v_chunks where content = '')")
def vector_delete_unscoped(x: Tables) -> DataFrame:
    empty = x.chunks().where("content = ''").select(F.col("id").alias("chunk_id"))
    return mutate.delete_keys(x.vectors(), empty, ["chunk_id"]).select("chunk_id", "tenant_id")


def _state(x: Tables) -> dict[str, DataFrame]:
    sources = x.chunks().select((F.col("id") * 10).alias("id"), F.col("id").alias("chunk_id"), "doc_id")
    return {"documents": x.documents(), "chunks": x.chunks(), "vectors": x.vectors(), "sources": sources}


def _without_spanish(x: Tables) -> dict[str, DataFrame]:
    return mutate.delete_documents(_state(x), x.documents().where("doc_type = 'es'"))


@query("select 'documents' as name, id from v_documents where doc_type <> 'es' union all select 'chunks', c.id from v_chunks c join v_documents d on d.id = c.doc_id where d.doc_type <> 'es' union all select 'vectors', chunk_id from v_vectors where chunk_id not in (select c.id from v_chunks c join v_documents d on d.id = c.doc_id where d.doc_type = 'es')")
def document_delete_cascade(x: Tables) -> DataFrame:
    s = _without_spanish(x)
    row = lambda n, c: s[n].select(F.lit(n).alias("name"), F.col(c).cast("long").alias("id"))
    return row("documents", "id").unionByName(row("chunks", "id")).unionByName(row("vectors", "chunk_id"))


@query("select c.id * 10 as id, case when d.doc_type = 'es' then null else c.id end as chunk_id, c.doc_id from v_chunks c join v_documents d on d.id = c.doc_id")
def sources_set_null(x: Tables) -> DataFrame:
    return _without_spanish(x)["sources"].select("id", "chunk_id", "doc_id")


@query("select id, case when doc_type = 'de' then 'deutsch' else doc_type end as doc_type, case when doc_type = 'de' then cast(0 as bigint) else doc_size end as doc_size from v_documents")
def document_patch(x: Tables) -> DataFrame:
    delta = x.documents().where("doc_type = 'de'").select("id", F.lit("deutsch").alias("doc_type"), F.lit(0).cast("long").alias("doc_size"), F.lit(None).cast("string").alias("doc_name"))
    return mutate.patch(x.documents(), delta, ["id"]).select("id", "doc_type", "doc_size")


@query("select id as document_id, case when doc_type = 'en' then doc_name else content end as summary_text from v_documents")
def document_summary_upsert(x: Tables) -> DataFrame:
    d = x.documents()
    state = d.select(F.col("id").alias("document_id"), F.col("content").alias("summary_text"))
    events = d.where("doc_type = 'en'").select(F.col("id").alias("document_id"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("earlier").alias("s")), F.struct(F.lit(2).alias("seq"), F.col("doc_name").alias("s")))).alias("e"))
    delta = mutate.latest(events.select("document_id", "e.seq", F.col("e.s").alias("summary_text")), ["document_id"], F.col("seq"))
    return mutate.upsert(state, delta.select("document_id", "summary_text"), ["document_id"])


@query(r"select tenant_id, project_id, to_json(list(id order by id))::varchar as ids, string_agg(s, chr(10) || chr(10) order by id) filter (where s <> '') as summary_input from (select *, case when regexp_extract(x, '(?s)^(.*?[.!?])\s', 1) <> '' then regexp_extract(x, '(?s)^(.*?[.!?])\s', 1) else x end as s from (select *, regexp_replace(content, '^\s+|\s+$', '', 'g') as x from v_documents)) group by tenant_id, project_id")
def project_summary_rollup(x: Tables) -> DataFrame:
    d = x.documents()
    rolled = summaries.project_inputs(d, summaries.summarize_documents(d, models.first_sentence))
    return rolled.select("tenant_id", "project_id", F.to_json("source_document_ids").alias("ids"), "summary_input")


@query("select c.c_custkey as id, coalesce(n.n_regionkey, -1) as tenant_id, coalesce(o.k, 0) as last_order from customer c left join nation n on n.n_nationkey = c.c_nationkey and n.n_regionkey <> 3 left join (select o_custkey, max(o_orderkey) as k from orders group by o_custkey) o on o.o_custkey = c.c_custkey")
def backfill_scope_from_parent(x: Tables) -> DataFrame:
    nations = x.projects().where("tenant_id <> 3")
    c = x["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    c = mutate.backfill(c, nations, "project_id", ["tenant_id"], {"tenant_id": F.lit(-1)}).select("id", F.col("tenant_id").cast("int").alias("tenant_id"))
    orders = x["orders"].groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order")).withColumnRenamed("o_custkey", "id")
    c = c.withColumn("cust", F.col("id"))
    return mutate.backfill(c, orders, "cust", ["last_order"], {"last_order": F.lit(0).cast("long")}).select("id", "tenant_id", "last_order")


@query("select id, name from v_projects where id in (select project_id from v_documents)")
def restrict_violations(x: Tables) -> DataFrame:
    return mutate.restricted(x.projects(), x.documents(), "project_id").select("id", "name")


@query("select name, entity_type, count(*) as n from v_entities group by name, entity_type having count(*) > 1")
def uniqueness_violations(x: Tables) -> DataFrame:
    return mutate.violations(x.entities(), ["name", "entity_type"])


# ---- model calls and edits ------------------------------------------------------------------------

_FIRST = r"regexp_extract(regexp_replace({}, '^\s+|\s+$', '', 'g'), '^(.*?)(?:[.!?]\s|$)', 0, 's')"


@query("with t as (select distinct role, text from conversations where text is not null) select role as round, (select count(*) from conversations c where c.role = t.role and c.text is not null) as n_asked, count(*) filter (where not exists (select 1 from conversations e where e.text = t.text and e.role < t.role)) as n_sent, cast(0 as bigint) as n_failed from t group by role")
def model_calls(x: Tables) -> DataFrame:
    """A ledger over the turns of each role in turn: what is asked, and what is sent as it has no reply yet."""
    log, counts = Ledger(x.spark), None
    turns = x["conversations"]
    for role in ("assistant", "system", "user"):  # a role that the table doesn't have sends nothing and has no row
        asked = turns.where((F.col("role") == role) & F.col("text").isNotNull())
        if asked.isEmpty():
            continue
        log.call("first_sentence", models.first_sentence, asked, F.col("text"))
        one = asked.agg(F.lit(role).alias("round"), F.count("*").alias("n_asked"))
        counts = one if counts is None else counts.unionByName(one)
    place = F.row_number().over(Window.orderBy("batch"))
    rounds = counts.withColumn("place", F.row_number().over(Window.orderBy("round")))
    return rounds.join(log.calls("first_sentence").withColumn("place", place), "place").select("round", "n_asked", "n_sent", "n_failed")


@query(rf"select conv_id, turn, regexp_replace({_FIRST.format('text')}, '\s+$', '') as reply from conversations")
def model_replies(x: Tables) -> DataFrame:
    """The reply to each turn: each distinct text is sent once."""
    return Ledger(x.spark).call("first_sentence", models.first_sentence, x["conversations"], F.col("text")).select("conv_id", "turn", "reply")


def _edits(x: Tables) -> DataFrame:
    """Two of three chunks are edited, neighbours that overlap among them."""
    return x.chunks().where("id % 3 <> 0").select("id", F.concat(F.lit("Edited "), F.col("id").cast("string"), F.lit(". "), F.left("content", F.lit(40))).alias("new_content"))


_SPLICED = """
e as (select id, doc_id, chunk_order, content, 'Edited ' || id || '. ' || left(content, 40) as new from v_chunks where id % 3 <> 0),
j as (select e.*, d.content as w, greatest(0, e.chunk_order * 492 - 512) as f from e join v_documents d on d.id = e.doc_id),
l as (select *, case when content = '' then null when position(content in substring(w, f + 1)) > 0 then position(content in substring(w, f + 1)) - 1 + f when position(content in w) > 0 then position(content in w) - 1 end as s from j),
p as (select doc_id, w, s, new, least(s + length(content), coalesce(lead(s) over (partition by doc_id order by s, s + length(content), new), length(w))) as t, row_number() over (partition by doc_id order by s, s + length(content), new) as n from l where s is not null),
q as (select *, coalesce(lag(t) over (partition by doc_id order by n), 0) as b from p),
d as (select doc_id, string_agg(substring(w, cast(b as int) + 1, cast(s - b as int)) || new, '' order by n) || substring(any_value(w), cast(max(t) as int) + 1) as content from q group by doc_id)
"""


@query(f"with {_SPLICED} select doc_id, length(content) as doc_size, sha256(content) as content_sha256 from d")
def edited_documents(x: Tables) -> DataFrame:
    """The texts of documents after edits of many of their chunks at once."""
    texts = ingest.spliced(_edits(x), x.chunks(), x.documents())
    return texts.select("doc_id", F.length("content").cast("long").alias("doc_size"), F.sha2("content", 256).alias("content_sha256"))


@query(rf"""
with {_SPLICED}, c as (select v.id as chunk_id, v.doc_id, v.chunk_order, case when v.new = d.content then '' else 'Edited ' || v.id || '.' end as context, v.new as content from e v left join d on d.doc_id = v.doc_id),
t as (select chunk_id, regexp_replace(context || ' ' || content, '^\s+|\s+$', '', 'g') as x from c),
b as (select chunk_id, n, cast(('0x' || sha256(x || ':' || cast(n as varchar))[1:8]) as bigint) / 4294967295.0 * 2 - 1 as y from t, range({DIM}) r(n)),
v as (select chunk_id, round((max(y) filter (where n = 0)) / sqrt(sum(y * y)), 5) as first_value from b group by chunk_id)
select c.*, v.first_value from c join v on v.chunk_id = c.chunk_id
""")
def edited_chunks(x: Tables) -> DataFrame:
    """The edited chunks in the state after the edits, with contexts and vectors made anew."""
    state = _empty(x) | {k: keep(v) for k, v in _state(x).items() if k in ("documents", "chunks", "vectors")}
    out = ingest.edit_chunks(_edits(x), state, SCOPE)
    chunk = out["chunks"].where("id % 3 <> 0").select(F.col("id").alias("chunk_id"), "doc_id", "chunk_order", "context", "content")
    return chunk.join(out["vectors"].select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value")), "chunk_id")


# ---- answers ------------------------------------------------------------------------------------


@query("select q.id as query_id, r.response_text, case when r.query_id is null then 'pending' else 'success' end as status from v_queries q left join v_responses r on r.query_id = q.id")
def response_pairing(x: Tables) -> DataFrame:
    return answers.pair_responses(x.queries(), x.responses())


@query(r"""
with s as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, regexp_replace(case when role = 'system' then ' ' else text end, '^\s+|\s+$', '', 'g') as x from conversations),
k as (select *, row_number() over (partition by conv_id order by i) - 1 as j, min(i) over (partition by conv_id) as f from s where x <> ''),
w as (select conv_id, i, case when i = 0 then x else (['Additionally,', 'Furthermore,', 'In addition,', 'Finally,'])[least(j - case when f = 0 then 1 else 0 end, 3) + 1] || ' ' || x end as y from k)
select c.conv_id as query_id, coalesce(r.response_text, '') as response_text from (select distinct conv_id from conversations) c left join (select conv_id, string_agg(y, ' ' order by i) as response_text from w group by conv_id) r on r.conv_id = c.conv_id
""")
def compose_response(x: Tables) -> DataFrame:
    rows = x["conversations"].select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.when(F.col("role") == "system", " ").otherwise(F.col("text")).alias("statement"))
    return answers.compose_responses(rows)


@query(r"""
with s as (select v.chunk_id * 10 as id, v.chunk_id, case when v.chunk_id % 7 = 0 then -5 else cast(floor(v.chunk_id / 4) as bigint) end as doc_id from v_vectors v)
select s.id, c.id as chunk_id, coalesce(c.doc_id, s.doc_id) as doc_id, coalesce(d.doc_name, 'Unknown Document') as doc_name, coalesce(regexp_replace(c.content, '^\s+|\s+$', '', 'g'), '') as content
from s left join v_chunks c on c.id = s.chunk_id left join v_documents d on d.id = coalesce(c.doc_id, s.doc_id)
""")
def citation_resolution(x: Tables) -> DataFrame:
    doc = F.when(F.col("chunk_id") % 7 == 0, F.lit(-5)).otherwise(F.floor(F.col("chunk_id") / 4)).cast("long")
    cited = x.vectors().select((F.col("chunk_id") * 10).alias("id"), "chunk_id", doc.alias("doc_id"))
    return answers.resolve_citations(cited, x.chunks(), x.documents())


@query("select conv_id as query_id, turn as position, cast(len(list_slice(list(text) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 1, 5)) as int) as n_prior, list_slice(list(text) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 1, 5)[1] as first_prior from conversations")
def prior_statements(x: Tables) -> DataFrame:
    rows = x["conversations"].select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("text").alias("statement"))
    made = answers.prior_statements(rows)
    return made.select("query_id", "position", F.nullif(F.size("prior"), F.lit(0)).alias("n_prior"), F.get("prior", F.lit(0)).alias("first_prior"))


@query(r"with s as (select id, unnest(string_split(regexp_replace(query_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as x, generate_subscripts(string_split(regexp_replace(query_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) as i from v_queries), k as (select id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') as x from s) select id, cast(row_number() over (partition by id order by i) - 1 as int) as position, x as subquestion from k where x <> ''")
def parse_subquestions(x: Tables) -> DataFrame:
    """The sentences of each question, by way of a model's JSON reply."""
    return answers.decompose(x.queries(), models.split_questions).select("id", "position", "subquestion")


@query()
def chunk_documents(x: Tables) -> DataFrame:
    made = chunking.chunk_documents(x.documents())
    return made.select("doc_id", "chunk_order", "content", F.to_json("headers").alias("headers"))


@query()
def entity_resolve(x: Tables) -> DataFrame:
    """Each word of part names against all entities of each tenant."""
    words = x["part"].select(F.explode(F.split("p_name", " ")).alias("mention")).distinct()
    tenants = x.tenants().select(F.col("id").cast("int").alias("tenant_id"))
    asked = words.join(F.broadcast(tenants)).select(F.concat_ws(":", "tenant_id", "mention").alias("mention_id"), "tenant_id", "mention")
    return resolve.resolve(x.entities(), asked)


def _empty(x: Tables) -> dict[str, DataFrame]:
    made = lambda s: x.spark.createDataFrame([], s)
    return {
        "documents": made("id long, doc_name string, context string, content string, doc_size long, tenant_id int, project_id int"),
        "chunks": made("id long, doc_id long, chunk_order int, context string, content string, tenant_id int, project_id int"),
        "vectors": made("chunk_id long, embedding array<float>, tenant_id int, project_id int"),
        "summaries": made("document_id long, tenant_id int, project_id int, summary_text string, summary_hash string"),
        "entities": made("id long, tenant_id int, project_id int, name string, entity_type string, description string"),
        "edges": made("id long, tenant_id int, project_id int, source_entity_id long, target_entity_id long, relationship_type string, description string"),
        "metadata": made("relationship_id long, key string, value string"),
    }


@query(r"""
with s as (select id as doc_id, unnest(string_split_regex(coalesce(content, ''), '[.!?\n]')) as x from v_documents),
w as (select doc_id, [t for t in regexp_extract_all(x, '[\p{L}\p{N}_]+') if regexp_full_match(t, '[A-Z][a-z]{3,}')] as ws from s),
p as (select doc_id, ws, unnest(range(1, len(ws))) as k from w where len(ws) > 1)
select ws[k] as source, ws[k + 1] as target, 'NEAR' as relationship_type, cast(max(doc_id) as varchar) as doc_id from p where ws[k] <> ws[k + 1] group by 1, 2
""")
def knowledge_refresh(x: Tables) -> DataFrame:
    """Edges of the terms of all documents, with the document that wrote each last."""
    found = keep(x.documents().select(F.col("id").alias("doc_id"), models.apply_model(models.capitalised_words, F.col("content"), models.EXTRACTION).alias("x")))
    entities = found.select("doc_id", F.posexplode("x.entities").alias("ord", "e")).select("doc_id", "ord", "e.*")
    relations = found.select("doc_id", F.posexplode("x.relations").alias("ord", "r")).select("doc_id", "ord", "r.*")
    s = _empty(x)
    g = knowledge.refresh(knowledge.Graph(s["entities"], s["edges"], s["metadata"]), x.documents().select(F.col("id").alias("doc_id")), entities, relations, SCOPE)
    name = lambda c: g.entities.select(F.col("id").alias(f"{c}_entity_id"), F.col("name").alias(c))
    of = g.metadata.select(F.col("relationship_id").alias("id"), F.col("value").alias("doc_id"))
    return g.edges.join(name("source"), "source_entity_id").join(name("target"), "target_entity_id").join(of, "id").select("source", "target", "relationship_type", "doc_id")


@query()
def ingest_document(x: Tables) -> DataFrame:
    """All documents uploaded to an empty state: the chunks with the first value of their vectors."""
    s = ingest.upload(x.documents().select("doc_name", "content"), _empty(x), SCOPE)
    chunk = s["chunks"].select(F.col("id").alias("chunk_id"), "doc_id", "chunk_order", "context", "content")
    return chunk.join(s["vectors"].select("chunk_id", F.round(F.col("embedding")[0], 5).alias("first_value")), "chunk_id")


@query("select cast(i as bigint) as id, tenant_id, name, entity_type from (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, cast(l_suppkey % 5 as int) as tenant_id, l_comment as name, l_returnflag as entity_type from (select *, cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as l_comment from lineitem))")
def insert_with_ids(x: Tables) -> DataFrame:
    """Every line item as a new row of an empty table: ids are gapless and in the order of the natural key."""
    empty = x.spark.createDataFrame([], "id long")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = x["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_suppkey") % 5).cast("int").alias("tenant_id"), key.alias("name"), F.col("l_returnflag").alias("entity_type"))
    return mutate.with_ids(empty, rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("id", "tenant_id", "name", "entity_type")


@query()
def answer_with_model(x: Tables) -> DataFrame:
    """Answers whose clauses a model words, with statements made before and the project's background; blank ones stay pending."""
    queries = x.queries().withColumn("tenant_id", (F.col("conv_id") % 5).cast("int"))
    about = queries.join(x.tenants().select(F.col("id").cast("int").alias("tenant_id"), "name"), "tenant_id").select(F.col("id").alias("query_id"), F.concat(F.lit("About "), "name").alias("background"))
    made = answers.answer(queries, x.chunks(), x.vectors(), x.documents(), lambda text: hash_vector(text, DIM), models.split_questions, clause_model=models.quote_sources, background=about)
    return made["responses"]


_ANSWERS = rf"""
with s as (select id, conv_id, unnest(string_split(regexp_replace(query_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as x, generate_subscripts(string_split(regexp_replace(query_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) as i from v_queries),
k as (select id, cast(conv_id % 5 as int) as tenant_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') as x from s),
a as (select id, tenant_id, x, row_number() over (partition by id order by i) - 1 as position from k where x <> ''),
t as (select distinct tenant_id, x from a),
b as (select tenant_id, x, n, cast(('0x' || sha256(x || ':' || cast(n as varchar))[1:8]) as bigint) / 4294967295.0 * 2 - 1 as y from t, range({DIM}) r(n)),
q as (select tenant_id, x, list(y order by n) as embedding from b group by tenant_id, x),
c as (select q.tenant_id, q.x, v.chunk_id, row_number() over (partition by q.tenant_id, q.x order by {_COS} desc, v.chunk_id) as rank from q join v_vectors v on v.tenant_id = q.tenant_id),
d as (select c.tenant_id, c.x, coalesce(nullif(d.doc_name, ''), 'Unknown Document') as doc_name, min(c.rank) as rank from c join v_chunks h on h.id = c.chunk_id left join v_documents d on d.id = h.doc_id where c.rank <= 3 group by all),
e as (select tenant_id, x, 'See ' || string_agg(doc_name, ', ' order by rank) || '.' as y from d group by tenant_id, x),
f as (select a.id, e.y, row_number() over (partition by a.id order by a.position) - 1 as j from a join e on e.tenant_id = a.tenant_id and e.x = a.x),
g as (select id, string_agg(case when j = 0 then y else (['Additionally,', 'Furthermore,', 'In addition,', 'Finally,'])[least(j - 1, 3) + 1] || ' ' || y end, ' ' order by j) as response_text from f group by id)
select v.id as query_id, g.response_text, case when g.id is null then 'pending' else 'success' end as status from v_queries v left join g on g.id = v.id
"""


@query(_ANSWERS)
def answer_pipeline(x: Tables) -> DataFrame:
    """Sourced answers to all questions, each in the tenant of its conversation."""
    queries = x.queries().withColumn("tenant_id", (F.col("conv_id") % 5).cast("int"))
    made = answers.answer(queries, x.chunks(), x.vectors(), x.documents(), lambda text: hash_vector(text, DIM), models.split_questions)
    return made["responses"]


@query(_ANSWERS)
def persisted_answers(x: Tables) -> DataFrame:
    """The same from a store: the batch is logged, answered, and run once more, which writes nothing."""
    store = Store(x.spark, f"{shared_folder(x.spark)}/answers-{uuid.uuid4().hex}")
    queries = x.queries().withColumns({"tenant_id": (F.col("conv_id") % 5).cast("int"), "project_id": F.lit(0)})
    made = None
    for _ in range(2):
        made = questions.ask(store, "all", queries, x.chunks(), x.vectors(), x.documents(), lambda text: hash_vector(text, DIM), models.split_questions)
    return made


_POLICY_TABLES = ("documents", "chunks", "vectors", "entities")


@query(" union all ".join(f"select '{n}' as name, count(*) as n_rows from v_{n} where {IN_SCOPE}" for n in _POLICY_TABLES) + " union all select 'tags', count(*) from v_documents where tenant_id = 1 and project_id in (1, 6, 11, 16, 21)")
def policy_reads(x: Tables) -> DataFrame:
    """Rows of each table that the scope's catalogue shows; tags have no scope and are seen with their documents."""
    tags = x.documents().select(F.col("id").alias("document_id"), "doc_type")
    read = lambda n: tags if n == "tags" else getattr(x, n)()
    seen = ScopedTables(read, SCOPE, {"tags": ("documents", "document_id")})
    counts = [seen[n].agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in (*_POLICY_TABLES, "tags")]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(f"""
with e as (select id, tenant_id, name, {_NORM.format("name")} as t from v_entities),
n as (select e.id, e.tenant_id, e.name, unnest(list_distinct(list_filter(list_concat([t, case when t like '%ies' and length(t) > 3 then left(t, length(t) - 3) || 'y' end, case when t like '%ses' and length(t) > 3 then left(t, length(t) - 2) end, case when t like '%s' and length(t) > 2 then left(t, length(t) - 1) end], string_split(t, ' ')), lambda x: x is not null and x <> ''))) as v from e),
r as (select *, row_number() over (partition by tenant_id, v order by lower(name), id) as place from n),
w as (select distinct unnest(string_split(p_name, ' ')) as t from part),
m as (select t as mention, unnest(list_distinct(list_filter([t, case when t like '%ies' and length(t) > 3 then left(t, length(t) - 3) || 'y' end, case when t like '%ses' and length(t) > 3 then left(t, length(t) - 2) end, case when t like '%s' and length(t) > 2 then left(t, length(t) - 1) end], lambda x: x is not null and x <> ''))) as v from w)
select distinct m.mention, r.tenant_id, r.id, r.name from m join r on r.v = m.v where r.place <= 5
""")
def entity_variant_matches(x: Tables) -> DataFrame:
    """The first entities of each tenant that share a variant with each word of the part names: the certain part of entity_resolve."""
    named = x.entities().select("tenant_id", "id", "name", "entity_type", F.struct("tenant_id", "name").alias("key"))
    known = named.select("key", F.col("key.tenant_id").alias("tenant_id"), t.variants(t.normalize("key.name")).alias("nv")).distinct()
    best = resolve.best_of_variant(known, named, 5)
    words = x["part"].select(F.explode(F.split("p_name", " ")).alias("mention")).distinct()
    asked = words.select("mention", F.explode(t.variants(t.normalize("mention"))).alias("variant"))
    return asked.join(best, "variant").select("mention", "tenant_id", "id", "name").distinct()


@query("select 'documents' as name, count(*) as n from v_documents where doc_type = 'es' union all select 'chunks', count(*) from v_chunks c join v_documents d on d.id = c.doc_id where d.doc_type = 'es' union all select 'vectors', count(*) from v_vectors v join v_chunks c on c.id = v.chunk_id join v_documents d on d.id = c.doc_id where d.doc_type = 'es' union all select 'sources', count(*) from v_chunks c join v_documents d on d.id = c.doc_id where d.doc_type = 'es'")
def deletion_counts(x: Tables) -> DataFrame:
    """How many rows of each table go with the Spanish documents."""
    return mutate.deletion_counts(_state(x), x.documents().where("doc_type = 'es'"))


@query("select conv_id, turn, 'Action: ' || role || chr(10) || 'Document name: ' || case when conv_id % 3 = 0 then 'document' else cast(conv_id as varchar) end || chr(10) || case when turn % 2 = 0 then '' else 'Details: ' || text || chr(10) end || 'Respond with a single commit message.' as prompt from conversations")
def commit_prompts(x: Tables) -> DataFrame:
    name = F.when(F.col("conv_id") % 3 != 0, F.col("conv_id").cast("string"))
    details = F.when(F.col("turn") % 2 != 0, F.col("text")).otherwise("")
    return x["conversations"].select("conv_id", "turn", t.commit_prompt("role", name, details).alias("prompt"))


_EDIT = "case when id % 4 = 0 then null when id % 4 = 1 then '  ' else ' ' || content || chr(10) end"


@query(rf"select id, case when id % 4 = 0 then 'no content' when regexp_full_match({_EDIT}, '\s*') then 'the content is blank' end as error, case when id % 4 > 1 and not regexp_full_match({_EDIT}, '\s*') then length(regexp_replace({_EDIT}, '^\s+|\s+$', '', 'g')) end as n_chars from v_chunks")
def edit_requests(x: Tables) -> DataFrame:
    """Edits of all chunks that may be made, and why the others may not."""
    new = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), "content", F.lit("\n")))
    good, bad = requests.edit_requests(x.chunks().select("id", new.alias("new_content")))
    rows = good.select("id", F.lit(None).cast("string").alias("error"), F.length("new_content").cast("long").alias("n_chars"))
    return rows.unionByName(bad.select("id", "error", F.lit(None).cast("long").alias("n_chars")))
