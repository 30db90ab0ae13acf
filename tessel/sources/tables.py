"""Tables, and views of them with the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The Parquet tables of a folder; views are lazy and read only the columns that a query takes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tenants(self) -> DataFrame:
        return self["region"].select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    def projects(self) -> DataFrame:
        return self["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("tenant_id"), F.col("n_name").alias("name"))

    def roles(self) -> DataFrame:
        user = F.concat(F.lit("u"), F.floor(F.col("c_custkey") / 3).cast("long").cast("string"))
        nation = self["nation"].select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("tenant_id"))
        joined = self["customer"].join(nation, "c_nationkey")
        return joined.select(F.col("c_custkey").alias("id"), user.alias("user_id"), "tenant_id", F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("role"))

    def documents(self) -> DataFrame:
        project = (F.col("doc_id") % 25).cast("int")
        return self["documents"].select(
            F.col("doc_id").alias("id"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc_name"),
            F.col("text").alias("content"),
            F.col("n_chars").alias("doc_size"),
            F.col("lang").alias("doc_type"),
            (project % 5).alias("tenant_id"),
            project.alias("project_id"),
            F.col("source").alias("created_by_user_id"),
        )

    def chunks(self) -> DataFrame:
        e = self["embeddings"].where(F.col("vec_id") % 17 != 0)
        order = (F.col("vec_id") % 4).cast("int")
        e = e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 4).cast("long").alias("doc_id"), order.alias("chunk_order"))
        d = self.documents().select(F.col("id").alias("doc_id"), "doc_name", F.col("content").alias("whole"), "tenant_id", "project_id")
        return e.join(d, "doc_id").select(
            F.col("chunk_id").alias("id"),
            "doc_id",
            "chunk_order",
            F.when(F.col("chunk_order") == 0, "").otherwise(F.concat(F.lit("ctx "), "doc_name")).alias("context"),
            F.substring(F.col("whole"), F.col("chunk_order") * 492 + 1, F.lit(512)).alias("content"),
            "tenant_id",
            "project_id",
        )

    def vectors(self) -> DataFrame:
        project = (F.floor(F.col("vec_id") / 4).cast("long") % 25).cast("int")
        return self["embeddings"].select(F.col("vec_id").alias("chunk_id"), "embedding", (project % 5).alias("tenant_id"), project.alias("project_id"))

    def entities(self) -> DataFrame:
        s = self["supplier"].select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("int").alias("tenant_id"), F.col("s_nationkey").cast("int").alias("project_id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("entity_type"))
        p = self["part"].select((F.col("p_partkey") + 1_000_000).alias("id"), (F.col("p_partkey") % 5).cast("int").alias("tenant_id"), (F.col("p_partkey") % 25).cast("int").alias("project_id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
        return s.unionByName(p)

    def relationships(self) -> DataFrame:
        r = self["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.max("l_orderkey").cast("string").alias("source_document_id"))
        return r.select(F.col("l_suppkey").alias("source_entity_id"), (F.col("l_partkey") + 1_000_000).alias("target_entity_id"), F.lit("SUPPLIES").alias("relationship_type"), "source_document_id")

    def queries(self) -> DataFrame:
        c = self["conversations"].where("role = 'user'")
        return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.col("text").alias("query_text"))

    def responses(self) -> DataFrame:
        """query_id, response_text of the queries that the next turn answers."""
        c = self["conversations"].where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text"))
        return self.queries().join(c, ["conv_id", "turn"]).select(F.col("id").alias("query_id"), "response_text")


#: The same views in SQL, as common table expressions.
VIEWS = {
    "v_tenants": "select r_regionkey as id, r_name as name from region",
    "v_projects": "select n_nationkey as id, n_regionkey as tenant_id, n_name as name from nation",
    "v_roles": "select c.c_custkey as id, concat('u', cast(cast(floor(c.c_custkey / 3) as bigint) as varchar)) as user_id, n.n_regionkey as tenant_id, c.c_nationkey as project_id, c.c_mktsegment as role from customer c join nation n on c.c_nationkey = n.n_nationkey",
    "v_documents": "select doc_id as id, concat('doc_', cast(doc_id as varchar), '.txt') as doc_name, text as content, n_chars as doc_size, lang as doc_type, cast((doc_id % 25) % 5 as int) as tenant_id, cast(doc_id % 25 as int) as project_id, source as created_by_user_id from documents",
    "v_chunks": "select e.vec_id as id, d.id as doc_id, cast(e.vec_id % 4 as int) as chunk_order, case when e.vec_id % 4 = 0 then '' else concat('ctx ', d.doc_name) end as context, substring(d.content, cast((e.vec_id % 4) * 492 + 1 as int), 512) as content, d.tenant_id, d.project_id from embeddings e join v_documents d on d.id = cast(floor(e.vec_id / 4) as bigint) where e.vec_id % 17 <> 0",
    "v_vectors": "select e.vec_id as chunk_id, e.embedding, cast((cast(floor(e.vec_id / 4) as bigint) % 25) % 5 as int) as tenant_id, cast(cast(floor(e.vec_id / 4) as bigint) % 25 as int) as project_id from embeddings e",
    "v_entities": "select s_suppkey as id, cast(s_nationkey % 5 as int) as tenant_id, cast(s_nationkey as int) as project_id, s_name as name, 'Supplier' as entity_type from supplier union all select 1000000 + p_partkey, cast(p_partkey % 5 as int), cast(p_partkey % 25 as int), p_name, p_type from part",
    "v_relationships": "select l_suppkey as source_entity_id, 1000000 + l_partkey as target_entity_id, 'SUPPLIES' as relationship_type, cast(max(l_orderkey) as varchar) as source_document_id from lineitem group by l_suppkey, l_partkey",
    "v_queries": "select conv_id * 1000 + turn as id, conv_id, turn, text as query_text from conversations where role = 'user'",
    "v_responses": "select q.id as query_id, c.text as response_text from v_queries q join conversations c on c.conv_id = q.conv_id and c.turn = q.turn + 1 and c.role = 'assistant'",
}


def sql(body: str) -> str:
    """body with the views in front that it names, and those that these name."""
    names: list[str] = []

    def need(text: str) -> None:
        for n in VIEWS:
            if n in text and n not in names:
                need(VIEWS[n])
                if n not in names:
                    names.append(n)

    need(body)
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    body = body.strip()
    if body.startswith("with "):
        return f"with {views}, {body[5:]}" if views else body
    return f"with {views} {body}" if views else body
