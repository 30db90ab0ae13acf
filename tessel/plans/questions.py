"""Questions that are logged, answered and kept: pending, then success or failed, with their sources.

A batch of questions has an id. It is logged with its pending responses in one version of the store, and its answers come in another, with all
their sources; so a batch that was stopped between both is whole when it is run again: what is logged is not logged twice, and
only what is still pending or has failed is answered. The ledger has the replies that came before the stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tessel.operators import answers
from tessel.operators.ledger import Ledger
from tessel.operators.models import Model
from tessel.sources.shared import keep
from tessel.sources.snapshots import Store

_KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType()}


def _schema(columns: str) -> StructType:
    return StructType([StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


SCHEMAS = {
    "queries": _schema("id long, batch_id string, tenant_id int, project_id int, query_text string"),
    "responses": _schema("query_id long, batch_id string, turn int, response_text string, status string"),
    "sources": _schema("query_id long, batch_id string, position int, rank int, chunk_id long, doc_id long, doc_name string, snippet string"),
}


def responses(store: Store, batch_id: str | None = None) -> DataFrame:
    """query_id, response_text, status of all questions, or of a batch: of each the state that was written last."""
    log = store.read("responses")
    log = log if batch_id is None else log.where(F.col("batch_id") == batch_id)
    last = log.groupBy("query_id").agg(F.max_by(F.struct("response_text", "status"), "turn").alias("last"), F.max("turn").alias("turn"))
    return last.select("query_id", "last.response_text", "last.status", "turn")


def log_batch(store: Store, batch_id: str, queries: DataFrame) -> None:
    """queries (id, tenant_id, project_id, query_text) with pending responses, unless the batch is there."""
    store.bootstrap(SCHEMAS)
    if not store.read("queries").where(F.col("batch_id") == batch_id).isEmpty():
        return
    rows = keep(queries.select("id", F.lit(batch_id).alias("batch_id"), "tenant_id", "project_id", "query_text"))
    pending = rows.select(F.col("id").alias("query_id"), "batch_id", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("response_text"), F.lit("pending").alias("status"))
    store.publish({n: _like(df, n) for n, df in {"queries": rows, "responses": pending}.items()}, add=True)


def _like(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def answer_batch(store: Store, batch_id: str, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, embed_text, decomposer: Model, k: int = 3, clause_model: Model | None = None, background: DataFrame | None = None, ledger: Ledger | None = None) -> int:
    """Answers what a batch has pending or failed; its new states and their sources are one version. How many questions were put."""
    state = responses(store, batch_id)
    left = keep(state.where("status in ('pending', 'failed')").select("query_id", "turn"))
    asked = keep(store.read("queries").where(F.col("batch_id") == batch_id).join(left, F.col("id") == F.col("query_id"), "left_semi"))
    n = asked.count()
    if not n:
        return 0
    made = answers.answer(asked, chunks, vectors, documents, embed_text, decomposer, k, clause_model, background, ledger)
    said = keep(made["responses"].where("status <> 'pending'").join(left, "query_id"))
    rows = {
        "responses": said.select("query_id", F.lit(batch_id).alias("batch_id"), (F.col("turn") + 1).alias("turn"), "response_text", "status"),
        "sources": made["sources"].join(said.where("status = 'success'").select("query_id"), "query_id", "left_semi").select("query_id", F.lit(batch_id).alias("batch_id"), "position", "rank", "chunk_id", "doc_id", "doc_name", F.col("content").alias("snippet")),
    }
    rows = {n_: keep(_like(df, n_)) for n_, df in rows.items()}
    if not rows["responses"].isEmpty():
        store.publish(rows, add=True)
    return n


def ask(store: Store, batch_id: str, queries: DataFrame, *args, **kwargs) -> DataFrame:
    """Logs and answers a batch; its responses. Running it again answers only what isn't answered."""
    log_batch(store, batch_id, queries)
    answer_batch(store, batch_id, *args, **kwargs)
    return responses(store, batch_id).drop("turn")
