"""Documents into the tables: chunks, contexts, vectors, knowledge and summaries, in one pass of set operations.

What has changed is carried from each level to the next: only documents with another content are processed, and the
ledger of model calls answers every prompt that was there before, so a text that has not changed calls no model. Each model result
is written before it is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import fill, join_nonempty, locate_span, splice_all, strip
from tessel.functions.vector import check_dimension, hash_vector
from tessel.operators import knowledge, models, summaries
from tessel.operators.chunking import chunk_documents
from tessel.operators.ledger import Ledger
from tessel.operators.mutate import delete_documents, upsert, with_ids
from tessel.operators.scope import Scope
from tessel.sources.shared import TEXTS, drop, keep, keep_parts

DIM = 64
#: Chunks get their contexts in one part for each so many of them, up to the largest number of parts: what a part shuffles goes before the next one's.
PART_ROWS, MOST_PARTS = 200_000, 4


#: What a model is asked for a chunk, unless another template is given.
CONTEXT_PROMPT = "Document:\n{content}\n\nPassage:\n{chunk}\n\nSay in one or two sentences where the passage stands in the document."


@dataclass(frozen=True)
class Makers:
    """The models of an ingestion. Without an embedder vectors come from the hash of a text, without project_model project summaries stay as they are."""

    context_model: models.Model = models.first_sentence
    embedder: models.Model | None = None
    summarizer: models.Model = models.first_sentence
    extractor: models.Model = models.capitalised_words
    context_prompt: str | None = None
    project_model: models.Model | None = None


def with_digest(documents: DataFrame, *columns: Column | str) -> DataFrame:
    """doc_id, columns and the digest of documents, by which marked() knows their texts."""
    return documents.select(F.col("id").alias("doc_id"), *columns, F.sha2("content", 256).alias("__digest"))


def marked(chunks: DataFrame) -> DataFrame:
    """chunks with __all, whether a chunk is all of its document, in place of the document's __digest."""
    return chunks.withColumn("__all", F.sha2("content", 256) == F.col("__digest")).drop("__digest")


def contextualize(chunks: DataFrame, documents: DataFrame, model: models.Model, prompt: str | None = None, ledger: Ledger | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """chunks with context: empty if the chunk is all of its document, else the model's text, stripped.

    With a prompt the model gets it filled with the chunk and its whole document, else the chunk alone; then no document moves, as
    a digest tells whether a chunk is all of it, and chunks that are marked() already do not move for that either. part (i, n): the i-th of n parts of the rows.
    """
    ledger = ledger or Ledger(chunks.sparkSession)
    whole = [F.col("content").alias("__whole")] if prompt else []
    if "__all" not in chunks.columns:
        joined = marked(chunks.join(with_digest(documents, *whole), "doc_id"))
    else:
        joined = chunks.join(documents.select(F.col("id").alias("doc_id"), *whole), "doc_id") if prompt else chunks
    asked = fill(prompt, "content", "__whole") if prompt else F.col("content")
    columns = [c for c in chunks.columns if c != "__all"]
    said = ledger.call("context", model, joined, F.when(F.col("__all"), F.lit(None)).otherwise(asked), out="__said", bring=columns, part=part)
    return said.withColumn("context", strip(models.as_text(F.col("__said")))).drop("__said")


def embedded(chunks: DataFrame, embedder: models.Model | None, ledger: Ledger) -> DataFrame:
    """chunk_id, embedding, tenant_id, project_id of chunks (id, context, content, …; kept) that have a text.

    A model's vectors are written once. Those of the hash follow from the texts, which are written, and are made where they are read, as random bits
    that no codec shortens would take more room than the texts.
    """
    text = join_nonempty("context", "content")
    rows = chunks.where(text != "").select(F.col("id").alias("chunk_id"), "tenant_id", "project_id", text.alias("text"))
    checked = lambda made: made.select("chunk_id", check_dimension(F.col("embedding"), DIM).alias("embedding"), "tenant_id", "project_id")
    if embedder is None:
        return checked(rows.withColumn("embedding", hash_vector(F.col("text"), DIM).cast("array<float>")))
    return keep(checked(ledger.call("embed", embedder, rows, F.col("text"), "array<float>", "embedding")))


def derive(documents: DataFrame, state: dict[str, DataFrame], scope: Scope, makers: Makers, ledger: Ledger) -> dict[str, DataFrame]:
    """state with the knowledge and the summaries of documents (kept), whose other tables are up to date."""
    out = dict(state)
    texts = documents.where(strip("content") != "").select(F.col("id").alias("doc_id"), "content")
    found = keep(ledger.call("extract", makers.extractor, texts, F.col("content"), models.EXTRACTION, "x", bring=["doc_id"]))
    entities = found.select("doc_id", F.posexplode("x.entities").alias("ord", "e")).select("doc_id", "ord", "e.*")
    relations = found.select("doc_id", F.posexplode("x.relations").alias("ord", "r")).select("doc_id", "ord", "r.*")
    graph = knowledge.Graph(state["entities"], state["edges"], state["metadata"])
    graph = knowledge.refresh(graph, documents.select(F.col("id").alias("doc_id")), entities, relations, scope)
    out |= {"entities": graph.entities, "edges": graph.edges, "metadata": graph.metadata}
    drop(found)
    written = keep(summaries.summarize_documents(documents, makers.summarizer, ledger))
    out["summaries"] = upsert(state["summaries"], written.select(*state["summaries"].columns), ["document_id"])
    return _rolled_up(out, documents, makers, ledger)


def _rolled_up(state: dict[str, DataFrame], touched: DataFrame, makers: Makers, ledger: Ledger) -> dict[str, DataFrame]:
    """state with new summaries of the projects of touched documents, where it has project summaries and a model for them."""
    if makers.project_model is None or "project_summaries" not in state:
        return state
    made = summaries.summarize_projects(state["documents"], state["summaries"], state["project_summaries"], makers.project_model, ledger, touched.select("tenant_id", "project_id").distinct())
    return state | {"project_summaries": keep(made)}


def process(documents: DataFrame, state: dict[str, DataFrame], scope: Scope, ledger: Ledger | None = None, **models_) -> dict[str, DataFrame]:
    """state, which has documents (id, doc_name, content, tenant_id, project_id) among its own, with these chunked, embedded, extracted and summarised."""
    makers, own = Makers(**models_), ledger is None
    ledger = ledger or Ledger(documents.sparkSession)
    scoped = with_digest(documents, "tenant_id", "project_id")
    cut = with_ids(state["chunks"], marked(chunk_documents(documents).drop("headers").join(scoped, "doc_id")), ["doc_id", "chunk_order"], codec=TEXTS)
    n = min(MOST_PARTS, 1 + cut.count() // PART_ROWS)
    made = keep_parts(lambda i: contextualize(cut, documents, makers.context_model, makers.context_prompt, ledger, (i, n)), n, TEXTS)
    drop(cut)
    out = dict(state)
    out["chunks"] = state["chunks"].unionByName(made.select(*state["chunks"].columns))
    vectors = embedded(made, makers.embedder, ledger).select(*state["vectors"].columns)
    left = state["vectors"].join(made.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select(*state["vectors"].columns)
    out["vectors"] = left.unionByName(vectors)
    out = derive(documents, out, scope, makers, ledger)
    if own:
        ledger.drop()  # all that was made of its replies is written
    return out


def upload(documents: DataFrame, state: dict[str, DataFrame], scope: Scope, **models_) -> dict[str, DataFrame]:
    """documents (doc_name, content) as new rows of the scope's primary project, processed."""
    here = documents.drop("context").withColumns({"tenant_id": F.lit(scope.tenant_id), "project_id": F.lit(scope.primary), "doc_size": F.length("content").cast("long")})
    here = here.withColumn("__hash", F.xxhash64("content"))  # ids follow the names; whole texts are no sort key
    # the context is the content, which is written once
    rows = with_ids(state["documents"], here, ["doc_name", "__hash"], codec=TEXTS).withColumn("context", F.col("content")).select(*state["documents"].columns)
    return process(rows, state | {"documents": state["documents"].unionByName(rows)}, scope, **models_)


def changed_documents(documents: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """Those of documents (id, content, …) that are there with another content, by digest."""
    old = state["documents"].select("id", F.sha2("content", 256).alias("__old"))
    return documents.join(old, "id").where(~F.sha2("content", 256).eqNullSafe(F.col("__old"))).select(*documents.columns)


def update(documents: DataFrame, state: dict[str, DataFrame], scope: Scope, **models_) -> dict[str, DataFrame]:
    """Documents that are there (id) with new content: their chunks and vectors go, then they are processed anew. Unknown ids and unchanged contents are left alone."""
    rows = changed_documents(documents, state)
    sizes = {c: x for c, x in {"context": F.col("content"), "doc_size": F.length("content").cast("long")}.items() if c in state["documents"].columns}
    rows = keep(rows.withColumns(sizes).select(*state["documents"].columns))
    fresh = delete_documents({k: state[k] for k in ("documents", "chunks", "vectors", "sources") if k in state}, rows)
    return process(rows, state | fresh | {"documents": upsert(state["documents"], rows, ["id"])}, scope, **models_)


def delete(doomed: DataFrame, state: dict[str, DataFrame], ledger: Ledger | None = None, **models_) -> dict[str, DataFrame]:
    """Documents (id) with all that comes from them; the summaries of their projects follow."""
    gone = keep(state["documents"].join(doomed.select("id").distinct(), "id", "left_semi").select("id", "tenant_id", "project_id"))
    graph = knowledge.purge(knowledge.Graph(state["entities"], state["edges"], state["metadata"]), gone.select(F.col("id").alias("doc_id")))
    out = delete_documents(state, gone) | {"entities": graph.entities, "edges": graph.edges, "metadata": graph.metadata}
    return _rolled_up(out, gone, Makers(**models_), ledger or Ledger(doomed.sparkSession))


def spliced(edits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, content of documents after all edits (id of a chunk, new_content) of their chunks.

    All edits of a document are one splice, from its right end on, so that no place moves before it is used. Where the chunk after it is edited too and
    begins inside an edited chunk, that one ends there. A chunk that isn't found in its document leaves it as it is.
    """
    texts = documents.select(F.col("id").alias("doc_id"), F.col("content").alias("__text"))
    found = chunks.select("id", "doc_id", "chunk_order", "content").join(edits, "id").join(texts, "doc_id")
    start = locate_span("__text", "content", "chunk_order")
    spans = found.select("doc_id", start.alias("start"), F.length("content").alias("size"), "new_content").where("start is not null")
    each = F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size")).cast("int").alias("end"), F.col("new_content").alias("new"))))
    by_doc = spans.groupBy("doc_id").agg(each.alias("__spans"))
    return texts.join(by_doc, "doc_id").select("doc_id", splice_all("__text", "__spans").alias("content"))


def last_edits(edits: DataFrame) -> DataFrame:
    """id, new_content: of several edits of one chunk the last by their column ord, or the largest text without one; null is empty."""
    new = F.coalesce("new_content", F.lit(""))
    return edits.where("id is not null").groupBy("id").agg((F.max_by(new, "ord") if "ord" in edits.columns else F.max(new)).alias("new_content"))


def edit_chunks(edits: DataFrame, state: dict[str, DataFrame], scope: Scope, ledger: Ledger | None = None, **models_) -> dict[str, DataFrame]:
    """edits (id, new_content) of any chunks: their texts, contexts and vectors, and of their documents the text, the knowledge and the summaries follow.

    Unknown ids are left out. Models see the edited chunks and the documents whose text has changed, and nothing else.
    """
    makers, ledger = Makers(**models_), ledger or Ledger(edits.sparkSession)
    asked = keep(last_edits(edits))
    texts = spliced(asked, state["chunks"], state["documents"]).withColumnRenamed("content", "__new")
    docs = state["documents"].join(texts.withColumnRenamed("doc_id", "id"), "id").where(~F.col("__new").eqNullSafe(F.col("content")))
    sizes = {c: x for c, x in {"context": F.col("__new"), "doc_size": F.length("__new").cast("long"), "content": F.col("__new")}.items() if c in state["documents"].columns}
    docs = keep(docs.withColumns(sizes).select(*state["documents"].columns))
    out = state | {"documents": upsert(state["documents"], docs, ["id"])}
    chunks = keep(state["chunks"].join(asked, "id").withColumn("content", F.col("new_content")).select(*state["chunks"].columns))
    chunks = keep(contextualize(chunks, out["documents"], makers.context_model, makers.context_prompt, ledger))
    out["chunks"] = upsert(state["chunks"], chunks, ["id"])
    vectors = embedded(chunks, makers.embedder, ledger)
    left = state["vectors"].join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select(*state["vectors"].columns)
    out["vectors"] = left.unionByName(vectors.select(*state["vectors"].columns))
    return derive(docs, out, scope, makers, ledger)
