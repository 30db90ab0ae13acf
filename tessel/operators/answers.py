"""Questions and sourced answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import NAME_MISSING, blank_to_null, compose, strip
from tessel.functions.udfs import parse_subquestions_udf
from tessel.sources.shared import keep

from .ledger import Ledger
from .models import Model, is_local, local
from .search import batch_search

PRIOR = 5


def pair_responses(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """query_id, response_text, status of each query: pending where no response is there yet."""
    r = responses.select("query_id", "response_text")
    joined = queries.select(F.col("id").alias("query_id")).join(r, "query_id", "left")
    return joined.withColumn("status", F.when(F.col("response_text").isNull(), "pending").otherwise("success"))


def decompose(queries: DataFrame, model: Model, ledger: Ledger | None = None) -> DataFrame:
    """query_id, position, subquestion, and the other columns of queries; each distinct query_text is sent once."""
    ledger = ledger or Ledger(queries.sparkSession)
    said = ledger.call("decompose", model, queries, F.col("query_text"), out="__said")
    parsed = parse_subquestions_udf()(F.col("__said"), F.col("query_text"))
    return said.select(*queries.columns, F.posexplode(parsed).alias("position", "subquestion"))


def resolve_citations(citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """citations (…, chunk_id, doc_id) with what they cite: an unknown chunk keeps the cited document and has no id and no text."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("doc_id").alias("__doc"), F.col("content").alias("__content"), F.lit(True).alias("__known"))
    d = documents.select(F.col("id").alias("doc_id"), F.col("doc_name").alias("__name"))
    rest = [x for x in citations.columns if x not in ("chunk_id", "doc_id")]
    found = citations.join(c, "chunk_id", "left").withColumn("doc_id", F.coalesce("__doc", "doc_id")).join(d, "doc_id", "left")
    return found.select(
        *rest,
        F.when(F.col("__known"), F.col("chunk_id")).alias("chunk_id"),
        "doc_id",
        F.coalesce(blank_to_null("__name"), F.lit(NAME_MISSING)).alias("doc_name"),
        F.coalesce(strip("__content"), F.lit("")).alias("content"),
    )


def prior_statements(clauses: DataFrame) -> DataFrame:
    """clauses (query_id, position, statement) with the first PRIOR statements before each."""
    before = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    early = clauses.withColumn("__n", place)
    kept = F.collect_list(F.when(F.col("__n") <= PRIOR, F.col("statement"))).over(before)
    return early.withColumn("prior", kept).drop("__n")


def compose_responses(clauses: DataFrame) -> DataFrame:
    """query_id, response_text of clauses (query_id, position, statement)."""
    parts = F.array_sort(F.collect_list(F.struct("position", F.coalesce("statement", F.lit("")).alias("s"))))
    return clauses.groupBy("query_id").agg(parts.alias("p")).select("query_id", compose(F.transform("p", lambda x: x["s"])).alias("response_text"))


def _say(model: Model):
    """A model of whole queries, as JSON: the statements of all subquestions of each, or why the model failed; it is called once for each place."""

    def call(prompts: pd.Series) -> list:
        try:
            return list(model(prompts))
        except Exception:  # one prompt that fails must not take the others with it
            said = []
            for p in prompts:
                try:
                    said.append(model(pd.Series([p])).iloc[0])
                except Exception as e:
                    said.append(e)
            return said

    def run(states: pd.Series) -> list:
        read = [json.loads(s) for s in states]
        asked, background = [r["asked"] for r in read], [r.get("background") for r in read]
        said: list[list[str | None]] = [[None] * len(a) for a in asked]
        failed: list[Exception | None] = [None] * len(said)
        for place in range(max(map(len, asked), default=0)):
            rows = [i for i, a in enumerate(asked) if place < len(a) and a[place].get("context") and failed[i] is None]
            prompts = []
            for i in rows:
                before = [s for s in said[i] if s][:PRIOR]
                prior = "\n".join(f"- {s}" for s in before) or "none"
                about = f"{background[i]}\n\n" if background[i] else ""
                prompts.append(f"{about}Said already:\n{prior}\n\nSources:\n{asked[i][place]['context']}\n\nQuestion:\n{asked[i][place]['subquestion']}")
            for i, reply in zip(rows, call(pd.Series(prompts, dtype=object)) if rows else (), strict=True):
                failed[i] = reply if isinstance(reply, Exception) else None
                said[i][place] = None if failed[i] else reply
        return [e or s for s, e in zip(said, failed, strict=True)]

    return local(run) if is_local(model) else run


def form_clauses(asked: DataFrame, sources: DataFrame, model: Model, background: DataFrame | None = None, ledger: Ledger | None = None) -> DataFrame:
    """query_id, position, statement, failed of subquestions (query_id, position, subquestion) with sources (query_id, position, rank, doc_name, content).

    A query's subquestions are put to the model in their order, each with its sources, the first PRIOR statements made before
    and the query's background (query_id, background). Subquestions without sources make no clause; a query whose model fails is failed.
    Queries with the same subquestions, sources and background are put once, and again only if they failed.
    """
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "doc_name", F.lit(": "), "content")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda r: r["x"]), "\n")
    context = sources.groupBy("query_id", "position").agg(texts.alias("context"))
    rows = asked.select("query_id", "position", "subquestion").join(context, ["query_id", "position"], "left")
    each = F.array_sort(F.collect_list(F.struct("position", "subquestion", "context")))
    by_query = rows.groupBy("query_id").agg(each.alias("asked"))
    by_query = by_query.join(background, "query_id", "left") if background is not None else by_query.withColumn("background", F.lit(None).cast("string"))
    rows = keep(by_query.select("query_id", F.to_json(F.struct("asked", "background")).alias("state"), F.transform("asked", lambda x: x["position"]).alias("at")))
    ledger = ledger or Ledger(asked.sparkSession)
    made = ledger.call("clauses", _say(model), rows, F.col("state"), "array<string>", "said", strict=False)
    lost = F.col("said_error").isNotNull()
    places = F.transform("at", lambda p, i: F.struct(p.alias("position"), F.when(lost, F.lit(None)).otherwise(F.get("said", i)).alias("statement")))
    return made.select("query_id", lost.alias("failed"), F.explode(places).alias("x")).select("query_id", "x.position", "x.statement", "failed")


def answer(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, embed_text, decomposer: Model, k: int = 3, clause_model: Model | None = None, background: DataFrame | None = None, ledger: Ledger | None = None) -> dict[str, DataFrame]:
    """Tables sources (query_id, position, rank, chunk_id, doc_id, doc_name, content), clauses and responses (query_id, response_text, status).

    queries: id, tenant_id, query_text. All subquestions of all queries are searched at once. A clause is what
    clause_model says of a subquestion's sources, or where they are if there is no model; subquestions without sources have
    none. background (query_id, background), as a project's summary, comes before each prompt. A query is failed where the
    model fails on it, pending where it has no clause. embed_text maps a text column to a vector column.
    """
    # replies of a model are written before they are read more than once
    ledger = ledger or Ledger(queries.sparkSession)
    asked = keep(decompose(queries.select(F.col("id").alias("query_id"), "tenant_id", "query_text"), decomposer, ledger))
    key = F.concat_ws(":", "query_id", "position")
    probes = keep(asked.select(key.alias("query_id"), "tenant_id", embed_text(F.col("subquestion")).alias("query")))
    # hits are read by the sources, the clauses and the responses
    hits = keep(batch_search(probes, vectors, k)).join(probes.select("query_id", "tenant_id"), "query_id")
    # whatever tenant a vector says it is of, its chunk and document are read only in the tenant of the query
    cited = hits.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "tenant_id"), ["chunk_id", "tenant_id"])
    of = documents.select(F.col("id").alias("doc_id"), F.col("tenant_id").alias("__of"))
    cited = cited.join(of, "doc_id", "left").where(F.col("__of").isNull() | (F.col("__of") == F.col("tenant_id"))).drop("__of", "tenant_id")
    sources = resolve_citations(cited, chunks, documents)
    split = F.split("query_id", ":")
    sources = sources.select(split[0].cast("long").alias("query_id"), split[1].cast("int").alias("position"), "rank", "chunk_id", "doc_id", "doc_name", "content")
    if clause_model is None:
        names = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_name"))), lambda x: x["doc_name"])), ", ")
        clauses = sources.groupBy("query_id", "position").agg(F.concat(F.lit("See "), names, F.lit(".")).alias("statement"))
        return {"sources": sources, "clauses": prior_statements(clauses), "responses": pair_responses(queries, compose_responses(clauses))}
    made = keep(form_clauses(asked, sources, clause_model, background, ledger))
    lost = made.where("failed").select("query_id").distinct()
    clauses = made.where("not failed and statement is not null").select("query_id", "position", "statement")
    paired = pair_responses(queries, compose_responses(clauses)).join(lost.withColumn("__lost", F.lit(True)), "query_id", "left")
    responses = paired.select("query_id", "response_text", F.when(F.col("__lost"), "failed").otherwise(F.col("status")).alias("status"))
    cited = sources.join(clauses.select("query_id", "position"), ["query_id", "position"], "left_semi")
    return {"sources": cited, "clauses": prior_statements(clauses), "responses": responses}
