"""Summaries of documents and of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import strip
from tessel.sources.shared import keep

from .ledger import Ledger
from .models import Model, as_text


#: What a model is asked for a project without and with a summary, unless other templates are given.
CREATE_PROMPT = "Summarise the project that these document summaries are of. Name its key points and themes.\n\n{summaries}"
UPDATE_PROMPT = "Bring the summary of a project up to date. What the document summaries say now holds; leave out what is no longer so.\n\nSummary:\n{summary}\n\nDocument summaries:\n{summaries}"
#: Characters of document summaries that a model gets at once; more are summarised in parts first.
MOST_CHARS = 100_000


def summarize_documents(documents: DataFrame, model: Model, ledger: Ledger | None = None) -> DataFrame:
    """document_id, tenant_id, project_id, summary_text, summary_hash; each distinct text goes to the model once."""
    ledger = ledger or Ledger(documents.sparkSession)
    rows = documents.select(F.col("id").alias("document_id"), "tenant_id", "project_id", "content")
    made = ledger.call("summary", model, rows, F.col("content"), out="summary_text", bring=["document_id", "tenant_id", "project_id"])
    return made.withColumn("summary_hash", F.sha2("summary_text", 256))


def project_inputs(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    """For each project with a summary: all its documents' ids, and their summaries that aren't blank, by id, with blank lines between."""
    ids = documents.groupBy("tenant_id", "project_id").agg(F.array_sort(F.collect_list("id")).alias("source_document_ids"))
    texts = summaries.withColumn("t", strip("summary_text")).where("t <> ''")
    parts = F.array_sort(F.collect_list(F.struct("document_id", "t")))
    rolled = texts.groupBy("tenant_id", "project_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("summary_input"))
    return ids.join(rolled, ["tenant_id", "project_id"])


def parts_of(texts: DataFrame, most: int) -> DataFrame:
    """tenant_id, project_id, part, text of texts (tenant_id, project_id, place, t): runs in order of place, joined by blank lines, of about most characters.

    A project is cut into blocks of places first, each with its number of characters, so that neither a row nor a task holds all of a large one;
    a part is a run of texts that begin in the same stretch of most characters.
    """
    size = F.length("t") + 2
    by = ["tenant_id", "project_id"]
    placed = texts.withColumn("__block", F.floor(F.col("place") / PLACES))
    blocks = placed.groupBy(*by, "__block").agg(F.sum(size).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*by, "__block", F.coalesce(earlier, F.lit(0)).alias("__before"))
    within = F.sum(size).over(Window.partitionBy(*by, "__block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - size
    at = placed.withColumn("__within", within).join(blocks, [*by, "__block"]).withColumn("part", F.floor((F.col("__before") + F.col("__within")) / most).cast("long"))
    each = F.array_sort(F.collect_list(F.struct("place", "t")))
    return at.groupBy(*by, "part").agg(F.array_join(F.transform(each, lambda x: x["t"]), "\n\n").alias("text"))


#: Texts of a project that one task takes at once.
PLACES = 4096


def roll_up(texts: DataFrame, model: Model, ledger: Ledger, most: int = MOST_CHARS) -> DataFrame:
    """tenant_id, project_id, text of texts (tenant_id, project_id, place, t) in their order; where they are more than about most characters, of summaries of parts of them.

    A tree: parts are summarised, and their summaries are the texts of the next level, until a project is one part. A project whose parts do not become fewer,
    as of a model that doesn't shorten, is joined as it is.
    """
    by, n_before, done = ["tenant_id", "project_id"], None, []
    left = texts
    while True:
        parts = keep(parts_of(left, most))
        counts = parts.groupBy(*by).agg(F.count("*").alias("n"))
        single = parts.join(counts.where("n = 1").select(*by), by, "left_semi")
        done.append(single.select(*by, "text"))
        several = parts.join(counts.where("n > 1").select(*by), by, "left_semi")
        n = several.count()
        if not n:
            break
        if n_before is not None and n >= n_before:
            whole = F.array_sort(F.collect_list(F.struct("part", "text")))
            done.append(several.groupBy(*by).agg(F.array_join(F.transform(whole, lambda x: x["text"]), "\n\n").alias("text")))
            break
        said = ledger.call("project_part", model, several, fill_project(None, F.col("text")), out="t")
        left, n_before = keep(said.select(*by, F.col("part").alias("place"), strip(as_text(F.col("t"))).alias("t"))), n
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fill_project(summary: Column | None, texts: Column) -> Column:
    """The prompt that makes a project's summary, or brings the one that is there up to date."""
    made = F.replace(F.lit(CREATE_PROMPT), F.lit("{summaries}"), texts)
    if summary is None:
        return made
    renewed = F.replace(F.replace(F.lit(UPDATE_PROMPT), F.lit("{summary}"), F.coalesce(summary, F.lit(""))), F.lit("{summaries}"), texts)
    return F.when(summary.isNull(), made).otherwise(renewed)


def summarize_projects(documents: DataFrame, summaries: DataFrame, existing: DataFrame, model: Model, ledger: Ledger | None = None, touched: DataFrame | None = None, most: int = MOST_CHARS) -> DataFrame:
    """The project summaries after a refresh, of the touched projects (tenant_id, project_id) or of all; projects without documents or summaries keep what they have."""
    ledger, by = ledger or Ledger(documents.sparkSession), ["tenant_id", "project_id"]
    if touched is not None:
        documents, summaries = documents.join(touched, by, "left_semi"), summaries.join(touched, by, "left_semi")
    texts = summaries.withColumn("t", strip("summary_text")).where("t <> ''").select(*by, F.col("document_id").alias("place"), "t")
    rolled = roll_up(texts, model, ledger, most)
    ids = documents.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("source_document_ids"))
    old = existing.select(*by, F.col("summary_text").alias("old"))
    inputs = keep(rolled.join(ids, by).join(old, by, "left"))
    made = ledger.call("project_summary", model, inputs, fill_project(F.col("old"), F.col("text")), out="summary_text")
    made = made.withColumn("summary_text", strip(as_text(F.col("summary_text"))))
    if "refreshed_at" in existing.columns:
        made = made.withColumn("refreshed_at", F.current_timestamp())
    rows = made.select(*by, "summary_text", "source_document_ids", *[c for c in ("refreshed_at",) if c in existing.columns])
    kept = existing.join(rows, by, "left_anti").select(*rows.columns)
    return kept.unionByName(rows)
