"""What a request may hold, checked before any work: single values fail, of many rows the good ones and the others with a reason are given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import strip

#: Most hits of one search, and most entities of one resolution. Fixed values.
MOST_HITS, MOST_ENTITIES = 50, 20


def search_request(text: str | None, k: int) -> tuple[str, int]:
    if not (text or "").strip():
        raise ValueError("the query is blank")
    if not 1 <= k <= MOST_HITS:
        raise ValueError(f"k must be 1 to {MOST_HITS}")
    return text, k


def resolve_request(mention: str | None, limit: int, min_confidence: float) -> tuple[str, int, float]:
    if not (mention or "").strip():
        raise ValueError("the mention is blank")
    if not 1 <= limit <= MOST_ENTITIES:
        raise ValueError(f"limit must be 1 to {MOST_ENTITIES}")
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be 0 to 1")
    return mention, limit, min_confidence


def document_request(content: str | None) -> str:
    if not content:
        raise ValueError("a document must have a content")
    return content


def edit_requests(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits (id, new_content) that may be made, stripped, and the others with an error: a content must be given and not be blank."""
    error = F.when(F.col("new_content").isNull(), "no content").when(strip("new_content") == "", "the content is blank").when(F.col("id").isNull(), "no id")
    marked = edits.withColumn("error", error)
    good = marked.where("error is null").drop("error").withColumn("new_content", strip("new_content"))
    return good, marked.where("error is not null")
