"""Models behind small interfaces, with deterministic ones that need no network.

A model is a function from a pandas series of texts to a series of results; it is called with whole
Arrow batches and may load what it needs at its first call in a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, _parse_datatype_string

from tessel.functions.text import commit_message
from tessel.functions.vector import hash_vector

Model = Callable[[pd.Series], pd.Series]
EXTRACTION = "struct<entities:array<struct<name:string,entity_type:string,description:string>>,relations:array<struct<source:string,target:string,relationship_type:string,description:string>>>"


def local(model: Model) -> Model:
    """Marks a model that works in the task alone: no number of tasks is too many for it."""
    model.is_local = True
    return model


def is_local(model: Model) -> bool:
    return getattr(model, "is_local", False)


def apply_model(model: Model, column: Column, kind: str = "string") -> Column:
    return F.pandas_udf(lambda s: model(s), kind)(column)


def as_text(reply: Column, kind: DataType | None = None) -> Column:
    """A model's reply as text: strings as they are, null as empty, lists of parts joined, structs by their content or text field."""
    if kind is None or isinstance(kind, StringType):
        return F.coalesce(reply, F.lit(""))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_join(F.transform(reply, lambda x: as_text(x, kind.elementType)), ""), F.lit(""))
    if isinstance(kind, StructType):
        own = next((f for n in ("content", "text") for f in kind.fields if f.name == n), None)
        return as_text(reply[own.name], own.dataType) if own else F.coalesce(F.to_json(reply), F.lit(""))
    return F.coalesce(reply.cast("string"), F.lit(""))


def structured(model: Model, column: Column, kind: str) -> Column:
    """A struct (value, error) of a model that replies with JSON: the value of this kind, or why the reply isn't one.

    A reply may have other text around its outermost braces. Missing and wrongly typed fields are errors, not nulls.
    """
    reply = apply_model(model, column)
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    value = F.from_json(body, kind, {"mode": "PERMISSIVE"})
    whole = [f.name for f in _parse_datatype_string(kind).fields]
    missing = [F.when(value[n].isNull(), F.lit(n)) for n in whole]
    wrong = F.filter(F.array(*missing), lambda n: n.isNotNull())
    error = F.when(body == "", "no JSON in the reply").when(F.size(wrong) > 0, F.concat(F.lit("no valid "), F.array_join(wrong, ", ")))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def covers(model: Model, question: Column, answer: Column) -> Column:
    """Whether a model says that an answer covers a question: its reply begins with yes, in either case."""
    asked = F.concat(F.lit("Question:\n"), question, F.lit("\n\nAnswer:\n"), answer, F.lit("\n\nDoes the answer cover the question? Reply yes or no."))
    return F.startswith(F.lower(F.trim(as_text(apply_model(model, asked)))), F.lit("yes"))


def commit_text(model: Model, changes: Column, action: str, noun: Column) -> Column:
    """A commit message by a model from a text of changes: its first line, or one made from action and noun where it says nothing."""
    return commit_message(as_text(apply_model(model, changes)), action, noun)


def embed(df: DataFrame, text: Column, dim: int, model: Model | None = None, name: str = "embedding") -> DataFrame:
    """df with a vector for each text; without a model the one that depends on the text's hash."""
    made = apply_model(model, text, "array<float>") if model else hash_vector(text, dim).cast("array<float>")
    return df.withColumn(name, made)


@local
def first_sentence(texts: pd.Series) -> pd.Series:
    """Stands for a summary."""
    return texts.map(lambda t: re.split(r"(?<=[.!?])\s", (t or "").strip(), maxsplit=1)[0])


@local
def split_questions(queries: pd.Series) -> pd.Series:
    """Stands for a decomposition: all sentences of a query as JSON."""
    cut = lambda q: [s.strip() for s in re.split(r"(?<=[.!?])\s+", q or "") if s.strip()] or [q or ""]
    return queries.map(lambda q: json.dumps({"subquestions": cut(q)}))


@local
def quote_sources(prompts: pd.Series) -> pd.Series:
    """Stands for the wording of a clause: the first sentence of the first source that wasn't quoted already."""

    def quote(prompt: str) -> str | None:
        said, _, rest = prompt.partition("\n\nSources:\n")
        sources, _, _ = rest.partition("\n\nQuestion:\n")
        for name, text in re.findall(r"(?m)^\[\d+\] (.*?): (.*)$", sources):
            words = re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0]
            if words and words not in said:
                return f"{words} ({name})"
        return None

    return prompts.map(quote)


@local
def capitalised_words(texts: pd.Series) -> pd.Series:
    """Stands for an extraction: capitalised words are entities, each is linked to the next of its sentence."""

    def extract(text: str | None) -> dict:
        names, links = [], []
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = re.findall(r"\b[A-Z][a-z]{3,}\b", sentence)
            names += words
            links += [(a, b) for a, b in zip(words, words[1:], strict=False) if a != b]
        return {
            "entities": [{"name": n, "entity_type": "Term", "description": ""} for n in dict.fromkeys(names)],
            "relations": [{"source": a, "target": b, "relationship_type": "NEAR", "description": None} for a, b in dict.fromkeys(links)],
        }

    return pd.DataFrame([extract(t) for t in texts], columns=["entities", "relations"])
