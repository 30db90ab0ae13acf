"""A ledger of model calls: each distinct prompt goes to its model once.

Replies are stored by model and hash of the prompt. A call finds the prompts that have no reply yet by an anti join, sends each
once, in a bounded number of tasks (a model that is marked as local calls nothing outside and runs in as many as its prompts fill), and writes what came back as one batch, before anything reads it: replies that are used twice are not asked for
twice. A prompt that fails is tried again on its own; one that still fails is written with its error, which
is no reply, so a later call sends just those again, while all replies that did come stay.

A task that is lost with its executor is repeated and sends its prompts again; writers that run at the same time may send one prompt
twice, and the reply of the first batch is everybody's.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tessel.sources import filesystem
from tessel.sources.shared import TEXTS, bound_batches, shared_folder, shuffles_end

from .models import Model, is_local


class ModelFailure(RuntimeError):
    """Some prompts have no reply; the replies of the others are in the ledger."""


def _replies(model: Model, prompts: list[str], attempts: int) -> list[tuple[object, str | None]]:
    """(reply, error) of each prompt: all at once, or one by one where that fails. A model may give an exception in place of a reply."""

    def ask(some: list[str]) -> list:
        said = model(pd.Series(some, dtype=object))
        said = said.to_dict("records") if isinstance(said, pd.DataFrame) else list(said)
        if len(said) != len(some):
            raise ValueError(f"{len(said)} replies to {len(some)} prompts")
        return said

    try:
        return [(None, str(r)) if isinstance(r, Exception) else (r, None) for r in ask(prompts)]
    except Exception as e:  # whatever the model says
        if len(prompts) == 1:
            error = e
            for _ in range(attempts - 1):
                try:
                    return [(None, str(r)) if isinstance(r, Exception) else (r, None) for r in ask(prompts)]
                except Exception as again:
                    error = again
            return [(None, f"{type(error).__name__}: {error}")]
    return [one for p in prompts for one in _replies(model, [p], attempts)]


class Ledger:
    def __init__(self, spark: SparkSession, path: str | None = None, concurrency: int = 4, attempts: int = 2, batch: int = 256):
        """path: a folder that all share, a new one if None; concurrency: tasks that call a model at once, unless it is local; batch: prompts of one call of a model."""
        self.spark, self.concurrency, self.attempts, self.batch = spark, concurrency, attempts, batch
        self.path = (path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}").rstrip("/")

    def _stored(self, name: str, kind: str | None = None) -> DataFrame | None:
        schema = StructType.fromDDL("key string, error string, batch string")
        if kind:
            schema = schema.add("reply", _parse_datatype_string(kind))
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def replies(self, name: str, kind: str) -> DataFrame | None:
        """key, reply of all prompts that a model has answered, the first batch's where there are several."""
        stored = self._stored(name, kind)
        if stored is None:
            return None
        return stored.where("error is null").groupBy("key").agg(F.min_by("reply", "batch").alias("reply"))

    def calls(self, name: str) -> DataFrame:
        """batch, n_sent, n_failed of each call that sent something, in the order of the calls."""
        stored = self._stored(name)
        if stored is None:
            return self.spark.createDataFrame([], "batch string, n_sent long, n_failed long")
        return stored.groupBy("batch").agg(F.count("*").alias("n_sent"), F.count("error").alias("n_failed")).orderBy("batch")

    def send(self, name: str, model: Model, prompts: DataFrame, kind: str = "string") -> str:
        """Sends the prompts (key, prompt) that have no reply, each key once; the name of the batch."""
        known = self._stored(name)
        fresh = prompts.where("prompt is not null")
        if known is not None:
            fresh = fresh.join(known.where("error is null").select("key"), "key", "left_anti")
        fresh = fresh.groupBy("key").agg(F.first("prompt").alias("prompt"))
        if not is_local(model):
            fresh = fresh.repartition(self.concurrency)
        bound_batches(self.spark)
        attempts, size = self.attempts, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), size):
                    some = frame.iloc[at : at + size]
                    said = _replies(model, some["prompt"].tolist(), attempts)
                    yield pd.DataFrame({"key": some["key"].tolist(), "reply": pd.Series([r for r, _ in said], dtype=object), "error": [e for _, e in said]})

        batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        with shuffles_end(self.spark):
            fresh.mapInPandas(run, f"key string, reply {kind}, error string").write.option("compression", TEXTS).parquet(f"{self.path}/{name}/batch={batch}")
        return batch

    def drop(self) -> None:
        """Removes all replies: of a ledger that nobody else knows, when all that was made of them is written."""
        filesystem.remove(self.spark, self.path)

    def call(self, name: str, model: Model, rows: DataFrame, prompt: Column, kind: str = "string", out: str = "reply", strict: bool = True, bring: list[str] | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
        """rows (or their columns in bring) with out, the reply to prompt, which is null where the prompt is.

        rows are read twice and must be the same each time: a kept table, or expressions over one. name stands for the model
        with its version. strict: fails if a prompt has no reply, after the others are stored; else out_error says why. part (i, n): only the rows
        of the i-th of n parts by key, so that callers who write each part before the next one move that much at once.
        """
        i, n = part
        mine = lambda df, key: df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else df
        keyed = mine(rows.withColumn("__key", F.sha2(prompt, 256)), "__key")
        batch = self.send(name, model, keyed.select(F.col("__key").alias("key"), prompt.alias("prompt")), kind)
        stored = mine(self._stored(name, kind), "key")
        failed = stored.where((F.col("batch") == batch) & F.col("error").isNotNull())
        if strict:
            first = failed.select("error").first()
            if first is not None:
                raise ModelFailure(f"{name}: {failed.count()} prompts have no reply; {first['error']}")
        known = mine(self.replies(name, kind), "key").withColumn("error", F.lit(None).cast("string"))
        known = known.unionByName(failed.select("key", "reply", "error")) if not strict else known
        wanted = bring if bring is not None else rows.columns
        said = known.select(F.col("key").alias("__key"), F.col("reply").alias(out), F.col("error").alias(f"{out}_error"))
        return keyed.select(*wanted, "__key").join(said, "__key", "left").select(*wanted, out, *([] if strict else [f"{out}_error"]))
