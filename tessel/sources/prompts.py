"""Prompts from a folder: one folder a prompt, with system.md and user.md."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PARTS = ("system", "user")


class Prompts:
    """Reads prompts through Spark, so that any store will do, and keeps what it has read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._read: dict[str, dict[str, str]] = {}

    def names(self) -> list[str]:
        found = self.spark.read.format("binaryFile").load(f"{self.folder}/*/system.md").select(F.element_at(F.split("path", "/"), -2).alias("n"))
        return sorted(r["n"] for r in found.collect())

    def load(self, name: str) -> dict[str, str]:
        """system and user text of a prompt; fails if either is missing."""
        if name not in self._read:
            rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{self.folder}/{name}")
            texts = {r["p"]: r["t"] for r in rows.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("p"), F.decode("content", "UTF-8").alias("t")).collect()}
            missing = [p for p in PARTS if p not in texts]
            if missing:
                raise FileNotFoundError(f"{name} has no {missing[0]}.md")
            self._read[name] = {p: texts[p] for p in PARTS}
        return self._read[name]

    def reload(self, name: str) -> dict[str, str]:
        self._read.pop(name, None)
        return self.load(name)
