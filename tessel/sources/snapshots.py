"""Versioned snapshots of several tables, published together.

Each version writes its tables to folders of its own, then one small manifest names them all. A
reader takes the newest manifest, so it sees all tables of a version or none. Tables may be partitioned, by tenant for
instance, so that a filter on those columns reads only their folders; appended rows are folders beside the old ones.

A manifest is made only if there is none of its number, so of many writers one wins each version. The others look at what the
winner changed: if it touched none of their tables, or both only added rows, they try the next number with their own folders, else they fail and
remove them. Folders that no manifest names are never read.

Unique keys are kept up folder by folder: each has the range of its keys and a Bloom filter of them, so an append reads old keys only of folders that may hold
a new one. Numbers for new rows come from counters in the manifest, as ranges that are handed out once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.operators.mutate import insert_missing, violations, with_ids

from . import filesystem
from .shared import keep

#: Tries of a writer that others overtake.
TRIES = 20
#: Bits for each key of a Bloom filter, and how many of them a key sets.
BITS, SET = 16, 5


class Conflict(RuntimeError):
    """Another writer has changed the same table since."""


class Store:
    def __init__(self, spark: SparkSession, path: str, unique: dict[str, list[str]] | None = None, partitions: dict[str, list[str]] | None = None):
        self.spark, self.path, self.unique, self.partitions = spark, path.rstrip("/"), unique or {}, partitions or {}

    # ---- manifests

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:015d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in filesystem.names(self.spark, f"{self.path}/manifests") if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        return json.loads(filesystem.read(self.spark, self._name(version)))

    def _newest(self) -> tuple[int, dict]:
        found = self.versions()
        return (found[-1], self._manifest(found[-1])) if found else (0, {"tables": {}, "counters": {}})

    def manifest(self) -> tuple[int, dict[str, dict]]:
        """The newest version, and of each of its tables the folders (paths) and the schema."""
        version, made = self._newest()
        return version, made["tables"]

    @property
    def version(self) -> int:
        return (self.versions() or [0])[-1]

    # ---- reading

    def read(self, name: str, version: int | None = None) -> DataFrame:
        if version is not None and version not in self.versions():
            raise KeyError(f"no version {version}")
        tables = self._manifest(version)["tables"] if version is not None else self.manifest()[1]
        return self._table(name, tables[name])

    def _table(self, name: str, entry: dict, paths: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{name}")
        return read.parquet(*(paths or [f["path"] for f in entry["folders"]])).select(*[f"`{n}`" for n in schema.names])

    def health(self) -> dict:
        """Whether the newest manifest, the versions without a gap and the schema of each table can be read."""
        try:
            found = self.versions()
            if found != list(range(1, len(found) + 1)):
                raise ValueError(f"versions {found} have a gap")
            version, tables = self.manifest()
            for name, entry in tables.items():
                self._table(name, entry).limit(1).count()
        except Exception as e:  # whatever the store says
            return {"ok": False, "error": str(e)}
        return {"ok": True, "version": version, "tables": sorted(tables)}

    # ---- unique keys

    def _hash(self, name: str) -> Column:
        return F.xxhash64(*self.unique[name])

    def _summary(self, name: str, path: str, schema: dict) -> dict:
        """Rows and range of the keys of a folder; its Bloom filter is written as words of 64 bits."""
        keys = self._table(name, {"schema": schema, "folders": []}, [path]).select(*self.unique[name])
        first = F.col(self.unique[name][0]).cast("string")
        n, low, high = keys.agg(F.count("*"), F.min(first), F.max(first)).first()
        bits = max(64, 1 << (n * BITS - 1).bit_length()) if n else 64
        words = keys.select(self._hash(name).alias("h")).select(F.explode(_places(F.col("h"), bits)).alias("p"))
        words = words.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("set"))
        bloom = f"{self.path}/keys/{name}/{uuid.uuid4().hex}"
        words.write.parquet(bloom)
        return {"rows": n, "low": low, "high": high, "bits": bits, "bloom": bloom}

    def folders_to_read(self, name: str, entry: dict, fresh: DataFrame) -> list[str]:
        """Folders of entry that may hold a key of fresh: by the range of the keys, then by the Bloom filters."""
        first = F.col(self.unique[name][0]).cast("string")
        low, high = fresh.agg(F.min(first), F.max(first)).first()
        hashes = fresh.select(self._hash(name).alias("h"))
        out = []
        for f in entry["folders"]:
            if not f.get("bloom"):
                out.append(f["path"])
                continue
            nulls = f["low"] is None or low is None  # a range says nothing of null keys
            if not f["rows"] or not nulls and (f["high"] < low or high < f["low"]):
                continue
            asked = hashes.select("h", F.explode(_places(F.col("h"), f["bits"])).alias("p")).select("h", F.shiftright("p", 6).alias("word"), _bit(F.col("p")).alias("bit"))
            words = self.spark.read.schema("word long, set long").parquet(f["bloom"])
            found = asked.join(words, "word").where(F.col("set").bitwiseAND(F.col("bit")) != 0)
            need = asked.groupBy("h").agg(F.count("*").alias("n"))
            if not found.groupBy("h").agg(F.count("*").alias("n")).join(need, ["h", "n"]).isEmpty():
                out.append(f["path"])
        return out

    def _check_unique(self, name: str, entry: dict, mine: dict) -> None:
        """Fails on a key that is twice in my folder, or in it and in another of entry."""
        keys = self.unique.get(name)
        if not keys:
            return
        fresh = self._table(name, entry, [mine["path"]]).select(*keys)
        clash = not violations(fresh, keys).isEmpty()
        if not clash:
            rest = entry | {"folders": [f for f in entry["folders"] if f["path"] != mine["path"]]}
            old = self.folders_to_read(name, rest, fresh)
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            clash = bool(old) and not fresh.alias("f").join(self._table(name, rest, old).select(*keys).alias("o"), condition, "left_semi").isEmpty()
        if clash:
            raise ValueError(f"{name} isn't unique by {', '.join(keys)}")

    # ---- writing

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.path}/data/{name}/__batch={uuid.uuid4().hex}"
        by = self.partitions.get(name, [])
        # a tenant's rows go to few files, and those of a large one to several tasks, by AQE
        (df.hint("rebalance", *by).write.partitionBy(*by) if by else df.write).parquet(path)
        return path

    def append(self, name: str, rows: DataFrame, at: int | None = None) -> int:
        """Rows added to a table; what is there isn't written again."""
        return self.publish({name: rows}, at=at, add=True)

    def reserve(self, name: str, n: int) -> int:
        """The first of n numbers that are handed out to nobody else; they follow the largest that was reserved before."""
        first = 0

        def take(current: dict) -> dict:
            nonlocal first
            first = current["counters"].get(name, 0) + 1
            return current | {"counters": current["counters"] | {name: first + n - 1}}

        self._commit(take)
        return first

    def insert(self, name: str, rows: DataFrame, order: list[str], id_col: str = "id") -> int:
        """Rows added with ids of a reserved range, in the order of their natural key; rows are evaluated once. The first id."""
        kept = keep(rows)
        n = kept.count()
        first = self.reserve(name, n)
        if n:
            columns = self.read(name).columns if name in self.manifest()[1] else [id_col, *rows.columns]
            self.append(name, with_ids(kept, kept, order, id_col, start=first - 1).select(*columns))
        return first

    def seed(self, rows: dict[str, tuple[DataFrame, list[str]]]) -> int:
        """Rows with keys that a table doesn't have yet; no new version where all are there."""
        fresh = {n: df.join(self.read(n).select(*keys), keys, "left_anti").select(*df.columns) for n, (df, keys) in rows.items()}
        fresh = {n: df for n, df in fresh.items() if not df.isEmpty()}
        return self.publish(fresh, add=True) if fresh else self.version

    def drop(self, names: list[str]) -> int:
        """A version without these tables; older versions still have them."""
        return self._commit(lambda current: current | {"tables": {n: t for n, t in current["tables"].items() if n not in names}})

    def reset(self, schemas: dict[str, StructType], seeds: dict[str, tuple[DataFrame, list[str]]] | None = None) -> int:
        """Only these tables, empty but for the seeds."""
        empty = {n: self.spark.createDataFrame([], s) for n, s in schemas.items()}
        made = {n: insert_missing(df, seeds[n][0], seeds[n][1]) if seeds and n in seeds else df for n, df in empty.items()}
        return self.publish(made, rebuild=True, at=self.version, only=True)

    def bootstrap(self, schemas: dict[str, StructType]) -> int:
        """Empty tables for those that aren't there."""
        have = self.manifest()[1]
        missing = {n: self.spark.createDataFrame([], s) for n, s in schemas.items() if n not in have}
        return self.publish(missing) if missing else self.version

    def publish(self, tables: dict[str, DataFrame], rebuild: bool = False, at: int | None = None, add: bool | set[str] = False, only: bool = False) -> int:
        """Write new states of tables, or rows to add to them (add: all, or the names of some); the others stay, unless these are to be the only ones.

        Fails if at is given and another version has come since, if another writer has changed the same tables meanwhile (rows added on both sides are
        no conflict), on keys that aren't unique, and on other columns unless rebuild is set. What a failed call wrote is removed.
        """
        version, base = self._newest()
        if at is not None and version != at:
            raise Conflict(f"version {version} is newer than {at}")
        adds = set(tables) if add is True else (add or set())
        mine: dict[str, dict] = {}
        checked: dict[str, set[str]] = {}

        def merge(current: dict) -> dict:
            if at is not None and current is not base and self.version != at:
                raise Conflict(f"version {self.version} is newer than {at}")
            new = {} if only else dict(current["tables"])
            for name, own in mine.items():
                before, now = base["tables"].get(name), current["tables"].get(name)
                if before != now and not (name in adds and before and now and now["folders"][: len(before["folders"])] == before["folders"] and now["schema"] == before["schema"]):
                    raise Conflict(f"{name} has been changed by another writer")
                kept = now["folders"] if name in adds and now else []
                entry = {"folders": [*kept, own["folder"]], "schema": own["schema"]}
                # folders of others that came meanwhile are checked as well, those before only once
                left = [f for f in kept if f["path"] not in checked.get(name, set())]
                self._check_unique(name, entry | {"folders": [*left, own["folder"]]}, own["folder"])
                checked[name] = {f["path"] for f in kept}
                new[name] = entry
            return current | {"tables": new}

        try:
            for name, df in tables.items():
                schema = df.schema.jsonValue()
                if name in base["tables"] and not rebuild:
                    kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
                    if kinds(StructType.fromJson(base["tables"][name]["schema"])) != kinds(df.schema):
                        raise ValueError(f"{name} has other columns than before")
                mine[name] = {"schema": schema, "folder": {"path": self._write(name, df)}}
                if name in self.unique:
                    mine[name]["folder"] |= self._summary(name, mine[name]["folder"]["path"], schema)
            return self._commit(merge, (version, base))
        except Exception:
            for own in mine.values():
                for path in (own["folder"]["path"], own["folder"].get("bloom")):
                    if path:
                        filesystem.remove(self.spark, path)
            raise

    def _commit(self, change, start: tuple[int, dict] | None = None) -> int:
        """The next version, by change(the newest manifest); tried again with a newer one as long as other writers come first."""
        version, current = start or self._newest()
        for _ in range(TRIES):
            made = change(current)
            if filesystem.create(self.spark, self._name(version + 1), json.dumps(made)):
                return version + 1
            version, current = self._newest()
        raise Conflict(f"overtaken {TRIES} times, last by version {version}")


def _places(h: Column, bits: int) -> Column:
    """The bits that a key of hash h sets in a filter of so many (a power of two)."""
    step = F.xxhash64(h).bitwiseOR(F.lit(1))
    at = lambda i: F.shiftrightunsigned(F.xxhash64(h.bitwiseXOR(F.lit(i)), step), 1).bitwiseAND(F.lit(bits - 1))
    return F.array_distinct(F.array(*[at(i) for i in range(SET)]))


def _bit(place: Column) -> Column:
    """The bit of a place in its word: words are 64 bits, whose sign is one of them."""
    n = place.bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)
