"""Row policies: tables as one scope sees them, and writes that stay inside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.scope import Scope, scoped, write_check

from .snapshots import Store

#: Tables without a tenant belong to a row of another: its table, and the column that has its id.
PARENTS = {"metadata": ("edges", "relationship_id"), "responses": ("queries", "query_id"), "sources": ("queries", "query_id"), "summaries_of_chunks": ("chunks", "chunk_id")}
OWNED = ("tenant_id", "project_id")


class ScopedTables:
    """Every read carries the scope's predicate, so no plan made from these tables can bring up another tenant's row, whatever a vector or an edge refers to.

    Stored columns are filtered at the scan. Rows whose scope is null are nobody's. A table that neither has a scope nor a parent can't be read.
    """

    def __init__(self, tables: Store | Callable[[str], DataFrame], scope: Scope, parents: dict[str, tuple[str, str]] | None = None):
        self.store = tables if isinstance(tables, Store) else None
        self._read = tables.read if isinstance(tables, Store) else tables
        self.scope, self.parents = scope, PARENTS if parents is None else parents

    def __getitem__(self, name: str) -> DataFrame:
        df = self._read(name)
        if all(c in df.columns for c in OWNED):
            return scoped(df, self.scope, rls=True)
        if name not in self.parents:
            raise PermissionError(f"{name} has no row policy")
        parent, column = self.parents[name]
        return df.join(self[parent].select(F.col("id").alias(column)), column, "left_semi").select(*df.columns)

    def _allowed(self, name: str, rows: DataFrame) -> DataFrame:
        if all(c in rows.columns for c in OWNED):
            _, bad = write_check(rows, self.scope)
        else:
            if name not in self.parents:
                raise PermissionError(f"{name} has no row policy")
            parent, column = self.parents[name]
            bad = rows.join(self[parent].select(F.col("id").alias(column)), column, "left_anti")
        if not bad.isEmpty():
            raise PermissionError(f"rows of {name} are outside the scope")
        return rows

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows, all of which must be in the scope; none is written if one is not."""
        return self.store.append(name, self._allowed(name, rows))

    def replace(self, name: str, rows: DataFrame) -> int:
        """Makes rows the scope's part of a table; what others have stays as it is."""
        whole = self.store.read(name)
        own = F.coalesce(F.col("__own"), F.lit(False))
        if all(c in whole.columns for c in OWNED):
            others = write_check(whole, self.scope)[1]
        else:
            parent, column = self.parents[name]
            mine = self[parent].select(F.col("id").alias(column), F.lit(True).alias("__own"))
            others = whole.join(mine, column, "left").where(~own).select(*whole.columns)
        return self.store.publish({name: others.unionByName(self._allowed(name, rows))}, at=self.store.version)
