"""What a user may see and write: a tenant and some of its projects."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    tenant_id: int | None
    project_ids: tuple[int, ...] = ()
    user_id: str = ""

    @property
    def primary(self) -> int:
        """The project that is written to: the first."""
        if not self.project_ids:
            raise ValueError("no project in scope")
        return self.project_ids[0]


def scope_predicate(scope: Scope) -> Column:
    """Tenant and projects; no project, no row."""
    return (F.col("tenant_id") == F.lit(scope.tenant_id)) & F.col("project_id").isin(list(scope.project_ids))


def visibility_predicate(scope: Scope) -> Column:
    """As scope_predicate, but without projects all of the tenant's are visible; without tenant nothing is."""
    if scope.tenant_id is None:
        return F.lit(False)
    tenant = F.col("tenant_id") == F.lit(scope.tenant_id)
    return tenant & F.col("project_id").isin(list(scope.project_ids)) if scope.project_ids else tenant


def scoped(df: DataFrame, scope: Scope, rls: bool = False) -> DataFrame:
    return df.where(visibility_predicate(scope) if rls else scope_predicate(scope))


def write_check(df: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written, and the others."""
    allowed = F.coalesce(visibility_predicate(scope), F.lit(False))
    return df.where(allowed), df.where(~allowed)


def user_scopes(roles: DataFrame) -> DataFrame:
    """user_id, n_tenants, status: ok, or why a user has no scope, and the projects in the order of their roles."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "project_id"))), lambda x: x["project_id"])
    by_user = roles.groupBy("user_id").agg(F.count_distinct("tenant_id").alias("n_tenants"), F.min("tenant_id").alias("tenant_id"), ordered.alias("projects"))
    return by_user.select("user_id", "n_tenants", F.when(F.col("n_tenants") == 1, "ok").otherwise("several tenants").alias("status"), "tenant_id", "projects")


def scope_of(roles: DataFrame, user_id: str) -> Scope:
    """The scope of one user; fails without roles and with more than one tenant."""
    row = user_scopes(roles.where(F.col("user_id") == user_id)).first()
    if row is None:
        raise PermissionError(f"{user_id} has no role")
    if row["n_tenants"] != 1:
        raise ValueError(f"{user_id} has roles in {row['n_tenants']} tenants")
    return Scope(row["tenant_id"], tuple(row["projects"]), user_id)


def projects_csv(roles: DataFrame) -> DataFrame:
    """user_id and its distinct projects, ascending, joined by commas."""
    ids = F.transform(F.array_sort(F.collect_set("project_id")), lambda x: x.cast("string"))
    return roles.groupBy("user_id").agg(F.array_join(ids, ",").alias("project_ids"))


def in_csv(csv: Column, value: Column) -> Column:
    """Whether value is one of the integers of a list joined by commas."""
    return F.array_contains(F.transform(F.split(csv, ","), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("long")), value.cast("long"))


def csv_rows(users: DataFrame, column: str = "project_ids", name: str = "project_id") -> DataFrame:
    """A row for each integer of a list joined by commas, so that a join on it is one of equal keys."""
    ids = F.transform(F.split(column, ","), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("long"))
    return users.withColumn(name, F.explode(F.array_distinct(ids))).where(F.col(name).isNotNull())


def requested(scope: Scope, ids: Iterable[int]) -> list[int]:
    """Of the requested projects those in scope, in the order of the request."""
    allowed = set(scope.project_ids)
    return [i for i in ids if i in allowed]
