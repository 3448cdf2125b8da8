"""Relational state: lookups, listings, patches, guards, replaced children and merged lists, as DataFrames.

State tables are append-only: an update is a new row, and the latest row of a key wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order; partial aggregation does most of it before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in rest))


def lookup(rows: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns have these values; deleted rows are seen."""
    for column, value in values.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def lookup_ignoring_case(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.where(F.lower(column) == value.lower())


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("deleted_at").isNull())


def with_child_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """The number of children of each parent, 0 where it has none; children are counted before the join."""
    counts = children.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return parents.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page; number is 1 at least, size 100 at most. The order should end in a unique column."""
    size = min(100, size) if size > 0 else 10
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def list_projects(projects: DataFrame, users: DataFrame, files: DataFrame, number: int, size: int) -> DataFrame:
    """A page of live projects, newest first, with owner and number of files. Only the page is joined."""
    rows = page(live(projects), number, size, F.desc("created_at"), F.desc("id"))
    owners = users.select(F.col("id").alias("user_id"), F.col("username"))
    rows = rows.join(owners, "user_id", "left").withColumn("username", F.coalesce("username", F.lit("")))
    wanted = files.join(F.broadcast(rows.select(F.col("id").alias("project_id"))), "project_id", "left_semi")  # 100 rows at most
    return with_child_count(rows, wanted, "project_id", "file_count")


def unapplied(wanted: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    return wanted.join(applied.select(key).distinct(), key, "left_anti")


def keep_last_per_key(rows: DataFrame, scope: list[str], key: str, order: str) -> DataFrame:
    """Of rows with one key the last stays, at the place of the first."""
    by = Window.partitionBy(*scope, key)
    out = rows.withColumn("place", F.min(order).over(by)).withColumn("newest", F.max(order).over(by))
    return out.where(F.col(order) == F.col("newest")).drop("newest")


def merge_by_key(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer merge: fields of new win where they are not null."""
    a = old.select(*key, *(F.col(c).alias(f"old_{c}") for c in values))
    b = new.select(*key, *(F.col(c).alias(f"new_{c}") for c in values))
    return a.join(b, key, "full").select(*key, *(F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in values))


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the keys in new are replaced by new."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_types(rows: DataFrame, column: str, denied: list[str]) -> DataFrame:
    return rows.where(~F.col(column).isin(denied) | F.col(column).isNull())


def first_available(rows: DataFrame, key: str, column: str, priorities: list[str], payload: str) -> DataFrame:
    """For each key the row whose type comes first in the list; keys without any are left out."""
    rank = F.coalesce(*(F.when(F.col(column) == p, F.lit(i)) for i, p in enumerate(priorities)))
    ranked = rows.withColumn("rank", rank).where(F.col("rank").isNotNull())
    return ranked.groupBy(key).agg(F.min_by(F.struct(F.col(column).alias("type"), F.col(payload).alias("payload")), F.struct("rank", payload)).alias("b")).select(key, F.col("b.type").alias("type"), F.col("b.payload").alias(payload))


def deliver(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events for each subscriber of their project, or of all projects (project_id is null).

    Two equality joins: one by project, one by the constant key of the wildcard. The list of subscribers
    without a project is the fan-out that the wildcard asks for.
    """
    named = events.join(subscriptions.where("project_id IS NOT NULL"), "project_id")
    every = subscriptions.where("project_id IS NULL").select("subscriber", F.lit(1).alias("k"))
    return named.unionByName(events.withColumn("k", F.lit(1)).join(every, "k").drop("k").select(named.columns))


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets columns from changes where there is a row; an empty text clears a column."""
    c = changes.select(key, *(F.col(x).alias(f"new_{x}") for x in columns), F.lit(True).alias("hit"))
    out = rows.join(c, key, "left")
    for x in columns:
        out = out.withColumn(x, F.when(F.col("hit"), F.nullif(F.coalesce(F.col(f"new_{x}"), F.col(x)), F.lit(""))).otherwise(F.col(x)))
    return out.select(rows.columns)


def soft_delete(rows: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Marks live rows; a row that is deleted already stays as it is."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return rows.join(hit, "id", "left").withColumn("deleted_at", F.when(F.col("hit") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("hit")


def guarded(rows: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each row with the actions that its status allows, by a join with the transition table."""
    return rows.join(F.broadcast(transitions), "status")  # a fixed table


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def cascade(rows: DataFrame, changed: DataFrame, depends: DataFrame) -> DataFrame:
    """Rows that stay when inputs change: those of no type that depends on a changed one of their project.

    rows(project_id, type), changed(project_id, type), depends(type, on): depends is a fixed table.
    """
    gone = changed.withColumnRenamed("type", "on").join(F.broadcast(depends), "on").select("project_id", "type").distinct()
    return rows.join(gone, ["project_id", "type"], "left_anti")


def suggested(codes: DataFrame, actions: DataFrame) -> DataFrame:
    """Distinct actions for the codes, in the order of the action table."""
    return actions.join(codes.select("code").distinct(), "code", "left_semi").orderBy("ordinal")
