"""Upserts and replacements without a table format: each returns the new state of a table.

Write the result to a new path and swap; never overwrite what is being read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the last in the order (insert or replace)."""
    return _pick(df, keys, [c.desc() for c in order])


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order (insert or ignore)."""
    return _pick(df, keys, [c.asc() for c in order])


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def once(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first in the order, then by what the row says; rows without a key all stay."""
    named = keep_first(df.filter(F.col(key).isNotNull()), [key], *order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return named.unionByName(df.filter(F.col(key).isNull()))


def missing_fields(notes: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``missing``: which of the fields a note must have are null."""
    return notes.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])))


def declared_resources(notes: DataFrame, column: str = "resource_links") -> DataFrame:
    """``(note_id, resource_id)`` that notes declare, each once."""
    return notes.select(F.col("id").alias("note_id"), F.explode(column).alias("resource_id")).filter("resource_id is not null").distinct()


def rehearsed_resources(resources: DataFrame) -> DataFrame:
    """Stand-ins of resources for a dry run: ``(resource_id, id)``, the id made of the resource's."""
    return resources.select("resource_id").distinct().withColumn("id", F.concat(F.lit("dry-resource-"), "resource_id"))


def merge_upsert(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``updates``; ``updates`` has one row per key.  Applying it twice changes nothing."""
    return existing.join(updates.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(updates.select(*existing.columns))


def upsert_actions(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The updates with ``action``: 'inserted' or 'updated'."""
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    return updates.join(known, keys, "left").withColumn("action", F.when(F.col("_known"), "updated").otherwise("inserted")).drop("_known")


def insert_ignore(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with those rows whose key is new."""
    return existing.unionByName(rows.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def replace_where(existing: DataFrame, condition: Column, rows: DataFrame) -> DataFrame:
    """Rows that meet the condition replaced by others."""
    return existing.filter(~F.coalesce(condition, F.lit(False))).unionByName(rows.select(*existing.columns))


def of_note(note_id: str, source_type: str) -> Column:
    """The rows of a note and of its chunks."""
    return (F.col("source_type") == source_type) & ((F.col("source_id") == note_id) | F.col("source_id").startswith(note_id + "::chunk::"))


def update_column(existing: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` replaced by the value of ``new`` where that has one."""
    n = new.select(*keys, F.col(column).alias("_new"))
    return existing.join(n, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*existing.columns)


def touch(df: DataFrame) -> DataFrame:
    return df.withColumn("updated_at", F.current_timestamp())


def tags(notes: DataFrame) -> DataFrame:
    """``(note_id, tag)``: trimmed, not empty, each once."""
    t = notes.select(F.col("id").alias("note_id"), F.explode("tags").alias("t")).select("note_id", F.trim("t").alias("tag"))
    return t.filter("tag <> ''").distinct()


def ingestion_counts(notes: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """What an ingestion of notes would do: processed, skipped (blank), inserted, updated, tags and relations."""
    one = once(notes, "id")
    blank = F.coalesce(F.trim("body"), F.lit("")) == ""
    known = one.join(existing_ids.select(F.col("id"), F.lit(True).alias("_known")).distinct(), "id", "left")
    counts = known.agg(F.count(F.lit(1)).alias("processed"), F.count_if(blank).alias("skipped"), F.count_if(~blank & F.col("_known").isNull()).alias("inserted"), F.count_if(~blank & F.col("_known").isNotNull()).alias("updated"))
    rel = tags(one.filter(~blank)).agg(F.countDistinct("tag").alias("tags"), F.count(F.lit(1)).alias("relations"))
    return counts.crossJoin(rel)
