"""Mutations of a stored registry: each is one commit of a table in versions, and its events follow from what it changed.

Rows lie in buckets by ``checksum``; a mutation reads and rewrites the buckets that hold rows it changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import registry_ops as ops
from folio.sources import versions

KEY = "checksum"

#: the type of event that each kind of change of a table is told by
REGISTRY_EVENTS = {"insert": "DOCUMENTS_UPDATED", "update": "REGISTRY_UPDATED", "delete": "DOCUMENTS_UPDATED"}
TAXONOMY_EVENTS = dict.fromkeys(("insert", "update", "delete"), "CATEGORIES_UPDATED")
DECISION_EVENTS = dict.fromkeys(("insert", "update", "delete"), "DECISIONS_UPDATED")


def schema_string(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def insert(rows: DataFrame, path: str, schema: str, key: str = KEY, order: str = "id", attempts: int = 5) -> versions.State:
    """Rows whose key is new, each key once (the smallest ``order``'s); rows without a key are all new.

    Only the keys of the rows' own buckets are read; if another commit comes into one of them, it is done again.
    """
    spark = rows.sparkSession
    touched = {r["b"] for r in rows.select(versions.bucket_of(F.col(key)).alias("b")).distinct().collect()}
    for _ in range(attempts):
        state = versions.state_of(spark, path)
        known = versions.rows_of(spark, path, schema, state, touched).select(key)
        fresh = ops.first_of_key(rows.join(known, key, "left_anti"), key, order)
        name, buckets = versions.write_files(fresh.select(*(c.strip().split(" ")[0] for c in versions._top_level(schema))), path, key)
        try:
            return versions.commit(spark, path, state, {(name, b) for b in buckets}, touched=touched, note="insert")
        except versions.Conflict:
            versions.storage.delete(spark, f"{path}/commit={name}")
    raise versions.Conflict(path)


def patch(patches: DataFrame, path: str, schema: str, key: str = "id", bucket_key: str = KEY, **options) -> versions.State:
    """``registry_ops.patch`` on the stored rows; options as there."""
    touched = lambda table: table.join(patches.select(key), key, "left_semi")
    return versions.update(patches.sparkSession, path, schema, bucket_key, lambda table: ops.patch(table, patches, key, **options), touched, "patch")


def delete(keys: DataFrame, path: str, schema: str, key: str = "id", bucket_key: str = KEY) -> versions.State:
    touched = lambda table: table.join(keys.select(key), key, "left_semi")
    return versions.update(keys.sparkSession, path, schema, bucket_key, lambda table: ops.delete(table, keys, key), touched, "delete")


def rename_subcategory(mapping: DataFrame, path: str, schema: str, bucket_key: str = KEY) -> versions.State:
    """``registry_ops.rename_subcategory`` on the stored rows."""

    def touched(table: DataFrame) -> DataFrame:
        m = mapping.select(F.lower("category").alias("__c"), F.lower("old").alias("__o"))
        return table.join(m, (F.lower(table["category"]) == F.col("__c")) & (F.lower(table["subcategory"]) == F.col("__o")), "left_semi")

    return versions.update(mapping.sparkSession, path, schema, bucket_key, lambda table: ops.rename_subcategory(table, mapping), touched, "rename")


TAXONOMY = "category string, slug string, name string, aliases array<string>, entry string"


def add_entries(resolved: DataFrame, path: str) -> versions.State:
    """The entries that ``resolved(category, subcategory, path)`` proposes become entries of the stored taxonomy, once each."""
    new = ops.new_entries(resolved).select(
        "category", "slug", "name", F.array().cast("array<string>").alias("aliases"), F.concat_ws("/", "category", "slug").alias("entry")
    )
    return insert(new, path, TAXONOMY, "entry", "entry")


def events_between(
    spark: SparkSession, path: str, schema: str, since: int, until: int | None = None, kinds: dict[str, str] = REGISTRY_EVENTS, key: str = "id"
) -> DataFrame:
    """``type, change, key`` of every row that differs between two versions: what clients are told of the commits between them."""
    rows = versions.changes(spark, path, schema, since, until, key)
    kind: Callable = lambda c: F.coalesce(*(F.when(c == k, v) for k, v in kinds.items()))
    return rows.select(kind(F.col("change")).alias("type"), "change", F.col("key").cast("string").alias("key"))


HINTS = "id long, hint string, created_at timestamp"


def keep_hints(placed: DataFrame, path: str, at: Column) -> versions.State:
    """Rows of ``placed(id, category, slug, to_category, to_slug, hint)`` that a guard moved become hints that later prompts are given.

    A row without a hint keeps none; what was kept before stays.
    """
    text = F.concat_ws(" ", F.col("hint"), F.lit(":"), F.concat_ws("/", "category", "slug"), F.lit("->"), F.concat_ws("/", "to_category", "to_slug"))
    rows = placed.where("hint is not null").select(F.col("id").cast("long").alias("id"), text.alias("hint"), at.alias("created_at"))
    return versions.append(rows, path, "id", note="hints")
