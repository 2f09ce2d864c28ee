"""References to records that do not exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import written


@dataclass(frozen=True)
class Reference:
    table: str
    field: str
    target: str


# The references of the synthetic schema.
REFERENCES = (
    Reference("users", "organization_id", "organizations"),
    Reference("subscriptions", "organization_id", "organizations"),
    Reference("credit_cards", "organization_id", "organizations"),
    Reference("organizations", "owner_id", "users"),
)


def canonical_uuid(text: Column) -> Column:
    """A uuid in lower case with hyphens, from any spelling PostgreSQL takes; other text trimmed and in lower case; blank is NULL."""
    bare = F.lower(F.trim(F.translate(text, "\t\n\r", "   ")))
    digits = F.regexp_replace(bare, r"[{}-]", "")
    spelt = bare.rlike(r"^(\{[0-9a-f]{4}(-?[0-9a-f]{4}){7}\}|[0-9a-f]{4}(-?[0-9a-f]{4}){7})$")
    joined = F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.substring(digits, 13, 4), F.substring(digits, 17, 4), F.substring(digits, 21, 12))
    return F.when(bare == "", None).when(spelt, joined).otherwise(bare)


def holding_versions(records: DataFrame, fields: list[str]) -> DataFrame:
    """Of each record the version with the latest updated_at, then loaded_at; with ``first_loaded``, the earliest loaded_at of all versions.

    Ties that remain are broken by the fields themselves.  Records without an
    id are left out.
    """
    slim = records.select(canonical_uuid(F.col("id")).alias("record_id"), "created_at", "updated_at", "loaded_at", *[canonical_uuid(F.col(f)).alias(f) for f in fields])
    best = F.max(F.struct("updated_at", "loaded_at", "created_at", *fields)).alias("best")
    held = slim.where("record_id is not null").groupBy("record_id").agg(best, F.min("loaded_at").alias("first_loaded"))
    return held.select("record_id", "first_loaded", "best.created_at", "best.loaded_at", *[f"best.{f}" for f in fields])


def orphan_references(tables: dict[str, DataFrame], removals: DataFrame, references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """table_name, record_id, field_name, period, reason of each reference to a record that is missing, deleted or late.

    Parents and references are united in long form and grouped by parent table
    and key, which combines map-side: of each key it is known whether it has a
    parent, whether that is removed and when it was first loaded.  Keys whose
    group has no live parent, or one loaded later than some reference to it,
    are joined back to the references; the join splits skewed keys (AQE), and
    the side per key is one row, so that a parent that holds a third of all
    references costs no task more than its share.

    Defined cases: NULL or blank references and references of removed records
    are none; text that is no uuid is compared as it stands; a NULL created_at
    gives a NULL period and such a record cannot be removed; a parent or
    reference without loaded_at is never late, but may be missing or deleted.
    """
    names = sorted({r.table for r in references} | {r.target for r in references})
    removed = removals.select(F.trim(F.col("table_name")).alias("table_name"), canonical_uuid(F.col("record_id")).alias("record_id"), "removed_at").groupBy("table_name", "record_id").agg(F.max("removed_at").alias("removed_at"))
    # The records of all tables, one row per record and reference (records without one have a NULL field).
    held = None
    for name in names:
        own = [r for r in references if r.table == name]
        versions = holding_versions(tables[name], sorted({r.field for r in own}))
        kinds = [F.struct(F.lit(r.field).alias("field_name"), F.lit(r.target).alias("target"), F.col(r.field).alias("key")) for r in own] or [F.struct(F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("key"))]
        part = versions.select(F.lit(name).alias("table_name"), "record_id", "first_loaded", "created_at", "loaded_at", F.explode(F.array(*kinds)).alias("r")).select("table_name", "record_id", "first_loaded", "created_at", "loaded_at", "r.*")
        held = part if held is None else held.unionByName(part)
    held = written(held.join(removed, ["table_name", "record_id"], "left").withColumn("is_removed", F.coalesce(F.col("removed_at") >= F.col("created_at"), F.lit(False))).drop("removed_at"), "records")
    children = held.where("not is_removed and key is not null").select("table_name", "record_id", "field_name", "target", "key", F.date_format("created_at", "yyyy-MM").alias("period"), "loaded_at")
    parents = held.where(F.col("table_name").isin(*{r.target for r in references}))
    long = parents.select(F.col("table_name").alias("target"), F.col("record_id").alias("key"), F.lit(1).alias("has_parent"), F.lit(0).alias("has_reference"), F.col("is_removed").cast("int").alias("gone"), F.to_date("first_loaded").alias("first_day"), F.lit(None).cast("date").alias("reference_day"))
    tagged = children.select("target", "key", F.lit(0).alias("has_parent"), F.lit(1).alias("has_reference"), F.lit(0).alias("gone"), F.lit(None).cast("date").alias("first_day"), F.to_date("loaded_at").alias("reference_day"))
    status = long.unionByName(tagged).groupBy("target", "key").agg(F.max("has_parent").alias("has_parent"), F.max("has_reference").alias("has_reference"), F.max("gone").alias("gone"), F.max("first_day").alias("first_day"), F.min("reference_day").alias("reference_day"))
    suspect = status.where("has_reference = 1").where("has_parent = 0 or gone = 1 or first_day > reference_day").drop("reference_day", "has_reference")
    reason = F.when(F.col("has_parent") == 0, "missing").when(F.col("gone") == 1, "deleted").when(F.col("first_day") > F.to_date("loaded_at"), "late")
    return children.join(suspect, ["target", "key"]).withColumn("reason", reason).where("reason is not null").select("table_name", "record_id", "field_name", "period", "reason")


def orphan_counts(found: DataFrame) -> DataFrame:
    """The orphans summed by table, field, period and reason."""
    return found.groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("orphans"))
