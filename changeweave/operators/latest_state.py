"""Typed state of one table from its changes, without sorting whole keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_rows(changes: DataFrame, key: list[str], columns: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """State of a table whose changes are typed columns, with ``present`` (names that a change sets).

    Each column has its last value set since the row's last insert; NULL where
    it was set to NULL.  Rows whose last insert a delete follows are gone.
    Everything is a map-side combining maximum by key, so a hot key costs no
    task more than its share: the first pass finds each key's last delete, the
    second each column's last value after it.
    """
    seq = F.struct(*order)
    gone = changes.where(F.col(kind) == "delete").groupBy(*key).agg(F.max(seq).alias("__gone"))
    live = changes.where(F.col(kind) != "delete").join(gone, key, "left").where(F.col("__gone").isNull() | (seq > F.col("__gone"))).drop("__gone")
    births = live.where(F.col(kind) == "insert").groupBy(*key).agg(F.min(seq).alias("__born"))
    since = live.join(births, key).where((seq == F.col("__born")) | ((F.col(kind) == "update") & (seq > F.col("__born"))))
    values = [F.max(F.when(F.array_contains("present", c), F.struct(seq.alias("at"), F.col(c).alias("value")))).alias(c) for c in columns]
    return since.groupBy(*key).agg(*values).select(*key, *[F.col(f"`{c}`.value").alias(c) for c in columns])


def rows_after(rows: DataFrame, changes: DataFrame, key: list[str], columns: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """State of a table that had ``rows`` (one per key) before all ``changes``."""
    types = {f.name: f.dataType for f in changes.schema.fields}
    before = rows.select(*key, *[F.col(f"`{c}`") for c in columns], *[F.lit(None).cast(types[o]).alias(o) for o in order], F.lit("insert").alias(kind), F.array(*[F.lit(c) for c in columns]).alias("present"))
    # NULL sorts before everything, so the rows are older than every change.
    return latest_rows(before.unionByName(changes.select(*before.columns)), key, columns, order, kind)
