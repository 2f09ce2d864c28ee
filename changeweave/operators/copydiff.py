"""Differences between two copies of data, row by row and cell by cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import joined_key, plain_table, with_key_parts
from ..storage import written
from .instants import instant_micros

#: Bytes of cells per hash bucket that the number of buckets aims at.
BUCKET_BYTES = 64 << 20
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"
_DATELIKE = r"^\s*\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}.*)?$"


def canonical_number(text: Column) -> Column:
    """One spelling per number: exact up to 26 digits before and 12 after the point, else that of the nearest double."""
    exact = text.try_cast("decimal(38,12)")
    back = exact.cast("double") == text.try_cast("double")
    return F.when(exact.isNotNull() & back, F.regexp_replace(exact.cast("string"), r"\.?0+$", "")).otherwise(text.try_cast("double").cast("string"))


def canonical_cell(value: Column) -> Column:
    """Text that is equal for two cells exactly if both denote the same number, truth value or instant, or are the same text; NULL for NULL.

    Truth values count as the numbers 1 and 0, so that 1, true and t agree.
    Readings without zone are in UTC.
    """
    text = value.getField("string_value")
    stamp = value.getField("timestamp_value")
    lower = F.lower(text)
    dated = F.coalesce(stamp, F.when(text.rlike(_DATELIKE), text))
    micros = instant_micros(dated, F.lit(0), F.lit(False), ["UTC"])
    whole = value.getField("int_value")
    number = F.coalesce(value.getField("float_value").cast("string"), F.when(text.rlike(_NUMBER), text))
    truth = F.coalesce(value.getField("bool_value"), F.when(lower.isin("t", "true"), True).when(lower.isin("f", "false"), False))
    return (
        F.when(whole.isNotNull(), F.concat(F.lit("#"), whole.cast("string")))
        .when(truth.isNotNull(), F.when(truth, "#1").otherwise("#0"))
        .when(number.isNotNull(), F.concat(F.lit("#"), canonical_number(number)))
        .when(dated.isNotNull(), F.coalesce(F.concat(F.lit("@"), micros.cast("string")), F.concat(F.lit("="), dated)))
        .when(text.isNotNull(), F.concat(F.lit("="), text))
    )


def _key_text(value: Column) -> Column:
    return F.coalesce(value["string_value"], value["int_value"].cast("string"), canonical_number(value["float_value"].cast("string")), value["bool_value"].cast("string"), value["timestamp_value"])


def cells_by_row(copies: DataFrame) -> DataFrame:
    """Of every table, key and side the cells that are not NULL, in canonical form: one row per cell.

    A row kept several times on one side counts once, as read last; which
    copy that is, is found by a map-side combining maximum, before the cells
    are spread.
    """
    slim = copies.select((F.col("held_by") == "primary").alias("primary"), "dml_table", "read_at", "copy_row_id", "column_names", "column_values")
    keyed = with_key_parts(slim, _key_text, {"own": ("column_names", "column_values")})
    rows = keyed.select("primary", plain_table(F.col("dml_table")).alias("dml_table"), joined_key(F.col("key_own")).alias("row_key"), "read_at", "copy_row_id", "column_names", "column_values").where("primary is not null and row_key is not null")
    latest = rows.groupBy("primary", "dml_table", "row_key").agg(F.max(F.struct("read_at", "copy_row_id", "column_names", "column_values")).alias("last"))
    spread = latest.select("primary", "dml_table", "row_key", "last.column_names", F.posexplode(F.arrays_zip("last.column_names", "last.column_values")).alias("place", "cell"))
    first = F.array_position("column_names", F.col("cell.column_names")) == F.col("place") + 1
    return spread.where(first).select("primary", "dml_table", "row_key", F.col("cell.column_names").alias("column_name"), canonical_cell(F.col("cell.column_values")).alias("text")).where("text is not null")


_EMPTY = pa.schema([(n, pa.string()) for n in ("dml_table", "row_key", "column_name", "text")]).empty_table()


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Differences of one bucket: primary cells on the left, replica cells on the right."""

    # The side that a bucket lacks comes without its columns.
    left, right = (t if "row_key" in t.column_names else _EMPTY for t in (left, right))

    def codes(name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        both = pa.chunked_array([*left[name].chunks, *right[name].chunks], type=pa.string()).combine_chunks().dictionary_encode()
        both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
        index = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return index[: left.num_rows], index[left.num_rows :], both.dictionary

    lt, rt, tables = codes("dml_table")
    lk, rk, keys = codes("row_key")
    lc, rc, columns = codes("column_name")
    lv, rv, _ = codes("text")
    n_keys, n_columns = len(keys) + 1, len(columns) + 1
    left_row, right_row = lt * n_keys + lk, rt * n_keys + rk
    rows_left, rows_right = np.unique(left_row), np.unique(right_row)

    def within(wanted: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each wanted key in the sorted keys, and whether it is there."""
        at = np.searchsorted(among, wanted)
        at_safe = np.minimum(at, max(len(among) - 1, 0))
        return at_safe, (among[at_safe] == wanted) if len(among) else np.zeros(len(wanted), bool)

    lost = rows_left[~within(rows_left, rows_right)[1]]
    extra = rows_right[~within(rows_right, rows_left)[1]]
    left_shared, right_shared = within(left_row, rows_right)[1], within(right_row, rows_left)[1]
    left_cell, right_cell = (left_row * n_columns + lc)[left_shared], (right_row * n_columns + rc)[right_shared]
    left_value, right_value = lv[left_shared], rv[right_shared]
    a, b = np.argsort(left_cell, kind="stable"), np.argsort(right_cell, kind="stable")
    left_cell, left_value, right_cell, right_value = left_cell[a], left_value[a], right_cell[b], right_value[b]
    cells = np.union1d(left_cell, right_cell)
    (at_left, has_left), (at_right, has_right) = within(cells, left_cell), within(cells, right_cell)
    value_left = np.where(has_left, left_value[at_left] if len(left_value) else -1, -1)
    value_right = np.where(has_right, right_value[at_right] if len(right_value) else -1, -1)
    masked = cells[(has_left != has_right) | (value_left != value_right)]
    row = np.concatenate([lost, extra, masked // n_columns])
    column = np.concatenate([np.full(len(lost) + len(extra), -1, np.int64), masked % n_columns])
    kind = np.concatenate([np.full(len(lost), 0), np.full(len(extra), 1), np.full(len(masked), 2)])
    named = pc.if_else(pa.array(column >= 0), pc.take(columns, pa.array(np.maximum(column, 0))) if len(columns) else pa.nulls(len(column), pa.string()), "")
    return pa.table({"dml_table": pc.take(tables, pa.array(row // n_keys)), "row_key": pc.take(keys, pa.array(row % n_keys)), "column_name": named, "difference": pc.take(pa.array(["missing_in_replica", "missing_in_primary", "value"]), pa.array(kind))})


def copy_differences(copies: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """dml_table, row_key, column_name, difference between primary and replica.

    Canonical cells go by a hash of table and key into as many buckets as keep
    each near ``bucket_bytes``, whatever the width of the rows; the two sides of a bucket meet as Arrow
    tables, keys are aligned by sorted search and cells compared through masks.
    As each side has one row per key by then, no key makes a bucket large.

    Defined cases: a column that is not listed, or listed without value, is
    NULL; NULL and the empty string differ; rows without a key (or held by
    neither system) cannot be compared and give nothing; of a name listed
    twice in a row the first holds; repeated rows of one side count once, as
    read last; an empty side makes every row of the other missing.
    """
    cells = written(cells_by_row(copies), "cells", by="primary")
    # A cell is held with its table, key and name, and some bytes of overhead.
    size = cells.agg(F.sum(sum((F.octet_length(c) for c in ("dml_table", "row_key", "column_name", "text")), F.lit(32)))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("dml_table", "row_key"), F.lit(buckets)))
    left = cells.where("primary").drop("primary")
    # Columns of its own: a cogroup of two branches of one table else loses the values of the second.
    right = cells.where("not primary").select(*[F.col(c).alias(c) for c in left.columns])
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_compare, "dml_table string, row_key string, column_name string, difference string")


def row_differences(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Changed cells among ``columns`` of two typed tables: key, column_name, old_value, new_value.

    A row that only one side has comes out with all its columns, the other
    side's values NULL.  Rows with the same key on both sides are compared
    each with each, so keys should be unique; rows whose key is NULL have no
    partner.
    """
    side = lambda rows, mark: rows.select(F.col(key).alias("__key"), F.lit(True).alias(f"{mark}_there"), *[F.col(c).cast("string").alias(f"{mark}_{i}") for i, c in enumerate(columns)])
    both = side(left, "l").join(side(right, "r"), "__key", "full")
    one_sided = F.col("l_there").isNull() | F.col("r_there").isNull()
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"l_{i}").alias("old_value"), F.col(f"r_{i}").alias("new_value")) for i, c in enumerate(columns)])
    return both.select(F.col("__key").alias(key), F.explode(F.filter(cells, lambda x: one_sided | ~x["old_value"].eqNullSafe(x["new_value"]))).alias("cell")).select(key, "cell.*")
