"""The change-log data model: cells, changes and their Spark schemas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# One cell: at most one field is set; none set is SQL NULL.
CELL = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
        T.StructField("float_value", T.DoubleType()),
        T.StructField("bool_value", T.BooleanType()),
        T.StructField("timestamp_value", T.StringType()),
    ]
)

OLD_KEYS = T.StructType(
    [
        T.StructField("key_names", T.ArrayType(T.StringType())),
        T.StructField("key_values", T.ArrayType(CELL)),
    ]
)

DML = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("column_names", T.ArrayType(T.StringType())),
        T.StructField("column_values", T.ArrayType(CELL)),
        T.StructField("kind", T.StringType()),
        T.StructField("old_keys", OLD_KEYS),
    ]
)

DDL = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("time", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("ddl", T.StringType()),
    ]
)

CHANGE = T.StructType(
    [
        T.StructField("position", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("dml", DML),
        T.StructField("ddl", DDL),
    ]
)

_FIELDS = ("string_value", "int_value", "float_value", "bool_value", "timestamp_value")


def cell(**given: Column) -> Column:
    """A cell with the one given field; ``cell()`` is the NULL cell."""
    kinds = {f.name: f.dataType.simpleString() for f in CELL.fields}
    return F.struct(*[given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in _FIELDS])


def tag(value: Column) -> Column:
    """Name of the set field of a cell: string, int, float, bool, timestamp or NULL."""
    return F.coalesce(*[F.when(value.getField(n).isNotNull(), F.lit(n[:-6])) for n in _FIELDS])


def plain_text(value: Column) -> Column:
    """The cell's value as text, however it is tagged; NULL for the NULL cell."""
    return F.coalesce(*[value.getField(n).cast("string") for n in _FIELDS])
