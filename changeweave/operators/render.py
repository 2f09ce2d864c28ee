"""Changes as SQL statements of either dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dialect import literal
from ..model import cell


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def render_dml(dml: Column, dialect: str = "postgresql") -> Column:
    """Struct of ``sql`` and ``error`` for a row change; identifiers are not quoted.

    Errors: a kind other than insert, update and delete in lower case, numbers
    of names and values that differ, an update or delete without keys, a
    timestamp that is none, and (unlike the statements they would give) an
    update that sets nothing and a NULL key.
    """
    names, values, keys = dml["column_names"], dml["column_values"], dml["old_keys"]
    key_names, key_values = keys["key_names"], keys["key_values"]
    texts = F.transform(values, lambda v: literal(v, dialect))
    key_texts = F.transform(key_values, lambda v: literal(v, dialect))
    sets = F.array_join(F.zip_with(names, texts, lambda n, t: F.concat(n, F.lit(" = "), t)), ", ")
    where = F.array_join(F.zip_with(key_names, key_texts, lambda n, t: F.concat(n, F.lit(" = "), t)), " AND ")
    kind, table = dml["kind"], dml["table"]
    error = (
        F.when(dml.isNull() | table.isNull(), "no data")
        .when(~F.coalesce(kind.isin("insert", "update", "delete"), F.lit(False)), F.concat(F.lit("unsupported kind: "), F.coalesce(kind, F.lit("NULL"))))
        .when((kind != "delete") & (_size(names) != _size(values)), "numbers of names and values differ")
        .when((kind != "insert") & (_size(key_names) == 0), F.concat(kind, F.lit(" without keys")))
        .when((kind != "insert") & (_size(key_names) != _size(key_values)), "numbers of key names and values differ")
        .when((kind != "delete") & F.exists(texts, lambda t: t.isNull()) | (kind != "insert") & F.exists(key_texts, lambda t: t.isNull()), "invalid timestamp")
        .when((kind == "update") & (_size(names) == 0), "update sets nothing")
        .when((kind != "insert") & F.exists(key_texts, lambda t: t == "NULL"), "NULL key")
    )
    sql = (
        F.when(kind == "insert", F.concat(F.lit("INSERT INTO "), table, F.lit(" ("), F.array_join(names, ", "), F.lit(") VALUES ("), F.array_join(texts, ", "), F.lit(");")))
        .when(kind == "update", F.concat(F.lit("UPDATE "), table, F.lit(" SET "), sets, F.lit(" WHERE "), where, F.lit(";")))
        .when(kind == "delete", F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), where, F.lit(";")))
    )
    return F.struct(F.when(error.isNull(), sql).alias("sql"), error.alias("error"))


def render_changes(changes: DataFrame, dialect: str = "postgresql") -> DataFrame:
    """Changes with columns ``sql`` and ``error``; schema changes are their own text."""
    made = render_dml(F.col("dml"), dialect)
    row, ddl = F.col("type") == "dml", F.col("type") == "ddl"
    sql = F.when(row, made["sql"]).when(ddl, F.col("ddl.ddl"))
    error = F.when(row, made["error"]).when(ddl, F.when(F.col("ddl.ddl").isNull(), "no data")).otherwise("unknown type of change")
    return changes.withColumn("sql", sql).withColumn("error", error)


def patch_change(table: str, keys: dict[str, Column], values: dict[str, Column], given: Column | None = None, now: Column | None = None, touched: str = "updated_at") -> Column:
    """The change that patches a row: an update of the given columns, and of ``touched`` to ``now``.

    ``keys`` and ``values`` are cells.  ``given`` is a list of the names that
    are to be set, row by row (NULL or absent: all of ``values``); names that
    ``values`` does not have are ignored.  A patch that sets nothing is NULL.
    """
    listed = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    chosen = listed if given is None else F.filter(listed, lambda x: given.isNull() | F.array_contains(given, x["name"]))
    also = F.array(F.struct(F.lit(touched).alias("name"), cell(timestamp_value=F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("value"))) if now is not None else None
    every = chosen if also is None else F.concat(chosen, also)
    old = F.struct(F.array(*[F.lit(n) for n in keys]).alias("key_names"), F.array(*keys.values()).alias("key_values"))
    made = F.struct(F.lit(table).alias("table"), F.transform(every, lambda x: x["name"]).alias("column_names"), F.transform(every, lambda x: x["value"]).alias("column_values"), F.lit("update").alias("kind"), old.alias("old_keys"))
    return F.when(F.size(chosen) > 0, made)
