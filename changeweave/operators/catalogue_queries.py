"""Relational queries that accompany replication: catalogue joins, high-water marks, lookups, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def owned_sequences(classes: DataFrame, depends: DataFrame, attributes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Sequences with the table and column that own them: sequence, schema, table, column.

    ``classes`` (oid, relname, relkind, relnamespace), ``depends`` (objid,
    refobjid, refobjsubid, deptype), ``attributes`` (attrelid, attnum,
    attname), ``namespaces`` (oid, nspname).
    """
    s = classes.where("relkind = 'S'").select(F.col("oid").alias("objid"), F.col("relname").alias("sequence"))
    t = classes.where("relkind = 'r'").select(F.col("oid").alias("refobjid"), F.col("relname").alias("table"), "relnamespace")
    d = depends.where("deptype = 'a'")
    a = attributes.select(F.col("attrelid").alias("refobjid"), F.col("attnum").alias("refobjsubid"), F.col("attname").alias("column"))
    n = namespaces.select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema"))
    return s.join(d, "objid").join(t, "refobjid").join(a, ["refobjid", "refobjsubid"]).join(n, "relnamespace").select("sequence", "schema", "table", "column")


def auto_increment_columns(tables: DataFrame, columns: DataFrame, system: tuple[str, ...] = ("mysql", "information_schema", "performance_schema", "sys")) -> DataFrame:
    """Columns that count themselves up: table_schema, table_name, column_name."""
    counted = columns.where(F.lower("extra").like("%auto_increment%")).select("table_schema", "table_name", "column_name")
    return tables.where((F.col("table_type") == "BASE TABLE") & ~F.col("table_schema").isin(*system)).select("table_schema", "table_name").join(counted, ["table_schema", "table_name"])


def user_table_count(tables: DataFrame, system: tuple[str, ...] = ("pg_catalog", "information_schema")) -> DataFrame:
    return tables.where((F.col("table_type") == "BASE TABLE") & ~F.col("table_schema").isin(*system)).agg(F.count("*").alias("tables"))


def high_water_mark(rows: DataFrame, column: str, dialect: str = "postgresql") -> DataFrame:
    """Next value of a sequence: the greatest value (1 if none); in mysql one more (1 if none)."""
    most = F.max(column)
    value = F.coalesce(most, F.lit(0)) + 1 if dialect == "mysql" else F.coalesce(most, F.lit(1))
    return rows.agg(value.cast("bigint").alias("next_value"))


def setval_statement(sequence: str, rows: DataFrame, column: str) -> DataFrame:
    return high_water_mark(rows, column).select(F.format_string("SELECT setval('%s', %d);", F.lit(sequence.replace("'", "''")), F.col("next_value")).alias("sql"))


def exists(rows: DataFrame) -> DataFrame:
    """One row that says whether there are any; the scan stops at the first."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def top_rows(rows: DataFrame, columns: list[str], key: str, n: int = 5) -> DataFrame:
    """The first rows by key, of these columns only."""
    return rows.select(*columns).orderBy(key).limit(n)
