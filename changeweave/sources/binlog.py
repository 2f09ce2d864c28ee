"""Row and query events of a MySQL binary log, decoded to changes.

Row events are rows: ``file``, ``offset``, ``action`` (insert, update,
delete), ``table``, ``columns`` (names), ``key_columns`` (names) and ``rows``
(arrays of cells; an update has old and new rows in turns).  ``typed_rows``
makes them of rows whose values are texts, as the server sends them, by the
types of the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.position import binlog_position
from ..model import CELL, cell
from .dumps import is_ddl

ROWS = f"file string, offset bigint, action string, table string, columns array<string>, key_columns array<string>, rows array<array<{CELL.simpleString()}>>"


# Column types whose values are whole numbers (an enum or a set is its number), and floating ones.
WHOLE_TYPES = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "year", "bit", "enum", "set")
FLOAT_TYPES = ("float", "double", "real")
INSTANT_TYPES = ("datetime", "timestamp")
BOOL_TYPES = ("bool", "boolean")


def decode_cell(text: Column, column_type: Column, null_is_empty: bool = False) -> Column:
    """The cell of a MySQL value by the type of its column, as ``int unsigned`` or ``varchar(20)``.

    Whole numbers keep their 64 bits, so an unsigned one beyond 2^63 wraps.
    Instants come out in RFC 3339 without their fraction; zero dates stay text.
    Decimals, dates, times, JSON and everything else stay text, as does what
    does not read as its type.  NULL is the NULL cell, or with
    ``null_is_empty`` the empty text.
    """
    bare = F.lower(F.regexp_extract(column_type, r"^\s*([A-Za-z]+)", 1))
    wide = text.try_cast("decimal(20,0)")
    whole = F.when(wide > F.lit("9223372036854775807").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).try_cast("bigint")
    stamp = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(\.\d+)?$", 0)
    moment = F.when((stamp != "") & stamp.try_cast("timestamp").isNotNull(), F.concat(F.substr(stamp, F.lit(1), F.lit(10)), F.lit("T"), F.substr(stamp, F.lit(12), F.lit(8)), F.lit("Z")))
    truth = F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False)
    number = F.when(bare.isin(*FLOAT_TYPES), text.try_cast("double"))
    return (
        F.when(text.isNull(), cell(string_value=F.lit("")) if null_is_empty else cell())
        .when(bare.isin(*WHOLE_TYPES) & whole.isNotNull(), cell(int_value=whole))
        .when(number.isNotNull(), cell(float_value=number))
        .when(bare.isin(*BOOL_TYPES) & truth.isNotNull(), cell(bool_value=truth))
        .when(bare.isin(*INSTANT_TYPES) & moment.isNotNull(), cell(timestamp_value=moment))
        .otherwise(cell(string_value=text))
    )


def typed_rows(events: DataFrame, null_is_empty: bool = False) -> DataFrame:
    """Row events whose ``rows`` are arrays of texts, with ``column_types``, as ``binlog_changes`` takes them; values beyond the columns are left out."""
    typed = F.transform("rows", lambda row: F.filter(F.zip_with(row, "column_types", lambda v, t: F.when(t.isNotNull(), decode_cell(v, t, null_is_empty))), lambda c: c.isNotNull()))
    return events.withColumn("rows", typed).drop("column_types")


def format_position(file: Column, offset: Column) -> Column:
    return binlog_position(file, offset)


def parse_position(text: Column) -> Column:
    """Struct of file and offset; empty and ``bootstrap`` are the start (empty file, 0); NULL for other text."""
    at = F.regexp_extract(text, r"^(.+):(\d+)$", 2)
    start = F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("offset"))
    return F.when(text.isin("", "bootstrap"), start).when(at != "", F.struct(F.regexp_extract(text, r"^(.+):(\d+)$", 1).alias("file"), at.try_cast("bigint").alias("offset")))


def binlog_changes(events: DataFrame) -> DataFrame:
    """position, row_no, type, dml of every row of every event.

    All rows of an event share its position; ``row_no`` counts them.  An
    update lists all columns but the key, and key columns that changed; its
    old keys come from the old row.  The last row of an odd number of rows is
    skipped.
    """
    n = F.size("rows")
    pairs = F.when(F.col("action") == "update", F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda i: F.struct(F.get("rows", i * 2).alias("old"), F.get("rows", i * 2 + 1).alias("new"))))
    single = F.transform("rows", lambda r: F.struct(F.when(F.col("action") == "delete", r).alias("old"), F.when(F.col("action") == "insert", r).alias("new")))
    some = events.where((n > 0) & ((F.col("action") != "update") | (n > 1)))
    spread = some.select("file", "offset", "action", "table", "columns", "key_columns", F.posexplode(F.when(F.col("action") == "update", pairs).otherwise(single)).alias("row_no", "row"))
    is_key = lambda name: F.array_contains("key_columns", name)

    def side(row: Column) -> Column:
        return F.zip_with("columns", row, lambda c, v: F.struct(c.alias("name"), v.alias("value")))

    new, old = side(F.col("row.new")), side(F.col("row.old"))
    both = F.filter(F.zip_with(new, old, lambda a, b: F.struct(a["name"].alias("name"), a["value"].alias("value"), b["value"].alias("old"))), lambda x: ~is_key(x["name"]) | ~x["value"].eqNullSafe(x["old"]))
    listed_names = F.when(F.col("action") == "insert", F.col("columns")).when(F.col("action") == "update", F.transform(both, lambda x: x["name"])).otherwise(F.array().cast("array<string>"))
    cells = F.array().cast(f"array<{CELL.simpleString()}>")
    listed_values = F.when(F.col("action") == "insert", F.transform(new, lambda x: x["value"])).when(F.col("action") == "update", F.transform(both, lambda x: x["value"])).otherwise(cells)
    keys = F.filter(old, lambda x: is_key(x["name"]))
    old_keys = F.when(F.col("action") != "insert", F.struct(F.transform(keys, lambda x: x["name"]).alias("key_names"), F.transform(keys, lambda x: x["value"]).alias("key_values")))
    dml = F.struct(F.col("table"), listed_names.alias("column_names"), listed_values.alias("column_values"), F.col("action").alias("kind"), old_keys.alias("old_keys"))
    return spread.select(format_position(F.col("file"), F.col("offset")).alias("position"), "row_no", F.lit("dml").alias("type"), dml.alias("dml"))


def query_changes(queries: DataFrame) -> DataFrame:
    """Schema changes among query events (file, offset, epoch_seconds, schema, query)."""
    stamp = F.date_format(F.timestamp_seconds("epoch_seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ddl = F.struct(F.lit(0).alias("id"), stamp.alias("time"), F.lit("").alias("username"), F.col("schema").alias("database"), F.col("query").alias("ddl"))
    return queries.where(is_ddl(F.col("query"))).select(format_position(F.col("file"), F.col("offset")).alias("position"), F.lit("ddl").alias("type"), ddl.alias("ddl"))
