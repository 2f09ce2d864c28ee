"""Logical-replication frames of PostgreSQL, decoded to changes.

Frames are rows: ``seq`` (order of arrival), ``frame`` (XLogData or other),
``lsn``, ``message`` (relation, insert, update, delete, begin, commit, ...),
``relation_id``, ``namespace``, ``name``, ``columns`` (name, oid, flags),
``new_tuple`` and ``old_tuple`` (texts in column order; NULL where absent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import CELL, cell

FRAME = (
    "seq bigint, frame string, lsn string, message string, relation_id int, namespace string, name string, "
    "columns array<struct<name:string,oid:int,flags:int>>, new_tuple array<string>, old_tuple array<string>"
)
#: At most so many descriptions of relations go to every executor; more are joined by a shuffle.
MAX_RELATIONS = 100_000
#: Table whose inserts are schema changes.
DDL_LOG_TABLE = "internal_ddl_log"
# Type numbers of the catalogue.
INT2, INT4, INT8, FLOAT4, FLOAT8, BOOL, TIMESTAMP, TIMESTAMPTZ, DATE = 21, 23, 20, 700, 701, 16, 1114, 1184, 1082
_CELLS = f"array<{CELL.simpleString()}>"


def decode_cell(text: Column, oid: Column) -> Column:
    """Struct of ``cell`` and ``error``: the text as the type of the number, NULL cell for an absent text.

    A NULL cell is a NULL, not the text of one; int2 is a number like the
    other integers.
    """
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    bits = F.when(oid == INT2, 16).when(oid == INT4, 32).otherwise(64)
    limit = F.when(bits == 16, 32767).when(bits == 32, 2147483647).otherwise(9223372036854775807).cast("bigint")
    ints = F.when((whole <= limit) & (whole >= -limit - 1), whole)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf(inity)?|nan)$"), text.try_cast("double"))
    number = F.when(oid == FLOAT4, number.cast("float").cast("double")).otherwise(number)
    truth = F.when(text.isin("t", "true", "1"), True).when(text.isin("f", "false", "0"), False)
    wall = F.substring(text, 1, 19)
    iso = F.replace(wall, F.lit(" "), F.lit("T"))
    zone = F.regexp_extract(text, r"([+-]\d{2})$", 1)
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$") & wall.try_cast("timestamp").isNotNull(), F.concat(iso, F.lit("Z")))
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}$") & wall.try_cast("timestamp").isNotNull(), F.concat(iso, F.when(zone.isin("+00", "-00"), "Z").otherwise(F.concat(zone, F.lit(":00")))))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), F.concat(text, F.lit("T00:00:00Z")))
    is_int, is_float, is_time = oid.isin(INT2, INT4, INT8), oid.isin(FLOAT4, FLOAT8), oid.isin(TIMESTAMP, TIMESTAMPTZ, DATE)
    stamp = F.when(oid == TIMESTAMP, plain).when(oid == TIMESTAMPTZ, zoned).when(oid == DATE, day)
    absent = text.isNull() | (text == "")
    made = cell(
        int_value=F.when(is_int & ~absent, ints), float_value=F.when(is_float & ~absent, number), bool_value=F.when((oid == BOOL) & ~absent, truth),
        timestamp_value=F.when(is_time & ~absent, stamp), string_value=F.when(~(is_int | is_float | is_time | (oid == BOOL)) & ~absent, text),
    )
    bad = ~absent & F.when(is_int, ints.isNull()).when(is_float, number.isNull()).when(oid == BOOL, truth.isNull()).when(is_time, stamp.isNull()).otherwise(False)
    return F.struct(made.alias("cell"), F.when(bad, F.concat(F.lit("invalid value: "), text)).alias("error"))


def _tuple(columns: Column, texts: Column) -> Column:
    """Columns beside their decoded texts, as far as both go."""
    n = F.least(F.size(columns), F.size(texts))
    return F.zip_with(F.slice(columns, F.lit(1), n), F.slice(texts, F.lit(1), n), lambda c, t: F.struct(c["name"].alias("name"), c["flags"].alias("flags"), t.alias("text"), decode_cell(t, c["oid"]).alias("value")))


def with_relations(frames: DataFrame) -> DataFrame:
    """Row messages beside the relation as last described before them; those of unknown relations have NULL ``relation``.

    Each description holds until the next of its relation, so the lookup is a
    join on relation and range, not a state passed from row to row.
    """
    data = frames.where("frame = 'XLogData'")
    relations = data.where("message = 'relation'").select("relation_id", F.col("seq").alias("since"), F.struct("namespace", "name", "columns").alias("relation"))
    held = relations.withColumn("until", F.lead("since").over(Window.partitionBy("relation_id").orderBy("since")))
    rows = data.where("message in ('insert', 'update', 'delete')").select("seq", "lsn", "message", "relation_id", "new_tuple", "old_tuple")
    held = held.withColumnRenamed("relation_id", "held_id")
    # Descriptions are few beside the rows, and a busy table is one key, so they go to every executor.
    if relations.limit(MAX_RELATIONS + 1).count() <= MAX_RELATIONS:
        held = F.broadcast(held)
    on = (F.col("relation_id") == F.col("held_id")) & (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq")))
    return rows.join(held, on, "left").select("seq", "lsn", "message", "new_tuple", "old_tuple", "relation")


def wal_changes(frames: DataFrame, ddl_table: str = DDL_LOG_TABLE, keys_like_reference: bool = False) -> DataFrame:
    """seq, position, type, dml, ddl, error of every row message, in the frames' order.

    Inserts into the DDL log are schema changes.  An update lists the columns
    that changed (all but the key if the old tuple is unknown); its old keys
    are those of the old tuple where it has them, else the new ones
    (``keys_like_reference``: always the new ones).  A delete has the key
    columns as old keys (``keys_like_reference``: all columns of the old tuple
    that are not NULL).  Begin, commit and other messages give nothing; a cell
    that cannot be decoded, or an unknown relation, gives an error.
    """
    known = with_relations(frames)
    new, old = _tuple(F.col("relation.columns"), F.coalesce("new_tuple", F.array().cast("array<string>"))), _tuple(F.col("relation.columns"), F.coalesce("old_tuple", F.array().cast("array<string>")))
    rows = known.withColumn("new", new).withColumn("old", old)
    first_error = F.get(F.filter(F.transform(F.concat("new", "old"), lambda x: x["value"]["error"]), lambda e: e.isNotNull()), F.lit(0))
    table = F.concat_ws(".", "relation.namespace", "relation.name")
    before = lambda name: F.get(F.filter(F.col("old"), lambda o: (o["name"] == name) & o["text"].isNotNull()), F.lit(0))
    is_key = lambda c: c["flags"] == 1
    without_old = F.col("old_tuple").isNull()
    listed = (
        F.when(F.col("message") == "insert", F.col("new"))
        .when(F.col("message") == "update", F.filter("new", lambda c: F.when(without_old, ~is_key(c)).otherwise(before(c["name"]).isNotNull() & ~before(c["name"])["text"].eqNullSafe(c["text"]))))
        .otherwise(F.filter("old", lambda c: F.lit(False)))
    )
    if keys_like_reference:
        update_keys, delete_keys = F.filter("new", is_key), F.filter("old", lambda c: c["text"].isNotNull())
    else:
        update_keys = F.transform(F.filter("new", is_key), lambda c: F.coalesce(before(c["name"]), c))
        delete_keys = F.filter("old", is_key)
    keys = F.when(F.col("message") == "update", update_keys).when(F.col("message") == "delete", delete_keys)
    names = lambda cs: F.transform(cs, lambda c: c["name"])
    values = lambda cs: F.transform(cs, lambda c: c["value"]["cell"])
    old_keys = F.when(F.col("message") != "insert", F.struct(names(keys).alias("key_names"), values(keys).alias("key_values")))
    is_ddl = (F.col("message") == "insert") & (F.col("relation.name") == ddl_table)
    named = lambda name: F.get(F.filter("new", lambda c: c["name"] == name), F.lit(0))["text"]
    ddl = F.when(is_ddl, F.struct(named("id").try_cast("int").alias("id"), F.coalesce(named("time"), named("ts")).alias("time"), named("username").alias("username"), named("database").alias("database"), named("ddl").alias("ddl")))
    dml = F.when(~is_ddl, F.struct(table.alias("table"), names(listed).alias("column_names"), values(listed).alias("column_values"), F.col("message").alias("kind"), old_keys.alias("old_keys")))
    error = F.when(F.col("relation").isNull(), "unknown relation").otherwise(first_error)
    return rows.select("seq", F.col("lsn").alias("position"), F.when(is_ddl, "ddl").otherwise("dml").alias("type"), F.when(error.isNull(), dml).alias("dml"), F.when(error.isNull(), ddl).alias("ddl"), error.alias("error"))
