"""Builders of small inputs."""

from __future__ import annotations

from datetime import datetime

CELL = "struct<string_value:string,int_value:bigint,float_value:double,bool_value:boolean,timestamp_value:string>"
LOG = f"delivery_id bigint, stream_id string, request_id bigint, received_at timestamp, change_position string, row_no int, change_type string, organization_id string, dml_table string, dml_kind string, column_names array<string>, column_values array<{CELL}>, old_key_names array<string>, old_key_values array<{CELL}>"
FILES = f"row_id bigint, file_id bigint, stream_id string, first_position string, file_received_at timestamp, dml_table string, column_names array<string>, column_values array<{CELL}>"
COPIES = f"copy_row_id bigint, held_by string, dml_table string, column_names array<string>, column_values array<{CELL}>, read_at timestamp"
DDL_LOG = "log_id bigint, stream_id string, change_position string, ddl_id int, ddl_time string, ddl_username string, ddl_database string, ddl_text string, logged_at timestamp"
SOURCES = "stream_id string, dialect string, database_name string, server_zone string, date_order string"


def cell(value=None, stamp=False):
    """A cell tagged by the Python type of its value."""
    row = dict.fromkeys(("string_value", "int_value", "float_value", "bool_value", "timestamp_value"))
    if value is not None:
        kind = "timestamp_value" if stamp else {bool: "bool_value", int: "int_value", float: "float_value", str: "string_value"}[type(value)]
        row[kind] = value
    return row


def change(number, position, kind, cells=None, old=None, row_no=0, table="public.tasks", stream="s", at=0):
    cells = cells or {}
    return (
        number, stream, 1, datetime(2024, 1, 1, 0, at), position, row_no, "dml", None, table, kind, list(cells), [cell(v) for v in cells.values()],
        None if old is None else list(old), None if old is None else [cell(v) for v in old.values()],
    )


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def dicts(df):
    return [r.asDict(True) for r in df.collect()]
