"""The JSON form of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import float_text
from ..model import CELL, CHANGE, cell

_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
# Values are read as variants: a text array would lose whether 1 was written 1 or "1".
_ENVELOPE = (
    "struct<type:string,position:string,data:struct<table:string,columnnames:array<string>,columnvalues:array<variant>,kind:string,"
    "oldkeys:struct<keynames:array<string>,keyvalues:array<variant>>,id:int,time:string,username:string,database:string,ddl:string>>"
)


def json_text(text: Column) -> Column:
    """A JSON string literal."""
    array = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substr(array, F.lit(2), F.length(array) - 2))


def json_cell(value: Column) -> Column:
    """An untagged JSON scalar; ``null`` for the NULL cell."""
    return F.coalesce(json_text(value["string_value"]), value["int_value"].cast("string"), float_text(value["float_value"]), value["bool_value"].cast("string"), json_text(value["timestamp_value"]), F.lit("null"))


def _list(values: Column, of) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.array()), of), ","), F.lit("]"))


def encode_dml(position: Column, table: Column, names: Column, values: Column, kind: Column, key_names: Column, key_values: Column) -> Column:
    """The envelope of a row change; without old keys if ``key_names`` is NULL."""
    cells = lambda v: F.coalesce(v, F.array().cast(f"array<{CELL.simpleString()}>"))
    texts = lambda v: F.coalesce(v, F.array().cast("array<string>"))
    keys = F.when(key_names.isNotNull(), F.concat(F.lit(',"oldkeys":{"keynames":'), _list(texts(key_names), json_text), F.lit(',"keyvalues":'), _list(cells(key_values), json_cell), F.lit("}"))).otherwise("")
    return F.concat(
        F.lit('{"type":"dml","position":'), json_text(position), F.lit(',"data":{"table":'), json_text(table), F.lit(',"columnnames":'), _list(texts(names), json_text),
        F.lit(',"columnvalues":'), _list(cells(values), json_cell), F.lit(',"kind":'), json_text(kind), keys, F.lit("}}"),
    )


def encode_ddl(position: Column, ddl: Column) -> Column:
    body = F.to_json(F.struct(*[ddl[n].alias(n) for n in ("id", "time", "username", "database", "ddl")]), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"ddl","position":'), json_text(position), F.lit(',"data":'), body, F.lit("}"))


def encode(change: Column) -> Column:
    """The JSON text of a change."""
    dml, ddl = change["dml"], change["ddl"]
    row = encode_dml(change["position"], dml["table"], dml["column_names"], dml["column_values"], dml["kind"], dml["old_keys"]["key_names"], dml["old_keys"]["key_values"])
    return F.when(change["type"] == "dml", row).when(change["type"] == "ddl", encode_ddl(change["position"], ddl))


def cell_of_variant(value: Column) -> Column:
    """Tag a JSON scalar: null, int, float, bool, RFC 3339 instant (its fraction cut off), else text."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    instant = (kind == "STRING") & text.rlike(_INSTANT)
    return cell(
        string_value=F.when((kind == "STRING") & ~text.rlike(_INSTANT), text),
        int_value=F.when(whole, F.try_variant_get(value, "$", "bigint")),
        float_value=F.when(number, F.try_variant_get(value, "$", "double")),
        bool_value=F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")),
        timestamp_value=F.when(instant, F.regexp_replace(text, r"\.\d+", "")),
    )


def decode(text: Column) -> Column:
    """The change in a JSON text; NULL if it is none."""
    read = F.from_json(text, _ENVELOPE)
    data = read["data"]
    keys = F.when(data["oldkeys"].isNotNull(), F.struct(data["oldkeys"]["keynames"].alias("key_names"), F.transform(data["oldkeys"]["keyvalues"], cell_of_variant).alias("key_values")))
    dml = F.when(read["type"] == "dml", F.struct(data["table"].alias("table"), data["columnnames"].alias("column_names"), F.transform(data["columnvalues"], cell_of_variant).alias("column_values"), data["kind"].alias("kind"), keys.alias("old_keys")))
    ddl = F.when(read["type"] == "ddl", F.struct(data["id"].alias("id"), data["time"].alias("time"), data["username"].alias("username"), data["database"].alias("database"), data["ddl"].alias("ddl")))
    made = F.struct(read["position"].alias("position"), read["type"].alias("type"), dml.alias("dml"), ddl.alias("ddl"))
    return F.when(read["type"].isin("dml", "ddl"), made).cast(CHANGE)


def read_changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Changes of a table of JSON texts, as columns position, type, dml, ddl; other texts are left out."""
    return lines.select(decode(F.col(column)).alias("change")).where("change is not null").select("change.*")
