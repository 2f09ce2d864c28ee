"""The binary wire form of changes (protocol buffers, proto3), written by expressions and read in Arrow batches.

Bytes are made as hexadecimal text and turned into bytes at the end.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..model import CHANGE

# Numbers of the fields.
#   change: position 1, type 2, dml 3, ddl 4; cell: string 1, int 2, float 3, bool 4, timestamp 5
#   dml: table 1, column_names 2, column_values 3, kind 4, old_keys 5; old_keys: key_names 1, key_values 2
#   ddl: id 1, time 2, username 3, database 4, ddl 5
_CELL_FIELDS = ("string_value", "int_value", "float_value", "bool_value", "timestamp_value")
_VARINT, _FIXED, _BYTES = 0, 1, 2


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _varint(value: Column) -> Column:
    """A 64-bit number in groups of seven bits, the lowest first."""

    def groups(v: Column) -> Column:
        last = F.ceil(F.length(F.bin(v)) / 7).cast("int") - 1
        group = lambda i: F.call_function("shiftrightunsigned", v, (i * 7).cast("int")).bitwiseAND(F.lit(127)).bitwiseOR(F.when(i < last, 128).otherwise(0).cast("bigint"))
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(group(i)), 2, "0")), "")

    return _let(value, groups)


def _tag(field: int, kind: int) -> Column:
    return F.lit(f"{field << 3 | kind:02X}")


def _block(field: int, body: Column) -> Column:
    """A field with its length; ``body`` is hexadecimal."""
    return _let(body, lambda b: F.concat(_tag(field, _BYTES), _varint((F.length(b) / 2).cast("bigint")), b))


def _text(field: int, text: Column) -> Column:
    """A text field; empty and NULL ones are left out, as proto3 does."""
    return F.when(F.coalesce(text, F.lit("")) != "", _block(field, F.hex(F.encode(text, "utf-8")))).otherwise("")


def _texts(field: int, texts: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: _block(field, F.hex(F.encode(F.coalesce(t, F.lit("")), "utf-8")))), "")


def _cell(value: Column) -> Column:
    """One of the fields, which is written even if it is zero or empty; nothing for the NULL cell."""
    bits = F.lpad(F.hex(F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value["float_value"], F.lit(0.0))).cast("bigint")), 16, "0")
    little = _let(bits, lambda b: F.concat(*[F.substr(b, F.lit(15 - 2 * i), F.lit(2)) for i in range(8)]))
    return (
        F.when(value["string_value"].isNotNull(), _block(1, F.hex(F.encode(value["string_value"], "utf-8"))))
        .when(value["int_value"].isNotNull(), F.concat(_tag(2, _VARINT), _varint(value["int_value"])))
        .when(value["float_value"].isNotNull(), F.concat(_tag(3, _FIXED), little))
        .when(value["bool_value"].isNotNull(), F.concat(_tag(4, _VARINT), F.when(value["bool_value"], "01").otherwise("00")))
        .when(value["timestamp_value"].isNotNull(), _block(5, F.hex(F.encode(value["timestamp_value"], "utf-8"))))
        .otherwise("")
    )


def _cells(field: int, values: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(values, F.array().cast(CHANGE["dml"].dataType["column_values"].dataType)), lambda v: _block(field, _cell(v))), "")


def wire_change(change: Column) -> Column:
    """The bytes of a change (a struct of position, type, dml and ddl)."""
    dml, ddl = change["dml"], change["ddl"]
    keys = F.when(dml["old_keys"].isNotNull(), _block(5, F.concat(_texts(1, dml["old_keys"]["key_names"]), _cells(2, dml["old_keys"]["key_values"])))).otherwise("")
    row = F.concat(_text(1, dml["table"]), _texts(2, dml["column_names"]), _cells(3, dml["column_values"]), _text(4, dml["kind"]), keys)
    number = F.when(F.coalesce(ddl["id"], F.lit(0)) != 0, F.concat(_tag(1, _VARINT), _varint(ddl["id"].cast("bigint")))).otherwise("")
    statement = F.concat(number, *[_text(i + 2, ddl[n]) for i, n in enumerate(("time", "username", "database", "ddl"))])
    data = F.when(dml.isNotNull(), _block(3, row)).when(ddl.isNotNull(), _block(4, statement)).otherwise("")
    return F.unhex(F.concat(_text(1, change["position"]), _text(2, change["type"]), data))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == _VARINT:
            yield key >> 3, number()
        elif key & 7 in (_FIXED, 5):
            size = 8 if key & 7 == _FIXED else 4
            yield key >> 3, data[at : at + size]
            at += size
        elif key & 7 == _BYTES:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError("no message of a change")


def _read_cell(data: bytes) -> dict:
    made = dict.fromkeys(_CELL_FIELDS)
    for field, value in _fields(data):
        if field in (1, 5):
            made[_CELL_FIELDS[field - 1]] = value.decode()
        elif field == 2:
            made["int_value"] = value - 2**64 if value >= 2**63 else value
        elif field == 3:
            made["float_value"] = struct.unpack("<d", value)[0]
        elif field == 4:
            made["bool_value"] = bool(value)
    return made


def read_change(data: bytes) -> dict:
    """The change that a message holds; fields that it leaves out are empty."""
    made = {"position": "", "type": "", "dml": None, "ddl": None}
    for field, value in _fields(data):
        if field in (1, 2):
            made[("position", "type")[field - 1]] = value.decode()
        elif field == 3:
            dml = {"table": "", "column_names": [], "column_values": [], "kind": "", "old_keys": None}
            for f, v in _fields(value):
                if f in (1, 4):
                    dml["table" if f == 1 else "kind"] = v.decode()
                elif f == 2:
                    dml["column_names"].append(v.decode())
                elif f == 3:
                    dml["column_values"].append(_read_cell(v))
                elif f == 5:
                    keys = list(_fields(v))
                    dml["old_keys"] = {"key_names": [x.decode() for k, x in keys if k == 1], "key_values": [_read_cell(x) for k, x in keys if k == 2]}
            made["dml"] = dml
        elif field == 4:
            ddl = {"id": 0, "time": "", "username": "", "database": "", "ddl": ""}
            for f, v in _fields(value):
                if f == 1:
                    ddl["id"] = (v & 0xFFFFFFFF) - (2**32 if v & 0x80000000 else 0)
                elif f <= 5:
                    ddl[("time", "username", "database", "ddl")[f - 2]] = v.decode()
            made["ddl"] = ddl
    return made


def read_wire(messages: DataFrame, column: str = "value") -> DataFrame:
    """Changes of messages: position, type, dml, ddl.  NULL messages are left out; bytes that are no message are an error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(CHANGE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([read_change(m) for m in batch.column(0).to_pylist() if m is not None], schema=schema)

    return messages.select(column).mapInArrow(read, CHANGE)
