"""Literals and identifiers of the two SQL dialects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIALECTS = ("postgresql", "mysql")
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
# Column types by dialect.
TYPES = {
    "postgresql": {"uuid": "uuid", "text": "text", "timestamp": "timestamptz", "decimal": "decimal(10,2)", "integer": "integer"},
    "mysql": {"uuid": "CHAR(36)", "text": "TEXT", "timestamp": "DATETIME(6)", "decimal": "DECIMAL(10,2)", "integer": "INT"},
}


def quoted(text: Column, dialect: str) -> Column:
    """A text literal; quotes are doubled, in mysql backslashes too."""
    inner = F.replace(text, F.lit("\\"), F.lit("\\\\")) if dialect == "mysql" else text
    return F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("''")), F.lit("'"))


def identifier(name: Column, dialect: str) -> Column:
    mark = "`" if dialect == "mysql" else '"'
    return F.concat(F.lit(mark), F.replace(name, F.lit(mark), F.lit(mark * 2)), F.lit(mark))


def regclass(schema: Column, name: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.concat_ws(".", schema, name), F.lit("'"), F.lit("''")), F.lit("'"))


def truth(value: Column, dialect: str) -> Column:
    yes, no = ("1", "0") if dialect == "mysql" else ("true", "false")
    return F.when(value, yes).when(~value, no)


def moment(text: Column) -> Column:
    """A date or the wall-clock reading of an instant, as a literal; its offset is dropped, not applied.  NULL for other text."""
    reading = F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" "))
    real = F.when(text.rlike(_INSTANT), reading.try_cast("timestamp").isNotNull()).when(text.rlike(_DATE), text.try_cast("date").isNotNull())
    return F.when(F.coalesce(real, F.lit(False)), F.concat(F.lit("'"), F.when(text.rlike(_DATE), text).otherwise(reading), F.lit("'")))


def literal(cell: Column, dialect: str) -> Column:
    """The literal of a cell; NULL cells give the word NULL, timestamps that are none give SQL NULL (an error to the caller)."""
    none = F.lit(False)
    for n in ("string_value", "int_value", "float_value", "bool_value", "timestamp_value"):
        none = none | cell[n].isNotNull()
    return (
        F.when(cell["string_value"].isNotNull(), quoted(cell["string_value"], dialect))
        .when(cell["int_value"].isNotNull(), cell["int_value"].cast("string"))
        .when(cell["float_value"].isNotNull(), F.format_string("%f", cell["float_value"]))
        .when(cell["bool_value"].isNotNull(), truth(cell["bool_value"], dialect))
        .when(cell["timestamp_value"].isNotNull(), moment(cell["timestamp_value"]))
        .when(~F.coalesce(none, F.lit(False)), "NULL")
    )
