"""Types of dump values, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..model import cell

# What counts as a number, a truth value and a timestamp.
_INT = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf(inity)?|nan)$"
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def infer_cell(text: Column, empty_is_null: bool = True) -> Column:
    """The cell of a dump's text: int, float, bool, timestamp, else string; NULL (and by default the empty text) gives the NULL cell."""
    given = text if not empty_is_null else F.when(text != "", text)
    whole = F.when(given.rlike(_INT), given.try_cast("bigint"))
    special = F.when(given.rlike(r"^[+-]?(?i:nan)$"), F.lit(float("nan"))).when(given.rlike(r"^\+?(?i:inf(inity)?)$"), F.lit(float("inf"))).when(given.rlike(r"^-(?i:inf(inity)?)$"), F.lit(float("-inf")))
    number = F.when(whole.isNull() & given.rlike(_FLOAT), F.coalesce(special, given.try_cast("double")))
    truth = F.when(whole.isNull() & given.isin(*_TRUE), True).when(whole.isNull() & given.isin(*_FALSE), False)
    wall = F.replace(F.substring(given, 1, 19), F.lit("T"), F.lit(" "))
    real = wall.try_cast("timestamp").isNotNull()
    stamp = (
        F.when(given.rlike(_RFC3339) & real, F.regexp_replace(given, r"\.\d+", ""))
        .when(given.rlike(_PLAIN) & real, F.concat(F.replace(wall, F.lit(" "), F.lit("T")), F.lit("Z")))
        .when(given.rlike(_DATE) & given.try_cast("date").isNotNull(), F.concat(given, F.lit("T00:00:00Z")))
    )
    other = F.when(whole.isNull() & number.isNull() & truth.isNull() & stamp.isNull(), given)
    return cell(string_value=other, int_value=whole, float_value=number, bool_value=truth, timestamp_value=stamp)


def unescape_copy(text: Column) -> Column:
    """A cell of COPY data: ``\\N`` is NULL; tab, newline, carriage return and backslash are unescaped one after the other."""
    made = text
    for escaped, plain in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
        made = F.replace(made, F.lit(escaped), F.lit(plain))
    return F.when(text != "\\N", made)
