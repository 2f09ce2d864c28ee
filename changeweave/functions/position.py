"""Position algebra: score, comparison, synthetic positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# A bootstrap position n scores -1000000 + n; file or high word weighs 2^32;
# the word "bootstrap" means before everything.
BOOTSTRAP_BASE = -1000000
WORD = 4294967296
BEFORE_ALL = -1000000000000000000
BOOTSTRAP_PATTERN = r"^0/BOOTSTRAP(\d+)$"
BINLOG_PATTERN = r"bin\.(\d+):(\d+)$"
LSN_PATTERN = r"^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$"


def score(position: Column) -> Column:
    """Exact 64-bit score of a position; NULL where the text is no position.

    Spelling does not matter: padding zeros, hexadecimal case and blanks
    around are ignored.  Scores are integers, not doubles, so neighbouring
    positions beyond 2^53 stay apart.
    """
    text = F.trim(position)
    high, low = F.regexp_extract(text, LSN_PATTERN, 1), F.regexp_extract(text, LSN_PATTERN, 2)
    file, offset = F.regexp_extract(text, BINLOG_PATTERN, 1), F.regexp_extract(text, BINLOG_PATTERN, 2)

    def word(upper: Column, lower: Column) -> Column:
        return F.try_add(F.try_multiply(upper.try_cast("bigint"), F.lit(WORD)), lower.try_cast("bigint"))

    return (
        F.when(text == "bootstrap", F.lit(BEFORE_ALL))
        .when(text.rlike(BOOTSTRAP_PATTERN), F.try_add(F.regexp_extract(text, BOOTSTRAP_PATTERN, 1).try_cast("bigint"), F.lit(BOOTSTRAP_BASE)))
        .when(text.rlike(BINLOG_PATTERN), word(file, offset))
        .when(text.rlike(LSN_PATTERN), word(F.conv(high, 16, 10), F.conv(low, 16, 10)))
        .cast("bigint")
    )


def score_of(text: str) -> int | None:
    """The score of a position that is known when a query is built."""
    text = text.strip()
    if text == "bootstrap":
        return BEFORE_ALL
    if m := re.match(BOOTSTRAP_PATTERN, text):
        return int(m[1]) + BOOTSTRAP_BASE
    if m := re.search(BINLOG_PATTERN, text):
        return int(m[1]) * WORD + int(m[2])
    if m := re.match(LSN_PATTERN, text):
        return int(m[1], 16) * WORD + int(m[2], 16)
    return None


def score_double(position: Column) -> Column:
    """The score as a 64-bit float, as a sorted-set store holds it."""
    return score(position).cast("double")


def is_bootstrap(position: Column) -> Column:
    return F.trim(position).rlike(BOOTSTRAP_PATTERN)


def bootstrap_sequence(position: Column) -> Column:
    return F.regexp_extract(F.trim(position), BOOTSTRAP_PATTERN, 1).try_cast("bigint")


def is_binlog(position: Column) -> Column:
    return F.trim(position).rlike(BINLOG_PATTERN)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; every bootstrap position precedes every real one."""
    a, b = _ordered(left), _ordered(right)
    return F.when(score(left).isNull() | score(right).isNull(), None).when(a < b, -1).when(a > b, 1).otherwise(0).cast("int")


def _ordered(position: Column) -> Column:
    real = ~(is_bootstrap(position) | (F.trim(position) == "bootstrap"))
    return F.struct(real.cast("int").alias("real"), score(position).alias("at"))


def binlog_position(file: Column, offset: Column) -> Column:
    return F.concat_ws(":", file, offset.cast("string"))


def bootstrap_text(sequence: Column) -> Column:
    return F.format_string("0/BOOTSTRAP%016d", sequence.cast("bigint"))
