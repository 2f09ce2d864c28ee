"""Mixed timestamp formats and time zones: one instant in UTC for each text.

A text is reduced to its shape: digits become 9, ASCII letters A, all other
bytes stay.  Shapes are few, so each distinct one is matched against the
grammar once; the match says at which places of the text year, month, zone and
so on stand.  All texts of a shape have the same length and are then converted
together, by arithmetic on their bytes and a search in the zone's transition
table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.zones import ZoneTable, zone_table

# The shapes that denote an instant.
_CLOCK = r"(?P<hour>99?):(?P<minute>99)(?::(?P<second>99)(?:[.,](?P<fraction>9+))?)?"
_OFFSET = r"(?P<sign>[+-])(?P<zh>99)(?::?(?P<zm>99))?"
_ZONE = rf"(?: ?{_OFFSET}(?: (?:A{{2,5}}|[+-]99(?:99)?))?(?:\[[A_/+-9]+\])?| ?(?P<letters>A{{1,5}}))?"
_GRAMMAR = [
    rf"(?P<year>9999)-(?P<month>99)-(?P<day>99)(?:(?P<t>[A ]){_CLOCK}{_ZONE})?",
    rf"(?P<year>9999)(?P<month>99)(?P<day>99)(?P<t>A)(?P<hour>99)(?P<minute>99)(?P<second>99)(?:[.,](?P<fraction>9+))?{_ZONE}",
    rf"(?P<one>99?)/(?P<two>99?)/(?P<year>9999)(?: {_CLOCK}(?: ?(?P<half>AA))?)?",
    rf"(?:AAA, ?)?(?P<day>99?) (?P<name>AAA) (?P<year>9999) {_CLOCK}{_ZONE}",
    r"(?P<number>9{9,19})(?:\.(?P<part>9+))?",
]
_SHAPES = [re.compile(p) for p in _GRAMMAR]
_MONTHS = b"jan feb mar apr may jun jul aug sep oct nov dec".split()
_UNITS = {10: 1_000_000, 9: 1_000_000, 13: 1_000, 12: 1_000, 16: 1, 15: 1}
_FIRST, _LAST = 1_672_531_200_000_000, 1_798_761_600_000_000  # 2023-01-01 and 2027-01-01
#: abbreviations that mean UTC in every zone whose table does not say otherwise
_UNIVERSAL = {"Z": 0, "UTC": 0, "GMT": 0}

_SHAPE_OF = np.arange(256, dtype=np.uint8)
_SHAPE_OF[ord("0") : ord("9") + 1] = ord("9")
_SHAPE_OF[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE_OF[ord("a") : ord("z") + 1] = ord("A")
_SHAPE_OF[128:] = ord("?")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Parser:
    """Where the parts of a text stand, for one shape."""

    spans: dict[str, tuple[int, int]]

    def has(self, name: str) -> bool:
        return name in self.spans

    def number(self, text: np.ndarray, name: str, default: int = 0) -> np.ndarray:
        if name not in self.spans:
            return np.full(len(text), default, dtype=np.int64)
        a, b = self.spans[name]
        total = np.zeros(len(text), dtype=np.int64)
        for i in range(a, b):
            total = total * 10 + (text[:, i].astype(np.int64) - 48)
        return total

    def letters(self, text: np.ndarray, name: str) -> np.ndarray:
        a, b = self.spans[name]
        return np.ascontiguousarray(_LOWER[text[:, a:b]]).view(f"S{b - a}").ravel()

    def micros(self, text: np.ndarray, name: str) -> np.ndarray:
        """A fraction of a second; digits beyond microseconds are cut off."""
        if name not in self.spans:
            return np.zeros(len(text), dtype=np.int64)
        a, b = self.spans[name]
        kept = min(b - a, 6)
        return Parser({"f": (a, a + kept)}).number(text, "f") * 10 ** (6 - kept)


@lru_cache(maxsize=65536)
def parser_of(shape: str) -> Parser | None:
    """The parser of a shape, looked up once per distinct shape; None if it denotes no instant."""
    for grammar in _SHAPES:
        if m := grammar.fullmatch(shape):
            return Parser({k: m.span(k) for k, v in m.groupdict().items() if v is not None})
    return None


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the Gregorian calendar."""
    months = (year - 1970) * 12 + (month - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + day - 1


def _month_length(year: np.ndarray, month: np.ndarray) -> np.ndarray:
    following = np.where(month == 12, year + 1, year), np.where(month == 12, 1, month + 1)
    one = np.ones_like(year)
    return _days(*following, one) - _days(year, month, one)


def _convert(parser: Parser, text: np.ndarray, zone: np.ndarray, day_first: np.ndarray, tables: list[ZoneTable]) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds and validity of texts of one shape; ``zone`` indexes ``tables`` (-1: unknown)."""
    if parser.has("number"):
        return _bare_number(parser, text)
    year = parser.number(text, "year")
    if parser.has("one"):
        one, two = parser.number(text, "one"), parser.number(text, "two")
        month, day = np.where(day_first, two, one), np.where(day_first, one, two)
    elif parser.has("name"):
        names, day = parser.letters(text, "name"), parser.number(text, "day")
        month = np.zeros(len(text), dtype=np.int64)
        for i, name in enumerate(_MONTHS):
            month[names == name] = i + 1
    else:
        month, day = parser.number(text, "month"), parser.number(text, "day")
    hour, minute, second = (parser.number(text, n) for n in ("hour", "minute", "second"))
    good = (year >= 2) & (month >= 1) & (month <= 12) & (day >= 1) & (minute <= 59) & (second <= 59)
    if parser.has("half"):
        half = parser.letters(text, "half")
        good &= ((half == b"am") | (half == b"pm")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * (half == b"pm")
    good &= hour <= 23
    if parser.has("t"):
        good &= np.isin(parser.letters(text, "t"), [b"t", b" ", b""])
    safe_year, safe_month = np.where(good, year, 2000), np.where(good, month, 1)
    good &= day <= _month_length(safe_year, safe_month)
    wall = _days(safe_year, safe_month, day) * 86400 + hour * 3600 + minute * 60 + second
    offset = np.zeros(len(text), dtype=np.int64)
    if parser.has("sign"):
        zh, zm = parser.number(text, "zh"), parser.number(text, "zm")
        good &= (zh <= 15) & (zm <= 59)
        a, _ = parser.spans["sign"]
        offset = np.where(text[:, a] == ord("-"), -1, 1) * (zh * 3600 + zm * 60)
    elif parser.has("letters"):
        names = parser.letters(text, "letters")
        for z in np.unique(zone):
            own = tables[z].abbreviations if z >= 0 else {}
            here = zone == z
            for name in np.unique(names[here]):
                known = name.decode("ascii").upper()
                found = own.get(known, _UNIVERSAL.get(known))
                these = here & (names == name)
                if found is None:
                    good &= ~these
                else:
                    offset[these] = found
    else:
        for z in np.unique(zone):
            here = zone == z
            if z < 0:
                good &= ~here
            else:
                offset[here] = tables[z].offset_at_wall(wall[here])
    return (wall - offset) * 1_000_000 + parser.micros(text, "fraction"), good


def _bare_number(parser: Parser, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = parser.spans["number"]
    digits = b - a
    if digits == 19 and (text[:, a] > ord("1")).any():  # beyond any instant of these years, and near the end of 64 bits
        text = text.copy()
        text[text[:, a] > ord("1"), a:b] = ord("0")
    if digits > 16:
        return _bare_cut(parser, text, digits)
    value = parser.number(text, "number")
    found, good = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=bool)
    for unit in (1_000_000, 1_000, 1):
        low, high = _FIRST // unit, _LAST // unit
        fits = (value >= low) & (value < high)
        part = np.zeros(len(text), dtype=np.int64)
        if parser.has("part"):
            part = parser.micros(text, "part") * unit // 1_000_000
        found[fits], good[fits] = value[fits] * unit + part[fits], True
    return found, good


def _bare_cut(parser: Parser, text: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Nanoseconds: the last three digits are cut off."""
    a, b = parser.spans["number"]
    value = Parser({"n": (a, b - 3)}).number(text, "n")
    return value, (value >= _FIRST) & (value < _LAST)


def to_micros(texts: pa.Array, zone: np.ndarray, day_first: np.ndarray, tables: list[ZoneTable]) -> pa.Array:
    """Microseconds since 1970 UTC of each text, NULL where it denotes no instant."""
    texts = pc.utf8_trim_whitespace(texts.cast(pa.string()).fill_null(""))
    texts = pa.concat_arrays([texts])  # offsets from 0
    n = len(texts)
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    shapes = pa.StringArray.from_buffers(n, texts.buffers()[1], pa.py_buffer(_SHAPE_OF[data].tobytes()), offset=texts.offset).dictionary_encode()
    code = shapes.indices.to_numpy(zero_copy_only=False)
    micros, good = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(shapes.dictionary) + 1))
    for k, shape in enumerate(shapes.dictionary.to_pylist()):
        parser = parser_of(shape)
        rows = order[ends[k] : ends[k + 1]]
        if parser is not None and len(rows):
            block = data[starts[rows][:, None] + np.arange(len(shape))]
            micros[rows], good[rows] = _convert(parser, block, zone[rows], day_first[rows], tables)
    return pa.array(micros, mask=~good)


def instant_micros(text: Column, zone: Column, day_first: Column, zones: list[str]) -> Column:
    """Column of microseconds since 1970 UTC.

    ``zone`` indexes ``zones``; a NULL zone leaves readings without zone, and
    only those, without an instant.  NULL, empty, blank, infinite, impossible
    and other texts give NULL, as do the years 0000 and 0001.
    """
    tables = [zone_table(z) for z in zones]

    def convert(texts: pa.Array, zone_no: pa.Array, dmy: pa.Array) -> pa.Array:
        return to_micros(texts, zone_no.fill_null(-1).to_numpy(zero_copy_only=False), dmy.fill_null(False).to_numpy(zero_copy_only=False), tables)

    convert.__annotations__ = {"texts": pa.Array, "zone_no": pa.Array, "dmy": pa.Array, "return": pa.Array}
    return F.arrow_udf(convert, "bigint")(text, zone.cast("int"), day_first.cast("boolean"))


#: A stream table of at most so many rows goes to every executor; a larger one is joined by a shuffle.
MAX_SOURCES = 100_000


def normalised_instants(changes: DataFrame, ddl: DataFrame, sources: DataFrame) -> DataFrame:
    """Every text of both logs that denotes an instant: found_in, record_id, column_name, utc_micros.

    ``sources`` (one row per stream; sent to every executor if it has at most
    ``MAX_SOURCES`` rows) gives each stream's zone and order of day and month.
    Deliveries of an unknown stream keep their texts with an explicit zone.
    A cell beyond the listed names has a NULL column_name.  Repeated rows give
    repeated rows; empty logs give none.
    """
    zones = sorted(r[0] for r in sources.select("server_zone").where("server_zone is not null").distinct().collect())
    number = F.create_map(*[x for i, z in enumerate(zones) for x in (F.lit(z), F.lit(i))]) if zones else F.lit(None)
    where = sources.groupBy("stream_id").agg(F.first("server_zone").alias("z"), F.first("date_order").alias("d")).select("stream_id", (F.element_at(number, F.col("z")) if zones else number.cast("int")).alias("zone_no"), (F.col("d") == "dmy").alias("day_first"))
    if sources.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        where = F.broadcast(where)
    cells = changes.select("delivery_id", "stream_id", "column_names", F.posexplode(F.col("column_values").getField("timestamp_value")).alias("place", "text")).where("text is not null")
    long = cells.select(F.lit("change_log").alias("found_in"), F.col("delivery_id").alias("record_id"), F.get("column_names", "place").alias("column_name"), "text", "stream_id").unionByName(
        ddl.where("ddl_time is not null").select(F.lit("ddl_log").alias("found_in"), F.col("log_id").alias("record_id"), F.lit("ddl_time").alias("column_name"), F.col("ddl_time").alias("text"), "stream_id")
    )
    return (
        long.join(where, "stream_id", "left")
        .withColumn("utc_micros", instant_micros(F.col("text"), F.col("zone_no"), F.col("day_first"), zones))
        .where("utc_micros is not null")
        .select("found_in", "record_id", "column_name", "utc_micros")
    )
