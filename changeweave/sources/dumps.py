"""Plain-text dumps of both databases as change logs.

A dump is a sequence, so each file is split into statements by one task, as a
stream of lines of which only the statement at hand is held; everything after
that, typing and conversion, is spread by row.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.position import bootstrap_sequence, bootstrap_text
from ..model import CELL
from ..storage import written
from .infer import infer_cell

#: Names with this prefix belong to the replication's own tables and are left out.
INTERNAL_PREFIX = "internal_"
#: Rows of one statement that travel together.
CHUNK = 1000


class DumpError(ValueError):
    """A statement that cannot be in a dump."""


@dataclass(frozen=True)
class Statement:
    kind: str  # ddl or dml
    table: str
    columns: tuple[str, ...] = ()
    rows: tuple[tuple[str | None, ...], ...] = ()
    sql: str = ""


# Kinds of statements by how they begin, first match wins, and what becomes of each.
_PG_KINDS: list[tuple[str, str]] = [
    ("CREATE_TABLE", r"create\s+(?:unlogged\s+|temp(?:orary)?\s+)?table\b"),
    ("CREATE_INDEX", r"create\s+(?:unique\s+)?index\b"),
    ("CREATE_EVENT_TRIGGER", r"create\s+event\s+trigger\b"),
    ("CREATE_TRIGGER", r"create\s+(?:or\s+replace\s+)?(?:constraint\s+)?trigger\b"),
    ("CREATE_FUNCTION", r"create\s+(?:or\s+replace\s+)?(?:function|procedure)\b"),
    ("CREATE_SEQUENCE", r"create\s+sequence\b"),
    ("ALTER_SEQUENCE", r"alter\s+sequence\s+\S+\s+(?!owner\s+to)"),
    ("ALTER_TABLE", r"alter\s+(?:table|sequence|index|view)\b"),
    ("CREATE_PUBLICATION", r"create\s+publication\b"),
    ("ALTER_PUBLICATION", r"alter\s+publication\b"),
    ("DROP_PUBLICATION", r"drop\s+publication\b"),
    ("CREATE_SUBSCRIPTION", r"create\s+subscription\b"),
    ("ALTER_SUBSCRIPTION", r"alter\s+subscription\b"),
    ("DROP_SUBSCRIPTION", r"drop\s+subscription\b"),
    ("INSERT", r"insert\b"),
    ("UPDATE", r"update\b"),
    ("DELETE", r"delete\b"),
    ("SELECT", r"select\b"),
    ("DROP", r"drop\b"),
    ("TRUNCATE", r"truncate\b"),
    ("COMMENT", r"comment\b"),
    ("GRANT", r"(?:grant|revoke)\b"),
    ("SET", r"(?:set|reset)\b"),
    ("TRANSACTION", r"(?:begin|start\s+transaction|commit|rollback|end)\b"),
    ("COPY", r"copy\b"),
]
KEPT_DDL = ("CREATE_TABLE", "CREATE_INDEX", "ALTER_TABLE", "CREATE_SEQUENCE", "ALTER_SEQUENCE", "CREATE_FUNCTION", "CREATE_TRIGGER", "CREATE_EVENT_TRIGGER", "DROP", "TRUNCATE", "COMMENT", "GRANT")
SKIPPED = ("SET", "TRANSACTION", "CREATE_PUBLICATION", "ALTER_PUBLICATION", "DROP_PUBLICATION", "CREATE_SUBSCRIPTION", "ALTER_SUBSCRIPTION", "DROP_SUBSCRIPTION")
DDL_PREFIXES = ("CREATE", "ALTER", "DROP", "RENAME", "TRUNCATE")
_NAME = r'(?:`[^`]+`|"(?:[^"]|"")+"|[\w$]+)'
_NAMES = rf"{_NAME}(?:\.{_NAME})*"
_TABLE_AFTER = r"(?is)^\s*(?:create\s+(?:unlogged\s+|temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?|alter\s+(?:table|sequence)\s+(?:if\s+exists\s+)?(?:only\s+)?|create\s+sequence\s+(?:if\s+not\s+exists\s+)?|create\s+(?:unique\s+)?index\s+\S+\s+on\s+(?:only\s+)?|drop\s+table\s+(?:if\s+exists\s+)?|truncate\s+(?:table\s+)?(?:only\s+)?|insert\s+(?:ignore\s+)?into\s+|copy\s+)(" + _NAMES + ")"


def statement_kind(sql: Column) -> Column:
    """The kind of a statement, UNKNOWN if it is none of those of a dump."""
    kind = F.lit("UNKNOWN")
    for name, pattern in reversed(_PG_KINDS):
        kind = F.when(sql.rlike(rf"(?is)^\s*{pattern}"), name).otherwise(kind)
    return F.when(sql.isNotNull(), kind)


def statement_table(sql: Column) -> Column:
    """The table that a statement is about; NULL where it names none."""
    found = F.translate(F.regexp_extract(sql, _TABLE_AFTER, 1), '`"', "")
    return F.when(found != "", found)


def statement_route(sql: Column) -> Column:
    """What becomes of a statement of a dump: ddl, rows, skip, or error."""
    kind = statement_kind(sql)
    select = F.when(F.upper(sql).contains("PG_CATALOG.SETVAL"), "ddl").when(F.upper(sql).contains("PG_CATALOG.SET_CONFIG"), "skip").otherwise("error")
    return F.when(kind.isin(*KEPT_DDL), "ddl").when(kind == "INSERT", "rows").when(kind.isin(*SKIPPED), "skip").when(kind == "SELECT", select).when(kind == "COPY", "rows").otherwise("error")


def is_ddl(sql: Column) -> Column:
    """Whether a logged query changes the schema."""
    return F.trim(sql).rlike(rf"(?is)^({'|'.join(DDL_PREFIXES)})")


def is_internal(sql: Column, prefix: str = INTERNAL_PREFIX) -> Column:
    """Whether a statement concerns the replication's own objects."""
    bare = F.substring_index(statement_table(sql), ".", -1)
    kind = statement_kind(sql)
    named = F.when(kind == "CREATE_FUNCTION", sql.rlike(rf"(?is)function\s+(?:public\.)?{prefix}")).when(kind.isin("CREATE_TRIGGER", "CREATE_EVENT_TRIGGER"), sql.rlike(rf"(?is)trigger\s+{prefix}")).when(kind.isin("ALTER_TABLE", "DROP", "COMMENT", "GRANT"), sql.rlike(rf"(?is)[ .]{prefix}"))
    return F.coalesce(bare.startswith(prefix), F.lit(False)) | F.coalesce(named, F.lit(False))


# The words that are written in capitals.
_KEYWORDS = ("create", "table", "index", "alter", "drop", "insert", "select", "update", "delete")


def normalise_keywords(sql: Column) -> Column:
    """The statement without blanks around it, its keywords in capitals wherever they stand, texts included."""
    sql = F.regexp_replace(sql, r"^\s+|\s+$", "")
    for word in _KEYWORDS:
        sql = F.regexp_replace(sql, rf"(?i)\b{word}\b", word.upper())
    return sql


#: Arguments of a COPY header: the table, and the list of columns in parentheses if there is one.
_COPY = rf'(?i)^COPY\s+({_NAMES})\s*(?:\(((?:"(?:[^"]|"")*"|[^)"])*)\))?'


def _bare(name: Column) -> Column:
    quoted = name.startswith('"')
    return F.when(quoted, F.replace(F.substr(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))).otherwise(name)


def copy_header(line: Column) -> Column:
    """Struct of table and columns of a COPY header; names may be quoted and hold any character."""
    parts = F.transform(F.regexp_extract_all(F.regexp_extract(line, _COPY, 1), F.lit(_NAME), 0), _bare)
    columns = F.transform(F.regexp_extract_all(F.regexp_extract(line, _COPY, 2), F.lit(_NAME), 0), _bare)
    return F.struct(F.array_join(parts, ".").alias("table"), columns.alias("columns"))


def mysql_table(sql: Column) -> Column:
    """The table of a mysql statement."""
    return statement_table(sql)


_TUPLES = {
    False: re.compile(r"""(?<!\w)[eE]'(?:[^'\\]|\\.|'')*'|'(?:[^']|'')*'|"(?:[^"]|"")*"|[(),]""", re.S),
    True: re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|[(),]""", re.S),
}


def _split_values(text: str, backslash: bool) -> list[list[str]]:
    """Tuples of raw values of a VALUES clause; what follows the last tuple is left out."""
    rows: list[list[str]] = []
    row: list[str] = []
    depth = start = 0
    for m in _TUPLES[backslash].finditer(text):
        c = m[0]
        if c == "(":
            if not depth and text[start : m.start()].strip(" \t\r\n,"):
                break
            depth += 1
            start = m.end() if depth == 1 else start
        elif c == ")" and depth:
            depth -= 1
            if not depth:
                rows.append([*row, text[start : m.start()]])
                row, start = [], m.end()
        elif c == "," and depth == 1:
            row.append(text[start : m.start()])
            start = m.end()
    return rows


# What opens a quote or comment in each dialect, and what closes it.
_OPENING = {
    "pg": re.compile(r"""--|/\*|(?<!\w)[eE]'|'|"|(?<![\w$])\$(?:[A-Za-z_]\w*)?\$|;"""),
    "mysql": re.compile(r"""--(?=\s|$)|\#|/\*|'|"|`|;"""),
}
_CLOSING = {"'": re.compile("'"), '"': re.compile('"'), "`": re.compile("`"), "/*": re.compile(r"\*/"), "e'": re.compile(r"\\.|'", re.S)}
_CLOSING_BACKSLASH = {"'": re.compile(r"\\.|'", re.S), '"': re.compile(r'\\.|"', re.S)}


class _Quotes:
    """What is open at the end of the lines read so far: a text, a name, a comment, or a body in dollar quotes."""

    def __init__(self, dialect: str):
        self.opening = _OPENING[dialect]
        self.closing = _CLOSING | (_CLOSING_BACKSLASH if dialect == "mysql" else {})
        self.open = ""

    def ends(self, line: str) -> bool:
        """Read a line; whether its last word outside of quotes and comments is a semicolon."""
        at, ended = 0, False
        while at < len(line):
            if self.open:
                m = re.compile(re.escape(self.open)).search(line, at) if self.open.startswith("$") else self.closing[self.open].search(line, at)
                if m is None:
                    return False
                at = m.end()
                if not m[0].startswith("\\"):
                    self.open = ""
                continue
            m = self.opening.search(line, at)
            if line[at : m.start() if m else len(line)].strip():
                ended = False
            if m is None or m[0] in ("--", "#"):
                break
            at = m.end()
            if m[0] == ";":
                ended = True
            else:
                self.open = m[0].lower()
                if self.open.startswith("$"):
                    self.open = m[0]
                ended = ended and self.open == "/*"
        return ended and not self.open


# Escapes in texts, and (below, in order) those that the ``like_reference`` forms replace.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a"}


def _clean(value: str, dialect: str, like_reference: bool) -> str | None:
    value = value.strip()
    if value.upper() == "NULL":
        return "" if like_reference else None
    if dialect == "pg" and not like_reference and value[:2] in ("E'", "e'") and value[-1] == "'":
        return re.sub(r"''|\\(.)", lambda m: "'" if m[1] is None else _ESCAPES.get(m[1], m[1]) if m[1] in "nrtb" else m[1], value[2:-1], flags=re.S)
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
        quote, value = value[0], value[1:-1]
        if dialect == "mysql" and not like_reference:
            value = re.sub(r"''|\\(.)", lambda m: "'" if m[1] is None else _ESCAPES.get(m[1], m[1]), value, flags=re.S)
        elif dialect == "mysql":
            for escaped, plain in (("''", "'"), ("\\\\", "\\"), ("\\'", "'"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0")):
                value = value.replace(escaped, plain)
        else:
            value = value.replace(quote * 2, quote)
    return value


_COLUMNS = r'\(((?:`[^`]*`|"(?:[^"]|"")*"|[^)`"])*)\)'
_INSERT = re.compile(rf"\s*insert\s+(?:ignore\s+)?into\s+({_NAMES})\s*(?:{_COLUMNS})?\s*(?:overriding\s+\w+\s+value\s+)?values\s*", re.I | re.S)


def _unquoted(names: str) -> list[str]:
    """Names of a list or of a path, without their quotes."""
    return [n[1:-1].replace(n[0] * 2, n[0]) if n[0] in "`\"" else n for n in re.findall(_NAME, names)]


def _insert(sql: str, dialect: str, like_reference: bool) -> Statement | None:
    m = _INSERT.match(sql)
    if not m:
        return None
    path = _unquoted(m[1])
    columns = tuple(_unquoted(m[2])) if m[2] else ()
    rows = _split_values(sql[m.end() :], dialect == "mysql")
    if like_reference and dialect == "pg":
        rows = rows[:1]
    return Statement("dml", path[-1] if dialect == "mysql" else ".".join(path), columns, tuple(tuple(_clean(v, dialect, like_reference) for v in r) for r in rows))


def _copy_cell(value: str, like_reference: bool) -> str | None:
    if value == "\\N":
        return "" if like_reference else None
    if like_reference:
        for escaped, plain in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
            value = value.replace(escaped, plain)
        return value
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]) if m[1] in "nrtb" else m[1], value)


_KIND = re.compile(r"\s*(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _PG_KINDS) + ")", re.I)


def _kind(sql: str) -> str:
    m = _KIND.match(sql)
    return m.lastgroup if m else "UNKNOWN"


def _named(sql: str) -> str:
    m = re.match(_TABLE_AFTER, sql)
    return ".".join(_unquoted(m[1])) if m else ""


def _internal(sql: str, table: str, prefix: str) -> bool:
    return table.rpartition(".")[2].lower().startswith(prefix) or re.search(rf"(?i)(?:function|trigger)\s+(?:public\.)?{prefix}|^\s*(?:alter|drop|comment|grant)\b.*[ .]{prefix}", sql) is not None


_COPY_FROM = re.compile(_COPY + r"\s+FROM\s+stdin")


def pg_statements(lines: Iterator[str], like_reference: bool = False, prefix: str = INTERNAL_PREFIX) -> Iterator[Statement]:
    """Statements of a plain pg_dump, in order; DumpError for what no dump has, and for a dump that ends inside a statement.

    ``like_reference`` reproduces that parser where it differs: rows of COPY
    data that are blank or begin with ``--`` or a backslash are lost, of a
    multi-row INSERT only the first row counts, NULL is the empty text,
    statements end at every line that ends with a semicolon outside of dollar
    quotes, and an open end is dropped.
    """
    statement: list[str] = []
    tag_open = ""
    quotes = _Quotes("pg")
    copying: Statement | None = None
    rows: list[tuple[str | None, ...]] = []
    for line in lines:
        line = line.rstrip("\r\n")
        if copying is not None:
            if line == "\\.":
                if rows:
                    yield Statement("dml", copying.table, copying.columns, tuple(rows))
                copying, rows = None, []
            elif not (like_reference and (line.startswith(("--", "\\")) or not line.strip())) and copying.table:
                rows.append(tuple(_copy_cell(v, like_reference) for v in line.split("\t")))
                if len(rows) >= CHUNK:
                    yield Statement("dml", copying.table, copying.columns, tuple(rows))
                    rows = []
            continue
        if not statement and (line.startswith("--") or not line.strip() or line.startswith("\\")):
            continue
        if not statement and (m := _COPY_FROM.match(line)):
            path = _unquoted(m[1])
            copying = Statement("dml", "" if path[-1].startswith(prefix) else ".".join(path), tuple(_unquoted(m[2])) if m[2] else ())
            continue
        statement.append(line)
        if like_reference:
            for tag in re.findall(r"\$(?:[A-Za-z_]\w*)?\$", line):
                tag_open = tag if not tag_open else "" if tag == tag_open else tag_open
            ended = not tag_open and line.rstrip().endswith(";")
        else:
            ended = quotes.ends(line)
        if not ended:
            continue
        sql = "\n".join(statement).strip()
        statement = []
        kind = _kind(sql)
        if kind == "INSERT":
            if (made := _insert(sql, "pg", like_reference)) and not made.table.rpartition(".")[2].startswith(prefix):
                yield made
            continue
        table = _named(sql)
        if kind in KEPT_DDL:
            if not _internal(sql, table, prefix):
                yield Statement("ddl", table, sql=sql)
        elif kind == "SELECT" and "PG_CATALOG.SETVAL" in sql.upper():
            if prefix not in sql:
                yield Statement("ddl", "", sql=sql)
        elif kind in SKIPPED or kind == "SELECT" and "PG_CATALOG.SET_CONFIG" in sql.upper():
            continue
        else:
            raise DumpError(f"unexpected {kind} statement: {sql[:200]}")
    if not like_reference and (copying is not None or "".join(statement).strip()):
        raise DumpError(f"the dump ends inside {'COPY data' if copying is not None else 'a statement'}: {' '.join(statement)[:200]}")


# Statements of a session, which are left out.
_SESSION = ("SET ", "LOCK TABLES", "UNLOCK TABLES", "START TRANSACTION", "COMMIT", "USE ")


def mysql_statements(lines: Iterator[str], like_reference: bool = False, prefix: str = INTERNAL_PREFIX) -> Iterator[Statement]:
    """Statements of a mysqldump, in order; statements that cannot be read are left out."""
    statement: list[str] = []
    quotes = _Quotes("mysql")
    delimiter = ";"
    for line in lines:
        line = line.rstrip("\r\n")
        bare = line.strip()
        if not statement or like_reference:
            if not bare or bare.startswith(("--", "/*", "#")):
                continue
            if bare.upper().startswith("DELIMITER "):
                delimiter = bare[10:].strip()
                continue
            if bare.upper().startswith(_SESSION):
                continue
        statement.append(line)
        quotes.ends(line)
        if not bare.endswith(delimiter) or quotes.open and not like_reference:
            continue  # the statement goes on, perhaps inside a text
        sql = "\n".join(statement).strip().removesuffix(delimiter).strip()
        statement, quotes.open = [], ""
        if sql.upper().startswith("INSERT "):
            made = _insert(sql, "mysql", like_reference)
            if made and not made.table.lower().startswith(prefix) and made.rows:
                yield made
        elif sql.upper().startswith(("CREATE ", "ALTER ", "DROP ", "TRUNCATE ")):
            table = _named(sql)
            if not table.lower().startswith(prefix):
                yield Statement("ddl", table, sql=sql)
    if not like_reference and "".join(statement).strip():
        raise DumpError(f"the dump ends inside a statement: {' '.join(statement)[:200]}")


_SCHEMA = "file string, statement bigint, kind string, table string, columns array<string>, rows array<array<string>>, sql string, changes_before bigint"
_ARROW = pa.schema([("file", pa.string()), ("statement", pa.int64()), ("kind", pa.string()), ("table", pa.string()), ("columns", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("sql", pa.string()), ("changes_before", pa.int64())])


def _numbered(file: str, statements: Iterator[Statement]) -> Iterator[pa.RecordBatch]:
    """Statements of one file in batches, each with its number and that of the changes before it; inserts one after the other into the same columns go together."""
    held: list[list] = [[] for _ in _ARROW]
    before = size = number = 0
    last: tuple | None = None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(held, _ARROW)], schema=_ARROW)

    for s in statements:
        into = (s.table, s.columns) if s.kind == "dml" else None
        if into is not None and into == last:
            held[5][-1].extend(s.rows)
        else:
            for values, value in zip(held, (file, number, s.kind, s.table, list(s.columns), list(s.rows), s.sql, before)):
                values.append(value)
            number += 1
        last = into
        before, size = before + (len(s.rows) if s.kind == "dml" else 1), size + len(s.rows) + 1
        if size >= 10 * CHUNK:
            yield batch()
            held, size, last = [[] for _ in _ARROW], 0, None
    yield batch()


_PARSERS = {"pg": pg_statements, "mysql": mysql_statements}


def dump_statements(texts: DataFrame, dialect: str, like_reference: bool = False, prefix: str = INTERNAL_PREFIX) -> DataFrame:
    """Statements of dumps held as texts (columns ``file`` and ``text``), numbered within each file, with the number of changes before each."""
    parse = _PARSERS[dialect]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                yield from _numbered(file, parse(iter((text or "").split("\n")), like_reference, prefix))

    return texts.select("file", "text").mapInArrow(split, _SCHEMA)


def read_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files at a path: file, block (where the split begins), line (their order within it) and value.

    Files are read in splits like any other, so their size has no bound.
    """
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def dump_line_statements(lines: DataFrame, dialect: str, like_reference: bool = False, prefix: str = INTERNAL_PREFIX) -> DataFrame:
    """The same as ``dump_statements``, of lines: each file's lines come in order to one task, which holds one statement at a time."""
    parse = _PARSERS[dialect]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((f, v) for b in batches for f, v in zip(b.column("file").to_pylist(), b.column("value").to_pylist()))
        for file, group in groupby(pairs, key=lambda p: p[0]):
            yield from _numbered(file, parse((v for _, v in group), like_reference, prefix))

    order = ["file", "block", "line"]
    return lines.repartition("file").sortWithinPartitions(*order).select("file", "value").mapInArrow(split, _SCHEMA)


def statement_changes(statements: DataFrame, skip_tables: list[str] | None = None, only_tables: list[str] | None = None, max_rows_per_table: int = 0, empty_is_null: bool = True) -> DataFrame:
    """One insert per row and one change per schema statement, in bootstrap positions: position, type, dml, ddl.

    Positions follow files by name, then statements, then rows.  A row with
    more or fewer values than columns is an error unless no columns are named
    (``on error``: the row is left out).
    """
    if skip_tables:
        statements = statements.where(~F.coalesce(F.col("table"), F.lit("")).isin(*skip_tables))
    if only_tables:
        statements = statements.where(F.col("table").isin(*only_tables) | (F.col("kind") == "ddl"))
    count = F.when(F.col("kind") == "dml", F.size("rows")).otherwise(1)
    totals = statements.groupBy("file").agg(F.max(F.col("changes_before") + count).alias("total"))
    # Files are few beside their rows; their running total is a window over one row per file.
    start = totals.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = statements.join(start, "file").withColumn("first", F.col("start") + F.col("changes_before"))
    cells = lambda row: F.transform(row, lambda v: infer_cell(v, empty_is_null))
    rows = placed.where("kind = 'dml'").select("table", "columns", "first", F.posexplode("rows").alias("row_no", "row"))
    rows = rows.where((F.size("columns") == 0) | (F.size("columns") == F.size("row")))
    if max_rows_per_table:
        rank = Window.partitionBy("table").orderBy("first", "row_no")
        rows = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_rows_per_table)
    none_keys = F.lit(None).cast(f"struct<key_names:array<string>,key_values:array<{CELL.simpleString()}>>")
    dml = rows.select(
        (F.col("first") + F.col("row_no") + 1).alias("sequence"), F.lit("dml").alias("type"),
        F.struct(F.col("table"), F.col("columns").alias("column_names"), cells(F.col("row")).alias("column_values"), F.lit("insert").alias("kind"), none_keys.alias("old_keys")).alias("dml"),
        F.lit(None).cast("struct<id:int,time:string,username:string,database:string,ddl:string>").alias("ddl"),
    )
    ddl = placed.where("kind = 'ddl'").select(
        (F.col("first") + 1).alias("sequence"), F.lit("ddl").alias("type"), F.lit(None).cast(dml.schema["dml"].dataType).alias("dml"),
        F.struct((F.col("first") + 1).cast("int").alias("id"), F.lit(None).cast("string").alias("time"), F.lit("bootstrap").alias("username"), F.lit("unknown").alias("database"), F.col("sql").alias("ddl")).alias("ddl"),
    )
    return dml.unionByName(ddl).select(bootstrap_text(F.col("sequence")).alias("position"), "type", "dml", "ddl")


def load_dump(spark: SparkSession, path: str, dialect: str, max_rows_per_table: int = 0, skip_tables: list[str] | None = None, only_tables: list[str] | None = None, like_reference: bool = False) -> DataFrame:
    """The changes of the dump files at a path."""
    # Statements are read several times; files are parsed once.
    statements = written(dump_line_statements(read_dump_lines(spark, path), dialect, like_reference), "statements")
    return statement_changes(statements, skip_tables, only_tables, max_rows_per_table, empty_is_null=like_reference)


@dataclass(frozen=True)
class LoadReport:
    """What a load read: changes by type, those that were stored, those that could not be, and seconds."""

    rows: int
    statements: int
    stored: int
    failed: int
    seconds: float


def store_dump(changes: DataFrame, store: Callable[[DataFrame], None] | None, batch_size: int = 0, progress: Callable[[int, float], None] | None = None, continue_on_error: bool = False) -> LoadReport:
    """Hand the changes of a dump to ``store``, in order of position.

    With ``store`` None nothing is stored (a dry run): everything is read and
    converted all the same.  ``batch_size`` cuts the load into ranges of that
    many positions, each stored by itself; ``progress`` hears after each how
    many changes are through, and the changes per second.  A batch that fails
    ends the load, or with ``continue_on_error`` counts as failed.
    """
    began = time.monotonic()
    by_type = {r["type"]: r["count"] for r in changes.groupBy("type").count().collect()}  # at most two rows
    total = sum(by_type.values())
    stored = failed = 0
    if store is not None and total:
        numbered = changes.withColumn("__number", bootstrap_sequence(F.col("position")))
        last = numbered.agg(F.max("__number")).first()[0]
        size = batch_size or last
        for first in range(1, last + 1, size):
            batch = numbered.where(F.col("__number").between(first, first + size - 1)).drop("__number")
            here = batch.count()
            try:
                store(batch)
                stored += here
            except Exception:
                if not continue_on_error:
                    raise
                failed += here
            if progress:
                progress(stored + failed, (stored + failed) / max(time.monotonic() - began, 1e-9))
    return LoadReport(by_type.get("dml", 0), by_type.get("ddl", 0), stored, failed, time.monotonic() - began)
