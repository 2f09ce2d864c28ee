"""Queries of the replication operators: transforms, log, rendering, decoding, catalogue, state.

Inputs are derived from the star-schema and event tables; the SQL says the
same in plain terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import dialect, position, scalar
from ..functions.fakes import FAKES, fake_sql
from ..functions.template import compile_template
from ..model import CELL, cell, plain_text, tag
from ..operators import catalogue_queries, change_log, copydiff, latest_state, render, transforms
from ..sources import binlog, codec, dumps, infer, synthetic, tables, wal, wire
from ..sources.config import ColumnTransform, TransformConfig
from ..storage import shared_root, table, written
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL if there is one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def _masked(rows: DataFrame, columns: dict[str, ColumnTransform], on_error: str = "skip") -> DataFrame:
    return transforms.transform_table(rows, columns, on_error)


# Column transforms -----------------------------------------------------------------------------------------------


@query(r"SELECT c_custkey, regexp_replace(c_name, 'Customer#(\d{5})(\d+)', 'Customer#XXXXX\2', 'g') AS c_name FROM customer WHERE c_name IS NOT NULL")
def mask_regex_capture(spark, folder):
    spec = ColumnTransform("Regex", {"pattern": r"Customer#(\d{5})(\d+)", "replacement": "Customer#XXXXX$2"})
    return _masked(table(spark, folder, "customer").select("c_custkey", "c_name"), {"c_name": spec})


@query(r"SELECT doc_id, regexp_replace(text, '[[:digit:]]+', '#', 'g') AS text FROM documents WHERE text IS NOT NULL")
def mask_regex_multi(spark, folder):
    return _masked(table(spark, folder, "documents").select("doc_id", "text"), {"text": ColumnTransform("Regex", {"pattern": "[[:digit:]]+", "replacement": "#"})})


@query(r"SELECT p_partkey, regexp_replace(p_name, '^[^a-z]+$', 'x', 'g') AS p_name FROM part WHERE p_name IS NOT NULL")
def mask_regex_nomatch(spark, folder):
    return _masked(table(spark, folder, "part").select("p_partkey", "p_name"), {"p_name": ColumnTransform("Regex", {"pattern": "^[^a-z]+$", "replacement": "x"})})


@query("SELECT c_custkey, c_name, coalesce(lower(c_mktsegment), '<no value>') || '-' || c_custkey || '@example.com' AS c_mktsegment FROM customer")
def tmpl_concat(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return _masked(rows, {"c_mktsegment": ColumnTransform("Template", {"template": "{{.c_mktsegment | lower}}-{{.c_custkey}}@example.com"})})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> '' THEN 'status ' || o_orderstatus ELSE 'none' END || ': ' || coalesce(o_orderpriority, '<no value>') AS o_orderpriority, o_orderstatus FROM orders")
def tmpl_if_else(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return _masked(rows, {"o_orderpriority": ColumnTransform("Template", {"template": "{{if .o_orderstatus}}status {{.o_orderstatus}}{{else}}none{{end}}: {{.o_orderpriority}}"})})


@query("SELECT n_nationkey, '<no value> of ' || coalesce(n_name, '<no value>') AS n_name FROM nation")
def tmpl_missing_field(spark, folder):
    return _masked(table(spark, folder, "nation").select("n_nationkey", "n_name"), {"n_name": ColumnTransform("Template", {"template": "{{.capital}} of {{.n_name}}"})})


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def fn_slugify(spark, folder):
    return table(spark, folder, "part").select("p_partkey", scalar.slugify(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS head FROM part")
def fn_before(spark, folder):
    return table(spark, folder, "part").select("p_partkey", scalar.before(F.col("p_type"), " ").alias("head"))


@query("SELECT p_partkey, CASE WHEN p_type IS NULL THEN NULL WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, strpos(p_type, ' ') + 1) ELSE '' END AS rest FROM part")
def fn_after(spark, folder):
    return table(spark, folder, "part").select("p_partkey", scalar.after(F.col("p_type"), " ").alias("rest"))


@query("SELECT p_partkey, coalesce(lower(p_name), '<no value>') AS lower_name, coalesce(upper(p_name), '<NO VALUE>') AS upper_name FROM part")
def fn_lower_upper(spark, folder):
    fields = {"p_name": (F.col("p_name"), T.StringType())}
    return table(spark, folder, "part").select("p_partkey", compile_template("{{.p_name | lower}}", fields).alias("lower_name"), compile_template("{{upper .p_name}}", fields).alias("upper_name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderstatus = 'P' THEN 'done' WHEN o_orderstatus IS NOT NULL AND o_totalprice > 1000.5 THEN 'large' ELSE 'open' END AS state,
    lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '/' || length(coalesce(o_orderpriority, '<no value>')) AS label, coalesce('[' || nullif(o_orderpriority, '') || ']', 'none') AS priority FROM orders""")
def tmpl_functions(spark, folder):
    rows = table(spark, folder, "orders")
    fields = {f.name: (F.col(f.name), f.dataType) for f in rows.schema.fields}
    state = '{{if eq .o_orderstatus "F" "P"}}done{{else if and (not (eq .o_orderstatus "F")) .o_orderstatus (gt .o_totalprice 1000.5)}}large{{else}}open{{end}}'
    templates = {"state": state, "label": '{{$key := printf "%08d" .o_orderkey}}{{$key}}/{{len .o_orderpriority}}', "priority": "{{with .o_orderpriority}}[{{.}}]{{else}}none{{end}}"}
    return rows.select("o_orderkey", *[compile_template(t, fields).alias(n) for n, t in templates.items()])


@query(r"""WITH one AS (SELECT c_custkey, regexp_replace(c_name, '\d+', 'N', 'g') AS c_name, c_mktsegment FROM customer WHERE c_name IS NOT NULL)
SELECT c_custkey, c_name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '.' || c_custkey || '@example.com' AS c_mktsegment FROM one""")
def two_pass_template(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return _masked(rows, {"c_name": ColumnTransform("Regex", {"pattern": r"\d+", "replacement": "N"}), "c_mktsegment": ColumnTransform("Template", {"template": "{{.c_name | slugify}}.{{.c_custkey}}@example.com"})})


@query("""SELECT n_nationkey, 'a ' || coalesce(n_name, '<no value>') AS n_name, 'b a ' || coalesce(n_name, '<no value>') AS note FROM nation""")
def two_pass_chain(spark, folder):
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name", F.col("n_name").alias("note"))
    return _masked(rows, {"n_name": ColumnTransform("Template", {"template": "a {{.n_name}}"}), "note": ColumnTransform("Template", {"template": "b {{.n_name}}"})})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def passthrough(spark, folder):
    return _masked(table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey"), {})


@query("SELECT o_orderkey, 'masked' AS o_orderstatus FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END IS NOT NULL")
def skip_on_type_error(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return _masked(rows, {"o_orderstatus": ColumnTransform("Regex", {"pattern": "^.*$", "replacement": "masked"})})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderstatus IS NULL THEN NULL ELSE 'masked' END AS o_orderstatus FROM orders")
def null_error_mode(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return _masked(rows, {"o_orderstatus": ColumnTransform("Regex", {"pattern": "^.*$", "replacement": "masked"})}, "null")


_FNV = "CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, [ascii_byte::HUGEINT FOR ascii_byte IN {bytes}]), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS VARCHAR)"


@query(
    "SELECT n_nationkey, " + _FNV.format(bytes="[ord(substr(n_name, CAST(i AS INTEGER), 1)) FOR i IN range(1, length(n_name) + 1)]") + " AS seed FROM nation WHERE n_name IS NOT NULL UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_name IS NULL"
)
def seed_hash_fnv1a(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", scalar.seed_hash(F.col("n_name")).cast("string").alias("seed"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS filled FROM orders WHERE o_orderstatus IS NOT NULL")
def bool_transform(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("filled"))
    return _masked(rows, {"filled": ColumnTransform("Bool")})


def _fake_query(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        source = {"bigint": F.col("c_custkey"), "double": F.col("c_custkey").cast("double")}.get(FAKES[kind][1], F.col("c_name"))
        rows = table(spark, folder, "customer").select("c_custkey", source.alias("value"))
        return _masked(rows, {"value": ColumnTransform(kind)})

    return run


for _kind, (_, _type) in FAKES.items():
    _name = "fake_" + _kind.removeprefix("Fake").lower()
    _source = {"bigint": "CAST(c_custkey AS VARCHAR)", "double": "CAST(CAST(c_custkey AS DOUBLE) AS VARCHAR)"}.get(_type, "c_name")
    query(f"SELECT c_custkey, {fake_sql(_kind, _source)} AS value FROM customer WHERE {_source} IS NOT NULL", _name)(_fake_query(_kind))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 32) AS salt FROM customer")
def salt_sha256(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", scalar.salt(F.col("c_name")).alias("salt"))


def _password_query(kind: str, options: dict):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("password"))
        return _masked(rows.repartition(4), {"password": ColumnTransform(kind, {"cleartext": "secret-{{.n_nationkey}}", **options})})

    return run


QUERIES |= {
    "password_pbkdf2": _password_query("PasswordPBKDF2", {"iterations": 1000}),
    "password_scrypt": _password_query("PasswordScrypt", {"n": 1024, "r": 8, "p": 1}),
    "password_argon2id": _password_query("PasswordArgon2id", {"time": 1, "memory": 64, "threads": 1}),
    "password_bcrypt": _password_query("PasswordBcrypt", {"cost": 4}),
}

# Positions and the log -----------------------------------------------------------------------------------------------

_BINLOG = "'mysql-bin.' || lpad(CAST(event_id // 1000 + 1 AS VARCHAR), 6, '0') || ':' || CAST(event_id % 1000 * 100 + 4 AS VARCHAR)"
_BINLOG_SCORE = "((event_id // 1000 + 1) * 4294967296 + event_id % 1000 * 100 + 4)"


def _binlog_position() -> Column:
    return position.binlog_position(F.concat(F.lit("mysql-bin."), F.lpad((F.floor(F.col("event_id") / 1000) + 1).cast("string"), 6, "0")), F.col("event_id") % 1000 * 100 + 4)


def log_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """One insert per event, with position, exact score and JSON payload."""
    names = F.array(F.lit("event_id"), F.lit("user_id"), F.lit("event_type"))
    values = F.array(cell(int_value=F.col("event_id")), cell(int_value=F.col("user_id")), cell(string_value=F.col("event_type")))
    payload = codec.encode_dml(_binlog_position(), F.lit("events"), names, values, F.lit("insert"), F.lit(None).cast("array<string>"), F.lit(None).cast(f"array<{CELL.simpleString()}>"))
    return change_log.scored(table(spark, folder, "events").select("event_id", _binlog_position().alias("position"), payload.alias("payload")))


_PAYLOAD = f"""'{{"type":"dml","position":"' || {_BINLOG} || '","data":{{"table":"events","columnnames":["event_id","user_id","event_type"],"columnvalues":[' || event_id || ',' || coalesce(CAST(user_id AS VARCHAR), 'null') || ',' || coalesce('"' || event_type || '"', 'null') || '],"kind":"insert"}}}}'"""
_LOG = f"SELECT event_id, {_BINLOG} AS position, {_PAYLOAD} AS payload, {_BINLOG_SCORE} AS score FROM events"


@query("SELECT event_id, printf('%X', event_id * 77777 // 4294967296) || '/' || printf('%X', event_id * 77777 % 4294967296) AS position, event_id * 77777 AS score FROM events")
def position_score_pg(spark, folder):
    n = F.col("event_id") * 77777
    text = F.concat(F.hex(F.floor(n / 4294967296)), F.lit("/"), F.hex(n % 4294967296))
    return table(spark, folder, "events").select("event_id", text.alias("position"), position.score(text).alias("score"))


@query(f"SELECT event_id, {_BINLOG} AS position, CAST({_BINLOG_SCORE} AS BIGINT) AS score FROM events")
def position_score_mysql(spark, folder):
    return table(spark, folder, "events").select("event_id", _binlog_position().alias("position"), position.score(_binlog_position()).alias("score"))


@query("SELECT event_id, '0/BOOTSTRAP' || lpad(CAST(event_id AS VARCHAR), 16, '0') AS position, event_id - 1000000 AS score, event_id AS sequence FROM events")
def position_score_bootstrap(spark, folder):
    text = position.bootstrap_text(F.col("event_id"))
    return table(spark, folder, "events").select("event_id", text.alias("position"), position.score(text).alias("score"), position.bootstrap_sequence(text).alias("sequence"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN -1 ELSE sign(event_id - 500) END AS INTEGER) AS compared FROM events")
def position_compare(spark, folder):
    lsn = lambda c: F.concat(F.lit("0/"), F.hex(c))
    left = F.when(F.col("event_id") % 3 == 0, position.bootstrap_text(F.col("event_id"))).otherwise(lsn(F.col("event_id")))
    return table(spark, folder, "events").select("event_id", position.compare(left, lsn(F.lit(500))).alias("compared"))


@query("SELECT o_orderkey, '0/BOOTSTRAP' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 16, '0') AS position FROM orders")
def position_generate(spark, folder):
    return change_log.with_bootstrap_positions(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT event_id, position, score FROM ({_LOG}) WHERE score > 2 * 4294967296 + 50004")
def log_range_after(spark, folder):
    return change_log.after(log_of_events(spark, folder), "mysql-bin.000002:50004").select("event_id", "position", "score")


@query(f"SELECT event_id, position, score FROM ({_LOG}) WHERE score > 4294967296 + 50004 ORDER BY score, payload LIMIT 100 OFFSET 200")
def log_page(spark, folder):
    return change_log.page(log_of_events(spark, folder), "mysql-bin.000001:50004", 200, 100).select("event_id", "position", "score")


@query(f"SELECT event_id, position, score FROM ({_LOG})")
def log_bootstrap_all(spark, folder):
    return change_log.after(log_of_events(spark, folder), "bootstrap").select("event_id", "position", "score")


@query(f"SELECT event_id, payload FROM ({_LOG})")
def log_dedup(spark, folder):
    log = log_of_events(spark, folder)
    return change_log.once(log.unionByName(log.where("event_id % 3 = 0"))).select("event_id", "payload")


@query(f"SELECT event_id, payload AS json FROM ({_LOG})")
def json_encode(spark, folder):
    return log_of_events(spark, folder).select("event_id", F.col("payload").alias("json"))


@query(f"SELECT event_id, {_BINLOG} AS position, 'events' AS table_name, 'int' AS id_tag, event_id AS id_value, CASE WHEN event_type IS NOT NULL THEN 'string' END AS type_tag, event_type AS type_value FROM events")
def json_decode_types(spark, folder):
    read = log_of_events(spark, folder).select("event_id", codec.decode(F.col("payload")).alias("c"))
    first, third = F.get("c.dml.column_values", F.lit(0)), F.get("c.dml.column_values", F.lit(2))
    return read.select("event_id", "c.position", F.col("c.dml.table").alias("table_name"), tag(first).alias("id_tag"), first["int_value"].alias("id_value"), tag(third).alias("type_tag"), third["string_value"].alias("type_value"))


@query("SELECT dml_kind AS kind, change_type AS type, count(*) AS changes FROM change_log GROUP BY ALL")
def run_statistics(spark, folder):
    log = table(spark, folder, "change_log").select(F.col("change_type").alias("type"), F.col("dml_kind").alias("kind"))
    return change_log.statistics(log)


@query("SELECT dml_table, min(delivery_id) AS first_score FROM change_log GROUP BY dml_table")
def tables_found(spark, folder):
    return change_log.tables_found(table(spark, folder, "change_log"), order="delivery_id")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def ddl_retention_7d(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return change_log.retained(events, "ts", events.agg(F.max("ts")).first()[0])


# Rendering -----------------------------------------------------------------------------------------------------------


def _dml(kind: str, name: str, columns: dict[str, Column], keys: dict[str, Column] | None) -> Column:
    cells = lambda cs: F.array(*cs.values()) if cs else F.array().cast(f"array<{CELL.simpleString()}>")
    texts = lambda cs: F.array(*[F.lit(c) for c in cs]) if cs else F.array().cast("array<string>")
    old = F.struct(texts(keys).alias("key_names"), cells(keys).alias("key_values")) if keys is not None else F.lit(None).cast(f"struct<key_names:array<string>,key_values:array<{CELL.simpleString()}>>")
    return F.struct(F.lit(name).alias("table"), texts(columns).alias("column_names"), cells(columns).alias("column_values"), F.lit(kind).alias("kind"), old.alias("old_keys"))


_int, _float, _string, _bool = (lambda c: cell(int_value=F.col(c))), (lambda c: cell(float_value=F.col(c))), (lambda c: cell(string_value=F.col(c))), (lambda c: cell(bool_value=c))
_stamp = lambda c: cell(timestamp_value=F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query("""SELECT o_orderkey, 'INSERT INTO orders (o_orderkey, o_orderstatus, o_totalprice, o_orderdate) VALUES (' || o_orderkey || ', ' || coalesce('''' || replace(o_orderstatus, '''', '''''') || '''', 'NULL') || ', ' ||
coalesce(printf('%f', o_totalprice), 'NULL') || ', ' || coalesce('''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '''', 'NULL') || ');' AS sql FROM orders""")
def render_insert(spark, folder):
    columns = {"o_orderkey": _int("o_orderkey"), "o_orderstatus": _string("o_orderstatus"), "o_totalprice": _float("o_totalprice"), "o_orderdate": _stamp("o_orderdate")}
    return table(spark, folder, "orders").select("o_orderkey", render.render_dml(_dml("insert", "orders", columns, None))["sql"].alias("sql"))


@query("""SELECT o_orderkey, 'UPDATE orders SET o_orderstatus = ' || coalesce('''' || o_orderstatus || '''', 'NULL') || ' WHERE o_orderkey = ' || o_orderkey || ';' AS sql FROM orders""")
def render_update(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", render.render_dml(_dml("update", "orders", {"o_orderstatus": _string("o_orderstatus")}, {"o_orderkey": _int("o_orderkey")}))["sql"].alias("sql"))


@query("SELECT o_orderkey, 'DELETE FROM orders WHERE o_orderkey = ' || o_orderkey || ';' AS sql FROM orders")
def render_delete(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", render.render_dml(_dml("delete", "orders", {}, {"o_orderkey": _int("o_orderkey")}))["sql"].alias("sql"))


@query("SELECT l_orderkey, l_linenumber, 'UPDATE lineitem SET l_quantity = ' || coalesce(printf('%f', l_quantity), 'NULL') || ' WHERE l_orderkey = ' || l_orderkey || ' AND l_linenumber = ' || l_linenumber || ';' AS sql FROM lineitem")
def render_composite_key(spark, folder):
    keys = {"l_orderkey": _int("l_orderkey"), "l_linenumber": _int("l_linenumber")}
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", render.render_dml(_dml("update", "lineitem", {"l_quantity": _float("l_quantity")}, keys))["sql"].alias("sql"))


@query("""SELECT p_partkey, 'INSERT INTO part (p_name, large) VALUES (' || coalesce('''' || replace(replace(p_name, '\\', '\\\\'), '''', '''''') || '''', 'NULL') || ', ' || CASE WHEN p_size > 25 THEN '1' WHEN p_size <= 25 THEN '0' ELSE 'NULL' END || ');' AS sql FROM part""")
def render_mysql_bool(spark, folder):
    columns = {"p_name": _string("p_name"), "large": _bool(F.col("p_size") > 25)}
    return table(spark, folder, "part").select("p_partkey", render.render_dml(_dml("insert", "part", columns, None), "mysql")["sql"].alias("sql"))


@query(r"""WITH checked AS (SELECT *,
    len(list_filter(list_concat(CASE WHEN dml_kind <> 'delete' THEN coalesce(column_values, []) ELSE [] END, CASE WHEN dml_kind <> 'insert' THEN coalesce(old_key_values, []) ELSE [] END), lambda v: v.timestamp_value IS NOT NULL AND NOT coalesce(
        regexp_matches(v.timestamp_value, '^\d{4}-\d{2}-\d{2}$') AND TRY_CAST(v.timestamp_value AS DATE) IS NOT NULL
        OR regexp_matches(v.timestamp_value, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$') AND TRY_CAST(replace(substr(v.timestamp_value, 1, 19), 'T', ' ') AS TIMESTAMP) IS NOT NULL, FALSE))) AS bad_times FROM change_log)
SELECT * FROM (SELECT delivery_id, CASE
    WHEN dml_kind NOT IN ('insert', 'update', 'delete') THEN 'unsupported kind: ' || dml_kind
    WHEN dml_kind <> 'delete' AND len(column_names) <> len(column_values) THEN 'numbers of names and values differ'
    WHEN dml_kind <> 'insert' AND coalesce(len(old_key_names), 0) = 0 THEN dml_kind || ' without keys'
    WHEN bad_times > 0 THEN 'invalid timestamp' END AS error FROM checked) WHERE error IS NOT NULL""")
def render_errors(spark, folder):
    log = table(spark, folder, "change_log")
    keys = F.when(F.col("old_key_names").isNotNull(), F.struct(F.col("old_key_names").alias("key_names"), F.col("old_key_values").alias("key_values")))
    dml = F.struct(F.col("dml_table").alias("table"), "column_names", "column_values", F.col("dml_kind").alias("kind"), keys.alias("old_keys"))
    return log.select("delivery_id", render.render_dml(dml)["error"].alias("error")).where("error is not null")


@query("""SELECT n_nationkey, '"' || replace(n_name, '"', '""') || '"' AS pg_name, '`' || replace(n_name, '`', '``') || '`' AS mysql_name, '''' || replace('public.' || n_name, '''', '''''') || '''' AS class_name FROM nation""")
def fn_identifiers(spark, folder):
    n = F.col("n_name")
    return table(spark, folder, "nation").select("n_nationkey", dialect.identifier(n, "postgresql").alias("pg_name"), dialect.identifier(n, "mysql").alias("mysql_name"), dialect.regclass(F.lit("public"), n).alias("class_name"))


@query("""SELECT o_orderkey, '''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '''' AS moment, '''' || strftime(o_orderdate, '%Y-%m-%d') || '''' AS day FROM orders""")
def fn_timestamp_literal(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", dialect.moment(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).alias("moment"), dialect.moment(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("""SELECT s_suppkey, 'mysql' AS dialect, 'u' || s_suppkey || ':pw@tcp(db' || s_suppkey || ':3306)/shop?tls=true' AS dsn, 'db' || s_suppkey AS host, '3306' AS port FROM supplier""")
def fn_url_parts(spark, folder):
    url = F.concat(F.lit("mysql://u"), F.col("s_suppkey").cast("string"), F.lit(":pw@db"), F.col("s_suppkey").cast("string"), F.lit("/shop?tls=true"))
    parts = scalar.mysql_url_parts(url)
    return table(spark, folder, "supplier").select("s_suppkey", scalar.dialect_of_url(url).alias("dialect"), scalar.mysql_dsn(url).alias("dsn"), parts["host"].alias("host"), parts["port"].alias("port"))


@query("""SELECT id AS row_id, array_extract(string_split(id, '-'), -1) AS last_part, right(id, 8) AS last_characters FROM (SELECT DISTINCT trim(id) AS id FROM users WHERE id IS NOT NULL)""")
def fn_id_parts(spark, folder):
    ids = table(spark, folder, "users").where("id is not null").select(F.trim("id").alias("row_id")).distinct()
    return ids.select("row_id", scalar.last_segment(F.col("row_id")).alias("last_part"), scalar.last_characters(F.col("row_id")).alias("last_characters"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE strftime(ts, '%Y-%m-%d') END AS age
FROM (SELECT event_id, ts, CAST(floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def fn_relative_time(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", scalar.relative_time(F.col("ts"), F.lit(events.agg(F.max("ts")).first()[0])).alias("age"))


# Decoding ------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'bool' WHEN 2 THEN 'timestamp' ELSE CASE WHEN event_type <> '' THEN 'string' END END AS tag,
    CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CASE WHEN event_id % 8 = 1 THEN 'true' ELSE 'false' END WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' ELSE nullif(event_type, '') END AS value FROM events""")
def wal_decode_types(spark, folder):
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.col("event_id").cast("string")).when(kind == 1, F.when(F.col("event_id") % 8 == 1, "t").otherwise("f")).when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.col("event_type"))
    oid = F.when(kind == 0, wal.INT4).when(kind == 1, wal.BOOL).when(kind == 2, wal.TIMESTAMP).otherwise(25)
    made = wal.decode_cell(text, oid)["cell"]
    value = F.coalesce(made["string_value"], made["int_value"].cast("string"), made["bool_value"].cast("string"), made["timestamp_value"])
    return table(spark, folder, "events").select("event_id", tag(made).alias("tag"), value.alias("value"))


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """A replication stream about orders: the relation, then an insert, an update of the status and a delete for some."""
    column = lambda name, oid, flags: F.struct(F.lit(name).alias("name"), F.lit(oid).alias("oid"), F.lit(flags).alias("flags"))
    columns = F.array(column("o_orderkey", wal.INT8, 1), column("o_orderstatus", 25, 0), column("o_totalprice", wal.FLOAT8, 0))
    relation = spark.range(1).select(F.lit(0).cast("bigint").alias("seq"), F.lit("XLogData").alias("frame"), F.lit("0/0").alias("lsn"), F.lit("relation").alias("message"), F.lit(1).alias("relation_id"), F.lit("public").alias("namespace"), F.lit("orders").alias("name"), columns.alias("columns"), F.lit(None).cast("array<string>").alias("new_tuple"), F.lit(None).cast("array<string>").alias("old_tuple"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("bigint").cast("string").alias("price"))
    key = F.col("o_orderkey").cast("string")
    row, changed = F.array(key, F.col("o_orderstatus"), F.col("price")), F.array(key, F.lit("X"), F.col("price"))

    def frame(n: int, message: str, new: Column, old: Column, frame: str = "XLogData") -> DataFrame:
        seq = F.col("o_orderkey") * 10 + n
        none = F.lit(None)
        return orders.select(seq.alias("seq"), F.lit(frame).alias("frame"), F.concat(F.lit("0/"), F.hex(seq)).alias("lsn"), F.lit(message).alias("message"), F.lit(1).alias("relation_id"), none.cast("string").alias("namespace"), none.cast("string").alias("name"), none.cast(relation.schema["columns"].dataType).alias("columns"), new.cast("array<string>").alias("new_tuple"), old.cast("array<string>").alias("old_tuple"))

    none = F.lit(None)
    return relation.unionByName(frame(1, "insert", row, none)).unionByName(frame(2, "update", changed, row).where("seq % 30 = 2")).unionByName(frame(3, "delete", none, changed).where("seq % 70 = 3")).unionByName(frame(4, "begin", none, none)).unionByName(frame(5, "insert", row, none, "keepalive"))


@query("""SELECT '0/' || printf('%X', o_orderkey * 10 + 1) AS position, 'public.orders' AS table_name, 'insert' AS kind, ['o_orderkey', 'o_orderstatus', 'o_totalprice'] AS names, [CAST(o_orderkey AS VARCHAR), o_orderstatus] AS first_values, trunc(o_totalprice) AS price, CAST(NULL AS VARCHAR[]) AS key_names, CAST(NULL AS VARCHAR[]) AS key_values FROM orders
UNION ALL SELECT '0/' || printf('%X', o_orderkey * 10 + 2), 'public.orders', 'update', ['o_orderstatus'], ['X'], NULL, ['o_orderkey'], [CAST(o_orderkey AS VARCHAR)] FROM orders WHERE (o_orderkey * 10 + 2) % 30 = 2 AND o_orderstatus IS NOT NULL
UNION ALL SELECT '0/' || printf('%X', o_orderkey * 10 + 3), 'public.orders', 'delete', [], [], NULL, ['o_orderkey'], [CAST(o_orderkey AS VARCHAR)] FROM orders WHERE (o_orderkey * 10 + 3) % 70 = 3""")
def wal_changes(spark, folder):
    made = wal.wal_changes(_frames(spark, folder))
    values = F.col("dml.column_values")
    return made.select(
        "position", F.col("dml.table").alias("table_name"), "dml.kind", F.col("dml.column_names").alias("names"), F.transform(F.slice(values, 1, 2), plain_text).alias("first_values"), F.get(values, F.lit(2))["float_value"].alias("price"),
        F.col("dml.old_keys.key_names").alias("key_names"), F.transform("dml.old_keys.key_values", plain_text).alias("key_values"),
    )


@query("""SELECT 'bin.000001:' || o_orderkey AS position, CAST(r AS INTEGER) AS row_no, CASE o_orderkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS kind,
    CASE o_orderkey % 3 WHEN 0 THEN ['o_orderkey', 'o_orderstatus'] WHEN 1 THEN ['o_orderstatus'] ELSE [] END AS names, CASE o_orderkey % 3 WHEN 0 THEN [CAST(o_orderkey AS VARCHAR), o_orderstatus] WHEN 1 THEN ['X'] ELSE [] END AS new_values,
    CASE WHEN o_orderkey % 3 <> 0 THEN ['o_orderkey'] END AS key_names, CASE WHEN o_orderkey % 3 <> 0 THEN [CAST(o_orderkey AS VARCHAR)] END AS key_values FROM orders, range(2) t(r) WHERE o_orderkey % 3 <> 1 OR r = 0""")
def binlog_changes(spark, folder):
    """Row events with values as the server sends them."""
    key = F.col("o_orderkey").cast("string")
    row = F.array(key, F.col("o_orderstatus"))
    action = F.when(F.col("o_orderkey") % 3 == 0, "insert").when(F.col("o_orderkey") % 3 == 1, "update").otherwise("delete")
    rows = F.when(F.col("o_orderkey") % 3 == 1, F.array(row, F.array(key, F.lit("X")), row)).otherwise(F.array(row, row))
    events = table(spark, folder, "orders").select(F.lit("bin.000001").alias("file"), F.col("o_orderkey").alias("offset"), action.alias("action"), F.lit("orders").alias("table"), F.array(F.lit("o_orderkey"), F.lit("o_orderstatus")).alias("columns"), F.array(F.lit("bigint"), F.lit("varchar(1)")).alias("column_types"), F.array(F.lit("o_orderkey")).alias("key_columns"), rows.alias("rows"))
    made = binlog.binlog_changes(binlog.typed_rows(events))
    return made.select("position", "row_no", "dml.kind", F.col("dml.column_names").alias("names"), F.transform("dml.column_values", plain_text).alias("new_values"), F.col("dml.old_keys.key_names").alias("key_names"), F.transform("dml.old_keys.key_values", plain_text).alias("key_values"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'timestamp' WHEN 3 THEN 'string' WHEN 4 THEN 'int' ELSE CASE WHEN event_type IS NOT NULL THEN 'string' END END AS tag,
    CASE event_id % 6 WHEN 0 THEN CAST(-event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 3 THEN CAST(event_id AS VARCHAR) || '.50' WHEN 4 THEN CAST(event_id - 1000 AS VARCHAR) ELSE event_type END AS value FROM events""")
def mysql_decode_types(spark, folder):
    """Values of six column types; unsigned numbers beyond 63 bits wrap."""
    kind = F.col("event_id") % 6
    number = F.col("event_id").cast("string")
    unsigned = F.col("event_id").cast("decimal(20,0)") - F.lit(1000)
    text = (
        F.when(kind == 0, F.concat(F.lit("-"), number)).when(kind == 1, F.concat(number, F.lit(".5"))).when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(kind == 3, F.concat(number, F.lit(".50")))
        .when(kind == 4, F.when(unsigned < 0, unsigned + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(unsigned).cast("decimal(20,0)").cast("string")).otherwise(F.col("event_type"))
    )
    types = F.when(kind == 0, "int(11)").when(kind == 1, "double").when(kind == 2, "datetime(6)").when(kind == 3, "decimal(10,2)").when(kind == 4, "bigint(20) unsigned").otherwise("enum_text")
    made = binlog.decode_cell(text, types)
    return table(spark, folder, "events").select("event_id", tag(made).alias("tag"), plain_text(made).alias("value"))


@query("SELECT log_id, ddl_text FROM ddl_log WHERE regexp_matches(trim(ddl_text), '(?i)^(CREATE|ALTER|DROP|RENAME|TRUNCATE)')")
def ddl_filter(spark, folder):
    return table(spark, folder, "ddl_log").where(dumps.is_ddl(F.col("ddl_text"))).select("log_id", "ddl_text")


def _statement_list(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    own = F.when(F.col("n_nationkey") % 2 == 0, dumps.INTERNAL_PREFIX).otherwise("")
    kinds = [
        ("CREATE TABLE public.{}t{} (id int);", "CREATE_TABLE"), ("CREATE FUNCTION {}f{}() RETURNS trigger;", "CREATE_FUNCTION"), ("CREATE TRIGGER {}g{} AFTER INSERT ON public.x;", "CREATE_TRIGGER"),
        ("ALTER TABLE ONLY public.{}t{} ADD PRIMARY KEY (id);", "ALTER_TABLE"), ("GRANT SELECT ON public.{}t{} TO reader;", "GRANT"), ("SET statement_timeout = 0; -- {}{}", "SET"),
    ]
    parts = None
    for i, (text, kind) in enumerate(kinds):
        head, middle, tail = text.split("{}")
        part = table(spark, folder, "nation").select((F.col("n_nationkey") * 10 + i).alias("statement_id"), F.concat(F.lit(head), own, F.lit(middle), n, F.lit(tail)).alias("sql"), F.lit(kind).alias("expected"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("""SELECT n_nationkey * 10 + i AS statement_id, CASE i WHEN 0 THEN 'CREATE_TABLE' WHEN 1 THEN 'CREATE_FUNCTION' WHEN 2 THEN 'CREATE_TRIGGER' WHEN 3 THEN 'ALTER_TABLE' WHEN 4 THEN 'GRANT' ELSE 'SET' END AS kind, CASE WHEN i = 5 THEN 'skip' ELSE 'ddl' END AS route FROM nation, range(6) t(i)""")
def statement_classifier(spark, folder):
    return _statement_list(spark, folder).select("statement_id", dumps.statement_kind(F.col("sql")).alias("kind"), dumps.statement_route(F.col("sql")).alias("route"))


@query("SELECT n_nationkey * 10 + i AS statement_id FROM nation, range(6) t(i) WHERE n_nationkey % 2 = 1 OR i = 5")
def internal_object_filter(spark, folder):
    return _statement_list(spark, folder).where(~dumps.is_internal(F.col("sql"))).select("statement_id")


@query(r"""SELECT event_id, CASE WHEN regexp_matches(t, '^-?[0-9]+$') THEN 'int' WHEN regexp_matches(t, '^-?[0-9]+\.[0-9]+$') THEN 'float' WHEN t IN ('true', 'false', 't', 'f') THEN 'bool' WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$') THEN 'timestamp' WHEN t <> '' THEN 'string' END AS tag
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 2 THEN 'true' WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN '' ELSE 'x' || event_id END AS t FROM events)""")
def infer_types(spark, folder):
    kind = F.col("event_id") % 6
    number = F.col("event_id").cast("string")
    text = F.when(kind == 0, number).when(kind == 1, F.concat(number, F.lit(".5"))).when(kind == 2, "true").when(kind == 3, F.date_format("ts", "yyyy-MM-dd")).when(kind == 4, "").otherwise(F.concat(F.lit("x"), number))
    return table(spark, folder, "events").select("event_id", tag(infer.infer_cell(text)).alias("tag"))


@query(r"""SELECT n_nationkey, n_name || chr(9) || n_name || chr(10) || 'end' AS value FROM nation""")
def copy_unescape(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", infer.unescape_copy(F.concat("n_name", F.lit("\\t"), "n_name", F.lit("\\nend"))).alias("value"))


def _row_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as a statement of a dump, into a table of its supplier."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    return table(spark, folder, "lineitem").select(
        F.lit("lines.sql").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("statement"), F.lit("dml").alias("kind"), F.concat(F.lit("s"), text("l_suppkey")).alias("table"), F.array(F.lit("l_orderkey"), F.lit("l_linenumber")).alias("columns"),
        F.array(F.array(text("l_orderkey"), text("l_linenumber"))).alias("rows"), none.alias("sql"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("changes_before"),
    )


def _statement_rows(changes: DataFrame) -> DataFrame:
    value = lambda i: F.get("dml.column_values", F.lit(i))["int_value"]
    return changes.select(value(0).alias("l_orderkey"), value(1).alias("l_linenumber"), F.col("dml.table").alias("table_name"))


@query("SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS table_name FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 3")
def limit_per_table(spark, folder):
    return _statement_rows(dumps.statement_changes(_row_statements(spark, folder), max_rows_per_table=3))


@query("SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS table_name FROM lineitem WHERE l_suppkey IN (2, 3)")
def only_and_skipped_tables(spark, folder):
    return _statement_rows(dumps.statement_changes(_row_statements(spark, folder), skip_tables=["s1"], only_tables=["s1", "s2", "s3"]))


def _dump(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A dump of the nations as text, made by the engine itself: a table definition, then COPY data or an extended INSERT."""
    rows = table(spark, folder, "nation").select(F.struct("n_nationkey", "n_name").alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))  # 25 rows, fixed
    if kind == "pg":
        body = F.concat(F.lit("COPY public.nation (n_nationkey, n_name) FROM stdin;\n"), F.array_join(F.transform("rows", lambda r: F.concat(r["n_nationkey"].cast("string"), F.lit("\t"), F.coalesce(r["n_name"], F.lit("\\N")))), "\n"), F.lit("\n\\.\n"))
        head = "--\n-- dump\n--\nSET client_encoding = 'UTF8';\nCREATE TABLE public.nation (\n    n_nationkey integer,\n    n_name text\n);\n"
    else:
        body = F.concat(F.lit("INSERT INTO `nation` (`n_nationkey`, `n_name`) VALUES "), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("("), r["n_nationkey"].cast("string"), F.lit(","), F.coalesce(dialect.quoted(r["n_name"], "mysql"), F.lit("NULL")), F.lit(")"))), ","), F.lit(";\n"))
        head = "/*!40101 SET NAMES utf8 */;\nDROP TABLE IF EXISTS `nation`;\nCREATE TABLE `nation` (`n_nationkey` int, `n_name` text);\n"
    return rows.select(F.lit("nation.sql").alias("file"), F.concat(F.lit(head), body).alias("text"))


def _dumped(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    changes = dumps.statement_changes(dumps.dump_statements(_dump(spark, folder, kind), kind))
    values = F.transform("dml.column_values", lambda v: F.coalesce(v["int_value"].cast("string"), v["string_value"]))
    return changes.select("position", "type", F.col("dml.table").alias("table_name"), values.alias("row_values"))


@query("""SELECT '0/BOOTSTRAP0000000000000001' AS position, 'ddl' AS type, CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR[]) AS row_values
UNION ALL SELECT '0/BOOTSTRAP' || lpad(CAST(1 + row_number() OVER (ORDER BY n_nationkey) AS VARCHAR), 16, '0'), 'dml', 'public.nation', [CAST(n_nationkey AS VARCHAR), n_name] FROM nation""")
def dump_pg_to_changes(spark, folder):
    return _dumped(spark, folder, "pg")


@query("""SELECT '0/BOOTSTRAP' || lpad(CAST(i AS VARCHAR), 16, '0') AS position, 'ddl' AS type, CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR[]) AS row_values FROM range(1, 3) t(i)
UNION ALL SELECT '0/BOOTSTRAP' || lpad(CAST(2 + row_number() OVER (ORDER BY n_nationkey) AS VARCHAR), 16, '0'), 'dml', 'nation', [CAST(n_nationkey AS VARCHAR), n_name] FROM nation""")
def dump_mysql_to_changes(spark, folder):
    return _dumped(spark, folder, "mysql")


# Relational queries --------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5")
def topk_by_id(spark, folder):
    return catalogue_queries.top_rows(table(spark, folder, "customer"), ["c_custkey", "c_name", "c_acctbal"], "c_custkey", 5)


@query("SELECT 'seq_' || n_nationkey AS sequence, r_name AS schema, n_name AS \"table\", 'id' AS \"column\" FROM nation JOIN region ON r_regionkey = n_regionkey")
def catalog_sequence_join(spark, folder):
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    tables = nation.select((F.col("n_nationkey") + 1000).alias("oid"), F.col("n_name").alias("relname"), F.lit("r").alias("relkind"), F.col("n_regionkey").alias("relnamespace"))
    sequences = nation.select((F.col("n_nationkey") + 5000).alias("oid"), F.concat(F.lit("seq_"), F.col("n_nationkey").cast("string")).alias("relname"), F.lit("S").alias("relkind"), F.col("n_regionkey").alias("relnamespace"))
    depends = nation.select((F.col("n_nationkey") + 5000).alias("objid"), (F.col("n_nationkey") + 1000).alias("refobjid"), F.lit(1).alias("refobjsubid"), F.lit("a").alias("deptype"))
    attributes = nation.select((F.col("n_nationkey") + 1000).alias("attrelid"), F.lit(1).alias("attnum"), F.lit("id").alias("attname"))
    return catalogue_queries.owned_sequences(tables.unionByName(sequences), depends, attributes, region.select(F.col("r_regionkey").alias("oid"), F.col("r_name").alias("nspname")))


@query("SELECT r_name AS table_schema, n_name AS table_name, 'id' AS column_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0 AND r_name NOT IN ('ASIA')")
def autoinc_join(spark, folder):
    both = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("table_schema"), F.col("n_name").alias("table_name"), "n_nationkey")
    tables = both.select("table_schema", "table_name", F.lit("BASE TABLE").alias("table_type"))
    columns = both.select("table_schema", "table_name", F.lit("id").alias("column_name"), F.when(F.col("n_nationkey") % 2 == 0, "auto_increment").otherwise("").alias("extra"))
    return catalogue_queries.auto_increment_columns(tables, columns, ("ASIA",))


@query("SELECT count(*) AS tables FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name NOT IN ('ASIA')")
def user_table_count(spark, folder):
    both = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalogue_queries.user_table_count(both.select(F.col("r_name").alias("table_schema"), F.lit("BASE TABLE").alias("table_type")), ("ASIA",))


@query("SELECT coalesce(max(o_orderkey), 1) AS next_value FROM orders")
def sequence_highwater_pg(spark, folder):
    return catalogue_queries.high_water_mark(table(spark, folder, "orders"), "o_orderkey")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_value FROM orders")
def sequence_highwater_mysql(spark, folder):
    return catalogue_queries.high_water_mark(table(spark, folder, "orders"), "o_orderkey", "mysql")


@query("SELECT 'SELECT setval(''orders_id_seq'', ' || coalesce(max(o_orderkey), 1) || ');' AS sql FROM orders")
def sequence_sync_statement(spark, folder):
    return catalogue_queries.setval_statement("orders_id_seq", table(spark, folder, "orders"), "o_orderkey")


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 1) AS found")
def slot_exists(spark, folder):
    return catalogue_queries.exists(table(spark, folder, "orders").where("o_custkey = 1"))


@query(r"""WITH a AS (SELECT c_custkey, c_name, c_mktsegment, regexp_replace(c_name, '\d', '#', 'g') AS masked FROM customer WHERE c_name IS NOT NULL)
SELECT c_custkey, 'c_name' AS column_name, c_name AS old_value, masked AS new_value FROM a WHERE c_name IS DISTINCT FROM masked""")
def cell_diff(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return copydiff.row_differences(rows, _masked(rows, {"c_name": ColumnTransform("Regex", {"pattern": r"\d", "replacement": "#"})}), "c_custkey", ["c_name", "c_mktsegment"])


@query("""SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity > 25 THEN 'l_quantity' END, CASE WHEN l_returnflag <> 'N' THEN 'l_returnflag' END], lambda x: x IS NOT NULL) AS changed FROM lineitem""")
def changed_columns(spark, folder):
    """Updates of every line item, as replication sends them with their old rows: only what changed is listed."""
    column = lambda name, oid, flags: F.struct(F.lit(name).alias("name"), F.lit(oid).alias("oid"), F.lit(flags).alias("flags"))
    columns = F.array(column("l_orderkey", wal.INT8, 1), column("l_linenumber", wal.INT4, 1), column("l_quantity", wal.FLOAT8, 0), column("l_returnflag", 25, 0))
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None)
    base = [F.lit("XLogData").alias("frame"), F.lit("0/1").alias("lsn")]
    relation = spark.range(1).select(F.lit(-1).cast("bigint").alias("seq"), *base, F.lit("relation").alias("message"), F.lit(1).alias("relation_id"), F.lit("public").alias("namespace"), F.lit("lineitem").alias("name"), columns.alias("columns"), none.cast("array<string>").alias("new_tuple"), none.cast("array<string>").alias("old_tuple"))
    old = F.array(text("l_orderkey"), text("l_linenumber"), text("l_quantity"), "l_returnflag")
    new = F.array(text("l_orderkey"), text("l_linenumber"), F.when(F.col("l_quantity") > 25, "25").otherwise(text("l_quantity")), F.lit("N"))
    updates = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("seq"), *base, F.lit("update").alias("message"), F.lit(1).alias("relation_id"), none.cast("string").alias("namespace"), none.cast("string").alias("name"), none.cast(relation.schema["columns"].dataType).alias("columns"), new.alias("new_tuple"), old.alias("old_tuple"))
    made = wal.wal_changes(relation.unionByName(updates))
    key = lambda i: F.get("dml.old_keys.key_values", F.lit(i))["int_value"]
    return made.select(key(0).alias("l_orderkey"), key(1).alias("l_linenumber"), F.col("dml.column_names").alias("changed"))


@query("""SELECT o_custkey AS organization_id, CAST(m AS DATE) AS date, CAST(10.00 * n AS DECIMAL(10, 2)) AS cost FROM (
    SELECT o_custkey, unnest(generate_series(date_trunc('month', min(o_orderdate)) + INTERVAL 1 MONTH, TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS m, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY o_custkey)""")
def invoice_generation(spark, folder):
    """Invoices of customers, as organizations whose users and subscriptions are their orders."""
    orders = table(spark, folder, "orders").where("o_orderdate is not null").withColumnRenamed("o_custkey", "organization_id")
    users = orders.select("organization_id", F.col("o_orderkey").alias("id"))
    subscriptions = orders.select("organization_id", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.lit(10).cast("decimal(10,2)").alias("monthly_per_user_price"))
    return synthetic.invoices(users, subscriptions, F.lit("1998-12-01").cast("date")).select("organization_id", "date", "cost")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders WHERE o_orderdate IS NOT NULL GROUP BY o_custkey")
def owner_min_by(spark, folder):
    return synthetic.first_of(table(spark, folder, "orders").where("o_orderdate is not null"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT o_custkey, count(*) AS users FROM orders GROUP BY o_custkey")
def users_per_org(spark, folder):
    return synthetic.members(table(spark, folder, "orders"), "o_custkey")


@query()
def synthetic_invoices(spark, folder):
    return synthetic.generate(spark, 10)["invoices"]


@query()
def synthetic_tasks(spark, folder):
    return synthetic.generate(spark, 10)["tasks"]


_RULES = ("users belong to organizations", "owners are users of their organization", "cards belong to organizations", "projects belong to organizations", "project owners are users of the organization", "tasks belong to projects", "assignees are users of the organization", "one invoice a month", "invoices cost users times price", "no updates before creation")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', 0)" for r in _RULES) + ") t(rule, violations)")
def synthetic_rules(spark, folder):
    """How many rows of the synthetic tables break each rule of the schema."""
    t = {n: written(d, n) for n, d in synthetic.generate(spark, 20).items()}
    users = t["users"].select(F.col("id").alias("uid"), F.col("organization_id").alias("org"))
    orgs = t["organizations"].select(F.col("id").alias("org"))
    lost = lambda rows, key: rows.withColumnRenamed(key, "org").join(orgs, "org", "left_anti").count()
    strangers = lambda rows, who, org: rows.join(users, (F.col(who) == F.col("uid")) & (F.col(org) == F.col("org")), "left_anti").count()
    tasks = t["tasks"].join(t["projects"].select(F.col("id").alias("project_id"), F.col("organization_id").alias("project_org")), "project_id", "left").where("project_org is null or project_org <> organization_id").count()
    price = t["subscriptions"].select("organization_id", "monthly_per_user_price")
    costs = t["invoices"].join(price, "organization_id").join(synthetic.members(t["users"]), "organization_id").where("cost <> cast(monthly_per_user_price * users as decimal(10,2))").count()
    months = t["invoices"].groupBy("organization_id", "date").count().where("count > 1 or day(date) <> 1").count()
    early = sum(d.where("updated_at < created_at").count() for d in t.values())
    found = [lost(t["users"], "organization_id"), strangers(t["organizations"], "owner_id", "id"), lost(t["credit_cards"], "organization_id"), lost(t["projects"], "organization_id"), strangers(t["projects"], "owner_id", "organization_id"), tasks, strangers(t["tasks"], "assignee_id", "organization_id"), months, costs, early]
    return spark.createDataFrame(list(zip(_RULES, found)), "rule string, violations int")


# State and streams ---------------------------------------------------------------------------------------------------


def _order_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Per order an insert, an update of the status for every third key, a delete for every seventh, and another insert for every 35th.

    Every fourth key has its changes twice, and nothing is in order.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    none = F.lit(None).cast("string")
    both, status, nothing = F.array(F.lit("o_orderstatus"), F.lit("o_orderpriority")), F.array(F.lit("o_orderstatus")), F.array().cast("array<string>")

    def change(kind: str, at: int, every: int, new_status: Column, new_priority: Column, present: Column) -> DataFrame:
        return orders.where(F.col("o_orderkey") % every == 0).select("o_orderkey", new_status.alias("o_orderstatus"), new_priority.alias("o_orderpriority"), F.lit(kind).alias("kind"), present.alias("present"), (F.col("o_orderkey") * 10 + at).alias("score"))

    insert = change("insert", 0, 1, F.col("o_orderstatus"), F.col("o_orderpriority"), both)
    log = insert.unionByName(change("update", 1, 3, F.lit("U"), none, status)).unionByName(change("delete", 2, 7, none, none, nothing)).unionByName(change("insert", 3, 35, F.lit("R"), none, status))
    return log.unionByName(log.where("o_orderkey % 4 = 0")).orderBy(F.xxhash64("score"))


_STATE = """SELECT o_orderkey, CASE WHEN o_orderkey % 35 = 0 THEN 'R' WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 35 <> 0 THEN o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 35 = 0"""
_ARGS = (["o_orderkey"], ["o_orderstatus", "o_orderpriority"], ["score"])


@query(_STATE)
def apply_latest_state(spark, folder):
    return latest_state.latest_rows(_order_changes(spark, folder), *_ARGS)


@query(f"SELECT * FROM ({_STATE}) WHERE o_orderkey % 3 = 0")
def apply_partial_update(spark, folder):
    return latest_state.latest_rows(_order_changes(spark, folder).where("o_orderkey % 3 = 0"), *_ARGS)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 35 = 0")
def apply_delete(spark, folder):
    return latest_state.latest_rows(_order_changes(spark, folder), *_ARGS).select("o_orderkey")


@query(f"""SELECT position, score FROM (SELECT '0/BOOTSTRAP' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 16, '0') AS position, n_nationkey + 1 - 1000000 AS score FROM nation UNION ALL SELECT position, score FROM ({_LOG}))""")
def bootstrap_then_live_order(spark, folder):
    dumped = table(spark, folder, "nation").select(position.bootstrap_text(F.col("n_nationkey") + 1).alias("position"))
    both = dumped.unionByName(log_of_events(spark, folder).select("position"))
    return change_log.scored(both).orderBy("score")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query(f"SELECT event_id, position, score FROM ({_LOG}) WHERE score > 2 * 4294967296 + 50004")
def stream_replay(spark, folder):
    """The log as a stream from a position, until all that is there is read."""
    place = _place(spark, "replay")
    log_of_events(spark, folder).drop("payload").write.parquet(f"{place}/log")
    schema = spark.read.parquet(f"{place}/log").schema
    after = streams.after_position(streams.stream_table(spark, f"{place}/log", schema), "mysql-bin.000002:50004")
    running = after.select("event_id", "position", "score").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("event_id bigint, position string, score bigint").parquet(f"{place}/out")


@query(_STATE)
def stream_apply(spark, folder):
    """Changes applied to a stored state by a stream, in batches out of order and with repeats; half way the state is compacted."""
    place = _place(spark, "apply")
    log = _order_changes(spark, folder)
    half = (table(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0] or 0) * 5
    run = lambda: streams.apply_to_state(streams.stream_table(spark, f"{place}/log", log.schema, 2), f"{place}/state", f"{place}/checkpoint").awaitTermination()
    log.where(F.col("score") <= half).write.parquet(f"{place}/log")
    run()
    streams.compact_state(spark, f"{place}/state", *_ARGS, (half,))
    log.where(F.col("score") > half).write.mode("append").parquet(f"{place}/log")
    run()
    return streams.read_state(spark, f"{place}/state", *_ARGS)


@query("SELECT event_id FROM events")
def stream_dedup(spark, folder):
    """Events of which some come again in later batches, each stored once, however late."""
    place = _place(spark, "dedup")
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    run = lambda: streams.store_once(streams.stream_table(spark, f"{place}/log", events.schema), f"{place}/store", f"{place}/checkpoint", ["event_id"], ["ts"]).awaitTermination()
    for part in (events.where("event_id % 3 <> 0"), events.where("event_id % 4 = 0"), events.where("event_id % 3 = 0 or event_id % 5 = 0")):
        part.write.mode("append").parquet(f"{place}/log")
        run()
    return streams.read_once(spark, f"{place}/store", ["event_id"], ["ts"]).select("event_id")


@query("SELECT event_id FROM events")
def stream_dedup_within(spark, folder):
    """Events that arrive twice, kept once within a day of state."""
    place = _place(spark, "dedup")
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.unionByName(events.where("event_id % 4 = 0")).write.parquet(f"{place}/log")
    source = streams.stream_table(spark, f"{place}/log", events.schema)
    running = streams.once_within(source, ["event_id"], "ts").select("event_id").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("event_id bigint").parquet(f"{place}/out")


# More of the survey --------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, 'public.' || n_name || ' (old)' AS table_name, ['id', 'full name', 'a"b'] AS columns FROM nation""")
def copy_header_parse(spark, folder):
    line = F.concat(F.lit("COPY public."), dialect.identifier(F.concat("n_name", F.lit(" (old)")), "postgresql"), F.lit(' (id, "full name", "a""b") FROM stdin;'))
    made = dumps.copy_header(line)
    return table(spark, folder, "nation").select("n_nationkey", made["table"].alias("table_name"), made["columns"].alias("columns"))


@query("SELECT n_nationkey, 'CREATE TABLE t' || n_nationkey || ' (x int); INSERT into t values (1);' AS sql FROM nation")
def normalise_sql(spark, folder):
    text = F.concat(F.lit("  create Table t"), F.col("n_nationkey").cast("string"), F.lit(" (x int); insert into t values (1);\n"))
    return table(spark, folder, "nation").select("n_nationkey", dumps.normalise_keywords(text).alias("sql"))


@query("""SELECT n_nationkey * 4 + i AS statement_id, 't' || n_nationkey AS table_name FROM nation, range(4) r(i)""")
def mysql_ddl_table(spark, folder):
    key = F.col("n_nationkey").cast("string")
    texts = [F.concat(F.lit(head), key, F.lit(tail)) for head, tail in (("CREATE TABLE IF NOT EXISTS `t", "` (id int)"), ("ALTER TABLE `t", "` ADD c int"), ("DROP TABLE IF EXISTS t", ""), ("TRUNCATE TABLE `t", "`"))]
    spread = table(spark, folder, "nation").select("n_nationkey", F.posexplode(F.array(*texts)).alias("i", "sql"))
    return spread.select((F.col("n_nationkey") * 4 + F.col("i")).alias("statement_id"), dumps.mysql_table(F.col("sql")).alias("table_name"))


@query("SELECT log_id, ddl_id AS id, ddl_username AS username, ddl_text AS ddl FROM ddl_log")
def wal_ddl_log(spark, folder):
    """Inserts into the DDL log, as they come through replication, become schema changes."""
    names = (("id", wal.INT4), ("time", 25), ("username", 25), ("database", 25), ("ddl", 25))
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("oid"), F.lit(0).alias("flags")) for n, o in names])
    none = F.lit(None)
    base = {"frame": F.lit("XLogData"), "relation_id": F.lit(1), "old_tuple": none.cast("array<string>")}
    relation = spark.range(1).select(F.lit(-1).cast("bigint").alias("seq"), base["frame"].alias("frame"), F.lit("0/0").alias("lsn"), F.lit("relation").alias("message"), base["relation_id"].alias("relation_id"), F.lit("public").alias("namespace"), F.lit(wal.DDL_LOG_TABLE).alias("name"), columns.alias("columns"), none.cast("array<string>").alias("new_tuple"), base["old_tuple"].alias("old_tuple"))
    row = F.array(F.col("ddl_id").cast("string"), "ddl_time", "ddl_username", "ddl_database", "ddl_text")
    inserts = table(spark, folder, "ddl_log").select(F.col("log_id").alias("seq"), base["frame"].alias("frame"), F.col("change_position").alias("lsn"), F.lit("insert").alias("message"), base["relation_id"].alias("relation_id"), none.cast("string").alias("namespace"), none.cast("string").alias("name"), none.cast(relation.schema["columns"].dataType).alias("columns"), row.alias("new_tuple"), base["old_tuple"].alias("old_tuple"))
    made = wal.wal_changes(relation.unionByName(inserts)).where("type = 'ddl'")
    return made.select(F.col("seq").alias("log_id"), "ddl.id", "ddl.username", "ddl.ddl")


@query("SELECT log_id, strftime(logged_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS time, ddl_database AS database FROM ddl_log WHERE regexp_matches(trim(ddl_text), '(?i)^(CREATE|ALTER|DROP|RENAME|TRUNCATE)')")
def binlog_query_ddl(spark, folder):
    queries = table(spark, folder, "ddl_log").select(F.lit("bin.000001").alias("file"), F.col("log_id").alias("offset"), F.unix_timestamp(F.col("logged_at").cast("timestamp")).alias("epoch_seconds"), F.col("ddl_database").alias("schema"), F.col("ddl_text").alias("query"))
    return binlog.query_changes(queries).select(binlog.parse_position(F.col("position"))["offset"].alias("log_id"), "ddl.time", "ddl.database")


@query("""SELECT delivery_id, dml_kind AS kind, CASE WHEN place > 0 THEN CASE WHEN column_values[place].string_value IS NOT NULL THEN 'N. N.' END END AS name, old_key_names AS key_names,
    [coalesce(v.string_value, CAST(v.int_value AS VARCHAR), CAST(v.float_value AS VARCHAR), CAST(v.bool_value AS VARCHAR), v.timestamp_value) FOR v IN old_key_values] AS key_values, CAST(NULL AS VARCHAR) AS ddl, CAST(NULL AS VARCHAR) AS username
FROM (SELECT *, coalesce(list_position(column_names, 'name'), 0) AS place FROM change_log WHERE dml_table = 'public.users') WHERE place = 0 OR column_values[place].string_value IS NOT NULL
UNION ALL SELECT log_id, NULL, NULL, NULL, NULL, ddl_text, NULL FROM ddl_log""")
def transform_envelope(spark, folder):
    """The change log's rows of one table, their names replaced inside the envelope and their old keys as they are, and all schema changes, of which only the text stays."""
    log = table(spark, folder, "change_log").where("dml_table = 'public.users'")
    keys = F.when(F.col("old_key_names").isNotNull(), F.struct(F.col("old_key_names").alias("key_names"), F.col("old_key_values").alias("key_values")))
    rows = log.select("delivery_id", F.col("change_position").alias("position"), F.lit("dml").alias("type"), F.struct(F.col("dml_table").alias("table"), "column_names", "column_values", F.col("dml_kind").alias("kind"), keys.alias("old_keys")).alias("dml"), F.lit(None).cast("struct<id:int,time:string,username:string,database:string,ddl:string>").alias("ddl"))
    ddl = F.struct(F.col("ddl_id").alias("id"), F.col("ddl_time").alias("time"), F.col("ddl_username").alias("username"), F.col("ddl_database").alias("database"), F.col("ddl_text").alias("ddl"))
    statements = table(spark, folder, "ddl_log").select(F.col("log_id").alias("delivery_id"), F.col("change_position").alias("position"), F.lit("ddl").alias("type"), F.lit(None).cast(rows.schema["dml"].dataType).alias("dml"), ddl.alias("ddl"))
    config = TransformConfig(0, {"public.users": {"name": ColumnTransform("Regex", {"pattern": r"(?s)^.*$", "replacement": "N. N."})}})
    made = transforms.transform_changes(rows.unionByName(statements), config)
    name = F.get("dml.column_values", F.array_position("dml.column_names", "name").cast("int") - 1)["string_value"]
    return made.select("delivery_id", "dml.kind", name.alias("name"), F.col("dml.old_keys.key_names").alias("key_names"), F.transform("dml.old_keys.key_values", plain_text).alias("key_values"), "ddl.ddl", "ddl.username")


_BYTES = lambda field, text: f"'{field << 3 | 2:02X}' || printf('%02X', strlen({text})) || hex({text})"
_INNER = f"{_BYTES(1, chr(39) + 'nation' + chr(39))} || '12046E6B6579' || '12046E616D65' || '1A0210' || printf('%02X', n_nationkey) || '1A' || printf('%02X', strlen(n_name) + 2) || {_BYTES(1, 'n_name')} || {_BYTES(4, chr(39) + 'insert' + chr(39))}"


@query(f"SELECT n_nationkey, {_BYTES(1, 'place')} || '1203646D6C' || '1A' || printf('%02X', length(body) // 2) || body AS message FROM (SELECT n_nationkey, '0/' || printf('%X', n_nationkey + 1) AS place, {_INNER} AS body FROM nation WHERE n_name IS NOT NULL)")
def wire_encode(spark, folder):
    """Inserts in the binary form in which they go over the wire."""
    dml = _dml("insert", "nation", {"nkey": _int("n_nationkey"), "name": _string("n_name")}, None)
    change = F.struct(F.concat(F.lit("0/"), F.hex(F.col("n_nationkey") + 1)).alias("position"), F.lit("dml").alias("type"), dml.alias("dml"), F.lit(None).cast("struct<id:int,time:string,username:string,database:string,ddl:string>").alias("ddl"))
    return table(spark, folder, "nation").where("n_name is not null").select("n_nationkey", F.hex(wire.wire_change(change)).alias("message"))


@query("SELECT '0/' || printf('%X', event_id) AS position, event_id AS score FROM events")
def wire_round_trip(spark, folder):
    """Changes written to the wire form and read again, by position."""
    dml = _dml("update", "events", {"user_id": _int("user_id"), "event_type": _string("event_type")}, {"event_id": _int("event_id")})
    change = F.struct(F.concat(F.lit("0/"), F.hex("event_id")).alias("position"), F.lit("dml").alias("type"), dml.alias("dml"), F.lit(None).cast("struct<id:int,time:string,username:string,database:string,ddl:string>").alias("ddl"))
    read = wire.read_wire(table(spark, folder, "events").select(wire.wire_change(change).alias("value")))
    return read.select("position", F.get("dml.old_keys.key_values", F.lit(0))["int_value"].alias("score"))


@query("SELECT o_orderkey, 'SELECT * FROM orders WHERE o_orderkey = ? AND o_custkey = ?' AS mysql, 'SELECT * FROM orders WHERE o_orderkey = $1 AND o_custkey = $2' AS pg FROM orders")
def param_rewrite(spark, folder):
    sql = F.lit("SELECT * FROM orders WHERE o_orderkey = $1 AND o_custkey = $2")
    return table(spark, folder, "orders").select("o_orderkey", tables.placeholders(sql, "mysql").alias("mysql"), tables.placeholders(sql, "postgresql").alias("pg"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'UPDATE customer SET c_name = ' || coalesce('''' || replace(c_name, '''', '''''') || '''', 'NULL') || ', updated_at = ''2024-05-06 07:08:09'' WHERE c_custkey = ' || c_custkey || ';'
    ELSE 'UPDATE customer SET c_name = ' || coalesce('''' || replace(c_name, '''', '''''') || '''', 'NULL') || ', c_mktsegment = ' || coalesce('''' || c_mktsegment || '''', 'NULL') || ', updated_at = ''2024-05-06 07:08:09'' WHERE c_custkey = ' || c_custkey || ';' END AS sql FROM customer""")
def row_patch(spark, folder):
    """Patches that set nothing, one column, or all."""
    given = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("unknown"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("c_name"), F.lit("unknown")))
    dml = render.patch_change("customer", {"c_custkey": _int("c_custkey")}, {"c_name": _string("c_name"), "c_mktsegment": _string("c_mktsegment")}, given, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return table(spark, folder, "customer").select("c_custkey", render.render_dml(dml)["sql"].alias("sql"))


def _insert_dump(spark: SparkSession, folder: str) -> str:
    """All orders as dumps of single INSERT statements, one for each core, with texts that look like ends and quotes."""
    place = _place(spark, "dump")
    text = F.concat(F.coalesce("o_orderpriority", F.lit("")), F.lit(" costs $$;\n-- it's \\ "))
    line = F.concat(F.lit('INSERT INTO public."order items" ("order key", note) VALUES ('), F.col("o_orderkey").cast("string"), F.lit(", '"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("');"))
    table(spark, folder, "orders").select(line.alias("value")).repartition(spark.sparkContext.defaultParallelism).write.text(place)
    return place


@query(r"SELECT 'public.order items' AS table_name, o_orderkey, coalesce(o_orderpriority, '') || ' costs $$;' || chr(10) || '-- it''s \ ' AS note FROM orders")
def dump_pg_inserts(spark, folder):
    changes = dumps.load_dump(spark, _insert_dump(spark, folder), "pg")
    value = lambda i: F.get("dml.column_values", F.lit(i))
    return changes.select(F.col("dml.table").alias("table_name"), value(0)["int_value"].alias("o_orderkey"), value(1)["string_value"].alias("note"))


@query("SELECT count(*) AS read_rows, 0 AS statements, 0 AS stored, 0 AS failed FROM orders")
def dump_dry_run(spark, folder):
    report = dumps.store_dump(dumps.load_dump(spark, _insert_dump(spark, folder), "pg"), None)
    return spark.createDataFrame([(report.rows, report.statements, report.stored, report.failed)], "read_rows bigint, statements bigint, stored bigint, failed bigint")


@query("SELECT max(o_orderkey) AS next_value FROM orders")
def sync_after_inserts(spark, folder):
    """What the periodic sync of sequences sets after a batch with inserts."""
    batch = _order_changes(spark, folder).withColumn("dml_table", F.lit("orders"))
    return streams.high_water_marks(batch, "orders", "o_orderkey")


@query(r"""SELECT c_custkey FROM customer WHERE c_name IS DISTINCT FROM regexp_replace(c_name, '\d', '#', 'g')""")
def edited_rows(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    masked = _masked(rows, {"c_name": ColumnTransform("Regex", {"pattern": r"\d", "replacement": "#"})})
    return copydiff.row_differences(rows, masked, "c_custkey", ["c_name"]).select("c_custkey").distinct()


@query(f"SELECT event_id, payload, CAST(score AS BIGINT) AS score FROM ({_LOG})")
def log_append(spark, folder):
    """The log appended to a store in two parts and read again."""
    place = _place(spark, "log")
    log = log_of_events(spark, folder).drop("score")
    change_log.append(log.where("event_id % 2 = 0"), place)
    change_log.append(log.where("event_id % 2 = 1"), place)
    return change_log.read_log(spark, place).select("event_id", "payload", "score")


@query("SELECT 'INSERT INTO orders (o_orderkey, o_orderstatus) VALUES (' || o_orderkey || ', ' || coalesce('''' || o_orderstatus || '''', 'NULL') || ');' AS sql FROM orders")
def stream_render(spark, folder):
    """Changes read as a stream of JSON, transformed and rendered batch by batch."""
    place = _place(spark, "render")
    names, values = F.array(F.lit("o_orderkey"), F.lit("o_orderstatus")), F.array(_int("o_orderkey"), _string("o_orderstatus"))
    none = F.lit(None)
    lines = table(spark, folder, "orders").select(codec.encode_dml(position.bootstrap_text(F.col("o_orderkey")), F.lit("orders"), names, values, F.lit("insert"), none.cast("array<string>"), none.cast(f"array<{CELL.simpleString()}>")).alias("value"))
    lines.write.text(f"{place}/in")
    sink = lambda batch, number: batch.select("sql").write.mode("overwrite").parquet(f"{place}/out/batch={number}")
    streams.replicate(streams.stream_changes(spark, f"{place}/in", "bootstrap"), TransformConfig(0, {}), "postgresql", sink, f"{place}/checkpoint").awaitTermination()
    return spark.read.schema("sql string").parquet(f"{place}/out").select("sql")


@query("SELECT 'CREATE TABLE ' || t || ' (' AS head FROM (VALUES ('organizations'), ('users'), ('subscriptions'), ('credit_cards'), ('invoices'), ('projects'), ('tasks')) v(t)")
def synthetic_ddl(spark, folder):
    return spark.createDataFrame([(t,) for t in synthetic.ddl("postgresql")], "sql string").select(F.regexp_extract("sql", r"^(CREATE TABLE \w+ \()", 1).alias("head"))
