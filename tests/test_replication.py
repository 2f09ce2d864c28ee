import json

import pytest
from fixtures import CELL, cell, dicts
from pyspark.sql import functions as F

from changeweave.model import CHANGE
from changeweave.operators import change_log, render, transforms
from changeweave.operators.latest_state import latest_rows
from changeweave.sources import binlog, codec, dumps, infer, synthetic, tables, wal, wire
from changeweave.sources.config import ColumnTransform, ConfigError, TransformConfig, Version, parse_config
from changeweave.streaming import streams
from changeweave.streaming.controller import BootstrapController, FileStore, State, StateError, resume_position, wait_to_stream, with_retry


def dml(table, kind, cells=None, keys=None, names=None):
    cells = cells or {}
    return {
        "table": table, "kind": kind, "column_names": list(cells) if names is None else names, "column_values": [v if isinstance(v, dict) else cell(v) for v in cells.values()],
        "old_keys": None if keys is None else {"key_names": list(keys), "key_values": [cell(v) for v in keys.values()]},
    }


def changes(spark, bodies, position="0/1"):
    return spark.createDataFrame([(position, "dml", b, None) for b in bodies], CHANGE)


def sql(spark, body, dialect="postgresql"):
    r = changes(spark, [body]).select(render.render_dml(F.col("dml"), dialect).alias("m")).first().m
    return r.sql, r.error


def test_rendering(spark):
    assert sql(spark, dml("users", "insert", {"name": "John Doe", "email": None}))[0] == "INSERT INTO users (name, email) VALUES ('John Doe', NULL);"
    assert sql(spark, dml("users", "update", {"name": "John Doe", "email": "john@example.com"}, {"id": 1}))[0] == "UPDATE users SET name = 'John Doe', email = 'john@example.com' WHERE id = 1;"
    assert sql(spark, dml("users", "delete", {}, {"id": 1}))[0] == "DELETE FROM users WHERE id = 1;"
    assert sql(spark, dml("user_roles", "update", {"role_name": "admin", "permissions": "read,write,delete"}, {"user_id": 123, "org_id": 456}))[0] == "UPDATE user_roles SET role_name = 'admin', permissions = 'read,write,delete' WHERE user_id = 123 AND org_id = 456;"
    assert sql(spark, dml("t", "insert", {"a": True}), "mysql")[0] == "INSERT INTO t (a) VALUES (1);"
    for bad in (dml("t", "merge", {"a": 1}), dml("t", "insert", {"a": 1}, names=["a", "b"]), dml("t", "update", {"a": 1}), dml("t", "delete"), dml("t", "update", {}, {"id": 1}), dml("t", "delete", {}, {"id": None}), dml("t", "insert", {"a": cell("bad", stamp=True)})):
        got = sql(spark, bad)
        assert got[0] is None and got[1]


def test_json(spark):
    insert = dml("users", "insert", {"id": 1, "name": "test"})
    text = changes(spark, [insert], "0/100").select(codec.encode(F.struct("position", "type", "dml", "ddl")).alias("j")).first().j
    assert text == '{"type":"dml","position":"0/100","data":{"table":"users","columnnames":["id","name"],"columnvalues":[1,"test"],"kind":"insert"}}'
    ddl = [("0/200", "ddl", None, {"id": 1, "time": "2024-03-20T15:00:00Z", "username": "postgres", "database": "testdb", "ddl": "CREATE TABLE test (id SERIAL PRIMARY KEY)"})]
    df = spark.createDataFrame(ddl, CHANGE)
    text = df.select(codec.encode(F.struct("position", "type", "dml", "ddl")).alias("j")).first().j
    assert text == '{"type":"ddl","position":"0/200","data":{"id":1,"time":"2024-03-20T15:00:00Z","username":"postgres","database":"testdb","ddl":"CREATE TABLE test (id SERIAL PRIMARY KEY)"}}'
    assert dicts(codec.read_changes(spark.createDataFrame([(text,), ("{}",), (None,), ("x",)], "value string"))) == dicts(df)


def test_json_types(spark):
    body = {"type": "dml", "position": "0/1", "data": {"table": "t", "columnnames": list("abcdefghi"), "columnvalues": [5, "5", True, None, "2024-03-20T15:04:05.5Z", "2024-03-20", 'a "q" \n é', 1.5, -7], "kind": "update", "oldkeys": {"keynames": ["id"], "keyvalues": [123]}}}
    got = dicts(codec.read_changes(spark.createDataFrame([(json.dumps(body),)], "value string")))[0]
    values = [{k: v for k, v in c.items() if v is not None} for c in got["dml"]["column_values"]]
    assert values == [{"int_value": 5}, {"string_value": "5"}, {"bool_value": True}, {}, {"timestamp_value": "2024-03-20T15:04:05Z"}, {"string_value": "2024-03-20"}, {"string_value": 'a "q" \n é'}, {"float_value": 1.5}, {"int_value": -7}]
    again = changes(spark, [got["dml"]]).select(codec.encode(F.struct("position", "type", "dml", "ddl")).alias("value"))
    assert dicts(codec.read_changes(again))[0]["dml"] == got["dml"]


def config(tables):
    return TransformConfig(0, {t: {c: ColumnTransform(*([s] if isinstance(s, str) else s)) for c, s in cs.items()} for t, cs in tables.items()})


def test_changes_are_transformed_in_two_passes(spark):
    c = config({"users": {"name": ("Regex", {"pattern": "J.*", "replacement": "X Y"}), "email": ("Template", {"template": "{{.name | slugify}}@example.com"}), "username": ("Template", {"template": '{{.email | before "@"}}'}), "password": ("PasswordPBKDF2", {"iterations": 2, "cleartext": "{{.name}}"})}})
    rows = [dml("users", "update", {"id": 1, "name": "John Doe", "email": "j@x", "username": "jd", "password": "secret"}, {"name": "John Doe"}), dml("users", "insert", {"username": "jd", "name": "John", "email": "j@x"}), dml("users", "insert", {"name": None}), dml("other", "insert", {"name": "John"}), dml("users", "delete", {}, {"id": 1})]
    out = transforms.transform_changes(changes(spark, rows), c)
    got = [{n: next((v for v in c.values() if v is not None), None) for n, c in zip(r["dml"]["column_names"], r["dml"]["column_values"])} for r in dicts(out)]
    password = next(g for g in got if g.get("id") == 1).pop("password")
    assert sorted(map(str, got)) == sorted(map(str, [{"id": 1, "name": "X Y", "email": "x-y@example.com", "username": "x-y"}, {"username": "j", "name": "X Y", "email": "x-y@example.com"}, {"name": "John"}, {}]))
    assert "$" in password
    keys = [r["dml"]["old_keys"] for r in dicts(out) if r["dml"]["kind"] == "update"]
    assert keys[0]["key_values"][0]["string_value"] == "John Doe"
    keys = [r["dml"]["old_keys"] for r in dicts(transforms.transform_changes(changes(spark, rows), c, transform_keys=True)) if r["dml"]["kind"] == "update"]
    assert keys[0]["key_values"][0]["string_value"] == "X Y"
    assert transforms.transform_changes(changes(spark, rows), c, "null").count() == 5
    with pytest.raises(Exception, match="cannot transform"):
        transforms.transform_changes(changes(spark, rows), c, "fail").collect()


def test_tables_are_transformed(spark):
    df = spark.createDataFrame([(1, "Ann", 5), (2, None, 6)], "id int, name string, `count` int")
    c = {"name": ColumnTransform("FakeName"), "count": ColumnTransform("FakeName"), "absent": ColumnTransform("FakeName")}
    assert transforms.transform_table(df, {"name": c["name"]}).count() == 1
    assert [r["count"] for r in transforms.transform_table(df, c, "null").collect()] == [None, None]
    with pytest.raises(Exception, match="cannot transform column name"):
        transforms.transform_table(df, {"name": c["name"]}, "fail").collect()
    assert transforms.transform_table(df.limit(0), {"name": c["name"]}).count() == 0
    assert transforms.leaking_fields(["a", "b"], {"a": ColumnTransform("Template", {"template": "{{.b}}"}), "b": ColumnTransform("Template", {"template": "x"})}) == [("a", "b")]


def test_configuration():
    c = parse_config("tables:\n  public.users:\n    name: FakeName\n    password:\n      type: PasswordArgon2id\n      config: {cleartext: x, time: 2}\n")
    assert c.columns("public.users")["password"].number("time", 3) == 2 and c.columns("nope") == {}
    for bad in ("major_version: 7", "tables:\n  t:\n    c: Nope", "tables:\n  t:\n    c: {config: {}}", "tables: [1]", "a: [", "tables:\n  t:\n    c: 5"):
        with pytest.raises(ConfigError):
            parse_config(bad)
    with pytest.raises(ConfigError):
        transforms.checked(config({"t": {"c": ("Regex", {"pattern": "[", "replacement": ""})}}))
    assert (Version.parse("v1.2.3-rc1"), Version.parse("2"), Version.parse("x").major) == (Version(1, 2, 3), Version(2), 0)


def test_inference(spark):
    cases = ["", "123", "123.45", "true", "hello world", "2024-03-20T15:04:05Z", "2024-03-20 15:04:05", "2024-03-20 15:04:05.123456", "2024-03-20", "007", "+1-555-1234", "1.23e10", " 42 ", "yes", "9223372036854775808", "t", None, "2024-99-99", "NaN"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [{k: v for k, v in r["c"].items() if v is not None} for r in dicts(df.orderBy("i").select(infer.infer_cell(F.col("t")).alias("c")))]
    assert got[:-1] == [
        {}, {"int_value": 123}, {"float_value": 123.45}, {"bool_value": True}, {"string_value": "hello world"}, {"timestamp_value": "2024-03-20T15:04:05Z"}, {"timestamp_value": "2024-03-20T15:04:05Z"}, {"timestamp_value": "2024-03-20T15:04:05Z"},
        {"timestamp_value": "2024-03-20T00:00:00Z"}, {"int_value": 7}, {"string_value": "+1-555-1234"}, {"float_value": 1.23e10}, {"string_value": " 42 "}, {"string_value": "yes"}, {"float_value": 9223372036854775808.0}, {"bool_value": True}, {}, {"string_value": "2024-99-99"},
    ]
    assert list(got[-1]) == ["float_value"]


PG = """--
SET client_encoding = 'UTF8';
\\restrict abc
CREATE FUNCTION public.f() RETURNS trigger AS $fn$
BEGIN
  SELECT 1;
END $fn$ LANGUAGE plpgsql;
CREATE TABLE public.internal_ddl_log (id int);
CREATE TABLE public.users (
    id integer, name text
);
COPY public.users (id, name, note) FROM stdin;
1\tAda\t\\N
2\ta\\tb\\\\c\t--
--x\tq\t
\\.
INSERT INTO public.posts VALUES (1, 'it''s, a (post)'), (2, NULL);
COPY public.internal_ddl_log (id) FROM stdin;
5
\\.
CREATE PUBLICATION p FOR ALL TABLES;
SELECT pg_catalog.setval('public.users_id_seq', 2, true);
SELECT pg_catalog.set_config('search_path', '', false);
"""
MYSQL = """-- dump
/*!40101 SET NAMES utf8 */;
DROP TABLE IF EXISTS `users`;
CREATE TABLE `users` (
  `id` int
);
LOCK TABLES `users` WRITE;
INSERT INTO `users` (`id`, `name`) VALUES (1,'It\\'s; ok'),(2,NULL),(3,'path\\\\to'),(4,'line\\nbreak');
INSERT INTO shop.`notes` VALUES (1,'a
-- b;
c');
DELIMITER ;;
CREATE TRIGGER x BEFORE INSERT ON users FOR EACH ROW BEGIN SET @a = 1; END ;;
DELIMITER ;
INSERT INTO internal_ddl_log VALUES (1);
UNLOCK TABLES;
"""


def test_dump_parsers():
    made = list(dumps.pg_statements(iter(PG.split("\n"))))
    assert [(s.kind, s.table, len(s.rows)) for s in made] == [("ddl", "", 0), ("ddl", "public.users", 0), ("dml", "public.users", 3), ("dml", "public.posts", 2), ("ddl", "", 0)]
    assert made[2].rows == (("1", "Ada", None), ("2", "a\tb\\c", "--"), ("--x", "q", "")) and made[3].rows == (("1", "it's, a (post)"), ("2", None))
    like = list(dumps.pg_statements(iter(PG.split("\n")), like_reference=True))
    assert len(like[2].rows) == 2 and like[3].rows == (("1", "it's, a (post)"),)
    for bad in ("UPDATE t SET a = 1;", "DELETE FROM t;", "SELECT 1;", "VACUUM;"):
        with pytest.raises(dumps.DumpError):
            list(dumps.pg_statements(iter([bad])))
    made = list(dumps.mysql_statements(iter(MYSQL.split("\n"))))
    assert [(s.kind, s.table, len(s.rows)) for s in made] == [("ddl", "users", 0), ("ddl", "users", 0), ("dml", "users", 4), ("dml", "notes", 1), ("ddl", "", 0)]
    assert made[2].rows == (("1", "It's; ok"), ("2", None), ("3", "path\\to"), ("4", "line\nbreak")) and made[3].rows == (("1", "a\n-- b;\nc"),)
    like = dumps._clean("'path\\\\to\\\\file'", "mysql", True)
    assert like == "path\to\\file"


TRICKY = '''INSERT INTO t VALUES (1, 'price $$ low');
INSERT INTO t VALUES (2, 'line ends;
and -- goes on /* here');
INSERT INTO public."order items" ("a b", "say ""hi""") VALUES (3, E'it\\'s;'), (4, 'x') ON CONFLICT (id) DO NOTHING; -- done
CREATE FUNCTION f() RETURNS int AS $body$ SELECT 'a;
' $body$ LANGUAGE sql;
COPY public."order items" ("a b", "c)", d) FROM stdin;
5\t6\t7
\\.
'''


def test_quotes_of_dumps():
    made = list(dumps.pg_statements(iter(TRICKY.split("\n"))))
    assert [(s.kind, s.table, s.columns) for s in made] == [("dml", "t", ()), ("dml", "t", ()), ("dml", "public.order items", ("a b", 'say "hi"')), ("ddl", "", ()), ("dml", "public.order items", ("a b", "c)", "d"))]
    assert [s.rows for s in made if s.kind == "dml"] == [(("1", "price $$ low"),), (("2", "line ends;\nand -- goes on /* here"),), (("3", "it's;"), ("4", "x")), (("5", "6", "7"),)]
    for open_end in ("INSERT INTO t VALUES (1", "INSERT INTO t VALUES ('a;", "CREATE FUNCTION f() AS $$ x;", "COPY t (a) FROM stdin;\n1"):
        with pytest.raises(dumps.DumpError, match="ends inside"):
            list(dumps.pg_statements(iter(open_end.split("\n"))))
    with pytest.raises(dumps.DumpError, match="ends inside"):
        list(dumps.mysql_statements(iter(["INSERT INTO t VALUES ('a;"])))
    quoted = list(dumps.mysql_statements(iter(["CREATE TABLE `order items` (`a` int COMMENT 'x;", "y');", 'INSERT INTO `order items` (`a b`) VALUES ("it\\"s;");'])))
    assert [(s.kind, s.table, s.columns, s.rows) for s in quoted] == [("ddl", "order items", (), ()), ("dml", "order items", ("a b",), (('it"s;',),))]


def test_store_of_a_dump(spark, tmp_path):
    (tmp_path / "b.sql").write_text(PG)
    (tmp_path / "a.sql").write_text(TRICKY)
    changes = dumps.load_dump(spark, str(tmp_path), "pg")
    assert changes.where("dml.table = 'public.order items'").count() == 3
    # Files follow each other by name.
    assert changes.where("dml.table = 't'").agg({"position": "max"}).first()[0] < changes.where("dml.table = 'public.users'").agg({"position": "min"}).first()[0]
    dry = dumps.store_dump(changes, None)
    assert (dry.rows, dry.statements, dry.stored) == (10, 4, 0)
    seen, heard = [], []
    whole = dumps.store_dump(changes, lambda b: seen.append(b.count()), batch_size=5, progress=lambda n, rate: heard.append(n))
    assert whole.stored == 14 and seen == [5, 5, 4] and heard == [5, 10, 14]

    def broken(batch):
        if batch.where("type = 'ddl'").count():
            raise OSError("full")

    assert dumps.store_dump(changes, broken, batch_size=1, continue_on_error=True).failed == 4
    with pytest.raises(OSError):
        dumps.store_dump(changes, broken)


def test_dump_to_changes(spark, tmp_path):
    (tmp_path / "a.sql").write_text(PG)
    out = dumps.load_dump(spark, str(tmp_path), "pg")
    got = sorted((r["position"], r["type"], r["dml"]["table"] if r["dml"] else None) for r in dicts(out))
    assert [p for p, *_ in got] == [f"0/BOOTSTRAP{i:016d}" for i in range(1, 9)]
    assert [t for _, _, t in got] == [None, None, "public.users", "public.users", "public.users", "public.posts", "public.posts", None]
    assert dumps.load_dump(spark, str(tmp_path), "pg", max_rows_per_table=1).where("type = 'dml'").count() == 2
    assert dumps.load_dump(spark, str(tmp_path), "pg", skip_tables=["public.users"]).where("type = 'dml'").count() == 2
    none = spark.createDataFrame([("x", None)], "file string, text string")
    assert dumps.statement_changes(dumps.dump_statements(none, "mysql")).count() == 0


def test_wal(spark):
    columns = [{"name": "id", "oid": 23, "flags": 1}, {"name": "name", "oid": 25, "flags": 0}, {"name": "ok", "oid": 16, "flags": 0}]
    log = [{"name": n, "oid": o, "flags": 0} for n, o in (("id", 23), ("ts", 1114), ("username", 25), ("database", 25), ("ddl", 25))]
    x = "XLogData"
    rows = [
        (0, x, "0/0", "relation", 1, "public", "users", columns, None, None), (1, x, "0/1", "insert", 1, None, None, None, ["1", "Ada", "t"], None), (2, x, "0/2", "update", 1, None, None, None, ["2", "Ada", "f"], ["1", "Ada", "t"]),
        (3, x, "0/3", "update", 1, None, None, None, ["2", "Bob", None], None), (4, x, "0/4", "delete", 1, None, None, None, None, ["2", "Bob", None]), (5, x, "0/5", "insert", 1, None, None, None, ["x", "A", "t"], None), (6, x, "0/6", "insert", 9, None, None, None, ["1"], None),
        (7, x, "0/7", "commit", None, None, None, None, None, None), (8, "keepalive", "0/8", "insert", 1, None, None, None, ["1", "A", "t"], None), (9, x, "0/9", "relation", 2, "public", wal.DDL_LOG_TABLE, log, None, None),
        (10, x, "0/A", "insert", 2, None, None, None, ["7", "2024-01-01 00:00:00", "u", "db", "CREATE TABLE t ()"], None), (11, x, "0/B", "relation", 1, "public", "renamed", columns[:1], None, None), (12, x, "0/C", "insert", 1, None, None, None, ["5"], None),
    ]
    got = {r["seq"]: r for r in dicts(wal.wal_changes(spark.createDataFrame(rows, wal.FRAME)))}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 10, 12]
    assert (got[1]["dml"]["table"], got[1]["dml"]["column_names"], got[1]["dml"]["column_values"][2]["bool_value"]) == ("public.users", ["id", "name", "ok"], True)
    assert got[2]["dml"]["column_names"] == ["id", "ok"] and got[2]["dml"]["old_keys"]["key_values"][0]["int_value"] == 1
    assert got[3]["dml"]["column_names"] == ["name", "ok"] and got[4]["dml"]["old_keys"]["key_names"] == ["id"]
    assert got[5]["error"] == "invalid value: x" and got[6]["error"] == "unknown relation" and got[5]["dml"] is None
    assert got[10]["type"] == "ddl" and got[10]["ddl"]["ddl"] == "CREATE TABLE t ()" and got[12]["dml"]["table"] == "public.renamed"
    like = {r["seq"]: r for r in dicts(wal.wal_changes(spark.createDataFrame(rows, wal.FRAME), keys_like_reference=True))}
    assert like[2]["dml"]["old_keys"]["key_values"][0]["int_value"] == 2 and like[4]["dml"]["old_keys"]["key_names"] == ["id", "name"]


def test_wal_cells(spark):
    cases = [("32768", 21, None), ("32767", 21, "32767"), ("2147483648", 23, None), ("1.5", 701, "1.5"), ("x", 700, None), ("maybe", 16, None), ("2024-03-20 15:04:05.123456", 1114, "2024-03-20T15:04:05Z"), ("2024-03-20 15:04:05+02", 1184, "2024-03-20T15:04:05+02:00"), ("2024-03-20", 1082, "2024-03-20T00:00:00Z"), ("2024-02-30", 1082, None), ("{}", 3802, "{}")]
    df = spark.createDataFrame([(i, t, o) for i, (t, o, _) in enumerate(cases)], "i int, t string, o int")
    for r, (_, _, wanted) in zip(dicts(df.orderBy("i").select(wal.decode_cell(F.col("t"), F.col("o")).alias("d"))), cases):
        value = next((str(v) for v in r["d"]["cell"].values() if v is not None), None)
        assert value == wanted and (r["d"]["error"] is None) == (wanted is not None)


def test_binlog(spark):
    row = lambda *vs: [cell(v) for v in vs]
    events = [
        ("b.000001", 4, "insert", "users", ["id", "name"], ["id"], [row(1, "a"), row(2, "b")]), ("b.000001", 9, "update", "users", ["id", "name"], ["id"], [row(1, "a"), row(5, "a"), row(2, "b"), row(2, "c"), row(3, "x")]),
        ("b.000001", 20, "delete", "users", ["id", "name"], ["id"], [row(1, "a")]), ("b.000001", 30, "update", "users", ["id", "name"], ["id"], [row(1, "a")]), ("b.000001", 31, "insert", "users", ["id"], ["id"], []),
    ]
    got = [(r["position"], r["row_no"], r["dml"]["kind"], r["dml"]["column_names"], r["dml"]["old_keys"] and r["dml"]["old_keys"]["key_values"][0]["int_value"]) for r in dicts(binlog.binlog_changes(spark.createDataFrame(events, binlog.ROWS)))]
    assert sorted(got) == [("b.000001:20", 0, "delete", [], 1), ("b.000001:4", 0, "insert", ["id", "name"], None), ("b.000001:4", 1, "insert", ["id", "name"], None), ("b.000001:9", 0, "update", ["id", "name"], 1), ("b.000001:9", 1, "update", ["name"], 2)]
    queries = spark.createDataFrame([("b.1", 5, 1710947045, "db", q) for q in ("  alter table t add c int", "BEGIN", "insert into t values (1)", "RENAME TABLE a TO b")], "file string, offset bigint, epoch_seconds bigint, schema string, query string")
    assert [r["ddl"]["time"] for r in dicts(binlog.query_changes(queries))] == ["2024-03-20T15:04:05Z"] * 2
    parsed = spark.createDataFrame([("b.1:7",), ("",), ("bootstrap",), ("x",)], "p string").select(binlog.parse_position(F.col("p")).alias("a")).collect()
    assert [r.a and (r.a.file, r.a.offset) for r in parsed] == [("b.1", 7), ("", 0), ("", 0), None]


def test_mysql_cells(spark):
    cases = [
        ("42", "tinyint(4)", 42, "int"), ("-5", "BIGINT(20)", -5, "int"), ("18446744073709551615", "bigint(20) unsigned", -1, "int"), ("1.5", "double", 1.5, "float"), ("2.50", "decimal(10,2)", "2.50", "string"), ("x", "int", "x", "string"), ("", "varchar(3)", "", "string"),
        ("2024-02-03 04:05:06.7", "datetime(6)", "2024-02-03T04:05:06Z", "timestamp"), ("0000-00-00 00:00:00", "datetime", "0000-00-00 00:00:00", "string"), ("2024-02-03", "date", "2024-02-03", "string"), ("1", "bool", True, "bool"), ('{"a":1}', "json", '{"a":1}', "string"), (None, "int", None, None), ("2", "enum('a','b')", 2, "int"), ("7", None, "7", "string"),
    ]
    df = spark.createDataFrame([(i, t, k) for i, (t, k, *_) in enumerate(cases)], "i int, t string, k string")
    for r, (*_, value, tag) in zip(dicts(df.orderBy("i").select(binlog.decode_cell(F.col("t"), F.col("k")).alias("c"), binlog.decode_cell(F.col("t"), F.col("k"), True).alias("e"))), cases):
        assert {k: v for k, v in r["c"].items() if v is not None} == ({f"{tag}_value": value} if tag else {})
        assert tag or r["e"]["string_value"] == ""
    events = spark.createDataFrame([("b.1", 4, "insert", "t", ["id", "name"], ["int", "text"], ["id"], [["1", "a", "extra"], ["2", None]])], "file string, offset bigint, action string, table string, columns array<string>, column_types array<string>, key_columns array<string>, rows array<array<string>>")
    assert [[(c["int_value"], c["string_value"]) for c in r["dml"]["column_values"]] for r in dicts(binlog.binlog_changes(binlog.typed_rows(events)))] == [[(1, None), (None, "a")], [(2, None), (None, None)]]


def test_wire_form(spark):
    """Bytes by hand, and a round trip of every field with small, large and empty values."""
    from changeweave.model import CHANGE

    values = [cell(""), cell("é" * 100), cell(0), cell(300), cell(-1), cell(2**62), cell(-(2**63)), cell(2**63 - 1), cell(0.0), cell(-1.5), cell(True), cell(False), cell("2024-01-01T00:00:00Z", stamp=True), cell()]
    names = [f"c{i}" for i in range(len(values))]
    rows = [
        ("0/1", "dml", {"table": "t", "column_names": names, "column_values": values, "kind": "update", "old_keys": {"key_names": ["id"], "key_values": [cell(7)]}}, None),
        ("0/2", "dml", {"table": "t", "column_names": [], "column_values": [], "kind": "delete", "old_keys": None}, None),
        ("0/3", "ddl", None, {"id": 1000, "time": "now", "username": "u", "database": "", "ddl": "x" * 20000}),
        ("", "", None, None),
    ]
    df = spark.createDataFrame(rows, CHANGE)
    sent = df.select(wire.wire_change(F.struct(*CHANGE.fieldNames())).alias("value"))
    assert bytes(sent.collect()[1].value) == b"\n\x030/2\x12\x03dml\x1a\x0b\n\x01t\"\x06delete"
    assert dicts(wire.read_wire(sent)) == dicts(df)
    assert wire.read_wire(sent.limit(0)).count() == 0
    with pytest.raises(ValueError):
        wire.read_change(b"\x0b")


def test_tables():
    assert tables.jdbc_options("mysql://u:p%40@h/shop?x=1") == {"url": "jdbc:mysql://h:3306/shop?x=1", "fetchsize": "10000", "user": "u", "password": "p@"}
    assert tables.jdbc_options("postgres://h:99/db")["url"] == "jdbc:postgresql://h:99/db"
    with pytest.raises(ValueError):
        tables.jdbc_options("http://h/x")
    assert tables.bound("a = $2 and b = $1 or c = $2", [1, 2], "mysql") == ("a = ? and b = ? or c = ?", [2, 1, 2]) and tables.bound("a = $1", [1], "postgresql") == ("a = $1", [1])


def test_waiting_and_retry(tmp_path):
    c = BootstrapController(FileStore(str(tmp_path / "s.json")))
    waits = []

    def sleep(seconds):
        waits.append(seconds)
        if len(waits) == 2:
            c.start_bootstrap("0/7")
        if len(waits) == 4:
            c.complete_bootstrap()

    wait_to_stream(c, sleep=sleep)
    assert waits == [0.1] * 4
    with pytest.raises(StateError):
        wait_to_stream(BootstrapController(FileStore(str(tmp_path / "t.json"))), most=0.3, sleep=lambda s: None)
    waits, left = [], [OSError()] * 7

    def attempt():
        if left:
            raise left.pop()
        return "done"

    assert with_retry(attempt, sleep=waits.append) == "done" and waits == [1, 2, 4, 8, 16, 30, 30]
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), tries=3, sleep=waits.append)
    c.accumulated(2, "0/9")
    assert c.status()["current_position"] == "0/9"


def test_live_end(spark, tmp_path):
    """An empty position takes only what comes after the changes that are there, also after a restart."""
    (tmp_path / "in").mkdir()
    body = lambda n: json.dumps({"type": "dml", "position": f"0/{n}", "data": {"table": "t", "columnnames": ["id"], "columnvalues": [n], "kind": "insert"}})
    (tmp_path / "in" / "1.json").write_text("\n".join(body(n) for n in (1, 2, 3)))
    seen = []
    run = lambda: streams.replicate(streams.stream_changes(spark, str(tmp_path / "in"), "", start=str(tmp_path / "start")), config({}), "postgresql", lambda b, n: seen.extend(r.position for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "2.json").write_text("\n".join(body(n) for n in (4, 5)))
    run()
    assert seen == ["0/4", "0/5"]


def test_state_after_compaction(spark, tmp_path):
    """Reading and compacting again give what the whole log gives."""
    rows = [("a", "insert", 1, ["x", "y"], "1", "p"), ("b", "insert", 2, ["x"], "2", None), ("a", "update", 3, ["x"], None, None), ("b", "delete", 4, [], None, None), ("a", "update", 6, ["y"], None, "q"), ("b", "insert", 7, ["y"], None, "r"), ("c", "insert", 8, ["x"], "3", None), ("c", "delete", 9, [], None, None)]
    schema = "k string, kind string, s int, present array<string>, x string, y string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    args = (["k"], ["x", "y"], ["s"])
    state = str(tmp_path / "state")
    streams.apply_to_state(streams.stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), state, str(tmp_path / "cp")).awaitTermination()
    wanted = sorted(map(tuple, latest_rows(spark.createDataFrame(rows, schema), *args).collect()))
    assert sorted(map(tuple, streams.read_state(spark, state, *args).collect())) == wanted
    for horizon in (3, 4, 7, 20):
        streams.compact_state(spark, state, *args, (horizon,))
        assert sorted(map(tuple, streams.read_state(spark, state, *args).collect())) == wanted


def test_log(spark, tmp_path):
    df = spark.createDataFrame([(f"0/{i:X}", f"p{i}") for i in range(1, 40)] + [("bad", "x"), ("0/BOOTSTRAP1", "b"), ("0/1", "p1")], "position string, payload string")
    change_log.append(df, str(tmp_path / "log"))
    log = change_log.once(change_log.read_log(spark, str(tmp_path / "log")))
    assert log.count() == 40
    assert [r.payload for r in change_log.page(log, "0/A", 2, 3).collect()] == ["p13", "p14", "p15"]
    assert change_log.after(log, "bootstrap").count() == 40 and change_log.after(log, "0/27").count() == 0
    with pytest.raises(ValueError):
        change_log.after(log, "nonsense")


def test_synthetic_positions_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("position_of")).repartition(7)
    got = [(r.k, r.position) for r in change_log.with_bootstrap_positions(df, "k").orderBy("k").collect()]
    assert got == [(i, f"0/BOOTSTRAP{i + 1:016d}") for i in range(1000)]
    assert change_log.with_bootstrap_positions(df.limit(0), "k").count() == 0
    tied = spark.createDataFrame([(None,), (1,), (1,)], "k int")
    assert sorted((r.k, r.position[-1]) for r in change_log.with_bootstrap_positions(tied, "k").collect() if r.k) == [(1, "2"), (1, "3")]


def test_pushed_filters(spark, tmp_path):
    change_log.append(spark.createDataFrame([("0/1", "a")], "position string, payload string"), str(tmp_path / "log"))
    plan = change_log.after(change_log.read_log(spark, str(tmp_path / "log")), "0/5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(score" in plan


def test_latest_rows(spark):
    rows = [("a", "insert", 1, ["x", "y"], "1", "p"), ("a", "update", 2, ["x"], None, None), ("a", "insert", 3, ["x"], "9", None), ("b", "insert", 1, ["x"], "1", None), ("b", "delete", 2, [], None, None), ("b", "update", 3, ["x"], "5", None), ("c", "update", 1, ["x"], "1", None), ("b", "insert", 4, ["y"], None, "q")]
    df = spark.createDataFrame(rows, "k string, kind string, s int, present array<string>, x string, y string")
    assert sorted(tuple(r) for r in latest_rows(df, ["k"], ["x", "y"], ["s"]).collect()) == [("a", None, "p"), ("b", None, "q")]
    assert latest_rows(df.limit(0), ["k"], ["x", "y"], ["s"]).count() == 0


def test_controller(tmp_path):
    store = FileStore(str(tmp_path / "state.json"))
    c = BootstrapController(store, clock=lambda: 5.0)
    with pytest.raises(StateError):
        c.complete_bootstrap()
    c.start_bootstrap("0/7")
    c.accumulated(3)
    with pytest.raises(StateError):
        c.start_bootstrap("0/8")
    assert BootstrapController(store).info.current == State.ACCUMULATING and BootstrapController(store, only_streaming=True).info.current == State.WAITING
    c.complete_bootstrap()
    assert c.may_stream() and c.status()["accumulated_changes"] == 3 and BootstrapController(store, only_streaming=True).info.start_position == "0/7"

    class Broken(FileStore):
        def save(self, info):
            raise OSError

    d = BootstrapController(Broken(str(tmp_path / "other.json")))
    with pytest.raises(OSError):
        d.start_bootstrap("0/1")
    assert d.info.current == State.WAITING
    assert (resume_position(0), resume_position(3)) == ("bootstrap", "")


def test_stream_replicates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = lambda p, n: json.dumps({"type": "dml", "position": p, "data": {"table": "users", "columnnames": ["id", "name"], "columnvalues": [n, f"n{n}"], "kind": "insert"}})
    (tmp_path / "in" / "1.json").write_text("\n".join(body(f"0/{n}", n) for n in (3, 1, 2)) + "\nnot json\n")
    seen = []
    run = lambda: streams.replicate(streams.stream_changes(spark, str(tmp_path / "in"), "0/1"), config({"users": {"name": ("Regex", {"pattern": "n", "replacement": "m"})}}), "postgresql", lambda b, n: seen.append([r.sql for r in b.collect()]), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "2.json").write_text(body("0/4", 4))
    run()
    insert = lambda n: f"INSERT INTO users (id, name) VALUES ({n}, 'm{n}');"
    assert seen == [[insert(2), insert(3)], [insert(4)]]


def test_synthetic_tables_refer_to_each_other(spark):
    t = synthetic.generate(spark, 3, 6)
    for child, column, parent in (("users", "organization_id", "organizations"), ("organizations", "owner_id", "users"), ("tasks", "assignee_id", "users"), ("tasks", "project_id", "projects"), ("projects", "owner_id", "users"), ("invoices", "organization_id", "organizations"), ("credit_cards", "organization_id", "organizations")):
        assert t[child].join(t[parent].select(F.col("id").alias(column)), column, "left_anti").count() == 0, child
    assert t["tasks"].where("status is null").count() == 0
    assert len(synthetic.ddl("mysql")) == 7 and "CHAR(36)" in synthetic.ddl("mysql")[0]


def test_every_query_has_rows_and_a_schema(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
