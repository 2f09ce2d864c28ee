import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F, types as T

from changeweave.functions import dialect, passwords, position, scalar
from changeweave.functions.fakes import FAKES, fake
from changeweave.functions.regex import PatternError, java_pattern, replace_all
from changeweave.functions.template import TemplateError, compile_template
from fixtures import cell as make_cell, CELL


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def apply(spark, values, f, kind="string"):
    return [r.out for r in column(spark, values, kind).select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_scores(spark):
    cases = {
        "0/100": 256, "bootstrap": -(10**18), "0/BOOTSTRAP00000001": -999999, "0/BOOTSTRAP00000123": -999877, "16/0": 22 * 2**32, "f/ffea45b0": 15 * 2**32 + 0xFFEA45B0, "mysql-bin.000002:4": 2 * 2**32 + 4,
        " mysql-bin.990:0000000004 ": 990 * 2**32 + 4, "invalid": None, "0/BOOTSTRAPinvalid": None, "mysql-bin.000001": None, "mysql-bin:100": None, "": None, None: None, "mysql-bin.99999999999999:1": None,
    }
    assert apply(spark, list(cases), position.score) == list(cases.values())
    for text, wanted in cases.items():
        if text is not None and wanted != position.score_of(text):
            assert wanted is None and position.score_of(text) > 2**63  # beyond 64 bits a column has no score


def test_positions_compare_and_generate(spark):
    pairs = [("0/1", "0/2", -1), ("0/2", "0/BOOTSTRAP0000000000000009", 1), ("0/A", "0/a", 0), ("x", "0/1", None), ("0/BOOTSTRAP0000002000000000", "0/1", -1)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r.c for r in df.select(position.compare(F.col("a"), F.col("b")).alias("c")).collect()] == [c for *_, c in pairs]
    assert apply(spark, [1, 12], position.bootstrap_text, "bigint") == ["0/BOOTSTRAP0000000000000001", "0/BOOTSTRAP0000000000000012"]


@pytest.mark.parametrize(
    "pattern, replacement, text, wanted",
    [
        (r"\d{3}-\d{3}-\d{4}", "XXX-XXX-XXXX", "123-456-7890", "XXX-XXX-XXXX"), (r"(\d{4})-(\d{4})-(\d{4})-(\d{4})", "XXXX-XXXX-XXXX-$4", "1234-5678-9012-3456", "XXXX-XXXX-XXXX-3456"),
        (r"\d+", "X", "abc123def456", "abcXdefX"), (r"\d+", "NUMBER", "no numbers here", "no numbers here"), (r"(a)", "$1W", "a", ""), (r"(a)", "${1}W", "a", "aW"), (r"(?P<x>a)", "<$x>", "ba", "b<a>"),
        (r"a", "$2", "abc", "bc"), (r"a", r"\$$", "a", r"\$"), (r"a$", "b", "a\n", "a\n"), (r"[[:alpha:]]+", "x", "ab1", "x1"), (r"[a[b]", "x", "a[b", "xxx"), (r"(a)(b)", "${1}0", "ab", "a0"), (r"a.c", "x", "a\rc", "x"),
    ],
)
def test_regex(spark, pattern, replacement, text, wanted):
    assert apply(spark, [text, None], lambda c: replace_all(c, pattern, replacement)) == [wanted, None]


@pytest.mark.parametrize("pattern", ["[", "(a", "a)", "(?=a)", r"(a)\1", "(?<!a)b", "[[:nope:]]"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(PatternError):
        java_pattern(pattern)


def test_regex_like_another_engine(spark):
    rng = random.Random(5)
    con = duckdb.connect()
    texts = ["".join(rng.choice("ab1-_ .\n[") for _ in range(12)) for _ in range(60)]
    for pattern in (r"[ab]+$", r"^a|b$", r"a.b", r"(a|b){2}", r"[^a\n]+", r"\W", r"[[:digit:]]", r"(?i)A+"):
        wanted = [con.execute("select regexp_replace(?, ?, '<>', 'g')", [t, pattern]).fetchone()[0] for t in texts]
        assert apply(spark, texts, lambda c, p=pattern: replace_all(c, p, "<>")) == wanted, pattern


ROW = {"first_name": ("John", "string"), "last_name": ("Doe", "string"), "title": ("Hello World! This is a Test.", "string"), "email": ("user@example.com", "string"), "active": (True, "boolean"), "score": (95.5, "double"), "n": (123, "bigint"), "none": (None, "string"), "zero": (0, "int"), "big": (1e21, "double"), "small": (1e-5, "double"), "whole": (5.0, "double")}


@pytest.mark.parametrize(
    "template, wanted",
    [
        ("{{.first_name | lower}}.{{.last_name | lower}}@company.com", "john.doe@company.com"), ("{{.title | slugify}}", "hello-world-this-is-a-test"), ('{{.email | before "@"}}', "user"), ('{{.email | after "@"}}', "example.com"),
        ('{{.first_name | after "@"}}', ""), ('{{before "@" .email | upper}}', "USER"), ("{{if .active}}ACTIVE{{else}}INACTIVE{{end}}: {{.first_name}} {{.last_name}}", "ACTIVE: John Doe"), ("Score: {{.score}}", "Score: 95.5"),
        ("{{.missing_field}}|{{.none}}", "<no value>|<no value>"), ("{{.n}} {{.active}} {{.big}} {{.small}} {{.whole}}", "123 true 1e+21 1e-05 5"), ("{{if .zero}}a{{else if .none}}b{{else}}c{{end}}", "c"), ("a {{- .n -}} b", "a123b"), ("", ""), ("plain", "plain"),
        ("{{/* note */}}x", "x"),
        ('{{if eq .n 1 123}}y{{else}}n{{end}}', "y"), ('{{if and .active (not .zero) (gt .score 95.0)}}y{{end}}', "y"), ('{{or .none .first_name "z"}}|{{and .zero .n}}', "John|0"), ("{{len .first_name}}{{len \"é\"}}", "42"),
        ('{{printf "%s-%05d|%.2f|%q|%v|%d%%" .first_name .n .score .last_name .active .n}}', 'John-00123|95.50|"Doe"|true|123%'), ('{{printf "%s" (lower .first_name) | upper}}', "JOHN"), ("{{$x := .n}}{{if .active}}{{$x}}{{end}}", "123"),
        ("{{with .first_name}}{{.}}{{else}}none{{end}}{{with .none}}x{{else}}none{{end}}", "Johnnone"), ("{{with $y := .last_name}}{{$y}}{{end}}", "Doe"), ('{{print .n .zero "a" .n}}', "123 0a123"), ("{{if lt .n 5}}a{{else if ne .first_name .last_name}}b{{end}}", "b"),
    ],
)
def test_templates(spark, template, wanted):
    schema = T.StructType([T.StructField(k, T._parse_datatype_string(t)) for k, (_, t) in ROW.items()])
    df = spark.createDataFrame([tuple(v for v, _ in ROW.values())], schema)
    fields = {f.name: (F.col(f.name), f.dataType) for f in schema.fields}
    assert df.select(compile_template(template, fields).alias("t")).first().t == wanted


@pytest.mark.parametrize("template", ["{{.name", "{{if .a}}x", "{{end}}", "{{.a | nope}}", "{{}}", "{{else}}", "{{year .a}}", "{{range .a}}{{end}}", "{{$x}}", "{{(.a}}", "{{.a)}}", "{{eq .a 1}}", '{{printf "%d" .a}}', '{{printf "%s"}}', "{{with .a}}{{.b}}{{end}}", "{{not .a .a}}", "{{len 3}}"])
def test_templates_that_are_refused(spark, template):
    with pytest.raises(TemplateError):
        compile_template(template, {"a": (F.lit("x"), T.StringType())})


def test_seed_hash(spark):
    cases = {"true": "6583304908937478053", "false": "13113042584710199672", "John Doe": "16878198346625375448", "José": "3600070339254720967", "": "14695981039346656037"}
    assert apply(spark, list(cases), lambda c: scalar.seed_hash(c).cast("string")) == list(cases.values())
    assert apply(spark, ["testuser"], scalar.salt) == ["ae5deb822e0d71992900471a7199d0d9"]


def test_literals(spark):
    cases = [(None, "NULL", "NULL"), ("it's", "'it''s'", "'it''s'"), ("a\\b", "'a\\b'", "'a\\\\b'"), (3.14, "3.140000", "3.140000"), (0.000001, "0.000001", "0.000001"), (True, "true", "1"), (False, "false", "0"), (-(2**63), str(-(2**63)), str(-(2**63))), ("漢😀", "'漢😀'", "'漢😀'")]
    df = spark.createDataFrame([(i, make_cell(v)) for i, (v, *_) in enumerate(cases)], f"i int, c {CELL}")
    for k, name in ((1, "postgresql"), (2, "mysql")):
        assert [r.t for r in df.orderBy("i").select(dialect.literal(F.col("c"), name).alias("t")).collect()] == [c[k] for c in cases]
    times = ["2024-03-20T15:04:05Z", "2024-03-20T15:04:05+02:00", "2024-03-20T15:04:05-05:00", "2024-03-20", "not-a-date", "2024-02-30", None]
    assert apply(spark, times, dialect.moment) == ["'2024-03-20 15:04:05'"] * 3 + ["'2024-03-20'", None, None, None]


def test_urls(spark):
    urls = ["mysql://u:p@h/db?x=1", "mysql://h:3307/db", "postgres://u@h/db?sslmode=require", "nonsense"]
    assert apply(spark, urls, scalar.mysql_dsn) == ["u:p@tcp(h:3306)/db?x=1", "tcp(h:3307)/db", "postgres://u@h/db?sslmode=require", "nonsense"]
    parts = apply(spark, urls, scalar.url_parts)
    assert (parts[2].user, parts[2].port, parts[2].sslmode, parts[3]) == ("u", "5432", "require", None)
    assert apply(spark, ["MySQL", "pg", "oracle"], scalar.dialect_of_name) == ["mysql", "postgresql", None]


@pytest.mark.parametrize("kind", sorted(FAKES))
def test_fakes_are_stable_and_spread(spark, kind):
    type_ = FAKES[kind][1]
    values = {"string": ["John Doe", "Jane", "", "José", "x" * 1000, None], "bigint": [1, 2, 3, 4, 5, None], "double": [1.5, 2.5, -3.0, 0.0, 9.9, None]}[type_]
    once, twice = (apply(spark, values, lambda c: fake(kind, c), type_) for _ in range(2))
    assert once == twice and once[-1] is None and len(set(once[:-1])) > 1


def test_forms_of_fakes(spark):
    names = [f"person {i}" for i in range(200)]
    forms = {"FakeEmail": r".+@.+\..+", "FakeSSN": r"\d{3}-\d{2}-\d{4}", "FakeDateOfBirth": r"\d{4}-\d{2}-\d{2}", "FakePhone": r"[\d\s\-().]+", "FakeZip": r"\d{5}", "FakeStateAbbr": "[A-Z]{2}", "FakePassword": r"(?s).{12}", "FakeIndustry": ".* Industry"}
    import re

    for kind, form in forms.items():
        assert all(re.fullmatch(form, v) for v in apply(spark, names, lambda c, k=kind: fake(k, c))), kind
    assert all(r.ok for r in column(spark, names).select(F.call_function("luhn_check", fake("FakeCreditCardNum", F.col("v"))).alias("ok")).collect())
    assert all(r.ok for r in column(spark, names).select(F.call_function("luhn_check", scalar.luhn_number(F.col("v"))).alias("ok")).collect())
    for kind, low, high in (("FakeLatitude", -90, 90), ("FakeLongitude", -180, 180)):
        assert all(low <= v <= high for v in apply(spark, [float(i) for i in range(100)], lambda c, k=kind: fake(k, c), "double"))
    assert set(apply(spark, list(range(300)), lambda c: fake("FakeMonthNum", c), "bigint")) == set(range(1, 13))


def test_passwords():
    # Test vectors: RFC 9106 (Argon2id), the crypt_blowfish suite, RFC 7914 (PBKDF2 by way of the library).
    assert passwords.argon2id_raw(b"\1" * 32, b"\2" * 16, 3, 32, 4, 32, b"\3" * 8, b"\4" * 12).hex() == "0d640df58d78766c08c037a34a8b53c9d01ef0452d75b65eb52520e96b01e659"
    assert passwords.bcrypt("U*U", cost=5, salt=passwords._from64("CCCCCCCCCCCCCCCCCCCCC.")) == "$2a$05$CCCCCCCCCCCCCCCCCCCCC.E5YPO9kmyuRGyh0XouQYb4YMJKvyOeW"
    one = passwords.bcrypt("x", cost=4)
    assert one != passwords.bcrypt("x", cost=4) and passwords.check_bcrypt("x", one) and not passwords.check_bcrypt("y", one)
    many = passwords.argon2id_batch([("a", "x"), ("b", "x"), ("a", "y")], time=2, memory=64, threads=4)
    assert many == [passwords.argon2id(c, o, time=2, memory=64, threads=4) for c, o in (("a", "x"), ("b", "x"), ("a", "y"))] and len(set(many)) == 3
    texts = [f"password {i}" * (i % 9) for i in range(passwords.BCRYPT_TOGETHER)]
    together = passwords.bcrypt_batch([(t, "") for t in texts], cost=4)
    assert all(passwords.check_bcrypt(t, h) for t, h in zip(texts, together)) and len(set(together)) == len(texts)
    assert passwords.argon2id_batch([]) == passwords.bcrypt_batch([]) == []
    assert passwords.scrypt("a", "b", n=16) == passwords.scrypt("a", "b", n=16) != passwords.scrypt("a", "c", n=16)
    assert passwords.pbkdf2("a", "testuser", iterations=2).startswith("ae5deb822e0d71992900471a7199d0d9$")
    assert passwords.pbkdf2("a", "b", use_salt=False, iterations=2).startswith("0" * 32)


def test_float_text(spark):
    cases = {0.0: "0", 1.0: "1", -2.5: "-2.5", 1e7: "10000000", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e-7: "1.5e-07", 0.0001: "0.0001", math.inf: "+Inf"}
    assert apply(spark, list(cases), scalar.float_text, "double") == list(cases.values())
