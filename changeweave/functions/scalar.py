"""Scalar functions of templates, literals, URLs and seeds, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Offset basis and prime of FNV-1a with 64 bits, in halves.
_BASIS_HIGH, _BASIS_LOW, _PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
_HALF = 0xFFFFFFFF


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def before(text: Column, separator: str) -> Column:
    """What stands before the first separator; the whole text if there is none."""
    return F.substring_index(text, separator, 1) if separator else F.when(text.isNotNull(), "")


def after(text: Column, separator: str) -> Column:
    """What stands after the first separator; the empty text if there is none."""
    if not separator:
        return text
    at = F.instr(text, separator)
    return F.when(text.isNull(), None).when(at > 0, F.substr(text, at + len(separator))).otherwise("")


def seed_hash(text: Column) -> Column:
    """FNV-1a (64 bits) of the text's UTF-8 bytes, as an unsigned decimal(20,0).

    The hash is folded in two halves of 32 bits, so no step can overflow.
    """
    bytes_ = F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
    start = F.struct(F.lit(_BASIS_HIGH).cast("bigint").alias("high"), F.lit(_BASIS_LOW).cast("bigint").alias("low"))

    def step(h: Column, c: Column) -> Column:
        low = h["low"].bitwiseXOR(F.ascii(c).cast("bigint"))
        product = low * _PRIME_LOW
        high = h["high"] * _PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_HALF)).alias("high"), product.bitwiseAND(F.lit(_HALF)).alias("low"))

    folded = F.aggregate(bytes_, start, step)
    return (folded["high"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(11,0)") + folded["low"].cast("decimal(20,0)")).cast("decimal(20,0)")


def salt(text: Column) -> Column:
    """The 16 bytes of salt of a value, in hexadecimal: the first half of its SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def float_text(value: Column) -> Column:
    """A double as templates print it: shortest digits, exponent form below 1e-4 and from 1e21 on."""
    size = F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa, exponent = F.split(value.cast("string"), "E").getItem(0), F.try_element_at(F.split(value.cast("string"), "E"), F.lit(2)).try_cast("int")
    # Spark writes 1.0E21; the exponent has a sign and two digits at least here.
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf")
        .when(value == 0, "0").when((size >= 1e-4) & (size < 1e21), plain).otherwise(scientific)
    )


def luhn_number(seed: Column, length: int = 16) -> Column:
    """A number of ``length`` digits whose last is the Luhn check digit of the others."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(length - 1)), lambda i: F.pmod(F.conv(F.substr(F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(10)).cast("int"))
    # From the right, beginning with the digit before the check digit, every second one is doubled.
    doubled = F.transform(digits, lambda d, i: F.when((F.lit(length - 2) - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.concat(F.array_join(digits.cast("array<string>"), ""), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def last_segment(text: Column) -> Column:
    """The part of a uuid after its last hyphen."""
    return F.substring_index(text, "-", -1)


def last_characters(text: Column, n: int = 8) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.substr(text, F.length(text) - (n - 1)))


def relative_time(at: Column, now: Column) -> Column:
    """just now, Nm, Nh, or the date, as a list of rows shows how old a value is."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).when(seconds.isNotNull(), F.date_format(at, "yyyy-MM-dd"))
    )


_PORTS = {"postgres": "5432", "postgresql": "5432", "mysql": "3306"}
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:@/]*)(?::([^@]*))?@)?([^:/?]*)(?::(\d+))?(?:/([^?]*))?(?:\?(.*))?$"


def url_parts(url: Column) -> Column:
    """Struct of scheme, user, password, host, port (default by scheme), database and sslmode of a database URL; NULL if it is none."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    port = F.when(part(5) != "", part(5))
    for scheme, number in _PORTS.items():
        port = F.coalesce(port, F.when(part(1) == scheme, number))
    mode = F.regexp_extract(part(7), r"(?:^|&)sslmode=([^&]*)", 1)
    made = F.struct(part(1).alias("scheme"), part(2).alias("user"), part(3).alias("password"), part(4).alias("host"), port.alias("port"), part(6).alias("database"), F.when(mode != "", mode).alias("sslmode"))
    return F.when(url.rlike(_URL), made)


def mysql_url_parts(url: Column) -> Column:
    """Host, port (3306 if absent), user, password and database of a mysql URL; NULL for another scheme."""
    parts = url_parts(url)
    return F.when(parts["scheme"] == "mysql", F.struct(*[parts[n].alias(n) for n in ("host", "port", "user", "password", "database")]))


def dialect_of_url(url: Column) -> Column:
    return F.when(F.lower(url).startswith("mysql://"), "mysql").when(url.isNotNull(), "postgresql")


def dialect_of_name(name: Column) -> Column:
    """mysql or postgresql; NULL for a name that is neither."""
    return F.when(F.lower(name).isin("mysql", "mariadb"), "mysql").when(F.lower(name).isin("postgres", "postgresql", "pg"), "postgresql")


def mysql_dsn(url: Column) -> Column:
    """``user:password@tcp(host:port)/database?options`` of a mysql URL; other text as it is."""
    login = F.regexp_extract(url, r"^mysql://([^@/]*@)?", 1)
    host, port = F.regexp_extract(url, _URL, 4), F.regexp_extract(url, _URL, 5)
    rest = F.regexp_extract(url, r"^mysql://[^/?]*(.*)$", 1)
    return F.when(url.startswith("mysql://"), F.concat(login, F.lit("tcp("), host, F.lit(":"), F.when(port == "", "3306").otherwise(port), F.lit(")"), rest)).otherwise(url)
