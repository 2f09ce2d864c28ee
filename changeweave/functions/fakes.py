"""Deterministic stand-ins for personal values.

Every stand-in is a small expression over the value's SHA-256, so equal values
get equal stand-ins in every table and every run, no state is kept, and the
same expression can be written for another SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, functions as F

# The words that stand-ins are made of.
FIRST = "Ada Bruno Clara Dario Edith Felix Greta Hugo Irene Jonas Karin Lukas Mira Nils Olga Pavel Quinn Rosa Samir Tilda Umar Vera Wanda Xenia Yusuf Zora".split()
LAST = "Abbott Becker Castro Dubois Eriksen Ferrara Goddard Hansen Ibarra Jansen Keller Lindqvist Moreau Novak Okafor Petrov Quigley Romero Santos Tanaka Ueda Varga Whitfield Yilmaz Zimmer".split()
PREFIX = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof."]
GENDER = ["female", "male"]
JOB_LEVEL = "Senior Junior Lead Chief Regional Global Principal Assistant".split()
JOB_AREA = "Accounts Security Research Marketing Operations Quality Logistics Data".split()
JOB_KIND = "Analyst Engineer Manager Officer Planner Consultant Designer Director".split()
COMPANY_HEAD = "Northwind Bluepeak Ironbridge Silverline Greenfield Redwood Clearwater Stonegate Brightway Fairmont".split()
COMPANY_TAIL = ["Group", "Industries", "Partners", "Holdings", "Labs", "Logistics", "Works", "Systems"]
DOMAIN_END = ["com", "net", "org", "info", "biz", "io"]
STREET = "Oak Maple Cedar Elm Pine River Lake Hill Park Mill Church Station Garden Meadow Sunset".split()
STREET_KIND = ["Street", "Avenue", "Lane", "Road", "Drive", "Court"]
CITY = "Ashford Brookside Carlton Dunmore Eastvale Fairview Glenwood Harborview Kingsport Lakewood Milton Newbury Oakdale Preston Riverton Salem Weston".split()
STATE = {"AZ": "Arizona", "CO": "Colorado", "FL": "Florida", "GA": "Georgia", "IA": "Iowa", "ME": "Maine", "NV": "Nevada", "OH": "Ohio", "OR": "Oregon", "TX": "Texas", "UT": "Utah", "VT": "Vermont"}
COUNTRY = ["Argentina", "Belgium", "Canada", "Denmark", "Estonia", "Finland", "Greece", "Hungary", "Iceland", "Japan", "Kenya", "Latvia", "Mexico", "Norway", "Portugal", "Spain", "Uruguay"]
MATERIAL = ["Steel", "Wooden", "Cotton", "Glass", "Ceramic", "Bamboo", "Leather", "Paper"]
ADJECTIVE = ["Compact", "Modern", "Rugged", "Portable", "Quiet", "Sturdy", "Light", "Smart"]
THING = ["Lamp", "Chair", "Kettle", "Router", "Backpack", "Clock", "Speaker", "Blender", "Camera", "Desk"]
WORD = "amber basin copper drift ember fable grove harbor island jolly kettle lantern meadow nimble orchard pebble quiet ripple silver timber umber velvet willow yonder zephyr".split()
MONTH = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
WEEKDAY = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CARD = ["Visa", "Mastercard", "American Express", "Discover", "JCB", "Diners Club"]
CURRENCY = ["USD", "EUR", "GBP", "JPY", "CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "CAD", "AUD", "NZD", "INR", "BRL", "ZAR"]
PASSWORD = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!@#$%*-_ "


def _hash(salt: str, text: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), text), 256), 1, 8), 16, 10).cast("bigint")


def _hash_sql(salt: str, text: str) -> str:
    return f"CAST(('0x' || substr(sha256('{salt}|' || {text}), 1, 8)) AS BIGINT)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Part:
    """A piece of a stand-in: an expression for Spark, and the same for a plain SQL engine."""

    def column(self, text: Column) -> Column:
        raise NotImplementedError

    def sql(self, text: str) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Fixed(Part):
    text: str

    def column(self, text: Column) -> Column:
        return F.lit(self.text)

    def sql(self, text: str) -> str:
        return _quoted(self.text)


@dataclass(frozen=True)
class Pick(Part):
    salt: str
    words: Sequence[str]

    def column(self, text: Column) -> Column:
        return F.get(F.array(*[F.lit(w) for w in self.words]), (_hash(self.salt, text) % len(self.words)).cast("int"))

    def sql(self, text: str) -> str:
        return f"list_extract([{', '.join(map(_quoted, self.words))}], 1 + {_hash_sql(self.salt, text)} % {len(self.words)})"


@dataclass(frozen=True)
class Number(Part):
    """A whole number from ``low`` to ``high``, padded to ``width``."""

    salt: str
    low: int
    high: int
    width: int = 0

    def number(self, text: Column) -> Column:
        return F.lit(self.low).cast("bigint") + _hash(self.salt, text) % (self.high - self.low + 1)

    def number_sql(self, text: str) -> str:
        return f"({self.low} + {_hash_sql(self.salt, text)} % {self.high - self.low + 1})"

    def column(self, text: Column) -> Column:
        made = self.number(text).cast("string")
        return F.lpad(made, self.width, "0") if self.width else made

    def sql(self, text: str) -> str:
        made = f"CAST({self.number_sql(text)} AS VARCHAR)"
        return f"lpad({made}, {self.width}, '0')" if self.width else made


@dataclass(frozen=True)
class Unit(Part):
    """A number between ``low`` and ``high`` with six digits after the point."""

    salt: str
    low: float
    high: float

    def column(self, text: Column) -> Column:
        return F.round(F.lit(self.low) + _hash(self.salt, text).cast("double") / 4294967295.0 * (self.high - self.low), 6)

    def sql(self, text: str) -> str:
        return f"round({self.low}::DOUBLE + CAST({_hash_sql(self.salt, text)} AS DOUBLE) / 4294967295.0::DOUBLE * {self.high - self.low}::DOUBLE, 6)"


@dataclass(frozen=True)
class Day(Part):
    """A date from ``first``, within so many days."""

    salt: str
    first: date
    days: int

    def column(self, text: Column) -> Column:
        return F.date_format(F.date_add(F.lit(self.first), (_hash(self.salt, text) % self.days).cast("int")), "yyyy-MM-dd")

    def sql(self, text: str) -> str:
        return f"strftime(DATE '{self.first}' + CAST({_hash_sql(self.salt, text)} % {self.days} AS INTEGER), '%Y-%m-%d')"


@dataclass(frozen=True)
class Joined(Part):
    parts: tuple[Part, ...]

    def column(self, text: Column) -> Column:
        return F.concat(*[p.column(text) for p in self.parts])

    def sql(self, text: str) -> str:
        return " || ".join(p.sql(text) for p in self.parts)


@dataclass(frozen=True)
class Lower(Part):
    part: Part

    def column(self, text: Column) -> Column:
        return F.lower(self.part.column(text))

    def sql(self, text: str) -> str:
        return f"lower({self.part.sql(text)})"


@dataclass(frozen=True)
class CheckDigit(Part):
    """Digits with their Luhn check digit."""

    salt: str
    length: int

    def _digits(self) -> list[Number]:
        return [Number(f"{self.salt}{i}", 4 if i == 0 else 0, 4 if i == 0 else 9) for i in range(self.length - 1)]

    def column(self, text: Column) -> Column:
        digits = [d.number(text) for d in self._digits()]
        total = F.lit(0).cast("bigint")
        for i, d in enumerate(digits):
            total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if (self.length - 2 - i) % 2 == 0 else d)
        return F.concat(*[d.cast("string") for d in digits], F.pmod(-total, F.lit(10)).cast("string"))

    def sql(self, text: str) -> str:
        digits = [d.number_sql(text) for d in self._digits()]
        terms = [f"(CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END)" if (self.length - 2 - i) % 2 == 0 else d for i, d in enumerate(digits)]
        return " || ".join(f"CAST({d} AS VARCHAR)" for d in digits) + f" || CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS VARCHAR)"


def _join(*parts: Part | str) -> Joined:
    return Joined(tuple(Fixed(p) if isinstance(p, str) else p for p in parts))


def _words(salt: str, n: int, gap: str = " ") -> Joined:
    parts: list[Part | str] = []
    for i in range(n):
        parts += ([gap] if i else []) + [Pick(f"{salt}{i}", WORD)]
    return _join(*parts)


_first, _last = Pick("first", FIRST), Pick("last", LAST)
_company = _join(Pick("head", COMPANY_HEAD), " ", Pick("tail", COMPANY_TAIL))
_domain = _join(Lower(Pick("head", COMPANY_HEAD)), ".", Pick("end", DOMAIN_END))
_street = _join(Number("house", 1, 9999), " ", Pick("street", STREET), " ", Pick("kind", STREET_KIND))
_state = Pick("state", list(STATE.values()))
_zip = Number("zip", 10000, 99999, 5)
_product = _join(Pick("adjective", ADJECTIVE), " ", Pick("material", MATERIAL), " ", Pick("thing", THING))

#: Stand-ins by transform type: (what they are made of, type of the input and output).
FAKES: dict[str, tuple[Part, str]] = {
    "FakeName": (_join(_first, " ", _last), "string"),
    "FakeFirstName": (_first, "string"),
    "FakeLastName": (_last, "string"),
    "FakeEmail": (_join(Lower(_first), ".", Lower(_last), Number("mail", 1, 9999), "@", _domain), "string"),
    "FakeSSN": (_join(Number("area", 100, 899, 3), "-", Number("group", 1, 99, 2), "-", Number("serial", 1, 9999, 4)), "string"),
    "FakeDateOfBirth": (Day("birth", date(1940, 1, 1), 24000), "string"),
    "FakePhone": (_join("(", Number("code", 200, 999, 3), ") ", Number("exchange", 200, 999, 3), "-", Number("line", 0, 9999, 4)), "string"),
    "FakeGender": (Pick("gender", GENDER), "string"),
    "FakeTitle": (Pick("prefix", PREFIX), "string"),
    "FakeJobTitle": (_join(Pick("level", JOB_LEVEL), " ", Pick("area", JOB_AREA), " ", Pick("job", JOB_KIND)), "string"),
    "FakeIndustry": (_join(_company, " Industry"), "string"),
    "FakeDomainName": (_domain, "string"),
    "FakeUsername": (_join(Lower(_first), Lower(_last), Number("user", 1, 999)), "string"),
    "FakePassword": (_join(*[Pick(f"secret{i}", list(PASSWORD)) for i in range(12)]), "string"),
    "FakeStreetAddress": (_join(_street, ", ", Pick("city", CITY), ", ", _state, " ", _zip), "string"),
    "FakeStreet": (_street, "string"),
    "FakeCity": (Pick("city", CITY), "string"),
    "FakeState": (_state, "string"),
    "FakeStateAbbr": (Pick("state", list(STATE)), "string"),
    "FakeZip": (_zip, "string"),
    "FakeCountry": (Pick("country", COUNTRY), "string"),
    "FakeLatitude": (Unit("latitude", -90.0, 90.0), "double"),
    "FakeLongitude": (Unit("longitude", -180.0, 180.0), "double"),
    "FakeCompany": (_company, "string"),
    "FakeProduct": (_product, "string"),
    "FakeProductName": (_join(Pick("adjective", ADJECTIVE), " ", Pick("thing", THING)), "string"),
    "FakeProductDescription": (_join("A ", Lower(Pick("adjective", ADJECTIVE)), " ", Lower(Pick("thing", THING)), " of ", Lower(Pick("material", MATERIAL)), ", ", _words("about", 3), "."), "string"),
    "FakeParagraph": (_join(_words("one", 5), ".\n", _words("two", 5), ".\n", _words("three", 5), "."), "string"),
    "FakeWord": (Pick("word", WORD), "string"),
    "FakeMonth": (Pick("month", MONTH), "string"),
    "FakeMonthNum": (Number("month", 1, 12), "bigint"),
    "FakeWeekDay": (Pick("weekday", WEEKDAY), "string"),
    "FakeYear": (Number("year", 1900, 2024), "bigint"),
    "FakeCreditCardType": (Pick("card", CARD), "string"),
    "FakeCreditCardNum": (CheckDigit("card", 16), "string"),
    "FakeCurrency": (Pick("currency", CURRENCY), "string"),
    # Declared and documented by the reference, but unusable there.
    "FakeSentence": (_join(_words("sentence", 6), "."), "string"),
    "FakeWords": (_words("words", 3), "string"),
    "FakeCharacters": (_join(*[Pick(f"char{i}", list("abcdefghijklmnopqrstuvwxyz")) for i in range(8)]), "string"),
    "FakeCharacter": (Pick("char0", list("abcdefghijklmnopqrstuvwxyz")), "string"),
    "FakeDigits": (Number("digits", 0, 99999999, 8), "string"),
}


def fake(kind: str, value: Column) -> Column:
    """The stand-in of a value; NULL for NULL.  The value is hashed as text."""
    part, type_ = FAKES[kind]
    text = value.cast("string")
    made = part.number(text) if type_ == "bigint" else part.column(text)
    return F.when(value.isNotNull(), made).cast(type_)


def fake_sql(kind: str, text: str) -> str:
    """The same for a plain SQL engine, over a text expression that is not NULL."""
    part, type_ = FAKES[kind]
    return part.number_sql(text) if type_ == "bigint" else part.sql(text)
