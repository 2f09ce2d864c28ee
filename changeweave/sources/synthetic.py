"""A synthetic schema with references: organizations, users, subscriptions, cards, invoices, projects, tasks.

Every value is a hash of the seed and the row's number, so tables need no
shuffle to refer to each other and any size is made in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fakes import fake
from ..functions.scalar import luhn_number
from ..functions.dialect import TYPES

# Most children per parent, prices, and weights of a task's status.
MAX_USERS, MAX_CARDS, MAX_PROJECTS, MAX_TASKS = 100, 3, 20, 50
PLANS = {"free": 0.0, "basic": 9.99, "business": 29.99, "enterprise": 99.99}
STATUS = [("todo", 50), ("doing", 15), ("done", 35)]
_START = "2022-01-01"


def _roll(n: int, *parts: Column | str) -> Column:
    """A number from 0 to n - 1 from a hash of the parts."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit(n))


def _uuid(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _past(*parts: Column | str) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(_START).cast("timestamp")) + _roll(86400 * 900, "at", *parts))


def _later(at: Column, *parts: Column | str) -> Column:
    """Half of the rows unchanged, else up to 719 hours later."""
    return F.when(_roll(2, "same", *parts) == 0, at).otherwise(F.timestamp_seconds(F.unix_timestamp(at) + 3600 * _roll(720, "later", *parts)))


def _children(parent: DataFrame, key: str, most: int, kind: str) -> DataFrame:
    """1 to ``most`` rows per parent, numbered from 0."""
    return parent.withColumn("n", F.explode(F.sequence(F.lit(0), _roll(most, kind, F.col(key)).cast("int"))))


def weighted(choices: list[tuple[str, int]], *parts: Column | str) -> Column:
    total, below, made = sum(w for _, w in choices), 0, None
    roll = _roll(total, "weight", *parts)
    for name, weight in choices:
        below += weight
        made = F.when(roll < below, name) if made is None else made.when(roll < below, name)
    return made


def generate(spark: SparkSession, organizations: int = 10, months: int = 36) -> dict[str, DataFrame]:
    """The seven tables."""
    o = spark.range(organizations).withColumn("oid", _uuid("organization", F.col("id"))).withColumn("at", _past("organization", F.col("id")))
    u = _children(o.select(F.col("oid").alias("organization_id"), "at"), "organization_id", MAX_USERS, "users").withColumn("id", _uuid("user", F.col("organization_id"), F.col("n")))
    users = u.select("id", "organization_id", fake("FakeName", F.col("id")).alias("name"), fake("FakeEmail", F.col("id")).alias("email"), F.sha2("id", 256).alias("password"), F.col("at").alias("created_at"), _later(F.col("at"), "user", F.col("id")).alias("updated_at"))
    # The first user of an organization owns it.
    owner = _uuid("user", F.col("oid"), F.lit(0))
    orgs = o.select(F.col("oid").alias("id"), fake("FakeCompany", F.col("oid")).alias("name"), fake("FakeStreetAddress", F.col("oid")).alias("billing_address"), owner.alias("owner_id"), F.col("at").alias("created_at"), _later(F.col("at"), "organization", F.col("oid")).alias("updated_at"))
    plan = F.get(F.array(*[F.lit(p) for p in PLANS]), _roll(len(PLANS), "plan", F.col("oid")).cast("int"))
    price = F.element_at(F.create_map(*[x for p, v in PLANS.items() for x in (F.lit(p), F.lit(v))]), F.col("plan_id"))
    subscriptions = o.select(_uuid("subscription", F.col("oid")).alias("id"), F.col("oid").alias("organization_id"), plan.alias("plan_id"), F.col("at").alias("created_at"), F.col("at").alias("updated_at")).withColumn("monthly_per_user_price", price.cast("decimal(10,2)"))
    c = _children(o.select(F.col("oid").alias("organization_id"), "at"), "organization_id", MAX_CARDS, "cards").withColumn("id", _uuid("card", F.col("organization_id"), F.col("n")))
    cards = c.select("id", "organization_id", luhn_number(F.col("id")).alias("number"), (_roll(12, "month", F.col("id")) + 1).cast("int").alias("exp_month"), (_roll(6, "year", F.col("id")) + 2025).cast("int").alias("exp_year"), F.lpad(_roll(1000, "cvv", F.col("id")).cast("string"), 3, "0").alias("cvv"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    p = _children(o.select(F.col("oid").alias("organization_id"), "at"), "organization_id", MAX_PROJECTS, "projects").withColumn("id", _uuid("project", F.col("organization_id"), F.col("n")))
    member = lambda kind, key: _uuid("user", F.col("organization_id"), F.pmod(F.xxhash64(F.lit(kind), F.col(key)), _roll(MAX_USERS, "users", F.col("organization_id")) + 1))
    projects = p.select("id", "organization_id", member("owner", "id").alias("owner_id"), fake("FakeProductName", F.col("id")).alias("name"), F.when(_roll(3, "described", F.col("id")) > 0, fake("FakeParagraph", F.col("id"))).alias("description"), F.col("at").alias("created_at"), _later(F.col("at"), "project", F.col("id")).alias("updated_at"))
    k = _children(p.select("organization_id", F.col("id").alias("project_id"), "at"), "project_id", MAX_TASKS, "tasks").withColumn("id", _uuid("task", F.col("project_id"), F.col("n")))
    tasks = k.select("id", "organization_id", "project_id", member("assignee", "id").alias("assignee_id"), fake("FakeWords", F.col("id")).alias("name"), F.when(_roll(2, "described", F.col("id")) > 0, fake("FakeSentence", F.col("id"))).alias("description"), weighted(STATUS, F.col("id")).alias("status"), F.col("at").alias("created_at"), _later(F.col("at"), "task", F.col("id")).alias("updated_at"))
    tables = {"organizations": orgs, "users": users, "subscriptions": subscriptions, "credit_cards": cards, "projects": projects, "tasks": tasks}
    end = F.add_months(F.trunc(F.lit(_START).cast("date"), "month"), months)
    tables["invoices"] = invoices(users, subscriptions, end)
    return tables


def first_of(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Of each group the first row by ``order``; rows without a group count as one."""
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(group).agg(best.alias("__first")).select("__first.*")


def members(users: DataFrame, group: str = "organization_id") -> DataFrame:
    """How many users each organization has."""
    return users.groupBy(group).agg(F.count("*").alias("users"))


def invoices(users: DataFrame, subscriptions: DataFrame, end: Column) -> DataFrame:
    """One invoice per organization and month, on the first: its users times its price.

    Months are counted from the first day of the month, so that no month end is clamped.
    """
    count = members(users)
    one = first_of(subscriptions, "organization_id", "created_at", "id")
    series = F.explode(F.sequence(F.add_months(F.trunc(F.col("created_at").cast("date"), "month"), 1), end, F.expr("INTERVAL 1 MONTH"))).alias("date")
    due = one.where(F.add_months(F.trunc(F.col("created_at").cast("date"), "month"), 1) <= end).select("organization_id", "monthly_per_user_price", series)
    made = due.join(count, "organization_id").withColumn("id", _uuid("invoice", F.col("organization_id"), F.col("date")))
    return made.select("id", "organization_id", "date", (F.col("monthly_per_user_price") * F.col("users")).cast("decimal(10,2)").alias("cost"), F.col("date").cast("timestamp").alias("created_at"), F.col("date").cast("timestamp").alias("updated_at"))


def ddl(dialect: str) -> list[str]:
    """CREATE TABLE statements of the seven tables."""
    t = TYPES["mysql" if dialect == "mysql" else "postgresql"]
    stamps = f"created_at {t['timestamp']} NOT NULL, updated_at {t['timestamp']} NOT NULL"
    columns = {
        "organizations": f"name {t['text']}, billing_address {t['text']}, owner_id {t['uuid']}",
        "users": f"organization_id {t['uuid']}, name {t['text']}, email {t['text']}, password {t['text']}",
        "subscriptions": f"organization_id {t['uuid']}, plan_id {t['text']}, monthly_per_user_price {t['decimal']}",
        "credit_cards": f"organization_id {t['uuid']}, number {t['text']}, exp_month {t['integer']}, exp_year {t['integer']}, cvv {t['text']}",
        "invoices": f"organization_id {t['uuid']}, date date, cost {t['decimal']}",
        "projects": f"organization_id {t['uuid']}, owner_id {t['uuid']}, name {t['text']}, description {t['text']}",
        "tasks": f"organization_id {t['uuid']}, project_id {t['uuid']}, assignee_id {t['uuid']}, name {t['text']}, description {t['text']}, status {t['text']}",
    }
    return [f"CREATE TABLE {name} (id {t['uuid']} PRIMARY KEY, {c}, {stamps});" for name, c in columns.items()]


def reset_script(tables: list[str], dialect: str) -> list[str]:
    return [f"DROP TABLE IF EXISTS {name}{'' if dialect == 'mysql' else ' CASCADE'};" for name in tables]
