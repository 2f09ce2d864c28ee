"""Tables of the primary and the replica, read over JDBC."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that a connection fetches at once.
FETCH = 10_000
# Schemes of database URLs, and their drivers' names and ports.
_DRIVERS = {"postgres": ("postgresql", 5432), "postgresql": ("postgresql", 5432), "mysql": ("mysql", 3306)}


def placeholders(sql: Column, dialect: str) -> Column:
    """Parameters ``$1``, ``$2`` as the dialect writes them: ``?`` for mysql, in the order in which they stand."""
    return F.regexp_replace(sql, r"\$\d+", "?") if dialect == "mysql" else sql


def bound(sql: str, parameters: list, dialect: str) -> tuple[str, list]:
    """A statement with ``$n`` parameters for the dialect: the text, and the parameters in the order in which it asks for them."""
    if dialect != "mysql":
        return sql, list(parameters)
    return re.sub(r"\$\d+", "?", sql), [parameters[int(n) - 1] for n in re.findall(r"\$(\d+)", sql)]


def jdbc_options(url: str) -> dict[str, str]:
    """Options of Spark's JDBC source for a database URL; ValueError for another scheme."""
    parts = urlsplit(url)
    if parts.scheme not in _DRIVERS:
        raise ValueError(f"no database URL: {parts.scheme}")
    name, port = _DRIVERS[parts.scheme]
    made = {"url": f"jdbc:{name}://{parts.hostname}:{parts.port or port}{parts.path}{'?' + parts.query if parts.query else ''}", "fetchsize": str(FETCH)}
    if parts.username:
        made["user"] = unquote(parts.username)
    if parts.password:
        made["password"] = unquote(parts.password)
    return made


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """A table over JDBC; filters and columns that are asked for go to the server.

    With a numeric ``key`` and its ``bounds`` the table is read in so many
    ranges at once; rows outside of the bounds belong to the first and last.
    The server's driver must be on the class path.
    """
    reader = spark.read.format("jdbc").options(**jdbc_options(url)).option("dbtable", name)
    if key and bounds and partitions > 1:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()
