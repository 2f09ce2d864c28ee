"""The ordered change log: append, range scans, retention, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.position import BEFORE_ALL, bootstrap_text, score, score_of
from ..storage import written

#: Changes that one page, or one single-shot scan, has.
PAGE = 1000


def scored(changes: DataFrame, position: str = "position") -> DataFrame:
    """The log with its exact ``score``; changes without a readable position are left out."""
    return changes.withColumn("score", score(F.col(position))).where("score is not null")


def with_bootstrap_positions(rows: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """The rows with gap-free synthetic positions in the given order, counted from 1.

    Rows are sorted in ranges and numbered within each; only the number of
    rows of each range goes through the driver.  Rows that are equal in
    ``order`` follow each other in any order; NULLs come first; an empty table
    stays empty.
    """
    keys = [F.col(c) for c in order]
    sorted_ = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    parts = sorted_.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first")).orderBy("__part").collect()  # one row per range
    starts, before = [], 0
    for part in parts:
        starts.append((part["__part"], before - part["first"] + 1))
        before += part["n"]
    shift = rows.sparkSession.createDataFrame(starts, "__part int, __shift bigint")
    return sorted_.join(F.broadcast(shift), "__part").withColumn(name, bootstrap_text(F.col("__row") + F.col("__shift"))).select(*rows.columns, name)


def append(changes: DataFrame, path: str) -> None:
    """Append to a stored log; ``score`` is stored so that range scans reach the files' statistics."""
    scored(changes).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def once(log: DataFrame, payload: str = "payload") -> DataFrame:
    """Set semantics: of equal payloads one stays."""
    return log.dropDuplicates(["score", payload])


def _bound(position: str) -> int:
    found = score_of(position)
    if found is None:
        raise ValueError(f"no position: {position!r}")
    return found


def after(log: DataFrame, position: str) -> DataFrame:
    """Changes after a position, which is not included; ``bootstrap`` is before all.

    The bound is a literal, so the filter reaches the scan.
    """
    bound = _bound(position)
    return log if bound == BEFORE_ALL else log.where(F.col("score") > bound)


def page(log: DataFrame, position: str, offset: int = 0, limit: int = PAGE, tie: str = "payload") -> DataFrame:
    """One page of the changes after a position, in order of score, then payload."""
    return after(log, position).orderBy("score", tie).offset(offset).limit(limit)


def retained(log: DataFrame, at: str, now, days: int = 7) -> DataFrame:
    """Rows not older than so many days."""
    return log.where(F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def statistics(changes: DataFrame) -> DataFrame:
    """Changes by type and kind."""
    return changes.groupBy("type", "kind").agg(F.count("*").alias("changes"))


def tables_found(changes: DataFrame, table: str = "dml_table", order: str = "score") -> DataFrame:
    """Tables in the order in which they first occur."""
    return changes.groupBy(table).agg(F.min(order).alias("first_score"))
