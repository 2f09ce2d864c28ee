"""The registered queries on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import table
from . import leakage, subjects, tokens


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_documents(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "test_items"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.removal_spans(leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "test_items")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(*[table(spark, folder, n) for n in ("documents", "subject_areas", "subject_labels")])


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p8_spans, p9_found)}
SQL: dict[str, str] = {}
