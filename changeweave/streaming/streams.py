"""Change logs as streams: replay and tail, deduplication, application to a stored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.position import BEFORE_ALL, score, score_of
from ..operators.dedup import newly_delivered, stored_once
from ..operators.latest_state import latest_rows, rows_after
from ..operators.render import render_changes
from ..operators.transforms import transform_changes
from ..sources.codec import read_changes
from ..sources.config import TransformConfig
from .controller import BootstrapController, wait_to_stream


def stream_changes(spark: SparkSession, path: str, last_position: str = "", files_per_batch: int = 1000, start: str | None = None, controller: BootstrapController | None = None) -> DataFrame:
    """Changes of JSON files as they arrive, after a position.

    The backlog and what comes later are one source with one checkpoint, so
    nothing between the two is missed.  ``bootstrap`` means all that the source
    still holds, an empty position the live end: only what comes after the
    changes that are there now.  Where that end is, is kept under ``start`` (a
    folder beside the checkpoint), so that a stream that is started again goes
    on at the same place.  With a ``controller`` the stream begins once the
    replication is STREAMING.
    """
    if controller is not None:
        wait_to_stream(controller)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    changes = read_changes(lines).withColumn("score", score(F.col("position")))
    if last_position == "":
        bound = live_end(read_changes(spark.read.text(path)).select(score(F.col("position")).alias("score")), start)
        return changes if bound is None else changes.where(F.col("score") > bound)
    return after_position(changes, last_position)


def live_end(log: DataFrame, kept: str | None = None) -> int | None:
    """The greatest score of a log now (None if it is empty), or the one that an earlier call kept in the folder ``kept``."""
    spark = log.sparkSession
    if kept is not None and _found(spark, kept):
        row = spark.read.schema("score bigint").parquet(kept).first()
        return None if row is None else row[0]
    bound = log.agg(F.max("score")).first()[0]
    if kept is not None:
        spark.createDataFrame([(bound,)], "score bigint").coalesce(1).write.parquet(kept)
    return bound


def _found(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet change log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def after_position(changes: DataFrame, last_position: str) -> DataFrame:
    """Changes after a position; ``bootstrap`` is before all.  The empty position needs the log's end: see ``live_end``."""
    if last_position == "bootstrap":
        return changes.where(F.col("score") >= BEFORE_ALL)
    bound = score_of(last_position)
    if bound is None:
        raise ValueError(f"no position: {last_position!r}")
    return changes.where(F.col("score") > bound)


def once_within(changes: DataFrame, identity: list[str], at: str, delay: str = "24 hours") -> DataFrame:
    """Each change once, as long as its copies arrive within ``delay`` of it; state older than that is dropped."""
    return changes.withWatermark(at, delay).dropDuplicatesWithinWatermark(identity)


def store_once(changes: DataFrame, store: str, checkpoint: str, identity: list[str], first: list[str]) -> StreamingQuery:
    """Store each change once under ``store``, however late its copies come: what is stored is never forgotten.

    Every batch is ranked together with the stored copies of its identifiers
    and written under its own number; a batch that is repeated after a failure
    replaces what it wrote.  Read with ``read_once``.
    """
    kept = changes.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _batches(spark, store, kept)
        stored = before.where(F.col("batch") != number).drop("batch") if before is not None else None
        newly_delivered(batch, stored, identity, first).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, store: str, schema: StructType) -> DataFrame | None:
    """What batches wrote, with ``batch``; None before the first."""
    if not _found(spark, store):
        return None
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(store)


def read_once(spark: SparkSession, store: str, identity: list[str], first: list[str]) -> DataFrame:
    """The changes under ``store``, each once."""
    return stored_once(spark.read.parquet(store).drop("batch"), identity, first)


def replicate(changes: DataFrame, config: TransformConfig, dialect: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Transform and render each batch and hand it to ``sink``, by score within the batch.

    Changes that cannot be transformed or rendered are left out.  Without
    ``every`` what is there is processed and the query ends.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rendered = render_changes(transform_changes(batch, config).withColumn("score", score(F.col("position"))), dialect).where("error is null")
        sink(rendered.orderBy("score").select("position", "score", "sql"), number)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def apply_to_state(changes: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep what a table's changes lead to in Parquet under ``state``.

    Each batch adds its part of the log under its own number and is written
    again as a whole if it is repeated, so a restart changes nothing.
    ``compact_state`` folds the log into rows, ``read_state`` gives the rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/log/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the compactions that were completed."""
    if not _found(spark, f"{state}/rows"):
        return []
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/rows"))]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and _found(spark, f"{state}/rows/{n}/_SUCCESS"))


def _state_parts(spark: SparkSession, state: str, key: list[str], columns: list[str], order: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """The rows of the last compaction (None before the first), and the changes after it, each once."""
    versions = _versions(spark, state)
    log = spark.read.parquet(f"{state}/log").drop("batch").dropDuplicates([*key, *order, "kind"])
    if not versions:
        return None, log
    rows = spark.read.parquet(f"{state}/rows/version={versions[-1]}")
    upto = spark.read.parquet(f"{state}/upto/version={versions[-1]}").first()
    bound = F.struct(*[F.lit(v).cast(log.schema[o].dataType).alias(o) for o, v in zip(order, upto)])
    # The first order column alone reaches the files' statistics.
    return rows, log.where((F.col(order[0]) >= F.lit(upto[0])) & (F.struct(*order) > bound))


def read_state(spark: SparkSession, state: str, key: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The rows that all batches so far leave, copies of a change counted once.

    After a compaction only its rows and the changes after its horizon are
    read, so reading does not grow with the history.
    """
    rows, log = _state_parts(spark, state, key, columns, order)
    return latest_rows(log, key, columns, order) if rows is None else rows_after(rows, log, key, columns, order)


def compact_state(spark: SparkSession, state: str, key: list[str], columns: list[str], order: list[str], upto: tuple) -> None:
    """Fold all changes up to ``upto`` (a value for each order column) into rows.

    Changes at or before that horizon that arrive later are not applied any
    more, so it should lie before everything that may still come.  The log
    stays; the next reads take the rows and the changes after the horizon.
    """
    rows, log = _state_parts(spark, state, key, columns, order)
    bound = F.struct(*[F.lit(v).cast(log.schema[o].dataType).alias(o) for o, v in zip(order, upto)])
    done = log.where(F.struct(*order) <= bound)
    folded = latest_rows(done, key, columns, order) if rows is None else rows_after(rows, done, key, columns, order)
    number = (_versions(spark, state) or [-1])[-1] + 1
    spark.createDataFrame([upto], log.select(*order).schema).coalesce(1).write.mode("overwrite").parquet(f"{state}/upto/version={number}")
    folded.write.mode("overwrite").parquet(f"{state}/rows/version={number}")


def high_water_marks(batch: DataFrame, table: str, column: str) -> DataFrame | None:
    """What a periodic sequence sync would set after a batch; None if it has no inserts."""
    inserts = batch.where((F.col("kind") == "insert") & (F.col("dml_table") == table))
    return None if inserts.isEmpty() else inserts.agg(F.max(column).alias("next_value"))
