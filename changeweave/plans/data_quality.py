"""Queries of the data-quality operators, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.position import score
from ..operators import apply_log, copydiff, dedup, instants, references, schema_drift
from ..storage import shared_root, table, written


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.surplus_deliveries(table(spark, folder, "change_log"))


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.delivered_once(table(spark, folder, "change_log")).select("delivery_id", "stream_id", "score", "row_no")


#: Batches in which p1_incremental takes the log.
BATCHES = 5


def p1_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log in batches that have nothing to do with its order, each against what is stored by then."""
    log = table(spark, folder, "change_log").withColumn("score", score(F.col("change_position"))).select("delivery_id", *dedup.DELIVERY, "received_at")
    place = f"{shared_root(spark)}/delivered-{uuid.uuid4().hex[:8]}"
    stored = None
    for n in range(BATCHES):
        batch = log.where(F.pmod(F.xxhash64("delivery_id"), F.lit(BATCHES)) == n)
        dedup.newly_delivered(batch, stored, dedup.DELIVERY, dedup.EARLIEST).write.parquet(f"{place}/batch={n}")
        stored = spark.read.schema(log.schema).option("basePath", f"{place}/").parquet(place)
    return dedup.stored_once(stored, dedup.DELIVERY, dedup.EARLIEST).select("delivery_id", *dedup.DELIVERY)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants.normalised_instants(*[table(spark, folder, n) for n in ("change_log", "ddl_log", "stream_sources")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copydiff.copy_differences(table(spark, folder, "table_copies"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    names = ("users", "subscriptions", "credit_cards", "organizations")
    return references.orphan_references({n: table(spark, folder, n) for n in names}, table(spark, folder, "removals"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_counts(p4_found(spark, folder))


def _changes(spark: SparkSession, folder: str, suggestions: bool = False) -> DataFrame:
    return schema_drift.schema_changes(table(spark, folder, "row_files"), table(spark, folder, "ddl_log"), suggestions)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).drop("proved")


def p5_suggested(spark: SparkSession, folder: str) -> DataFrame:
    """Renames that no statement tells of and likeness suggests; p5_found has their columns as removed and added."""
    return _changes(spark, folder, suggestions=True).where("not proved").select("stream_id", "dml_table", "file_id", "old_column", "new_column")


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.unified_rows(table(spark, folder, "row_files"), written(_changes(spark, folder), "schema-changes"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return apply_log.current_cells(table(spark, folder, "change_log"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_incremental, p2_found, p3_found, p4_found, p4_counts, p5_found, p5_suggested, p5_unified, p6_found)}

_SCORED = r"""
    SELECT *, CASE
        WHEN regexp_matches(change_position, '^0/BOOTSTRAP[0-9]+$') THEN CAST(substr(change_position, 12) AS BIGINT) - 1000000
        WHEN regexp_matches(change_position, 'bin\.[0-9]+:[0-9]+$') THEN CAST(regexp_extract(change_position, 'bin\.([0-9]+):([0-9]+)$', 1) AS BIGINT) * 4294967296 + CAST(regexp_extract(change_position, 'bin\.([0-9]+):([0-9]+)$', 2) AS BIGINT)
        WHEN regexp_matches(change_position, '^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$') THEN CAST('0x' || split_part(change_position, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part(change_position, '/', 2) AS BIGINT)
        END AS score FROM change_log"""
_RANKED = f"SELECT delivery_id, stream_id, score, row_no, row_number() OVER (PARTITION BY stream_id, score, row_no ORDER BY received_at, delivery_id) AS place FROM ({_SCORED})"


def _uuid(column: str) -> str:
    bare = f"lower(trim({column}))"
    digits = f"regexp_replace({bare}, '[{{}}-]', '', 'g')"
    return f"CASE WHEN {bare} = '' THEN NULL WHEN length({digits}) = 32 THEN substr({digits}, 1, 8) || '-' || substr({digits}, 9, 4) || '-' || substr({digits}, 13, 4) || '-' || substr({digits}, 17, 4) || '-' || substr({digits}, 21) ELSE {bare} END"


def _references_sql() -> str:
    parts = []
    for name, field in (("users", "organization_id"), ("subscriptions", "organization_id"), ("credit_cards", "organization_id"), ("organizations", "owner_id")):
        parts.append(f"SELECT '{name}' AS table_name, {_uuid('id')} AS record_id, '{field}' AS field_name, '{'users' if field == 'owner_id' else 'organizations'}' AS target, {_uuid(field)} AS ref, created_at, updated_at, loaded_at FROM {name}")
    return f"""
    WITH versions AS ({' UNION ALL '.join(parts)}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, record_id ORDER BY updated_at DESC, loaded_at DESC) AS place, min(loaded_at) OVER (PARTITION BY table_name, record_id) AS first_loaded FROM versions WHERE record_id IS NOT NULL),
    gone AS (SELECT table_name, {_uuid('record_id')} AS record_id, max(removed_at) AS removed_at FROM removals GROUP BY ALL),
    held AS (SELECT r.*, coalesce(g.removed_at >= r.created_at, FALSE) AS is_removed FROM ranked r LEFT JOIN gone g USING (table_name, record_id) WHERE place = 1)
    SELECT c.table_name, c.record_id, c.field_name, strftime(c.created_at, '%Y-%m') AS period,
        CASE WHEN p.record_id IS NULL THEN 'missing' WHEN p.is_removed THEN 'deleted' ELSE 'late' END AS reason
    FROM held c LEFT JOIN held p ON p.table_name = c.target AND p.record_id = c.ref
    WHERE NOT c.is_removed AND c.ref IS NOT NULL AND (p.record_id IS NULL OR p.is_removed OR CAST(p.first_loaded AS DATE) > CAST(c.loaded_at AS DATE))"""


_COPIES = r"""
    WITH listed AS (
        SELECT held_by, replace(dml_table, 'public.', '') AS dml_table, copy_row_id, read_at, unnest(column_names) AS column_name, unnest(column_values) AS v FROM table_copies),
    spelt AS (
        SELECT *, coalesce(v.string_value, CAST(v.int_value AS VARCHAR), CAST(v.float_value AS VARCHAR), CAST(v.bool_value AS VARCHAR), v.timestamp_value) AS plain,
            CASE WHEN v.bool_value OR lower(v.string_value) IN ('t', 'true') THEN '#1.0' WHEN NOT v.bool_value OR lower(v.string_value) IN ('f', 'false') THEN '#0.0'
                WHEN v.int_value IS NOT NULL THEN '#' || CAST(v.int_value AS DOUBLE)
                WHEN v.float_value IS NOT NULL THEN '#' || v.float_value
                WHEN regexp_matches(v.string_value, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN '#' || CAST(v.string_value AS DOUBLE)
                WHEN v.timestamp_value IS NOT NULL THEN '@' || epoch_us(CAST(regexp_replace(v.timestamp_value, '([+-][0-9]{2})$', '\1:00') AS TIMESTAMPTZ))
                ELSE '=' || v.string_value END AS canon FROM listed),
    keyed AS (
        SELECT held_by, dml_table, copy_row_id, CASE WHEN dml_table = 'user_roles' THEN max(plain) FILTER (WHERE column_name = 'org_id') || '|' || max(plain) FILTER (WHERE column_name = 'user_id') ELSE max(plain) FILTER (WHERE column_name = 'id') END AS row_key
        FROM spelt GROUP BY held_by, dml_table, copy_row_id),
    cells AS (SELECT DISTINCT held_by, dml_table, row_key, column_name, canon FROM spelt JOIN keyed USING (held_by, dml_table, copy_row_id) WHERE canon IS NOT NULL AND row_key IS NOT NULL),
    p AS (SELECT * FROM cells WHERE held_by = 'primary'), r AS (SELECT * FROM cells WHERE held_by = 'replica')
    SELECT DISTINCT dml_table, row_key, '' AS column_name, 'missing_in_replica' AS difference FROM p WHERE (dml_table, row_key) NOT IN (SELECT (dml_table, row_key) FROM r)
    UNION ALL SELECT DISTINCT dml_table, row_key, '', 'missing_in_primary' FROM r WHERE (dml_table, row_key) NOT IN (SELECT (dml_table, row_key) FROM p)
    UNION ALL SELECT dml_table, row_key, column_name, 'value' FROM p FULL JOIN r USING (dml_table, row_key, column_name)
        WHERE p.canon IS DISTINCT FROM r.canon AND (dml_table, row_key) IN (SELECT (dml_table, row_key) FROM p) AND (dml_table, row_key) IN (SELECT (dml_table, row_key) FROM r)"""

_INSTANTS = r"""WITH texts AS (
    SELECT 'change_log' AS found_in, delivery_id AS record_id, column_names[i] AS column_name, column_values[i].timestamp_value AS raw, stream_id FROM (SELECT *, unnest(range(1, len(column_values) + 1)) AS i FROM change_log)
    UNION ALL SELECT 'ddl_log', log_id, 'ddl_time', ddl_time, stream_id FROM ddl_log),
trimmed AS (SELECT found_in, record_id, column_name, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS t, server_zone AS zone, date_order FROM texts JOIN stream_sources USING (stream_id) WHERE raw IS NOT NULL),
matched AS (SELECT *,
    regexp_extract(t, '^(\d{4})-(\d\d)-(\d\d)(?:[Tt ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?: ?([Zz]|[A-Za-z]{2,5}|[+-]\d\d(?::?\d\d)?)(?: [A-Z]+| [+-]\d+)?(?:\[[^\]]*\])?)?)?$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z']) AS iso,
    regexp_extract(t, '^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z$', ['y', 'mo', 'd', 'h', 'mi', 's']) AS packed,
    regexp_extract(t, '^(\d\d?)/(\d\d?)/(\d{4})(?: (\d\d?):(\d\d):(\d\d)(?: (AM|PM))?)?$', ['a', 'b', 'y', 'h', 'mi', 's', 'half']) AS slash,
    regexp_extract(t, '^[A-Za-z]{3}, (\d\d) ([A-Za-z]{3}) (\d{4}) (\d\d):(\d\d):(\d\d) GMT$', ['d', 'name', 'y', 'h', 'mi', 's']) AS mail
    FROM trimmed),
parts AS (SELECT found_in, record_id, column_name, t, zone,
    CASE WHEN iso.y <> '' THEN iso.y || '-' || iso.mo || '-' || iso.d || ' ' || coalesce(nullif(iso.h, ''), '00') || ':' || coalesce(nullif(iso.mi, ''), '00') || ':' || coalesce(nullif(iso.s, ''), '00')
        WHEN packed.y <> '' THEN packed.y || '-' || packed.mo || '-' || packed.d || ' ' || packed.h || ':' || packed.mi || ':' || packed.s
        WHEN slash.y <> '' THEN slash.y || '-' || lpad(CASE WHEN date_order = 'dmy' THEN slash.b ELSE slash.a END, 2, '0') || '-' || lpad(CASE WHEN date_order = 'dmy' THEN slash.a ELSE slash.b END, 2, '0') || ' '
            || lpad(CASE WHEN slash.h = '' THEN '0' WHEN slash.half = '' THEN slash.h ELSE CAST(TRY_CAST(slash.h AS INT) % 12 + CASE slash.half WHEN 'PM' THEN 12 ELSE 0 END AS VARCHAR) END, 2, '0') || ':' || coalesce(nullif(slash.mi, ''), '00') || ':' || coalesce(nullif(slash.s, ''), '00')
        WHEN mail.y <> '' THEN mail.y || '-' || lpad(CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(mail.name)) AS VARCHAR), 2, '0') || '-' || mail.d || ' ' || mail.h || ':' || mail.mi || ':' || mail.s
        END AS wall,
    CASE WHEN iso.y <> '' THEN rpad(left(iso.f, 6), 6, '0') ELSE '000000' END AS fraction,
    CASE WHEN iso.y <> '' THEN iso.z WHEN packed.y <> '' OR mail.y <> '' THEN 'Z' ELSE '' END AS z FROM matched),
walls AS (SELECT *, CASE WHEN left(wall, 4) NOT IN ('0000', '0001') THEN TRY_CAST(wall AS TIMESTAMP) END AS w FROM parts),
abbreviations(zone, z, minutes) AS (VALUES ('Europe/Berlin', 'CET', 60), ('Europe/Berlin', 'CEST', 120), ('America/New_York', 'EST', -300), ('America/New_York', 'EDT', -240), ('Europe/London', 'GMT', 0), ('Europe/London', 'BST', 60),
    ('Australia/Sydney', 'AEST', 600), ('Australia/Sydney', 'AEDT', 660), ('Asia/Kolkata', 'IST', 330)),
offsets AS (SELECT w.*, CASE WHEN regexp_matches(w.z, '^[+-]') THEN CASE left(w.z, 1) WHEN '-' THEN -1 ELSE 1 END * (TRY_CAST(substr(w.z, 2, 2) AS INT) * 60 + TRY_CAST(coalesce(nullif(substr(replace(w.z, ':', ''), 4, 2), ''), '0') AS INT))
        WHEN upper(w.z) IN ('Z', 'UTC') THEN 0 WHEN a.minutes IS NOT NULL THEN a.minutes WHEN upper(w.z) = 'GMT' THEN 0 END AS minutes
    FROM walls w LEFT JOIN abbreviations a ON a.zone = w.zone AND a.z = upper(w.z)),
instants AS (SELECT *, CASE
    WHEN regexp_matches(t, '^\d{10}$') THEN TRY_CAST(t AS BIGINT) * 1000000 WHEN regexp_matches(t, '^\d{13}$') THEN TRY_CAST(t AS BIGINT) * 1000 WHEN regexp_matches(t, '^\d{16}$') THEN TRY_CAST(t AS BIGINT) WHEN regexp_matches(t, '^\d{19}$') THEN TRY_CAST(t AS BIGINT) // 1000
    WHEN w IS NULL THEN NULL
    WHEN z = '' THEN epoch_us(CASE WHEN timezone(zone, timezone(zone, w) - INTERVAL 1 HOUR) = w THEN timezone(zone, w) - INTERVAL 1 HOUR ELSE timezone(zone, w) END) + TRY_CAST(fraction AS BIGINT)
    ELSE epoch_us(w) - CAST(minutes AS BIGINT) * 60000000 + TRY_CAST(fraction AS BIGINT) END AS utc_micros FROM offsets)
SELECT found_in, record_id, column_name, utc_micros FROM instants WHERE utc_micros IS NOT NULL AND (w IS NOT NULL OR utc_micros BETWEEN 1672531200000000 AND 1798761599999999)"""

SQL = {
    "p2_found": _INSTANTS,
    "p3_found": _COPIES,
    "p1_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE place > 1",
    "p1_incremental": f"SELECT delivery_id, stream_id, score, row_no FROM ({_RANKED}) WHERE place = 1",
    "p1_kept": f"SELECT delivery_id, stream_id, score, row_no FROM ({_RANKED}) WHERE place = 1",
    "p4_found": _references_sql(),
    "p4_counts": f"SELECT table_name, field_name, period, reason, count(*) AS orphans FROM ({_references_sql()}) GROUP BY ALL",
}
