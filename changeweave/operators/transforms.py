"""The transform layer: a configuration compiled to expressions, for typed tables and for changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import passwords
from ..functions.fakes import FAKES, fake
from ..functions.regex import replace_all
from ..functions.template import compile_template, fields_of
from ..model import CELL, cell
from ..sources.config import ColumnTransform, ConfigError, TransformConfig

_FIELD = {"string": "string_value", "bigint": "int_value", "double": "float_value", "boolean": "bool_value"}
ON_ERROR = ("skip", "null", "fail")


def input_type(spec: ColumnTransform) -> str | None:
    """Type that a value must have; None if any will do."""
    if spec.type in FAKES:
        return FAKES[spec.type][1]
    return {"Bool": "boolean", "Regex": "string"}.get(spec.type)


def _first_pass(spec: ColumnTransform, value: Column) -> Column:
    if spec.type == "Bool":
        # The parity of a hash that is odd for true and even for false.
        return value
    if spec.type == "Regex":
        return replace_all(value, spec.text("pattern"), spec.text("replacement"))
    return fake(spec.type, value)


def _password(spec: ColumnTransform, cleartext: Column, original: Column) -> Column:
    options = {argument: spec.number(name, 0) for name, argument in passwords.METHODS[spec.type][1].items() if name in spec.options}
    return passwords.hashed(spec.type, cleartext, original, spec.flag("use_salt", True), **options)


def _second_pass(spec: ColumnTransform, original: Column, fields: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    if spec.type == "Template":
        return compile_template(spec.text("template"), fields)
    cleartext = spec.text("cleartext", required=False) or ""
    text = compile_template(cleartext, fields) if "{{" in cleartext else F.lit(cleartext)
    return _password(spec, text, original)


def _fits(kind: T.DataType, wanted: str) -> bool:
    groups = {"string": (T.StringType, T.TimestampType), "bigint": (T.IntegralType,), "double": (T.DoubleType, T.FloatType), "boolean": (T.BooleanType,)}
    return isinstance(kind, groups[wanted])


def transform_table(rows: DataFrame, columns: Mapping[str, ColumnTransform], on_error: str = "skip") -> DataFrame:
    """Rows of a typed table with the configured columns replaced.

    All columns but templates and passwords are computed from the original
    values in one projection.  Templates and passwords follow in column order;
    each sees the results before it, but the originals of those after it.
    Passwords are salted from the original.

    A NULL, or a value of another type than its transform takes, is an error:
    ``skip`` leaves the row out, ``null`` makes the value NULL, ``fail`` stops
    the query.  Templates and passwords take anything.  Configured columns
    that the table lacks are left out.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {ON_ERROR}")
    wanted = {c: columns[c] for c in rows.columns if c in columns}
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    first = {c: s for c, s in wanted.items() if not s.second_pass}
    second = {c: s for c, s in wanted.items() if s.second_pass}
    col = lambda c: F.col(f"`{c}`")
    if on_error == "skip":
        for c, s in first.items():
            rows = rows.where(col(c).isNotNull() if _fits(kinds[c], input_type(s)) else F.lit(False))

    def replaced(c: str, s: ColumnTransform) -> Column:
        value = col(c).cast("string") if isinstance(kinds[c], T.TimestampType) else col(c)
        made = _first_pass(s, value) if _fits(kinds[c], input_type(s)) else F.lit(None).cast(input_type(s))
        if on_error == "fail":
            return F.coalesce(made, F.raise_error(F.concat(F.lit(f"cannot transform column {c}: "), F.coalesce(col(c).cast("string"), F.lit("NULL")))).cast(input_type(s)))
        return made

    originals = {f"__original_{c}": col(c).cast("string") if isinstance(kinds[c], (T.StringType, T.TimestampType)) else F.lit("") for c in second}
    out = rows.select(*[(replaced(c, first[c]) if c in first else col(c)).alias(c) for c in rows.columns], *[v.alias(k) for k, v in originals.items()])
    for c, s in second.items():
        fields = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in out.schema.fields if not f.name.startswith("__original_")}
        out = out.withColumn(c, _second_pass(s, F.col(f"`__original_{c}`"), fields))
    return out.drop(*originals)


def leaking_fields(order: list[str], columns: Mapping[str, ColumnTransform]) -> list[tuple[str, str]]:
    """Pairs of a template's column and a later second-pass column whose original it shows."""
    second = [c for c in order if c in columns and columns[c].second_pass]
    found = []
    for i, c in enumerate(second):
        text = columns[c].options.get("template" if columns[c].type == "Template" else "cleartext") or ""
        found += [(c, later) for later in second[i + 1 :] if later in fields_of(text)]
    return found


def transform_changes(changes: DataFrame, config: TransformConfig, on_error: str = "skip", transform_keys: bool = False) -> DataFrame:
    """Changes (position, type, dml, ddl) with the configured columns of their tables replaced.

    Tables without configuration pass unchanged, as do old keys (unless
    ``transform_keys``, for first-pass transforms) and, of schema changes, the
    text; their other fields are dropped.  Errors are as in
    ``transform_table``, but of the whole change.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {ON_ERROR}")
    tables = {t: c for t, c in config.tables.items() if c}
    ddl = F.when(F.col("ddl").isNotNull(), F.struct(F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("username"), F.lit(None).cast("string").alias("database"), F.col("ddl.ddl").alias("ddl")))
    plain = changes.where(F.col("dml.table").isNull() | ~F.col("dml.table").isin(*tables) if tables else F.lit(True)).withColumn("ddl", ddl)
    out = plain
    for table, columns in tables.items():
        out = out.unionByName(_transform_dml(changes.where(F.col("dml.table") == table), columns, on_error, transform_keys).withColumn("ddl", ddl))
    return out


def _cell_first(spec: ColumnTransform, value: Column) -> Column:
    """Struct of the replaced cell and whether it failed."""
    wanted = input_type(spec)
    field = _FIELD[wanted]
    given = F.coalesce(value[field], value["timestamp_value"]) if wanted == "string" else value[field]
    made = _first_pass(spec, given)
    return F.struct(F.when(given.isNotNull(), cell(**{field: made})).otherwise(cell()).alias("cell"), given.isNull().alias("failed"))


def _transform_dml(rows: DataFrame, columns: Mapping[str, ColumnTransform], on_error: str, transform_keys: bool) -> DataFrame:
    first = {c: s for c, s in columns.items() if not s.second_pass}
    second = {c: s for c, s in columns.items() if s.second_pass}

    def apply_first(names: Column, values: Column) -> Column:
        def one(name: Column, value: Column) -> Column:
            made = F.struct(value.alias("cell"), F.lit(False).alias("failed"))
            for c, s in first.items():
                made = F.when(name == c, _cell_first(s, value)).otherwise(made)
            return made

        return F.zip_with(names, values, one)

    out = rows.withColumn("__names", F.col("dml.column_names")).withColumn("__original", F.col("dml.column_values")).withColumn("__made", apply_first(F.col("dml.column_names"), F.col("dml.column_values")))
    failed = F.exists("__made", lambda x: x["failed"])
    if on_error == "skip":
        out = out.where(~F.coalesce(failed, F.lit(False)))
    elif on_error == "fail":
        out = out.withColumn("__made", F.when(~F.coalesce(failed, F.lit(False)), F.col("__made")).otherwise(F.raise_error(F.concat(F.lit("cannot transform the change at "), F.col("position"))).cast(out.schema["__made"].dataType)))
    out = out.withColumn("__values", F.transform("__made", lambda x: x["cell"]))
    # Second pass, in the order in which each change lists the columns.
    places = F.array_sort(F.filter(F.array(*[F.struct(F.array_position("__names", c).cast("int").alias("at"), F.lit(c).alias("name")) for c in second]), lambda p: p["at"] > 0)) if second else None
    if second:
        out = out.withColumn("__places", places)
    for step in range(len(second)):
        place = F.get("__places", F.lit(step))
        made = F.lit(None).cast("string")
        for c, s in second.items():
            needs = fields_of(s.options.get("template" if s.type == "Template" else "cleartext") or "")
            fields = {n: (F.get("__values", F.array_position("__names", n).cast("int") - 1), CELL) for n in needs}
            original = F.get("__original", F.array_position("__names", c).cast("int") - 1)["string_value"]
            made = F.when(place["name"] == c, _second_pass(s, original, fields)).otherwise(made)
        out = out.withColumn("__text", made).withColumn("__values", F.when(place.isNull(), F.col("__values")).otherwise(F.transform("__values", lambda v, i: F.when(i + 1 == place["at"], cell(string_value=F.col("__text"))).otherwise(v)))).drop("__text")
    keys = F.col("dml.old_keys")
    if transform_keys and first:
        keys = F.when(keys.isNotNull(), F.struct(keys["key_names"].alias("key_names"), F.transform(apply_first(keys["key_names"], keys["key_values"]), lambda x: x["cell"]).alias("key_values")))
    dml = F.struct(F.col("dml.table").alias("table"), F.col("__names").alias("column_names"), F.col("__values").alias("column_values"), F.col("dml.kind").alias("kind"), keys.alias("old_keys"))
    return out.withColumn("dml", dml).drop("__names", "__original", "__made", "__values", "__places")


def checked(config: TransformConfig) -> TransformConfig:
    """The configuration, after compiling every pattern and template in it."""
    from ..functions.regex import PatternError, java_pattern
    from ..functions.template import TemplateError

    for table, columns in config.tables.items():
        for name, spec in columns.items():
            try:
                if spec.type == "Regex":
                    java_pattern(spec.text("pattern"))
                    spec.text("replacement")
                elif spec.type == "Template":
                    fields_of(spec.text("template"))
            except (PatternError, TemplateError) as e:
                raise ConfigError(f"{table}.{name}: {e}") from e
    return config
