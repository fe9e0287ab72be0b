"""Typed tables per event and their column and null tests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from signalpact.functions import flatten as fl
from signalpact.functions.paths import ODD, name, root_object, sealed
from signalpact.model import Contract, Mapping, local_table
from signalpact.operators.normalize import DOC, ROOTS, TEXTS, identity_names, normalize, parse, read_names
from signalpact.operators.resolve import resolve_properties

# --- fixed values: column type per contract type; every other type is text ---
COLUMN_TYPES = {"number": "double", "integer": "int", "boolean": "boolean"}
# ------------------------------------------------------------------------------


def model_name(event: str) -> str:
    """Table name of an event's model."""
    return "analytics." + event.replace(" ", "_").lower()


def event_properties(contract: Contract, event: str) -> list[tuple[str, str, bool]]:
    """(property, type, required) of one event by name (a single event's columns fit the driver)."""
    rows = resolve_properties(contract).properties.filter(F.col("event") == event).select(
        "property", "type", "required"
    ).orderBy("property").collect()
    return [(r["property"], r["type"], bool(r["required"])) for r in rows]


def typed_model(
    df: DataFrame, properties: list[tuple[str, str, bool]], event: str | None = None,
    payload: str = "payload", mapping: Mapping = Mapping(), keep: tuple[str, ...] = (),
) -> DataFrame:
    """One column per property, cast to its type, in name order; bad values become NULL.

    With ``event`` only that event's rows are taken; without it all rows are, so that columns
    other events lack are NULL there.
    """
    return _typed(df, [(p, t, p) for p, t, _ in sorted(properties)], event, payload, mapping, keep)


def _typed(
    df: DataFrame, wanted: list[tuple[str, str, str]], event: str | None, payload: str, mapping: Mapping,
    keep: tuple[str, ...], with_event: bool = False,
) -> DataFrame:
    """A column per (property, type, column name) of one event or of all rows; ``with_event`` adds their ``event``."""
    text = name(payload)
    properties = {p for p, _, _ in wanted}
    identity = {k: f"__id_{i}" for i, k in enumerate(identity_names(mapping)) if k in properties}
    parsed = parse(df.select(*keep, payload), payload, mapping)
    if with_event:
        parsed = read_names(parsed, text, mapping, "__name", {})
    elif event is not None:
        named = read_names(parsed, text, mapping, "__name", {})
        parsed = sealed(named, [*keep, payload], {c: c for c in (DOC, ODD, TEXTS, "__name") if c in named.columns}).filter(
            F.col("__name") == event)
    opened = read_names(parsed, text, mapping, None, identity, first={
        f"__root_{r}": root_object(text, DOC, r) for r in ROOTS})
    found = {
        p: fl.value_at(text, p.split(".")[0], f"__root_{p.split('.')[0]}", p.split(".")[1:])
        for p in properties if p.split(".")[0] in ROOTS and "." in p
    }
    order = {p: n for n, p in enumerate(sorted(found))}
    valued = opened.selectExpr("*", *[f"{found[p]} AS __v{n}" for p, n in order.items()])

    def column(prop: str, type_name: str, alias: str) -> str:
        target = COLUMN_TYPES.get(type_name, "string")
        value = f"cast(NULL AS {target})"
        if prop in order:
            held = f"__v{order[prop]}"
            # Objects are flattened away, so an object here means the key itself is absent.
            value = (f"CASE WHEN NOT {fl.is_object(held)} THEN "
                     f"try_variant_get({held}, '$', '{target}') END")
        if prop in identity:
            value = f"coalesce(try_cast({identity[prop]} AS {target}), {value})"
        return f"{value} AS {name(alias)}"

    own = ["__name AS event"] if with_event else []
    return valued.selectExpr(*own, *[name(c) for c in keep], *[column(*w) for w in wanted])


def model_columns(contract: Contract, resolved: DataFrame | None = None) -> list[tuple[str, str, str, str]]:
    """(event, property, type, column) of every event's model, from the contract (config, so it fits the driver).

    Events share the column of a property unless they give it different types.
    """
    resolved = resolve_properties(contract).properties if resolved is None else resolved
    rows = sorted({(r["event"], r["property"], r["type"]) for r in resolved.select("event", "property", "type").collect()})
    targets: dict[str, set[str]] = {}
    for _, prop, kind in rows:
        targets.setdefault(prop, set()).add(COLUMN_TYPES.get(kind, "string"))

    def column(prop: str, kind: str) -> str:
        return prop if len(targets[prop]) == 1 else f"{prop} ({COLUMN_TYPES.get(kind, 'string')})"

    return [(event, prop, kind, column(prop, kind)) for event, prop, kind in rows]


def wide_models(
    df: DataFrame, columns: list[tuple[str, str, str, str]], keep: tuple[str, ...] = (), payload: str = "payload",
    mapping: Mapping = Mapping(),
) -> DataFrame:
    """Rows of all events that have a model: ``event``, ``keep`` and every model's columns, from one scan.

    ``columns`` come from :func:`model_columns`. What an event's own model has is selected when it is read
    (:func:`read_model`), so a row may hold further values. ``keep`` must not name a column ``event``.
    """
    wanted = sorted({(prop, COLUMN_TYPES.get(kind, "string"), column) for _, prop, kind, column in columns})
    kinds = {target: kind for kind, target in COLUMN_TYPES.items()}
    rows = _typed(df, [(p, kinds.get(t, "string"), c) for p, t, c in wanted], None, payload, mapping, keep, with_event=True)
    known = local_table(df.sparkSession, [(e,) for e in sorted({c[0] for c in columns})], "event string")
    return rows.join(F.broadcast(known), "event", "left_semi")  # the contract's events


def write_models(wide: DataFrame, columns: list[tuple[str, str, str, str]], path: str, keep: tuple[str, ...] = ()) -> str:
    """Full refresh of all models in one pass over ``wide``: a folder per event under a version of its own.

    The version takes effect when its line is added to ``path/current``, which is written last: readers see
    all models of the old version or all of the new one. Returns the version; older ones stay until removed.
    """
    spark, version = wide.sparkSession, uuid.uuid4().hex
    wide.write.partitionBy("event").parquet(f"{path}/versions/{version}")
    local_table(spark, columns, "event string, property string, type string, column string").coalesce(1).write.parquet(f"{path}/columns/{version}")
    line = local_table(spark, [(version, list(keep), wide.select(*keep).schema.json())], "version string, keep array<string>, schema string")
    line.withColumn("written", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


def read_model(spark: SparkSession, path: str, event: str) -> DataFrame:
    """One event's model as last written by :func:`write_models`: its kept columns and its own properties, typed."""
    line = spark.read.parquet(f"{path}/current").orderBy(F.col("written").desc(), "version").first()
    own = spark.read.parquet(f"{path}/columns/{line['version']}").filter(F.col("event") == event).orderBy("property").collect()
    if not own:
        raise ValueError(f"the models under {path} have no event {event!r}")
    kept = StructType.fromJson(json.loads(line["schema"]))
    fields = [(c["column"], COLUMN_TYPES.get(c["type"], "string")) for c in own]
    schema = ", ".join([*(f"{name(f.name)} {f.dataType.simpleString()}" for f in kept), *(f"{name(c)} {t}" for c, t in fields), "event string"])
    rows = spark.read.schema(schema).parquet(f"{path}/versions/{line['version']}").filter(F.col("event") == event)
    return rows.selectExpr(*[name(c) for c in line["keep"]], *[f"{name(c['column'])} AS {name(c['property'])}" for c in own])


def typed_values(
    df: DataFrame, properties: DataFrame, keep: tuple[str, ...], payload: str = "payload", mapping: Mapping = Mapping(),
) -> DataFrame:
    """Typed values of all events in one scan: (``keep``, event, property, type, text, number, whole, flag).

    ``properties`` are the resolved (event, property, type) of one plan version. Each declared property
    an event carries gives a row, with its value in the column of its type and NULL there if it can't be
    cast; identity keys come from the payload's identity paths. Stored partitioned by event, this is
    every event's model (see :func:`typed_model` for the wide form of one).
    """
    flat = normalize(df.select(*keep, payload), payload, mapping)
    ids = "transform(map_entries(identity), e -> named_struct('key', e.key, 'value', cast(e.value AS variant)))"
    leaves = "transform(map_entries(properties), e -> named_struct('key', e.key, 'value', e.value))"
    # An identity key is its text, whatever the properties hold.
    both = f"concat({ids}, filter(coalesce({leaves}, array()), e -> NOT map_contains_key(identity, e.key)))"
    rows = flat.selectExpr(*[name(c) for c in keep], "event", f"inline({both})")
    known = properties.select("event", F.col("property").alias("key"), "type")

    def column(target: str, types: str) -> str:
        return f"CASE WHEN type {types} THEN try_variant_get(value, '$', '{target}') END"

    return rows.join(known, ["event", "key"]).selectExpr(
        *[name(c) for c in keep], "event", "key AS property", "type",
        f"{column('string', "NOT IN ('number', 'integer', 'boolean')")} AS text", f"{column('double', "= 'number'")} AS number",
        f"{column('int', "= 'integer'")} AS whole", f"{column('boolean', "= 'boolean'")} AS flag",
    )


def null_counts(values: DataFrame, events: DataFrame, required: DataFrame) -> DataFrame:
    """Nulls per required property of all events: (event, property, nulls, total).

    ``values`` come from :func:`typed_values`, ``events`` has a row per event that was read (column
    ``event``), ``required`` the (event, property) to test.
    """
    total = events.groupBy("event").agg(F.count(F.lit(1)).alias("total"))
    there = values.where("coalesce(text, cast(number AS string), cast(whole AS string), cast(flag AS string)) IS NOT NULL")
    held = there.groupBy("event", "property").agg(F.count(F.lit(1)).alias("held"))
    return required.select("event", "property").distinct().join(total, "event").join(held, ["event", "property"], "left").select(
        "event", "property", (F.col("total") - F.coalesce("held", F.lit(0))).alias("nulls"), "total")


def materialize_model(model: DataFrame, table: str | None = None, path: str | None = None) -> None:
    """Full refresh of a model, as a table or as parquet under a path."""
    writer = model.write.mode("overwrite").format("parquet")
    writer.saveAsTable(table) if table else writer.save(path)


def required_columns(properties: DataFrame, event: str | None = None) -> DataFrame:
    """Required properties as (event, property)."""
    rows = properties.filter("required")
    if event is not None:
        rows = rows.filter(F.col("event") == event)
    return rows.select("event", "property")


def check_columns(model: DataFrame, required: DataFrame) -> DataFrame:
    """Required properties the model has no column for."""
    have = local_table(model.sparkSession, [(c,) for c in model.columns], "property string")
    return required.join(F.broadcast(have), "property", "left_anti")


def check_not_null(model: DataFrame, required: list[str]) -> DataFrame:
    """Nulls per required column in one pass: (property, nulls, total)."""
    there = [c for c in required if c in model.columns]
    counts = model.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(name(c)).isNull()).alias(f"n{i}") for i, c in enumerate(there)],
    )
    if not there:
        return model.sparkSession.createDataFrame([], "property string, nulls bigint, total bigint")
    pairs = F.array(*[
        F.struct(F.lit(c).alias("property"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(there)
    ])
    return counts.select(F.inline(pairs), "total")
