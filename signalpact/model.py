"""Contract tables, path mappings and the config loader that fills them."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping as MappingType
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# --- fixed values: defaults that must match the event producers -------------------------------
EVENT_PATHS = ("event", "event_name", "type", "properties.event_name")
IDENTITY_PATHS = {
    "userId": ("userId", "user_id", "context.userId", "context.user_id"),
    "anonymousId": ("anonymousId", "anonymous_id", "context.anonymousId"),
    "wallet_address": ("wallet_address", "walletAddress", "properties.wallet_address"),
}
MAX_DEPTH = 100
PROPERTY_TYPES = ("string", "number", "integer", "boolean", "array", "object", "null")
# ----------------------------------------------------------------------------------------------

PLAN_KEYS = ["plan_id", "version"]

EVENTS_DDL = "plan_id string, version string, event string, description string, entity_type string"
MIXINS_DDL = "plan_id string, version string, mixin string, description string"
IMPORTS_DDL = (
    "plan_id string, version string, owner_kind string, owner string, ordinal int, mixin string"
)
PROPERTY_BODY_DDL = (
    "type string, required boolean, enum array<string>, ref string, description string, "
    "min double, max double, min_length int, max_length int, pattern string"
)
PROPS_DDL = (
    "plan_id string, version string, owner_kind string, owner string, property string, "
    + PROPERTY_BODY_DDL
)
ENUMS_DDL = "plan_id string, version string, name string, values array<string>"
IDENTITY_DDL = "plan_id string, version string, key string"
NODES_DDL = (
    "plan_id string, version string, flow string, namespace string, node string, type string, "
    "event string, listen_for string, "
    "transitions array<struct<target:string>>, "
    "conditions array<struct<expression:string,is_default:boolean,target:string>>, "
    "timeout struct<duration:string,target:string>, "
    f"properties map<string,struct<{PROPERTY_BODY_DDL.replace(' ', ':').replace(',:', ',')}>>"
)
PROPERTY_BODY = [
    "type", "required", "enum", "ref", "description",
    "min", "max", "min_length", "max_length", "pattern",
]


@dataclass(frozen=True)
class Mapping:
    """Where a payload keeps its event name and its identity keys (first non-empty path wins)."""

    event_paths: tuple[str, ...] = EVENT_PATHS
    identity_paths: MappingType[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(IDENTITY_PATHS)
    )


@dataclass(frozen=True)
class Contract:
    """One or many plan versions as DataFrames; every table is keyed by (plan_id, version)."""

    events: DataFrame
    imports: DataFrame
    props: DataFrame
    enums: DataFrame
    identity: DataFrame
    mixins: DataFrame | None = None
    flows: DataFrame | None = None

    def at(self, plan_id: str, version: str) -> Contract:
        """Only the rows of one plan version."""
        def pick(df: DataFrame | None) -> DataFrame | None:
            if df is None:
                return None
            return df.filter((F.col("plan_id") == plan_id) & (F.col("version") == version))

        return Contract(
            pick(self.events), pick(self.imports), pick(self.props), pick(self.enums),
            pick(self.identity), pick(self.mixins), pick(self.flows),
        )

    def mixin_names(self) -> DataFrame:
        """Known mixins; without a mixin table, whatever owns properties or imports."""
        if self.mixins is not None:
            return self.mixins.select(*PLAN_KEYS, "mixin").distinct()
        owners = [
            df.filter(F.col("owner_kind") == "mixin").select(*PLAN_KEYS, F.col("owner").alias("mixin"))
            for df in (self.props, self.imports)
        ]
        return owners[0].unionByName(owners[1]).distinct()


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str | StructType) -> DataFrame:
    """A literal relation in the plan itself (no job, no Python workers) for config-sized rows."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rows = list(rows)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([_plain(r[i]) for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def _plain(value: Any) -> Any:
    """Rows inside a value as dicts and maps as pairs, as Arrow wants them."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return [(k, _plain(v)) for k, v in value.items()]
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _property_row(name: str, spec: dict | None) -> tuple:
    spec = spec or {}
    rules = spec.get("rules") or {}
    number = lambda v: None if v is None else float(v)
    return (
        name, spec.get("type") or "", bool(spec.get("required", False)), spec.get("enum"),
        spec.get("ref"), spec.get("description"), number(rules.get("min")),
        number(rules.get("max")), rules.get("min_length"), rules.get("max_length"),
        rules.get("pattern"),
    )


def contract_from_dict(
    spark: SparkSession, plan: dict[str, Any], plan_id: str = "plan", version: str | None = None
) -> Contract:
    """Contract tables of one plan given as nested dicts (config, so it fits the driver)."""
    key = (plan_id, version or plan.get("version") or "")
    taxonomy = {**(plan.get("taxonomy") or {})}
    # Taxonomy sections may also stand at the top level; there they win per key.
    for section in ("events", "mixins", "enums"):
        taxonomy[section] = {**(taxonomy.get(section) or {}), **(plan.get(section) or {})}
    identity = plan.get("identity_properties") or taxonomy.get("identity_properties") or []

    events, mixins, imports, props = [], [], [], []
    for kind, section, out in (("event", "events", events), ("mixin", "mixins", mixins)):
        for name, body in taxonomy[section].items():
            body = body or {}
            row = key + (name, body.get("description") or "")
            out.append(row + (body.get("entity_type") or "",) if kind == "event" else row)
            for i, mixin in enumerate(body.get("imports") or []):
                imports.append(key + (kind, name, i, mixin))
            for prop, spec in (body.get("properties") or {}).items():
                props.append(key + (kind, name) + _property_row(prop, spec))
    enums = [key + (n, v) for n, v in taxonomy["enums"].items()]

    nodes = []
    for flow, flow_body in (plan.get("flows") or {}).items():
        for node, n in ((flow_body or {}).get("nodes") or {}).items():
            timeout = n.get("timeout")
            nodes.append(key + (
                flow, flow_body.get("namespace") or "", node, n.get("type") or "",
                n.get("event") or "", n.get("listen_for") or "",
                [{"target": t.get("target")} for t in n.get("transitions") or []],
                [{"expression": c.get("if") or "", "is_default": bool(c.get("default", False)),
                  "target": c.get("target")} for c in n.get("conditions") or []],
                {k: timeout.get(k) for k in ("duration", "target")} if timeout else None,
                [(p, dict(zip(PROPERTY_BODY, _property_row(p, s)[1:])))
                 for p, s in (n.get("properties") or {}).items()] or None,
            ))
    return Contract(
        events=local_table(spark, events, EVENTS_DDL),
        imports=local_table(spark, imports, IMPORTS_DDL),
        props=local_table(spark, props, PROPS_DDL),
        enums=local_table(spark, enums, ENUMS_DDL),
        identity=local_table(spark, [key + (k,) for k in identity], IDENTITY_DDL),
        mixins=local_table(spark, mixins, MIXINS_DDL),
        flows=local_table(spark, nodes, NODES_DDL),
    )


def read_plan_file(path: str) -> dict[str, Any]:
    """One plan file as nested dicts: JSON, or YAML where a YAML reader is installed."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.lower().endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading YAML plans needs PyYAML; JSON plans work without it") from exc
    return yaml.safe_load(text) or {}


def load_contract(spark: SparkSession, path: str, plan_id: str = "plan", gate: bool = False) -> Contract:
    """Contract tables from one plan file, or from all plan files of a folder in name order.

    With ``gate`` a plan whose flows and events don't fit together is refused
    (:class:`signalpact.operators.lint.PlanRefused`).
    """
    from signalpact.operators.lint import check_plan

    contract = _load(spark, path, plan_id)
    if gate:
        check_plan(contract)
    return contract


def _load(spark: SparkSession, path: str, plan_id: str) -> Contract:
    from signalpact.operators.resolve import fragments_of_plan, merge_fragments, plan_of_fragments

    if not os.path.isdir(path):
        return contract_from_dict(spark, read_plan_file(path), plan_id)
    names = sorted(
        n for n in os.listdir(path)
        if n.lower().endswith((".yaml", ".yml", ".json")) and os.path.isfile(os.path.join(path, n))
    )
    rows = [
        row
        for order, name in enumerate(names)
        for row in fragments_of_plan(read_plan_file(os.path.join(path, name)), plan_id, order)
    ]
    merged = merge_fragments(spark.createDataFrame(
        rows, "plan_id string, kind string, name string, body string, file_order int"
    ))
    return contract_from_dict(spark, plan_of_fragments(merged), plan_id)


__all__ = ["Contract", "Mapping", "contract_from_dict", "load_contract", "read_plan_file"]
