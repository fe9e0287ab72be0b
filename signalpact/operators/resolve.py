"""Contract resolution over contract tables: inheritance, enums, constraints, merging."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from signalpact.model import PLAN_KEYS, PROPERTY_BODY, PROPERTY_TYPES, Contract
from signalpact.session import cut_lineage

LAST = 2**31 - 1  # sorts an owner after everything it imports
LINEAGE_LEVELS = 8
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Resolution:
    """Resolved contract: properties per event and the events that cannot be resolved."""

    properties: DataFrame  # plan_id, version, event, property, <body>
    errors: DataFrame      # plan_id, version, event, error


def import_closure(contract: Contract) -> tuple[DataFrame, DataFrame, int]:
    """All mixins each event reaches, with the position of their first visit.

    Returns (closure, errors, closure row count). Walks level by level with one join per level.
    Among import chains of equal length that meet in one mixin only the first in import order
    goes on, since nothing below it can be visited earlier through another; so diamond-shaped
    imports stay linear. A chain stops at a repeated mixin (a cycle) or an unknown one; the error
    kept per event is the one a depth-first walk in import order meets first.
    """
    keys = PLAN_KEYS + ["event"]
    event_imports = contract.imports.filter(F.col("owner_kind") == "event").join(
        contract.events.select(*PLAN_KEYS, F.col("event").alias("owner")), PLAN_KEYS + ["owner"]
    )
    mixin_imports = contract.imports.filter(F.col("owner_kind") == "mixin").select(
        *PLAN_KEYS, F.col("owner").alias("mixin"), "ordinal", F.col("mixin").alias("next")
    )
    known = contract.mixin_names().withColumn("__known", F.lit(True))

    step = event_imports.select(
        *PLAN_KEYS, F.col("owner").alias("event"), "mixin",
        F.array(F.col("ordinal")).alias("path"),
        F.array().cast("array<string>").alias("stack"),
    )
    levels, failures, total, depth = [], [], 0, 0
    while True:
        checked = step.join(known, PLAN_KEYS + ["mixin"], "left").withColumn(
            "error",
            F.when(
                F.array_contains("stack", F.col("mixin")),
                F.concat(
                    F.lit("circular dependency detected in mixins: ["),
                    F.array_join("stack", " -> "), F.lit(" -> "), F.col("mixin"), F.lit("]"),
                ),
            ).when(
                F.col("__known").isNull(),
                F.concat(F.lit("mixin "), F.col("mixin"), F.lit(" not found")),
            ),
        )
        # Good rows keep one chain per (event, mixin); failed rows keep the first per event.
        level = checked.groupBy(
            *keys, F.when(F.col("error").isNull(), F.col("mixin")).alias("mixin")
        ).agg(F.min_by(F.struct("path", "stack", "error"), F.col("path")).alias("at")).select(
            *keys, "mixin", "at.*"
        )
        if depth and depth % LINEAGE_LEVELS == 0:
            level = cut_lineage(level, "imports")
        level = level.persist()
        counts = level.agg(F.count("mixin"), F.count("error")).first()
        if counts[1]:
            failures.append(level.filter(F.col("error").isNotNull()).select(*keys, "path", "error"))
        if counts[0] or not levels:
            levels.append(level.filter(F.col("error").isNull()).select(*keys, "mixin", "path", "stack"))
        if not counts[0]:
            break
        total += counts[0]
        depth += 1
        step = levels[-1].join(mixin_imports, PLAN_KEYS + ["mixin"]).select(
            *keys, F.col("next").alias("mixin"),
            F.concat("path", F.array("ordinal")).alias("path"),
            F.concat("stack", F.array("mixin")).alias("stack"),
        )

    reached = _union(levels).groupBy(*keys, "mixin").agg(
        F.min(F.concat("path", F.array(F.lit(LAST)))).alias("visit")
    )
    if failures:
        errors = _union(failures).groupBy(*keys).agg(F.min_by("error", "path").alias("error"))
    else:
        errors = reached.select(*keys, F.lit("").alias("error")).limit(0)
    return reached, errors, total


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def resolve_properties(contract: Contract) -> Resolution:
    """Properties per event after inheritance: later import wins, the event's own always win."""
    closure, errors, size = import_closure(contract)
    body = [F.col(c) for c in PROPERTY_BODY]
    small = F.broadcast if size <= BROADCAST_ROWS else (lambda df: df)
    inherited = contract.props.filter(F.col("owner_kind") == "mixin").withColumnRenamed(
        "owner", "mixin"
    ).join(small(closure), PLAN_KEYS + ["mixin"]).select(
        *PLAN_KEYS, "event", "property", "visit", F.struct(*body).alias("body")
    )
    own = contract.props.filter(F.col("owner_kind") == "event").join(
        contract.events.select(*PLAN_KEYS, F.col("event").alias("owner")), PLAN_KEYS + ["owner"],
        "left_semi",
    ).select(
        *PLAN_KEYS, F.col("owner").alias("event"), "property",
        F.array(F.lit(LAST)).alias("visit"), F.struct(*body).alias("body"),
    )
    winners = inherited.unionByName(own).groupBy(*PLAN_KEYS, "event", "property").agg(
        F.max_by("body", "visit").alias("body")
    )
    properties = winners.select(*PLAN_KEYS, "event", "property", "body.*").join(
        errors.select(*PLAN_KEYS, "event"), PLAN_KEYS + ["event"], "left_anti"
    )
    return Resolution(properties, errors)


def resolve_enum_refs(properties: DataFrame, enums: DataFrame) -> DataFrame:
    """Turn ``enum`` properties whose reference exists into strings with a list of values."""
    refs = enums.select(
        *PLAN_KEYS, F.col("name").alias("__enum_name"), F.col("values").alias("allowed")
    )
    on = [properties[k] == refs[k] for k in PLAN_KEYS] + [
        properties["type"] == "enum", properties["ref"] == refs["__enum_name"],
    ]
    joined = properties.join(refs, on, "left").select(
        *[properties[c] for c in properties.columns], refs["allowed"]
    )
    return joined.withColumn(
        "type", F.when(F.col("allowed").isNotNull(), "string").otherwise(F.col("type"))
    )


CHECK_FIELDS = ["property", "type", "required", "min", "max", "min_length", "max_length",
                "pattern", "allowed"]


def constraint_table(contract: Contract, resolution: Resolution | None = None) -> DataFrame:
    """One row per (event, property) with the checks to run; inline enum lists are not checks."""
    resolution = resolution or resolve_properties(contract)
    resolved = resolve_enum_refs(resolution.properties, contract.enums)
    return resolved.select(
        *PLAN_KEYS, "event", "property", "type",
        F.coalesce("required", F.lit(False)).alias("required"), "min", "max", "min_length", "max_length",
        F.nullif("pattern", F.lit("")).alias("pattern"), "allowed",
    )


def unusable(row: Column | None = None) -> Column:
    """Reason why a constraint cannot be enforced at all, else NULL."""
    c = F.col
    return (
        F.when(~c("type").isin(*PROPERTY_TYPES), F.concat(
            F.lit("property "), c("property"), F.lit(": unknown type ["), c("type"), F.lit("]")))
        .when((c("min_length") < 0) | (c("max_length") < 0), F.concat(
            F.lit("property "), c("property"), F.lit(": negative length bound")))
        .when(c("min_length") > c("max_length"), F.concat(
            F.lit("property "), c("property"), F.lit(": min_length exceeds max_length")))
        .when(F.size(F.array_distinct("allowed")) < F.size("allowed"), F.concat(
            F.lit("property "), c("property"), F.lit(": enum values repeat")))
    )


def catalogue(contract: Contract, resolution: Resolution | None = None) -> DataFrame:
    """Resolved catalogue for readers: event, description, property, type, requirement, error.

    An event that can't be resolved has one row with its ``error`` and no properties.
    """
    resolution = resolution or resolve_properties(contract)
    p = resolution.properties.select(
        *PLAN_KEYS, "event", "property", "type",
        F.when(F.col("required"), "REQUIRED").otherwise("OPTIONAL").alias("requirement"),
    )
    every = contract.events.select(*PLAN_KEYS, "event", "description").join(
        resolution.errors.select(*PLAN_KEYS, "event", "error"), PLAN_KEYS + ["event"], "left"
    )
    return every.join(p, PLAN_KEYS + ["event"], "left").select(
        *PLAN_KEYS, "event", "description", "property", "type", "requirement", "error"
    ).orderBy(*PLAN_KEYS, "event", "property")


def merge_fragments(df: DataFrame, order_col: str = "file_order") -> DataFrame:
    """One body per (plan_id, kind, name): the fragment latest in order wins.

    An empty body (an unset scalar or empty identity list) never replaces a set one.
    """
    return df.filter(F.col("body") != "").groupBy("plan_id", "kind", "name").agg(
        F.max_by("body", order_col).alias("body")
    )


def fragments_of_plan(plan: dict[str, Any], plan_id: str, order: int) -> list[tuple]:
    """Rows for :func:`merge_fragments` from one plan file."""
    taxonomy = plan.get("taxonomy") or {}
    rows = []

    def add(kind: str, name: str, body: Any) -> None:
        rows.append((plan_id, kind, name, json.dumps(body) if body or kind in sections else "", order))

    sections = ("events", "mixins", "enums", "flows")
    for kind in ("events", "mixins", "enums"):
        for name, body in {**(taxonomy.get(kind) or {}), **(plan.get(kind) or {})}.items():
            add(kind, name, body)
    for name, body in (plan.get("flows") or {}).items():
        add("flows", name, body)
    add("version", "", plan.get("version"))
    add("identity_properties", "",
        plan.get("identity_properties") or taxonomy.get("identity_properties"))
    return rows


def plan_of_fragments(merged: DataFrame) -> dict[str, Any]:
    """The merged plan as nested dicts (plan files are config and fit the driver)."""
    plan: dict[str, Any] = {}
    for row in merged.select("kind", "name", "body").toLocalIterator():
        body = json.loads(row["body"])
        if row["kind"] in ("version", "identity_properties"):
            plan[row["kind"]] = body
        else:
            plan.setdefault(row["kind"], {})[row["name"]] = body
    return plan


def extract_contract(flow_nodes: DataFrame) -> DataFrame:
    """Skeleton entry per event a flow uses; the first node by (flow, node) gives its properties."""
    used = F.coalesce(F.nullif("event", F.lit("")), F.nullif("listen_for", F.lit("")))
    first = F.struct(
        F.concat(F.lit("Auto-extracted: "), F.col("flow")).alias("description"),
        F.col("properties"),
    )
    return flow_nodes.select(
        *PLAN_KEYS, used.alias("event"), F.struct("flow", "node").alias("at"), first.alias("entry")
    ).filter(F.col("event").isNotNull()).groupBy(*PLAN_KEYS, "event").agg(
        F.min_by("entry", "at").alias("entry")
    ).select(*PLAN_KEYS, "event", "entry.*")
