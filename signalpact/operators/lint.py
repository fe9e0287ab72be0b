"""Integrity of contracts and journey graphs, over contract and flow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalpact.model import PLAN_KEYS, Contract
from signalpact.operators.resolve import Resolution, resolve_properties

FLOW_KEYS = PLAN_KEYS + ["flow"]


def flow_edges(nodes: DataFrame) -> DataFrame:
    """Edges of the journey graphs: (plan, flow, src, dst, kind, label)."""
    def edges(items, kind, dst, label):
        return F.transform(F.coalesce(items, F.array()), lambda x: F.struct(
            dst(x).alias("dst"), F.lit(kind).alias("kind"), label(x).alias("label")))

    timeouts = F.when(F.col("timeout").isNotNull(), F.array("timeout"))
    return nodes.select(*FLOW_KEYS, F.col("node").alias("src"), F.inline(F.concat(
        edges(F.col("transitions"), "transition", lambda x: x["target"], lambda x: F.lit("")),
        edges(F.col("conditions"), "condition", lambda x: x["target"],
              lambda x: F.when(x["is_default"], "default").otherwise(x["expression"])),
        edges(timeouts, "timeout", lambda x: x["target"],
              lambda x: F.concat(F.lit("timeout: "), x["duration"])),
    )))


def orphan_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that point to no node of their flow."""
    known = nodes.select(*FLOW_KEYS, F.col("node").alias("dst"))
    return edges.join(known, FLOW_KEYS + ["dst"], "left_anti").select(
        *FLOW_KEYS, "src", "dst", "kind",
        F.format_string("node %s: orphaned %s target %s", "src", "kind", "dst").alias("error"),
    )


def used_events(nodes: DataFrame) -> DataFrame:
    """Event name each node works on, where it has one."""
    return nodes.select(
        *FLOW_KEYS, "node",
        F.coalesce(F.nullif("event", F.lit("")), F.nullif("listen_for", F.lit(""))).alias("event"),
    ).filter(F.col("event").isNotNull())


def uncontracted_events(used: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of ``used`` whose event the contract does not know."""
    return used.join(events.select("event").distinct(), "event", "left_anti")


def unused_events(events: DataFrame, used: DataFrame) -> DataFrame:
    """Contract events that no row of ``used`` names. ``used`` is reduced before it is joined."""
    return events.select("event").distinct().join(used.select("event").distinct(), "event", "left_anti")


def bad_gate_refs(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Gate conditions naming a property that no event of their flow has.

    Only the first ``$event.`` of a condition is read, up to the next blank. Flows without a
    trigger are left out. A reference is good when any trigger or awaited event has the property.
    """
    refs = nodes.filter(F.col("type") == "GateNode").select(
        *FLOW_KEYS, "node", F.explode("conditions").alias("c")
    ).filter(F.contains("c.expression", F.lit("$event."))).select(
        *FLOW_KEYS, "node", F.col("c.expression").alias("expression"),
        F.substring_index(F.element_at(
            F.split("c.expression", r"\$event\.", 3), 2), " ", 1).alias("property"),
    )
    triggers = nodes.filter((F.col("type") == "TriggerNode") & (F.col("event") != "")).select(
        *FLOW_KEYS, "event")
    waits = nodes.filter((F.col("type") == "WaitNode") & (F.col("listen_for") != "")).select(
        *FLOW_KEYS, F.col("listen_for").alias("event"))
    active = triggers.unionByName(waits).distinct()
    offered = active.join(
        properties.select(*PLAN_KEYS, "event", "property"), PLAN_KEYS + ["event"]
    ).select(*FLOW_KEYS, "property").distinct()
    return refs.join(triggers.select(*FLOW_KEYS).distinct(), FLOW_KEYS, "left_semi").join(
        offered, FLOW_KEYS + ["property"], "left_anti"
    ).select(*FLOW_KEYS, "node", "property", "expression")


class PlanRefused(ValueError):
    """The flows and events of a plan don't fit together."""


def lint_contract(contract: Contract, resolution: Resolution | None = None) -> DataFrame:
    """All integrity findings of every plan version: (plan_id, version, rule, subject, error).

    Rules: ``target`` (an edge to no node), ``event`` (a node's event the plan lacks), ``orphan`` (an
    event no flow uses), ``gate`` (a condition on a property no event of its flow has).
    """
    resolution = resolution or resolve_properties(contract)
    nodes, events = contract.flows, contract.events.select(*PLAN_KEYS, "event").distinct()
    used = used_events(nodes)

    def finding(df: DataFrame, rule: str, subject: str, error) -> DataFrame:
        return df.select(*PLAN_KEYS, F.lit(rule).alias("rule"), F.col(subject).alias("subject"), error.alias("error"))

    unknown = used.join(events, PLAN_KEYS + ["event"], "left_anti")
    orphans = events.join(used.select(*PLAN_KEYS, "event").distinct(), PLAN_KEYS + ["event"], "left_anti")
    return finding(
        orphan_targets(flow_edges(nodes), nodes), "target", "src",
        F.concat(F.lit("flow "), F.col("flow"), F.lit(": "), F.col("error")),
    ).unionByName(finding(
        unknown, "event", "node", F.format_string("node %2$s of flow %1$s uses event %3$s, which the plan does not define", "flow", "node", "event"),
    )).unionByName(finding(
        orphans, "orphan", "event", F.format_string("event %s is used by no flow (orphan event)", "event"),
    )).unionByName(finding(
        bad_gate_refs(nodes, resolution.properties), "gate", "node",
        F.format_string("flow %s, node %s: property %s is unknown to the events of the flow", "flow", "node", "property"),
    ))


def check_plan(contract: Contract) -> None:
    """Raise :class:`PlanRefused` with the first finding of a plan, if there is any."""
    if contract.flows is None:
        raise PlanRefused("the plan has no flow table")
    first = lint_contract(contract).orderBy("rule", "subject", "error").first()
    if first:
        raise PlanRefused(first["error"])
