"""Compatibility of contract versions: replaying samples and comparing plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalpact.model import Contract
from signalpact.operators.compiled import CompiledContract, compile_contract
from signalpact.operators.resolve import Resolution, resolve_properties
from signalpact.operators.validate import validate
from signalpact.session import cut_lineage


class GateFailed(RuntimeError):
    """A gate found changes or breaches; ``count`` tells how many."""

    def __init__(self, count: int, what: str) -> None:
        super().__init__(f"{what} failed with {count} findings")
        self.count = count


def check_parity(
    snapshots: DataFrame, sha: str | None, contract: Contract | CompiledContract, ranges: int = 1,
) -> DataFrame:
    """At most one breach per stored event name: the errors of its first failing sample by id.

    The stored name decides the contract entry and identity is not asked for. A sample that cannot
    be checked at all is a breach too, so that one bad sample does not stop the run.

    Every sample is parsed once at most; only failing ones have reasons, and of these a partial
    aggregation keeps one per event and task. With ``ranges`` the samples are taken in that many ranges
    of ids, one after the other: an event that failed in a range is not looked at in the next ones.
    """
    compiled = contract if isinstance(contract, CompiledContract) else compile_contract(contract)
    samples = (snapshots if sha is None else snapshots.filter(F.col("sha") == sha)).select("id", "event_name", "payload")

    def first_breaches(some: DataFrame) -> DataFrame:
        checked = validate(some, compiled, identity_gate=False, event=F.col("event_name"))
        return checked.filter(F.col("status") != "valid").groupBy("event_name").agg(
            F.min("id").alias("id"), F.min_by("errors", "id").alias("errors"))

    if ranges <= 1:
        return first_breaches(samples)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = sorted(set(samples.agg(F.percentile_approx("id", shares, 20 * ranges)).first()[0] or []))
    found = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        some = samples if low is None else samples.filter(F.col("id") > low)
        some = some if high is None else some.filter(F.col("id") <= high)
        if found is not None:
            some = some.join(found.select("event_name"), "event_name", "left_anti")
        new = cut_lineage(first_breaches(some), "breaches")
        found = new if found is None else found.unionByName(new)
    return found


# The texts of the changes below are fixed values.


def diff_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events added or removed between two event tables: (event, change, breaking)."""
    a = old.select("event").distinct().withColumn("in_old", F.lit(True))
    b = new.select("event").distinct().withColumn("in_new", F.lit(True))
    both = a.join(b, "event", "full_outer")
    return both.filter(F.col("in_old").isNull() | F.col("in_new").isNull()).select(
        "event",
        F.when(F.col("in_old").isNull(), F.format_string("event [%s]: ADDED", "event"))
        .otherwise(F.format_string("event [%s]: REMOVED (BREAKING)", "event")).alias("change"),
        F.col("in_new").isNull().alias("breaking"),
    )


def diff_properties(
    old_props: DataFrame, new_props: DataFrame, old_events: DataFrame, new_events: DataFrame
) -> DataFrame:
    """Changes of resolved properties, for events on both sides: (event, property, change, breaking).

    Inline enum lists are compared by length only.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "event", "property", F.lit(True).alias(f"{prefix}_there"),
            F.col("type").alias(f"{prefix}_type"),
            F.coalesce("required", F.lit(False)).alias(f"{prefix}_required"),
            F.coalesce(F.array_size("enum"), F.lit(0)).alias(f"{prefix}_enum"),
        )

    shared = old_events.select("event").distinct().join(
        new_events.select("event").distinct(), "event", "left_semi"
    )
    pairs = side(old_props, "old").join(side(new_props, "new"), ["event", "property"], "full_outer")
    there = pairs.join(shared, "event", "left_semi")
    gone, added = F.col("new_there").isNull(), F.col("old_there").isNull()
    kept = ~gone & ~added

    def change(when, text, breaking):
        return F.when(when, F.struct(
            F.concat(F.format_string("event [%s] prop [%s]: ", "event", "property"), text).alias("change"),
            F.lit(breaking).alias("breaking"),
        ))

    found = F.array_compact(F.array(
        change(gone, F.lit("REMOVED (BREAKING)"), True),
        change(added, F.lit("ADDED"), False),
        change(kept & ~F.col("old_type").eqNullSafe(F.col("new_type")),
               F.format_string("TYPE CHANGE %s -> %s (BREAKING)", "old_type", "new_type"), True),
        change(kept & ~F.col("old_required") & F.col("new_required"),
               F.lit("NOW REQUIRED (BREAKING)"), True),
        change(kept & (F.col("old_enum") != F.col("new_enum")),
               F.lit("ENUM CHANGED (POTENTIAL BREAKING)"), True),
    ))
    return there.select("event", "property", F.inline(found))


def diff_entity(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events whose entity type differs: (event, change, breaking)."""
    a = old.select("event", F.coalesce("entity_type", F.lit("")).alias("was"))
    b = new.select("event", F.coalesce("entity_type", F.lit("")).alias("now"))
    return a.join(b, "event").filter(F.col("was") != F.col("now")).select(
        "event", F.format_string("event [%s]: ENTITY CHANGE %s -> %s", "event", "was", "now").alias("change"),
        F.lit(False).alias("breaking"),
    )


def diff_contracts(
    old: Contract, new: Contract,
    old_resolved: Resolution | None = None, new_resolved: Resolution | None = None,
) -> DataFrame:
    """All changes between two plan versions: (event, change, breaking)."""
    a = old_resolved or resolve_properties(old)
    b = new_resolved or resolve_properties(new)
    props = diff_properties(a.properties, b.properties, old.events, new.events).drop("property")
    return diff_events(old.events, new.events).unionByName(props).unionByName(
        diff_entity(old.events, new.events)
    )


def gate_count(findings: DataFrame, breaking_only: bool = False) -> DataFrame:
    """One row: number of findings and whether the gate fails."""
    kept = findings.filter("breaking") if breaking_only else findings
    return kept.agg(F.count(F.lit(1)).alias("findings")).withColumn("failed", F.col("findings") > 0)


def gate_counts(findings: DataFrame) -> DataFrame:
    """Both scopes in one pass over the findings: (scope ``all`` or ``breaking``, findings, failed)."""
    counts = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if("breaking").alias("b"))
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).alias("findings"), (F.col(c) > 0).alias("failed"))
                     for s, c in (("all", "n"), ("breaking", "b"))])
    return counts.select(F.inline(rows))


def gate(findings: DataFrame, breaking_only: bool = False, what: str = "contract check") -> int:
    """Raise when there is any finding (any change at all, unless ``breaking_only``)."""
    count = gate_count(findings, breaking_only).first()["findings"]
    if count:
        raise GateFailed(count, what)
    return count
