"""A resolved contract made ready for the validation join."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from signalpact.functions.checks import absent_errors
from signalpact.functions.paths import quotable
from signalpact.model import PLAN_KEYS, Contract, local_table
from signalpact.operators.resolve import CHECK_FIELDS, constraint_table, resolve_properties, unusable
from signalpact.session import cut_lineage

MAX_LITERAL_CHECKS = 256        # beyond this the checks travel as data instead of as code
BROADCAST_BYTES = 64 << 20      # beyond this the contract is joined by a salted shuffle
LOCAL_EVENTS = 10_000           # up to this the rule table is kept as a literal relation
WORD_BITS = 62


@dataclass(frozen=True)
class CompiledContract:
    """Rules by event plus what the query needs to know about them.

    ``checks`` holds the distinct checks when they are few: they become literal expressions and an
    event only carries a bit mask of those it wants. Otherwise it is None and every event carries
    its checks as a map from property to structs, beside the errors of an absent value.
    """

    rules: DataFrame                # __event, __broken, then __mask_0.. or __checks (property -> its checks and the errors without a value)
    identity_keys: tuple[str, ...]
    checks: tuple[Any, ...] | None
    levels: int                     # most dotted segments below a root in any property name
    broadcast: bool


def _bad_patterns(table: DataFrame) -> list[str]:
    """Patterns the regex dialect of Spark rejects; each event that has one cannot be checked."""
    compile_java = table.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile
    bad = []
    for row in table.select("pattern").filter(F.col("pattern").isNotNull()).distinct().toLocalIterator():
        try:
            compile_java(row["pattern"])
        except (Py4JJavaError, PySparkException):
            bad.append(row["pattern"])
    return bad


def compile_contract(
    contract: Contract,
    max_literal_checks: int = MAX_LITERAL_CHECKS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> CompiledContract:
    """Resolve one plan version and fix the join strategy from its measured size."""
    spark = contract.events.sparkSession
    versions = contract.events.select(*PLAN_KEYS).distinct().limit(2).count()
    if versions > 1:
        raise ValueError("the contract holds several plan versions: pick one with Contract.at(plan_id, version)")
    resolution = resolve_properties(contract)
    table = constraint_table(contract, resolution).withColumn("__why", unusable()).persist()
    frames = [table]
    bad = _bad_patterns(table)
    if bad:
        table = table.withColumn("__why", F.coalesce("__why", F.when(
            F.col("pattern").isin(bad),
            F.concat(F.lit("property "), F.col("property"), F.lit(": bad pattern")),
        ))).withColumn("pattern", F.when(~F.col("pattern").isin(bad), F.col("pattern"))).persist()
        frames.append(table)

    levels = table.agg(F.max(F.size(F.split("property", r"\.")) - 1)).first()[0]
    distinct = table.select(*CHECK_FIELDS).distinct().limit(max_literal_checks + 1).collect()
    literal = len(distinct) <= max_literal_checks and all(
        quotable(s) for r in distinct for s in r["property"].split(".")
    )
    identity = tuple(
        r["key"] for r in contract.identity.select("key").distinct().orderBy("key").collect()
    )

    if literal:
        checks = sorted(distinct, key=_check_order)
        grouped = _masks(spark, table, checks)
    else:
        checks = None
        by_property = table.groupBy("event", "property").agg(
            F.min("__why").alias("__why"), F.array_sort(F.collect_list(F.struct(*CHECK_FIELDS))).alias("checks")
        ).select("*", F.expr(absent_errors("checks")).alias("absent"))
        grouped = by_property.groupBy("event").agg(
            F.min("__why").alias("__broken"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", F.struct("checks", "absent").alias("rules"))))).alias("__checks"),
        )

    events = contract.events.select("event").distinct()
    rules = (
        events.join(grouped, "event", "left")
        .join(resolution.errors.select("event", "error"), "event", "left")
        .withColumn("__broken", F.coalesce("error", "__broken"))
        .drop("error").withColumnRenamed("event", "__event")
    )
    # Everything the join would send counts, events without properties and failed ones too.
    held = rules.agg(F.count(F.lit(1)).alias("events"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    small = (held["bytes"] or 0) <= broadcast_bytes
    if small and held["events"] <= LOCAL_EVENTS:
        rules = local_table(spark, rules.collect(), rules.schema)
    else:
        rules = cut_lineage(rules, "rules")
    for frame in frames:
        frame.unpersist()
    return CompiledContract(
        rules, identity, None if checks is None else tuple(checks), max(levels or 1, 1), small
    )


def _check_order(row: Any) -> tuple:
    return tuple((row[c] is not None, "" if row[c] is None else str(row[c])) for c in CHECK_FIELDS)


def _masks(spark, table: DataFrame, checks: list[Any]) -> DataFrame:
    """Per event one bit per distinct check it wants, packed into BIGINT words."""
    words = len(checks) // WORD_BITS + 1
    ids = local_table(
        spark, [tuple(r[c] for c in CHECK_FIELDS) + (i,) for i, r in enumerate(checks)],
        table.select(*CHECK_FIELDS).schema.add("__id", "integer"),
    )
    on = None
    for c in CHECK_FIELDS:
        same = table[c].eqNullSafe(ids[c])
        on = same if on is None else on & same
    numbered = table.join(F.broadcast(ids), on).select(table["event"], table["__why"], "__id")
    return numbered.groupBy("event").agg(
        F.min("__why").alias("__broken"),
        *[
            F.bit_or(F.when(
                F.floor(F.col("__id") / WORD_BITS) == w,
                F.expr(f"shiftleft(1L, __id % {WORD_BITS})"),
            ).otherwise(F.lit(0).cast("bigint"))).alias(f"__mask_{w}")
            for w in range(words)
        ],
    )
