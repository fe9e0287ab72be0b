"""Time the headline queries and the validation throughput; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Queries read stored payloads where
their input is payloads only in part; the throughput cases read stored payloads alone. Every figure is
taken from warm runs; throughput gives the best and the median of several.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalpact.model import contract_from_dict
from signalpact.operators.compiled import compile_contract
from signalpact.operators.normalize import normalize
from signalpact.operators.validate import summary, validate
from signalpact.plans import fixtures as fx
from signalpact.plans.queries import QUERIES, demo
from signalpact.session import configure, scratch_path

HEADLINE = [
    "extract_event_name", "extract_identity", "flatten_properties", "normalize_events", "validate_events",
    "validation_summary", "dlq_records", "check_parity", "typed_model", "resolve_inheritance",
    "merge_fragments", "diff_properties", "orphan_targets",
]
RUNS = 3


def run(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def warm(make, runs: int = 1) -> list[float]:
    """Seconds of several runs, building the query included, after one warm-up."""
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        run(make())
        times.append(time.perf_counter() - start)
    return times[1:]


def wide_contract(spark: SparkSession, **options):
    """32 properties on every event, all of them present in the payloads of :func:`wide_payload`."""
    props = {f"properties.utm_{i}": {"type": "string", "rules": {"max_length": 64}} for i in range(24)}
    props.update({f"properties.n_{i}": {"type": "integer", "rules": {"min": 0, "max": 1000}} for i in range(8)})
    return compile_contract(contract_from_dict(spark, {
        "identity_properties": ["userId"], "events": {e: {"properties": props} for e in fx.TYPES},
    }), **options)


def wide_payload(events: DataFrame) -> DataFrame:
    """Payloads that carry every property of the wide contract."""
    i = F.col("event_id")
    fields = [F.concat(F.lit(f"campaign-{n}-"), i.cast("string")).alias(f"utm_{n}") for n in range(24)]
    fields += [(i % (100 + n)).alias(f"n_{n}") for n in range(8)]
    return events.select(F.to_json(F.struct(
        F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("userId"), F.struct(*fields).alias("properties"),
    )).alias("payload"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("signalpact-bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {name: round(min(warm(lambda: QUERIES[name](spark, sf_dir))), 3) for name in HEADLINE}

    def stored(payloads: DataFrame) -> DataFrame:
        path = scratch_path(spark, "bench-payloads")
        payloads.repartition(cpus * 2).write.parquet(path)
        out = spark.read.parquet(path)
        return out.unionAll(out).unionAll(out.unionAll(out))  # planning must not hide the sustained rate

    table = fx.table(spark, sf_dir, "events")
    events, wide_events = stored(fx.raw_events(table)), stored(wide_payload(table))
    count = events.count()
    contract, wide = demo(spark), wide_contract(spark)
    as_data, wide_data = compile_contract(fx.demo_contract(spark), max_literal_checks=0), wide_contract(spark, max_literal_checks=0)
    cases = {
        "normalize": lambda: normalize(events),
        "validate_events": lambda: validate(events, contract),
        "validation_summary": lambda: summary(validate(events, contract, with_errors=False)),
        "validate_data_mode": lambda: validate(events, as_data),
        "validate_32_present": lambda: validate(wide_events, wide),
        "validate_32_present_data_mode": lambda: validate(wide_events, wide_data),
    }
    best, median = {}, {}
    for name, make in cases.items():
        times = warm(make, RUNS)
        best[name], median[name] = (round(count / t / cpus) for t in (min(times), statistics.median(times)))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1], "cpus": cpus,
        "spark": spark.version, "throughput_events": count, "events_per_sec_per_core": best,
        "median_events_per_sec_per_core": median, "baseline_events_per_sec_per_core": 45000,
    }))


if __name__ == "__main__":
    main()
