"""Every operator as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalpact.model import Contract, Mapping
from signalpact.operators import impact, lint, models, normalize as norm, resolve, validate as val
from signalpact.operators.compiled import CompiledContract, compile_contract
from signalpact.plans import fixtures as fx
from signalpact.session import scratch_path, spread
from signalpact.sources import sinks, snapshots as snap
from signalpact.sources.events import read_events, read_events_stream
from signalpact.sources.outbox import Outbox
from signalpact.streaming.jobs import routed_sink, summary_stream, validate_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_compiled: dict[tuple[str, int], CompiledContract] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def demo(spark: SparkSession, version: int = 1) -> CompiledContract:
    """The demo contract, compiled once per application as a validation service would."""
    key = (spark.sparkContext.applicationId, version)
    if key not in _compiled:
        _compiled[key] = compile_contract(fx.demo_contract(spark, version))
    return _compiled[key]


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(fx.table(spark, sf_dir, "events"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_events(events_table(spark, sf_dir))


def validated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return val.validate(raw(spark, sf_dir), demo(spark), **options)


def codes(errors: str = "errors") -> Column:
    return F.array_join(F.transform(errors, lambda e: F.concat_ws(":", e["property"], e["rule"])), ";")


# --- sources and sinks ------------------------------------------------------------------------

@query
def read_events_query(spark, sf_dir):
    fx.configure(spark)
    events = read_events(spark, f"{sf_dir}/events.parquet", "parquet", column="props")
    return events.select("event_id", "payload")


@query
def stream_validate_counts(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    stream = read_events_stream(
        spark, sf_dir, "parquet", schema, pathGlobFilter="events.parquet", maxFilesPerTrigger="8"
    )
    name = "counts_" + scratch_path(spark, "q")[-32:]
    summary_stream(fx.raw_events(stream), demo(spark), name, scratch_path(spark, "counts"), available_now=True).awaitTermination()
    return spark.table(name)


@query
def snapshot_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    snap.save_snapshots(fx.snapshots(events_table(spark, sf_dir)), path)
    return snap.load_snapshots(spark, path, "sha_a").select(
        "id", "sha", "event_name", F.unix_micros("created_at").alias("created_us"),
        F.get_json_object("payload", "$.properties.qty").cast("int").alias("qty"),
    )


@query
def snapshots_saved_twice(spark, sf_dir):
    """A save that is repeated, beside another one and a third that never finished."""
    path, rows = scratch_path(spark, "snapshots"), fx.snapshots(events_table(spark, sf_dir))
    for sha, save_id in (("sha_a", "first"), ("sha_b", "second"), ("sha_a", "first")):
        snap.save_snapshots(rows.filter(F.col("sha") == sha), path, save_id=save_id)
    rows.write.partitionBy("sha").parquet(f"{path}/saves/save_id=broken")
    return snap.load_snapshots(spark, path).groupBy("sha", "event_name").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("id").alias("ids"))


@query
def check_parity_ranges(spark, sf_dir):
    """Parity in four ranges of ids."""
    samples = fx.snapshots(events_table(spark, sf_dir))
    return impact.check_parity(samples, "sha_a", demo(spark, 2), ranges=4).select(
        "event_name", "id", codes().alias("errors"))


@query
def snapshots_by_event(spark, sf_dir):
    samples = fx.snapshots(events_table(spark, sf_dir)).filter("sha = 'sha_a'")
    groups = snap.snapshots_by_event(samples, chunk_rows=500)
    return groups.select(
        "event_name", F.size("payloads").alias("n"),
        F.aggregate("payloads", F.lit(0).cast("bigint"), lambda acc, p: acc + F.get_json_object(
            p, "$.properties.qty").cast("bigint")).alias("qty"),
    ).groupBy("event_name").agg(F.sum("n").alias("payloads"), F.sum("qty").alias("qty"))


@query
def dlq_records(spark, sf_dir):
    return sinks.dlq_records(validated(spark, sf_dir)).select(
        F.try_variant_get("payload", "$.properties.qty", "int").alias("qty"),
        F.try_variant_get("payload", "$.properties.price", "double").alias("price"),
        F.array_join("errors", " | ").alias("errors"), (F.col("ts") > 0).alias("stamped"),
    )


@query
def dlq_malformed(spark, sf_dir):
    """Payloads cut short are no JSON documents: their text must reach the dead letter."""
    cut = raw(spark, sf_dir).withColumn("payload", F.expr("left(payload, length(payload) - 1)"))
    letters = sinks.dlq_records(val.validate(cut, demo(spark)))
    return letters.select(
        F.regexp_extract(F.try_variant_get("payload", "$", "string"), '"qty":([0-9]+)', 1).cast("int").alias("qty"),
        F.array_join("errors", " | ").alias("errors"))


@query
def dlq_webhook_envelope(spark, sf_dir):
    body = sinks.webhook_envelopes(validated(spark, sf_dir), source="edge")
    payload = F.get_json_object("body", "$.payload")
    return body.select(
        F.get_json_object(payload, "$.properties.qty").cast("int").alias("qty"),
        F.array_join(F.from_json(F.get_json_object("body", "$.errors"), "array<string>"), " | ").alias("errors"),
        F.get_json_object("body", "$.source").alias("source"),
    )


@query
def outbox_redelivery(spark, sf_dir):
    """An endpoint that first refuses some letters: how often each letter was posted, and how often it arrived."""
    outbox = Outbox(spark, scratch_path(spark, "outbox"))
    for attempt in range(3):  # a replay of the batch finds its letters written
        outbox.put(0, sinks.webhook_envelopes(validated(spark, sf_dir)))
        outbox.deliver(0, _refuse_some if attempt == 0 else _take_all)
    posts = outbox.log(0).groupBy("letter").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(F.col("failure").isNull()).alias("arrived"))
    qty = F.get_json_object(F.get_json_object("body", "$.payload"), "$.properties.qty").cast("int")
    return outbox.letters(0).join(posts, "letter", "left").select(qty.alias("qty"), "posts", "arrived")


def _refuse_some(body: str) -> int:
    return 503 if '\\"qty\\":1' in body else 200


def _take_all(body: str) -> int:
    return 200


@query
def result_feed(spark, sf_dir):
    return sinks.result_feed(validated(spark, sf_dir)).select(
        "name", "is_valid", F.array_join("errors", " | ").alias("errors"))


# --- normalisation ----------------------------------------------------------------------------

@query
def extract_event_name(spark, sf_dir):
    return norm.extract_event_name(raw(spark, sf_dir)).select("event_id", "event")


@query
def extract_identity(spark, sf_dir):
    ids = F.col("identity")
    return norm.extract_identity(raw(spark, sf_dir)).select(
        "event_id", ids["userId"].alias("user"), ids["anonymousId"].alias("anonymous"),
        ids["wallet_address"].alias("wallet"), F.size(ids).alias("found"),
    )


@query
def identity_fallback(spark, sf_dir):
    ids = F.col("identity")
    return norm.extract_identity(raw(spark, sf_dir)).filter(
        ids["userId"] == ids["anonymousId"]
    ).select("event_id", ids["userId"].alias("user"))


def _leaves(df: DataFrame) -> DataFrame:
    numeric = F.col("key").isin("properties.price", "properties.qty")
    return df.select(
        "event_id", "key", "depth",
        F.when(~numeric, F.try_variant_get("value", "$", "string")).alias("text"),
        F.when(numeric, F.try_variant_get("value", "$", "double")).alias("number"),
        F.is_variant_null("value").alias("is_null"),
    )


@query
def flatten_properties(spark, sf_dir):
    return _leaves(norm.flatten_events(raw(spark, sf_dir), "properties"))


@query
def flatten_context(spark, sf_dir):
    return _leaves(norm.flatten_events(raw(spark, sf_dir), "context"))


@query
def depth_guard(spark, sf_dir):
    deep = fx.deep_events(events_table(spark, sf_dir))
    return norm.depth_guard(deep).select("event_id", "too_deep")


@query
def normalize_events(spark, sf_dir):
    p = F.col("properties")
    return norm.normalize(raw(spark, sf_dir)).select(
        "event_id", "event", F.col("identity")["userId"].alias("user"), F.size(p).alias("keys"),
        F.try_variant_get(p["properties.metadata.source"], "$", "string").alias("source"),
        F.try_variant_get(p["properties.price"], "$", "double").alias("price"),
        F.col("error").isNull().alias("ok"),
    )


@query
def custom_mapping(spark, sf_dir):
    mapping = Mapping(("properties.code", "event"), {
        "account": ("userId", "anonymousId"), "library": ("context.library.name",)})
    named = norm.extract_event_name(raw(spark, sf_dir), mapping=mapping)
    ids = F.col("identity")
    return norm.extract_identity(named, mapping=mapping).select(
        "event_id", "event", ids["account"].alias("account"), ids["library"].alias("library"))


# --- contract resolution ----------------------------------------------------------------------

def _registry(spark, sf_dir):
    return fx.registry(fx.table(spark, sf_dir, "part"))


@query
def resolve_inheritance(spark, sf_dir):
    return resolve.resolve_properties(_registry(spark, sf_dir)).properties.select(
        "event", "property", "type", "required", "description")


@query
def detect_import_cycles(spark, sf_dir):
    contract = fx.chained_registry(fx.table(spark, sf_dir, "part"))
    return resolve.resolve_properties(contract).errors.select("event", "error")


@query
def constraint_table(spark, sf_dir):
    return resolve.constraint_table(_registry(spark, sf_dir)).select(
        "event", "property", "type", "required", "min", "max", "min_length", "max_length",
        "pattern", F.array_join("allowed", ",").alias("allowed"),
    )


@query
def resolve_enum_refs(spark, sf_dir):
    contract = _registry(spark, sf_dir)
    enum_props = contract.props.filter(F.col("type") == "enum")
    return resolve.resolve_enum_refs(enum_props, contract.enums).select(
        "property", "type", "ref", F.array_join("allowed", ",").alias("allowed"))


@query
def merge_fragments(spark, sf_dir):
    fragments = fx.table(spark, sf_dir, "part").select(
        F.lit("registry").alias("plan_id"), F.lit("events").alias("kind"),
        F.col("p_brand").alias("name"),
        F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("body"),
        F.col("p_partkey").alias("file_order"),
    )
    return resolve.merge_fragments(fragments).select("name", "body")


@query
def extract_contract(spark, sf_dir):
    nodes = fx.flow_nodes(fx.table(spark, sf_dir, "customer"))
    return resolve.extract_contract(nodes).select(
        "event", "description", F.array_join(F.map_keys("properties"), ",").alias("properties"))


@query
def contract_catalogue(spark, sf_dir):
    return resolve.catalogue(_registry(spark, sf_dir)).select(
        "event", "description", "property", "type", "requirement")


# --- validation -------------------------------------------------------------------------------

@query
def identity_gate(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "event_id", (F.array_position(F.transform("errors", lambda e: e["rule"]), "identity") == 0)
        .alias("identified"))


def _check(name: str, *rules: str) -> None:
    def run(spark, sf_dir):
        found = validated(spark, sf_dir).select("event_id", F.inline("errors"))
        return found.filter(F.col("rule").isin(*rules)).select("event_id", "property", "rule", "detail")

    run.__name__ = name
    query(run)


_check("check_required", "required")
_check("check_type", "type")
_check("check_bounds", "min", "max")
_check("check_length", "min_length", "max_length")
_check("check_pattern", "pattern")
_check("check_enum", "enum")


@query
def validate_events(spark, sf_dir):
    return validated(spark, sf_dir).select("event_id", "event", "status", codes().alias("errors"))


@query
def validate_no_identity(spark, sf_dir):
    return validated(spark, sf_dir, identity_gate=False).select(
        "event_id", "event", "status", codes().alias("errors"))


def _salted(spark: SparkSession) -> CompiledContract:
    """The demo contract with its checks as data and its rules joined by a salted shuffle."""
    key = (spark.sparkContext.applicationId, -1)
    if key not in _compiled:
        _compiled[key] = compile_contract(fx.demo_contract(spark), max_literal_checks=0, broadcast_bytes=0)
    return _compiled[key]


@query
def validate_salted(spark, sf_dir):
    """Checks held as data and rules joined by a salted shuffle, beside a column that can't be hashed."""
    rows = raw(spark, sf_dir).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    return val.validate(rows, _salted(spark)).select("event_id", "event", "status", codes().alias("errors"))


@query
def validate_wide_contract(spark, sf_dir):
    """Hundreds of checks per event, held as data."""
    contract = compile_contract(fx.wide_contract(fx.table(spark, sf_dir, "part")), max_literal_checks=0)
    checked = val.validate(fx.wide_events(events_table(spark, sf_dir)), contract)
    found = lambda rule: F.expr(f"size(filter(errors, e -> e.rule = '{rule}'))").alias(f"n_{rule}")
    return checked.select("event_id", "event", "status", *map(found, ("required", "type", "max", "max_length")))


@query
def validate_repeated_keys(spark, sf_dir):
    """Members of repeated objects all count, checked as code and as data."""
    rows = fx.repeating_events(events_table(spark, sf_dir))
    as_code = val.validate(rows, demo(spark)).select("event_id", "status", codes().alias("errors"))
    as_data = val.validate(rows, _salted(spark)).select("event_id", F.col("status").alias("data_status"), codes().alias("data_errors"))
    return as_code.join(as_data, "event_id")


@query
def flatten_repeated_keys(spark, sf_dir):
    """Every flat key of documents that repeat objects."""
    flat = norm.flatten_events(fx.repeating_events(events_table(spark, sf_dir)))
    return flat.groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))


@query
def reload_between_batches(spark, sf_dir):
    """A stream restarted under the next plan version: even ids come first and meet version 1, odd ids version 2."""
    rows = raw(spark, sf_dir)
    inbox, outbox, checkpoint = (scratch_path(spark, f"reload-{n}") for n in ("in", "out", "checkpoint"))
    for version, odd in ((1, 0), (2, 1)):
        rows.filter(F.col("event_id") % 2 == odd).write.mode("append").parquet(inbox)
        stream = read_events_stream(spark, inbox, "parquet", rows.schema)
        validate_stream(
            stream, lambda v=version: (str(v), fx.demo_contract(spark, v)), [routed_sink(outbox)], checkpoint,
            available_now=True).awaitTermination()
    return spark.read.parquet(outbox).select("event_id", "event", "status", codes().alias("errors"))


@query
def event_metrics(spark, sf_dir):
    return val.event_metrics(validated(spark, sf_dir)).select(
        "event", "total", "valid", "invalid", "error", "rule_type", "rule_required", "rule_min", "rule_max")


@query
def validate_event_override(spark, sf_dir):
    return validated(spark, sf_dir, identity_gate=False, event="click").select(
        "event_id", "event", "status", codes().alias("errors"))


@query
def unknown_event_errors(spark, sf_dir):
    return validated(spark, sf_dir).filter("status = 'error'").select(
        "event_id", F.element_at("errors", 1)["detail"].alias("reason"))


@query
def route_counts(spark, sf_dir):
    path = scratch_path(spark, "routed")
    sinks.write_routed(validated(spark, sf_dir), path)
    accepted, rejected, failed = val.route(spark.read.parquet(path))
    out = None
    for name, frame in (("accepted", accepted), ("rejected", rejected), ("error", failed)):
        one = frame.agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum")).select(
            F.lit(name).alias("route"), "events", "id_sum")
        out = one if out is None else out.unionByName(one)
    return out


@query
def validation_metrics(spark, sf_dir):
    observed, seen = val.observe_validation(validated(spark, sf_dir, with_errors=False))
    observed.write.format("noop").mode("overwrite").save()
    got = seen.get
    names = ("total", "valid", "invalid", "error")
    return spark.range(1).select(*[F.lit(got[n]).cast("bigint").alias(n) for n in names])


@query
def validation_summary(spark, sf_dir):
    return val.summary(validated(spark, sf_dir, with_errors=False))


# --- impact and compatibility -----------------------------------------------------------------

@query
def check_parity(spark, sf_dir):
    samples = fx.snapshots(events_table(spark, sf_dir))
    return impact.check_parity(samples, "sha_a", demo(spark, 2)).select(
        "event_name", "id", codes().alias("errors"))


@query
def diff_events(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return impact.diff_events(fx.side_events(part, False), fx.side_events(part, True))


def _property_diff(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    old, new = fx.side(part, False), fx.side(part, True)
    return impact.diff_properties(old, new, old, new)


@query
def diff_properties(spark, sf_dir):
    return _property_diff(spark, sf_dir)


@query
def diff_entity(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return impact.diff_entity(fx.side_events(part, False), fx.side_events(part, True))


@query
def impact_gate(spark, sf_dir):
    return impact.gate_counts(_property_diff(spark, sf_dir))


# --- models -----------------------------------------------------------------------------------

_purchase: dict[str, list] = {}


def _purchase_properties(spark):
    key = spark.sparkContext.applicationId
    if key not in _purchase:
        _purchase[key] = models.event_properties(fx.demo_contract(spark), "purchase")
    return _purchase[key]


def _purchase_model(spark, sf_dir):
    return models.typed_model(
        raw(spark, sf_dir), _purchase_properties(spark), event="purchase", keep=("event_id",))


@query
def typed_model(spark, sf_dir):
    return _purchase_model(spark, sf_dir)


def _typed_values(spark, sf_dir):
    resolved = resolve.resolve_properties(fx.demo_contract(spark)).properties
    return resolved, models.typed_values(raw(spark, sf_dir), resolved, keep=("event_id",))


@query
def typed_models_all(spark, sf_dir):
    """All events' models from one scan, as counts and sums per event and property."""
    _, values = _typed_values(spark, sf_dir)
    there = "coalesce(text, cast(number AS string), cast(whole AS string), cast(flag AS string)) IS NOT NULL"
    return values.groupBy("event", "property").agg(
        F.count_if(F.expr(there)).alias("held"), F.round(F.sum("number"), 2).alias("number_sum"), F.sum("whole").alias("whole_sum"))


@query
def null_counts_all(spark, sf_dir):
    resolved, values = _typed_values(spark, sf_dir)
    events = norm.extract_event_name(raw(spark, sf_dir))
    return models.null_counts(values, events, models.required_columns(resolved))


@query
def materialized_model(spark, sf_dir):
    path = scratch_path(spark, models.model_name("purchase"))
    models.materialize_model(_purchase_model(spark, sf_dir), path=path)
    return spark.read.parquet(path).select(
        "event_id", F.col("`properties.qty`").alias("qty"), F.col("`properties.price`").alias("price"))


@query
def wide_models_read_back(spark, sf_dir):
    """Every event's wide model from one write over one scan; two of them read back."""
    path, columns = scratch_path(spark, "models"), models.model_columns(fx.demo_contract(spark))
    models.write_models(models.wide_models(raw(spark, sf_dir), columns, keep=("event_id",)), columns, path, keep=("event_id",))
    out = None
    for event in ("purchase", "signup"):
        one = models.read_model(spark, path, event).select(
            F.lit(event).alias("model"), "event_id", F.col("`properties.qty`").alias("qty"), F.col("`properties.price`").alias("price"),
            F.col("`properties.code`").alias("code"), F.col("`context.ip`").alias("ip"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def model_missing_columns(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    model = part.select(*[F.col("p_size").alias(f"properties.s{n}") for n in range(0, 50, 2)])
    resolved = resolve.resolve_properties(fx.registry(part)).properties
    return models.check_columns(model, models.required_columns(resolved)).select("event", "property")


@query
def model_null_counts(spark, sf_dir):
    required = [p for p, _, r in _purchase_properties(spark) if r]
    return models.check_not_null(_purchase_model(spark, sf_dir), required)


# --- integrity --------------------------------------------------------------------------------

def _nodes(spark, sf_dir):
    return fx.flow_nodes(fx.table(spark, sf_dir, "customer"))


@query
def flow_edges(spark, sf_dir):
    return lint.flow_edges(_nodes(spark, sf_dir)).select("flow", "src", "dst", "kind", "label")


@query
def orphan_targets(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return lint.orphan_targets(lint.flow_edges(nodes), nodes).select("flow", "src", "dst", "kind", "error")


def _observed(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"))


@query
def uncontracted_events(spark, sf_dir):
    unknown = lint.uncontracted_events(_observed(spark, sf_dir), fx.demo_contract(spark).events)
    return unknown.groupBy("event").agg(F.count(F.lit(1)).alias("seen"))


@query
def unused_events(spark, sf_dir):
    return lint.unused_events(fx.demo_contract(spark, 2).events, _observed(spark, sf_dir))


@query
def lint_contract(spark, sf_dir):
    """The demo plan with the journeys of all customers, as one plan version."""
    demo_plan = fx.demo_contract(spark)
    keyed = {
        part: getattr(demo_plan, part).withColumns({"plan_id": F.lit("registry"), "version": F.lit("1")})
        for part in ("events", "imports", "props", "enums", "identity", "mixins")
    }
    return lint.lint_contract(Contract(**keyed, flows=_nodes(spark, sf_dir))).select("rule", "subject", "error")


@query
def bad_gate_refs(spark, sf_dir):
    resolved = resolve.resolve_properties(fx.demo_contract(spark)).properties.select(
        F.lit("registry").alias("plan_id"), F.lit("1").alias("version"), "event", "property")
    return lint.bad_gate_refs(_nodes(spark, sf_dir), resolved).select("flow", "node", "property")
