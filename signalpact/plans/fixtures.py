"""Raw events, contracts and registries derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalpact.model import Contract, contract_from_dict
from signalpact.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def payload_of(events: DataFrame) -> Column:
    """JSON document of one ``events`` row, with faults injected by its id."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    by_name, by_prop = i % 17 == 0, (i % 19 == 0) & (i % 17 != 0)
    properties = F.struct(
        F.when(by_prop, F.col("event_type")).alias("event_name"),
        F.when(i % 13 == 0, F.col("value").cast("string").cast("variant"))
        .otherwise(F.col("value").cast("variant")).alias("price"),
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("category"),
        F.concat(F.lit("K"), k.cast("string")).alias("code"),
        k.alias("qty"),
        F.struct(
            F.when(i % 11 == 0, F.lit(None)).when(i % 29 == 0, "website").otherwise("web").alias("source")
        ).alias("metadata"),
        F.array(F.lit("a"), F.lit("b")).alias("tags"),
    )
    main = F.to_json(F.struct(
        F.when(~by_name & ~by_prop, F.col("event_type")).alias("event"),
        F.when(by_name, F.col("event_type")).alias("event_name"),
        F.when(i % 7 != 0, F.col("user_id").cast("string")).alias("userId"),
        F.when((i % 7 == 0) & (i % 2 == 0), F.concat(F.lit("a"), F.col("user_id").cast("string")))
        .alias("anonymousId"),
        properties.alias("properties"),
    ))
    context = F.to_json(
        F.struct(
            F.when(i % 23 != 0, "10.0.0.1").alias("ip"),
            F.struct(F.lit("sdk").alias("name")).alias("library"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.concat(
        F.substr(main, F.lit(1), F.length(main) - F.lit(1)), F.lit(',"context":'), context, F.lit("}")
    )


def raw_events(events: DataFrame, *keep: str) -> DataFrame:
    """``events`` rows as raw events (event_id, payload)."""
    return events.select("event_id", payload_of(events).alias("payload"), *keep)


GLOBAL = {"properties": {
    "context.ip": {"type": "string", "required": True},
    "context.library.name": {"type": "string", "required": True},
    "properties.metadata.source": {"type": "string", "required": True, "rules": {"max_length": 3}},
}}
CODE = {"type": "string", "rules": {"min_length": 3, "pattern": "^K[0-9]{2}$"}}
CATEGORY = {"type": "enum", "ref": "category"}
QTY = {"type": "integer", "rules": {"min": 5, "max": 95}}


def _demo(version: int) -> dict:
    price = {"type": "number" if version == 1 else "string"}
    commerce = {"imports": ["global_context"], "properties": {
        "properties.price": price,
        "properties.category": CATEGORY,
        "properties.qty": {**QTY, "required": version == 2},
        "properties.tags": {"type": "array"},
        **({"properties.coupon": {"type": "string"}} if version == 2 else {}),
    }}
    size = {"type": "string", "enum": ["s", "m"] if version == 1 else ["s", "m", "l"]}
    events = {
        "click": {"description": "Click", "imports": ["global_context"], "properties": {
            "properties.price": price, "properties.category": CATEGORY}},
        "view": {"description": "View", "imports": ["global_context"], "properties": {
            "properties.code": CODE}},
        "purchase": {"description": "Purchase", "entity_type": "order" if version == 1 else "cart",
                     "imports": ["commerce"], "properties": {
                         "userId": {"type": "string", "required": True},
                         "properties.price": {**price, "required": True, "rules": {"min": 1, "max": 400}},
                         "properties.code": CODE}},
        "signup": {"description": "Signup", "entity_type": "user", "imports": ["commerce"],
                   "properties": {"properties.size": size, "properties.code": CODE}},
    }
    if version == 2:
        del events["view"]
        events["refund"] = {"description": "Refund", "imports": ["commerce"]}
    return {
        "version": str(version),
        "taxonomy": {
            "identity_properties": ["userId"],
            "enums": {"category": ["c0", "c1", "c2", "c3"]},
            "mixins": {"global_context": GLOBAL, "commerce": commerce},
            "events": events,
        },
    }


def demo_contract(spark: SparkSession, version: int = 1) -> Contract:
    return contract_from_dict(configure(spark), _demo(version), "demo")


def snapshots(events: DataFrame) -> DataFrame:
    """Stored samples: even ids under ``sha_a``, odd ones under ``sha_b``."""
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "sha_a").otherwise("sha_b").alias("sha"),
        F.col("event_type").alias("event_name"),
        payload_of(events).alias("payload"),
        F.col("ts").alias("created_at"),
    )


def deep_events(events: DataFrame) -> DataFrame:
    """Raw events whose properties nest 95 to 106 objects, so that some exceed the limit."""
    levels = (F.lit(95) + F.col("event_id") % 12).cast("int")
    return events.select("event_id", F.concat(
        F.lit('{"event":"'), F.col("event_type"), F.lit('","userId":"u","properties":'),
        F.repeat(F.lit('{"d":'), levels), F.lit("1"), F.repeat(F.lit("}"), levels), F.lit("}"),
    ).alias("payload"))


def _plan_columns() -> list[Column]:
    return [F.lit("registry").alias("plan_id"), F.lit("1").alias("version")]


def _type_by(n: Column) -> Column:
    return F.when(n % 3 == 0, "number").when(n % 3 == 1, "string").otherwise("boolean")


def _body(**given: Column) -> list[Column]:
    blank = {
        "type": "string", "required": "boolean", "enum": "array<string>", "ref": "string",
        "description": "string", "min": "double", "max": "double", "min_length": "int",
        "max_length": "int", "pattern": "string",
    }
    return [(given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in blank.items()]


def registry(part: DataFrame) -> Contract:
    """A contract that grows with ``part``: brands are events that import one mixin per type.

    Mixins collide on their properties; the one latest in alphabetical order must win. Every fifth
    own property refers to an enum, three of ten of which do not exist.
    """
    p = part.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", "p_name")
    brand_types = p.select("p_brand", "p_type").distinct()
    ranked = brand_types.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    imports = ranked.select(
        *_plan_columns(), F.lit("event").alias("owner_kind"), F.col("p_brand").alias("owner"),
        F.posexplode("types").alias("ordinal", "mixin"),
    )
    shared = p.groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("k")).select(
        *_plan_columns(), F.lit("mixin").alias("owner_kind"), F.col("p_type").alias("owner"),
        F.concat(F.lit("properties.s"), F.col("p_size").cast("string")).alias("property"),
        *_body(type=_type_by(F.col("k")), required=F.col("k") % 2 == 0, description=F.col("p_type")),
    )
    is_enum = F.col("p_partkey") % 5 == 0
    own = p.select(
        *_plan_columns(), F.lit("event").alias("owner_kind"), F.col("p_brand").alias("owner"),
        F.concat(F.lit("properties.p"), F.col("p_partkey").cast("string")).alias("property"),
        *_body(
            type=F.when(is_enum, "enum").otherwise(_type_by(F.col("p_size"))),
            required=F.col("p_partkey") % 4 == 0,
            ref=F.when(is_enum, F.concat(F.lit("e"), (F.col("p_size") % 10).cast("string"))),
            description=F.col("p_name"), min=F.col("p_size"), max=F.col("p_retailprice"),
            max_length=F.col("p_size") + 10, pattern=F.when(F.col("p_size") % 2 == 0, "^[a-z]+$"),
        ),
    )
    enums = p.filter(F.col("p_size") % 10 < 7).groupBy((F.col("p_size") % 10).alias("j")).agg(
        F.array_sort(F.collect_set("p_type")).alias("values")
    ).select(*_plan_columns(), F.concat(F.lit("e"), F.col("j").cast("string")).alias("name"), "values")
    events = p.select("p_brand").distinct().select(
        *_plan_columns(), F.col("p_brand").alias("event"),
        F.concat(F.lit("All of "), F.col("p_brand")).alias("description"), F.lit("").alias("entity_type"),
    )
    mixins = p.select("p_type").distinct().select(
        *_plan_columns(), F.col("p_type").alias("mixin"), F.lit("").alias("description"))
    identity = events.select("plan_id", "version", F.lit("userId").alias("key")).distinct()
    return Contract(events, imports, shared.unionByName(own), enums, identity, mixins)


def chained_registry(part: DataFrame) -> Contract:
    """One event per seven parts, importing a chain of mixins; some chains close, some break off."""
    k = F.col("p_partkey")
    p = part.select(k, F.floor(k / 7).cast("bigint").alias("block"), (k % 7).alias("place"))
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    events = p.select("block").distinct().select(
        *_plan_columns(), F.concat(F.lit("B"), F.col("block").cast("string")).alias("event"),
        F.lit("").alias("description"), F.lit("").alias("entity_type"), "block",
    )
    first = events.select(
        *_plan_columns(), F.lit("event").alias("owner_kind"), F.col("event").alias("owner"),
        F.lit(0).alias("ordinal"), name(F.col("block") * 7).alias("mixin"),
    )
    last = p.agg(F.max("p_partkey").alias("last"))
    target = (
        F.when((F.col("place") < 6) & (k < F.col("last")), name(k + 1))
        .when((F.col("place") == 6) & (F.col("block") % 5 == 0), name(F.col("block") * 7))
        .when((F.col("place") == 6) & (F.col("block") % 5 == 1),
              F.concat(F.lit("X"), F.col("block").cast("string")))
    )
    onward = p.join(F.broadcast(last)).select(  # a single row
        *_plan_columns(), F.lit("mixin").alias("owner_kind"), name(k).alias("owner"),
        F.lit(0).alias("ordinal"), target.alias("mixin"),
    ).filter(F.col("mixin").isNotNull())
    props = p.select(
        *_plan_columns(), F.lit("mixin").alias("owner_kind"), name(k).alias("owner"),
        F.concat(F.lit("properties.p"), F.col("place").cast("string")).alias("property"),
        *_body(type=F.lit("string"), required=F.lit(False)),
    )
    mixins = p.select(*_plan_columns(), name(k).alias("mixin"), F.lit("").alias("description"))
    enums = events.select("plan_id", "version", F.lit("").alias("name"), F.array(F.lit("")).alias("values")).limit(0)
    identity = events.select("plan_id", "version", F.lit("userId").alias("key")).distinct()
    return Contract(events.drop("block"), first.unionByName(onward), props, enums, identity, mixins)


def side(part: DataFrame, new: bool) -> DataFrame:
    """Resolved properties of the old or the new registry side."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = part.filter(k % (5 if new else 7) != 0)
    return rows.select(
        F.col("p_brand").alias("event"),
        F.concat(F.lit("properties.p"), k.cast("string")).alias("property"),
        _type_by(size + (k % 11 == 0).cast("int") if new else size).alias("type"),
        (k % (3 if new else 4) == 0).alias("required"),
        F.slice(F.array(*[F.lit(x) for x in "abcd"]), F.lit(1), size % (4 if new else 3)).alias("enum"),
    )


def side_events(part: DataFrame, new: bool) -> DataFrame:
    """Events (brand and size) of one side, with an entity type that moves on some of them."""
    rows = part.filter(F.col("p_partkey") % (5 if new else 7) != 0)
    event = F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string"))
    moved = (F.col("p_size") % 4 == 0).cast("int") if new else F.lit(0)
    return rows.select(
        event.alias("event"),
        F.concat(F.lit("t"), (F.col("p_size") % 3 + moved).cast("string")).alias("entity_type"),
    ).distinct()


def wide_contract(part: DataFrame) -> Contract:
    """Up to 400 properties on every event type, from ``part``: the least part key of a name sets its checks."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit("_"), (k % 8).cast("string"))
    types = F.array(*[F.lit(t) for t in TYPES])
    owner = F.element_at(types, (k % 5 + 1).cast("int"))
    rows = part.groupBy(owner.alias("event"), name.alias("name")).agg(F.min(k).alias("k"))
    number = F.col("k") % 3 != 1
    props = rows.select(
        *_plan_columns(), F.lit("event").alias("owner_kind"), F.col("event").alias("owner"),
        F.concat(F.lit("properties."), F.col("name")).alias("property"),
        *_body(type=F.when(F.col("k") % 3 == 0, "number").when(F.col("k") % 3 == 1, "string").otherwise("integer"),
               required=F.col("k") % 4 == 0, max=F.when(number, 50 + F.col("k") % 50), max_length=F.when(~number, 1 + F.col("k") % 3)),
    )
    events = part.sparkSession.range(1).select(F.explode(types).alias("event")).select(
        *_plan_columns(), "event", F.lit("").alias("description"), F.lit("").alias("entity_type"))
    spark = part.sparkSession
    none = {"imports": "plan_id string, version string, owner_kind string, owner string, ordinal int, mixin string",
            "enums": "plan_id string, version string, name string, values array<string>"}
    identity = events.select("plan_id", "version", F.lit("userId").alias("key")).distinct()
    return Contract(events, spark.createDataFrame([], none["imports"]), props, spark.createDataFrame([], none["enums"]), identity)


def wide_events(events: DataFrame) -> DataFrame:
    """Raw events with ten of the names of :func:`wide_contract` each, numbers and texts in turn."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")

    def member(j: int) -> Column:
        key = F.concat(F.lit('"s'), ((i + 5 * j) % 50 + 1).cast("string"), F.lit(f'_{j % 8}":'))
        return F.concat(key, F.when((i + j) % 2 == 0, k).otherwise(F.concat(F.lit('"v'), k, F.lit('"'))))

    return events.select("event_id", F.concat(
        F.lit('{"event":"'), F.col("event_type"), F.lit('","userId":"u","properties":{'),
        F.concat_ws(",", *[member(j) for j in range(10)]), F.lit("}}")).alias("payload"))


def repeating_events(events: DataFrame) -> DataFrame:
    """Raw events that give keys twice: an object (both count), a leaf (the last counts) and a root (the first counts)."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", F.concat(
        F.lit('{"event":"click","userId":"u","properties":{"metadata":{"source":"'), F.when(i % 4 == 0, "website").otherwise("web"),
        F.lit('"},"price":"first","metadata":{"medium":"m"},"price":'),
        F.when(i % 3 == 0, F.lit('"text"')).otherwise(F.col("value").cast("string")),
        F.lit(',"category":"c'), (k % 5).cast("string"), F.lit('"},"context":{"library":{"version":1},"ip":"10.0.0.1","library":{"name":"sdk"}}'),
        F.when(i % 5 == 0, ',"properties":{"price":"late"}}').otherwise("}"),
    ).alias("payload"))


TYPES = ["click", "view", "purchase", "signup", "error"]


def flow_nodes(customer: DataFrame) -> DataFrame:
    """Journeys of ten customers each; every node leads to the next, the last one out of its flow."""
    i = F.col("c_custkey")
    flow = F.floor(i / 10).cast("bigint")
    types = F.array(*[F.lit(t) for t in TYPES])
    pick = lambda n: F.element_at(types, (n % 5 + 1).cast("int"))
    opens = (i % 10 == 0) & (flow % 6 != 0)
    kind = (
        F.when(opens, "TriggerNode").when(i % 3 == 1, "GateNode").when(i % 3 == 2, "WaitNode")
        .otherwise("TerminalNode")
    )
    target = F.concat(F.lit("N"), (i + 1).cast("string"))
    expression = (
        F.when(i % 4 == 0, "$event.properties.price > 10")
        .when(i % 4 == 1, "x == 1 and $event.properties.qty < 3 or $event.zzz")
        .when(i % 4 == 2, "$event.missing").otherwise("")
    )
    inline = F.struct(*_body(type=F.lit("string"), required=F.lit(True)))
    return customer.select(
        *_plan_columns(),
        F.concat(F.lit("F"), flow.cast("string")).alias("flow"), F.lit("Main").alias("namespace"),
        F.concat(F.lit("N"), i.cast("string")).alias("node"), kind.alias("type"),
        F.when(opens, pick(flow)).otherwise("").alias("event"),
        F.when(~opens & (i % 3 == 2), pick(i)).otherwise("").alias("listen_for"),
        F.when(i % 3 == 0, F.array(F.struct(target.alias("target")))).alias("transitions"),
        F.when(i % 3 == 1, F.array(F.struct(
            expression.alias("expression"), (i % 4 == 3).alias("is_default"), target.alias("target")
        ))).alias("conditions"),
        F.when(i % 3 == 2, F.struct(F.lit("24h").alias("duration"), target.alias("target"))).alias("timeout"),
        F.create_map(F.concat(F.lit("properties.n"), i.cast("string")), inline).alias("properties"),
    )
