import json

import pytest
from pyspark.sql import functions as F

from signalpact.model import contract_from_dict, load_contract
from signalpact.operators import impact, lint, models, resolve


def resolved(spark, plan):
    return resolve.resolve_properties(contract_from_dict(spark, plan))


def import_chains(plan, event):
    """All import chains of an event with the places of their steps, until one repeats or is unknown."""
    done, open_ = [], [((i,), (m,)) for i, m in enumerate(plan["events"][event].get("imports", []))]
    while open_:
        places, names = open_.pop()
        done.append((places, names))
        if names[-1] in plan["mixins"] and names[-1] not in names[:-1]:
            below = plan["mixins"][names[-1]].get("imports", [])
            open_ += [((*places, i), (*names, m)) for i, m in enumerate(below)]
    return sorted(done)


def brute_order(plan, event):
    """Owner of every property: chains are followed in import order, a mixin counts where it is met first.

    What a mixin imports comes before it, and the event itself comes last.
    """
    chains = import_chains(plan, event)
    for _, names in chains:
        if names[-1] in names[:-1]:
            raise ValueError(f"circular dependency detected in mixins: [{' -> '.join(names)}]")
        if names[-1] not in plan["mixins"]:
            raise ValueError(f"mixin {names[-1]} not found")
    last = 10**6
    visits = {}
    for places, names in chains:
        visits[names[-1]] = min(visits.get(names[-1], (last,) * 99), (*places, last))
    owners = {}
    for mixin in sorted(visits, key=visits.get):
        owners |= dict.fromkeys(plan["mixins"][mixin].get("properties", {}), mixin)
    return owners | dict.fromkeys(plan["events"][event].get("properties", {}), event)


def random_plan(seed, cyclic):
    import random

    rnd = random.Random(seed)
    names = [f"M{i}" for i in range(9)]
    prop = lambda owner: {f"properties.q{rnd.randrange(6)}": {"type": "string", "description": owner} for _ in range(3)}
    mixins = {}
    for i, n in enumerate(names):
        pool = names if cyclic else names[i + 1:]
        imports = rnd.sample(pool, min(len(pool), rnd.randrange(4)))
        if cyclic and rnd.random() < 0.2:
            imports.append("Gone")
        mixins[n] = {"imports": imports, "properties": prop(n)}
    events = {f"E{i}": {"imports": rnd.sample(names, 3), "properties": prop(f"E{i}") if i % 2 else {}} for i in range(6)}
    return {"mixins": mixins, "events": events}


@pytest.mark.parametrize("seed,cyclic", [(1, False), (2, False), (3, True), (4, True)])
def test_inheritance_matches_depth_first_merge(spark, seed, cyclic):
    plan = random_plan(seed, cyclic)
    res = resolved(spark, plan)
    got = {}
    for r in res.properties.collect():
        got.setdefault(r["event"], {})[r["property"]] = r["description"]
    errors = {r["event"]: r["error"] for r in res.errors.collect()}
    for event in plan["events"]:
        try:
            assert got.get(event, {}) == brute_order(plan, event)
            assert event not in errors
        except ValueError as exc:
            assert errors[event] == str(exc) and event not in got


def test_cycle_text(spark):
    plan = {"mixins": {"A": {"imports": ["B"]}, "B": {"imports": ["A"]}}, "events": {"Login": {"imports": ["A"]}}}
    assert [r["error"] for r in resolved(spark, plan).errors.collect()] == [
        "circular dependency detected in mixins: [A -> B -> A]"]


def test_diamond_imports_stay_linear(spark):
    mixins = {f"L{i}{s}": {"imports": [f"L{i + 1}a", f"L{i + 1}b"] if i < 9 else []} for i in range(10) for s in "ab"}
    contract = contract_from_dict(spark, {"mixins": mixins, "events": {"E": {"imports": ["L0a", "L0b"]}}})
    closure, _, visited = resolve.import_closure(contract)
    assert closure.count() == 20 and visited == 20


def test_project_folder_merges_in_name_order(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "version": "1", "taxonomy": {"events": {"Login": {"description": "old"}, "Only": {}},
                                     "identity_properties": ["userId"]}}))
    (tmp_path / "b.yaml").write_text(
        "events:\n  Login: {description: User Login}\nflows:\n  F:\n    nodes:\n"
        "      Start: {type: TriggerNode, event: Login, transitions: [{target: End}]}\n      End: {type: TerminalNode}\n")
    (tmp_path / "notes.txt").write_text("not a plan")
    contract = load_contract(spark, str(tmp_path))
    assert {r["event"]: r["description"] for r in contract.events.collect()} == {"Login": "User Login", "Only": ""}
    assert [r["key"] for r in contract.identity.collect()] == ["userId"]
    assert contract.flows.count() == 2
    assert {r["version"] for r in contract.events.collect()} == {"1"}
    unused = lint.unused_events(contract.events, lint.used_events(contract.flows))
    assert [r["event"] for r in unused.collect()] == ["Only"]


def test_extract_and_lint_of_flows(spark):
    plan = {"events": {"A": {"properties": {"properties.x": {"type": "number"}}}, "B": {}}, "flows": {
        "F": {"namespace": "Main", "nodes": {
            "s": {"type": "TriggerNode", "event": "A", "transitions": [{"target": "w"}],
                  "properties": {"properties.x": {"type": "number", "rules": {"min": 1}}}},
            "w": {"type": "WaitNode", "listen_for": "Z", "timeout": {"duration": "1h", "target": "gone"}},
            "g": {"type": "GateNode", "conditions": [
                {"if": "$event.properties.x > 1", "target": "s"}, {"if": "$event.nope == $event.properties.x", "target": "s"},
                {"default": True, "target": "w"}]}}},
        "NoTrigger": {"nodes": {"g": {"type": "GateNode", "conditions": [{"if": "$event.nope", "target": "g"}]}}},
    }}
    contract = contract_from_dict(spark, plan)
    edges = lint.flow_edges(contract.flows)
    assert {(r["flow"], r["src"], r["dst"], r["label"]) for r in edges.collect()} >= {
        ("F", "w", "gone", "timeout: 1h"), ("F", "g", "w", "default")}
    assert [r["error"] for r in lint.orphan_targets(edges, contract.flows).collect()] == [
        "node w: orphaned timeout target gone"]
    used = lint.used_events(contract.flows)
    assert {r["event"] for r in lint.uncontracted_events(used, contract.events).collect()} == {"Z"}
    bad = lint.bad_gate_refs(contract.flows, resolve.resolve_properties(contract).properties).collect()
    assert [(r["flow"], r["property"]) for r in bad] == [("F", "nope")]
    skeleton = {r["event"]: r for r in resolve.extract_contract(contract.flows).collect()}
    assert skeleton["A"]["description"] == "Auto-extracted: F"
    assert skeleton["A"]["properties"]["properties.x"]["min"] == 1.0 and set(skeleton) == {"A", "Z"}


def test_diff_and_gate(spark):
    base = {"events": {"Keep": {"properties": {"a": {"type": "string"}, "b": {"type": "string", "enum": ["x"]}}}, "Gone": {}}}
    new = {"events": {"Keep": {"entity_type": "user", "properties": {
        "a": {"type": "number", "required": True}, "b": {"type": "string", "enum": ["x", "y"]}, "c": {"type": "string"}}}, "Fresh": {}}}
    changes = impact.diff_contracts(contract_from_dict(spark, base), contract_from_dict(spark, new))
    assert sorted(r["change"] for r in changes.collect()) == [
        "event [Fresh]: ADDED",
        "event [Gone]: REMOVED (BREAKING)",
        "event [Keep] prop [a]: NOW REQUIRED (BREAKING)",
        "event [Keep] prop [a]: TYPE CHANGE string -> number (BREAKING)",
        "event [Keep] prop [b]: ENUM CHANGED (POTENTIAL BREAKING)",
        "event [Keep] prop [c]: ADDED",
        "event [Keep]: ENTITY CHANGE  -> user",
    ]
    with pytest.raises(impact.GateFailed) as failed:
        impact.gate(changes)
    assert failed.value.count == 7
    same = contract_from_dict(spark, base)
    assert impact.gate(impact.diff_contracts(same, same)) == 0


def test_parity(spark):
    samples = spark.createDataFrame([
        (1, "old", "Login", '{"event":"Other","properties":{"user":"alice"}}'),
        (2, "old", "Login", '{"event":"Login","properties":{"deep":' + '{"d":' * 120 + "1" + "}" * 121 + "}"),
        (3, "new", "Login", "{}"), (4, "old", "Lost", "{}"),
    ], "id bigint, sha string, event_name string, payload string")
    props = {"user": {"type": "string"}}
    ok = contract_from_dict(spark, {"identity_properties": ["userId"], "events": {"Login": {"properties": props}}})
    got = {r["event_name"]: (r["id"], r["errors"][0]["rule"]) for r in impact.check_parity(samples, "old", ok).collect()}
    assert got == {"Login": (2, "depth"), "Lost": (4, "unknown_event")}
    broken = contract_from_dict(spark, {"events": {"Login": {"properties": {**props, "new_req": {"type": "string", "required": True}}}}})
    got = {r["event_name"]: r["id"] for r in impact.check_parity(samples, "old", broken).collect()}
    assert got == {"Login": 1, "Lost": 4}


def test_identity_values_are_text(spark):
    contract = contract_from_dict(spark, {"events": {"L": {"properties": {"userId": {"type": "number"}}}}})
    samples = spark.createDataFrame([(1, "s", "L", '{"userId":5}')], "id bigint, sha string, event_name string, payload string")
    assert impact.check_parity(samples, "s", contract).first()["errors"][0]["rule"] == "type"


def test_typed_model(spark):
    raw = spark.createDataFrame([
        (1, '{"event":"Order Completed","userId":"u","properties":{"total":"7.5","n":3.9,"ok":true,"o":{"x":1}}}'),
        (2, '{"event":"Other","properties":{"total":1}}')], "id int, payload string")
    props = [("properties.total", "number", True), ("properties.n", "integer", False), ("properties.ok", "boolean", False),
             ("properties.o", "string", False), ("userId", "string", True), ("total", "number", True)]
    model = models.typed_model(raw, props, event="Order Completed", keep=("id",))
    assert model.columns == ["id", "properties.n", "properties.o", "properties.ok", "properties.total", "total", "userId"]
    assert tuple(model.first()) == (1, 3, None, True, 7.5, None, "u")
    assert models.typed_model(raw, props).count() == 2
    assert models.model_name("Order Completed") == "analytics.order_completed"
    counts = models.check_not_null(model, ["userId", "total"]).collect()
    assert {r["property"]: r["nulls"] for r in counts} == {"userId": 0, "total": 1}
    required = spark.createDataFrame([("e", "userId"), ("e", "absent")], "event string, property string")
    assert [r["property"] for r in models.check_columns(model, required).collect()] == ["absent"]
    assert dict(model.dtypes)["properties.n"] == "int"


def test_models_of_unusual_names_and_no_requirements(spark):
    raw = spark.createDataFrame([(r'{"event":"E","properties":{"it\'s":1,"a[0]":"x"}}',)], "payload string")
    model = models.typed_model(raw, [("properties.it's", "integer", False), ("properties.a[0]", "string", True)])
    assert tuple(model.first()) == ("x", 1)
    assert models.check_not_null(model, []).count() == 0
    assert [tuple(r) for r in models.check_not_null(model, ["properties.a[0]"]).collect()] == [("properties.a[0]", 0, 1)]


def test_catalogue_names_events_that_do_not_resolve(spark):
    contract = contract_from_dict(spark, {"mixins": {}, "events": {"A": {"imports": ["Gone"]}, "B": {"properties": {"properties.x": {"type": "string"}}}}})
    rows = {(r["event"], r["property"]): r["error"] for r in resolve.catalogue(contract).collect()}
    assert rows == {("A", None): "mixin Gone not found", ("B", "properties.x"): None}


def test_wide_models_swap_as_one(spark, tmp_path):
    plan = {"events": {
        "a": {"properties": {"properties.x": {"type": "integer"}, "properties.y": {"type": "string"}, "userId": {"type": "string"}}},
        "b": {"properties": {"properties.x": {"type": "string"}, "properties.z": {"type": "boolean"}}}}}
    columns = models.model_columns(contract_from_dict(spark, plan))
    assert [c[3] for c in columns] == ["properties.x (int)", "properties.y", "userId", "properties.x (string)", "properties.z"]
    rows = spark.createDataFrame([
        (1, '{"event":"a","userId":"u","properties":{"x":5,"y":"t","z":true}}'), (2, '{"event":"b","properties":{"x":7,"z":false}}'),
        (3, '{"event":"c","properties":{"x":9}}'), (4, '{"event":"a","properties":{"x":"no"}}')], "id long, payload string")
    path = str(tmp_path / "models")
    wide = models.wide_models(rows, columns, keep=("id",))
    models.write_models(wide, columns, path, keep=("id",))
    a = models.read_model(spark, path, "a")
    assert a.columns == ["id", "properties.x", "properties.y", "userId"]
    assert sorted(map(tuple, a.collect())) == [(1, 5, "t", "u"), (4, None, None, None)]
    assert [tuple(r) for r in models.read_model(spark, path, "b").collect()] == [(2, "7", False)]
    wide.filter("id > 1").write.partitionBy("event").parquet(f"{path}/versions/unfinished")
    assert models.read_model(spark, path, "a").count() == 2
    models.write_models(wide.filter("id > 1"), columns, path, keep=("id",))
    assert models.read_model(spark, path, "a").count() == 1
    with pytest.raises(ValueError):
        models.read_model(spark, path, "c")
