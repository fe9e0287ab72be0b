import json

import pytest
from pyspark.sql import functions as F

from signalpact.functions import flatten as fl
from signalpact.model import Contract, Mapping, contract_from_dict
from signalpact.operators import normalize as norm
from signalpact.operators.compiled import compile_contract
from signalpact.operators.validate import error_strings, validate
from tests import brute


def nest(levels, leaf="1"):
    return '{"d":' * levels + leaf + "}" * levels


SPECS = {
    "E": {
        "userId": {"type": "string", "required": True, "rules": {"min_length": 2}},
        "properties.age": {"type": "number", "rules": {"min": 18, "max": 99.5}},
        "properties.n": {"type": "integer"},
        "properties.name": {"type": "string", "rules": {"min_length": 2, "max_length": 3}},
        "properties.code": {"type": "string", "rules": {"pattern": "[0-9]{2}"}},
        "properties.kind": {"type": "enum", "ref": "kinds"},
        "properties.flag": {"type": "boolean"},
        "properties.tags": {"type": "array"},
        "properties.a.b": {"type": "integer", "rules": {"max": 5}},
        "properties.a.b.c": {"type": "string"},
        "properties.obj": {"type": "object"},
        "properties.nothing": {"type": "null"},
        "context.ip": {"type": "string", "required": True},
        "bare": {"type": "string"},
    },
    "Needs": {"bare": {"type": "string", "required": True}, "properties.obj": {"type": "object", "required": True}},
    "Id": {"userId": {"type": "number"}, "wallet_address": {"type": "string"}},
    "Free": {},
}
PLAN = {"identity_properties": ["userId", "wallet_address"], "enums": {"kinds": ["x", "y"]},
        "events": {e: {"properties": p} for e, p in SPECS.items()}}
RESOLVED = {
    e: {p: ({**s, "type": "string", "values": ["x", "y"]} if s["type"] == "enum" else s) for p, s in props.items()}
    for e, props in SPECS.items()
}


def event(props="{}", context='{"ip":"1"}', name="E", head='"userId":"u1",'):
    return f'{{"event":"{name}",{head}"properties":{props},"context":{context}}}'


PAYLOADS = [
    event(), event('{"age":20}'), event('{"age":10}'), event('{"age":99.5}'), event('{"age":100}'),
    event('{"age":"20"}'), event('{"age":null}'), event('{"n":20.0}'), event('{"n":20.5}'),
    event('{"n":12345678901234567890}'), event('{"n":1e3}'), event('{"n":1e300}'), event('{"n":-2.0}'), event('{"name":"a"}'), event('{"name":"é😀"}'),
    event('{"name":"é😀é😀"}'), event('{"code":"a12b"}'), event('{"code":"a1b2"}'), event('{"kind":"x"}'),
    event('{"kind":"z"}'), event('{"flag":true,"tags":[{"deep":{"er":1}}]}'), event('{"flag":0,"tags":{"a":1}}'),
    event('{"obj":{"x":1}}'), event('{"obj":5}'), event('{"nothing":null}'), event('{"nothing":1}'),
    event('{"a":{"b":3}}'), event('{"a":{"b":7}}'), event('{"a.b":7}'), event('{"a":{"b":3},"a.b":7}'),
    event('{"a.b":7,"a":{"b":3}}'), event('{"a\\u002eb":7}'), event('{"a.b":{"c":1}}'), event('{"a":{"b.c":2}}'),
    event('{"a":{"b":{"c":"s"}}}'), event('{"a":{"b":{}}}'), event('{"age":1,"age":30}'), event('{"age":30,"age":1}'),
    event("5"), event("[]"), event('""'), event("null"), event("{}", "{}"), event("{}", '{"ip":null}'),
    event("{}", '{"ip":7,"ip":"x"}'), event(nest(101)), event(nest(102)), event("{}", nest(102)),
    event('{"tags":[' + nest(300) + "]}"), event('{"name":"' + "{" * 300 + '"}'),
    event('{"age":1}', head=""), event('{"age":1}', head='"userId":"",'), event(head='"userId":null,"user_id":"zz",'),
    event(head='"anonymousId":"an",'), event(head='"userId":7,'), event(head='"userId":true,'), event(head='"userId":"a","userId":"bb",'),
    event(head='"wallet_address":"w1",'), event(name="Nope"), event(name="Nope", head=""), event(name="Needs"),
    event(name="Id"), event(name="Id", head='"userId":"u1","walletAddress":"w",'), event(name="Free", context="1"),
    '{"event":"","event_name":"Free","userId":"u"}', '{"type":"Free","userId":"u"}',
    '{"properties":{"event_name":"Free"},"context":{"user_id":"u"}}', '{"event":"Free","event":"Nope","userId":"u"}',
    '{"event":"Free","userId":"u","properties":{"age":1},"properties":{"age":2}}',
    '{"event":"E","userId":"u1","context":{"ip":"1"},"properties":{"age":1},"properties":{"age":20}}',
    "", "nope", "[1]", '"text"', '[{"event":"Free","userId":"u"}]', '{"event":"Free","userId":"u"',
]


@pytest.fixture(scope="module")
def modes(spark):
    contract = contract_from_dict(spark, PLAN)
    return {
        "code": compile_contract(contract),
        "data": compile_contract(contract, max_literal_checks=0),
        "salted": compile_contract(contract, max_literal_checks=0, broadcast_bytes=0),
    }


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(list(enumerate(PAYLOADS)), "event_id bigint, payload string").repartition(2)


@pytest.mark.parametrize("mode", ["code", "data", "salted"])
@pytest.mark.parametrize("gate", [True, False])
def test_edge_payloads_match_brute_force(modes, raw, mode, gate):
    rows = validate(raw, modes[mode], identity_gate=gate).collect()
    assert len(rows) == len(PAYLOADS)
    for r in rows:
        got = (r["event"], r["status"], [(e["property"], e["rule"]) for e in r["errors"]])
        keys = PLAN["identity_properties"] if gate else []
        assert got == brute.validate(PAYLOADS[r["event_id"]], RESOLVED, keys), PAYLOADS[r["event_id"]][:200]


def test_modes_give_equal_details(modes, raw):
    code = validate(raw, modes["code"])
    for other in ("data", "salted"):
        assert code.exceptAll(validate(raw, modes[other])).count() == 0
    assert [c for c in validate(raw, modes["code"], with_errors=False).columns if c == "errors"] == []


def test_normalize_matches_brute_force(raw):
    p = F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"], F.to_json(e["value"]).alias("value")))
    for r in norm.normalize(raw).select("event_id", "event", "identity", p.alias("p"), "error").collect():
        text = PAYLOADS[r["event_id"]]
        try:
            event_name, identity, flat = brute.normalize(text)
        except brute.TooDeep:
            assert r["p"] is None and "depth" in r["error"]
            continue
        assert (r["event"], r["identity"]) == (event_name, identity), text
        got = {e["key"]: json.loads(e["value"]) for e in r["p"]}
        # plain dicts are enough to compare array leaves
        want = {k: json.loads(json.dumps(v, default=list)) if not isinstance(v, list) else None for k, v in flat.items()}
        assert {k: v for k, v in got.items() if not isinstance(v, list)} == {
            k: v for k, v in want.items() if not isinstance(flat[k], list)}, text
        assert got.keys() == flat.keys()


def test_json_reader_limit_is_an_error_not_invalid(spark, modes):
    raw = spark.createDataFrame([(1, event(nest(1500)))], "event_id bigint, payload string")
    assert validate(raw, modes["code"]).first()["status"] == "error"


def test_unusable_contract_entries_are_errors(spark):
    bad = {
        "T": {"type": "enum"}, "R": {"type": "enum", "ref": "missing"}, "Y": {"type": ""},
        "L": {"type": "string", "rules": {"min_length": 5, "max_length": 2}},
        "P": {"type": "string", "rules": {"pattern": "["}},
    }
    plan = {"events": {e: {"properties": {"properties.x": s}} for e, s in bad.items()}}
    plan["events"]["M"] = {"imports": ["gone"]}
    plan["events"]["Ok"] = {"properties": {"properties.x": {"type": "string", "enum": ["a"]}}}
    raw = spark.createDataFrame(
        [(e, f'{{"event":"{e}","properties":{{"x":"b"}}}}') for e in [*bad, "M", "Ok"]], "id string, payload string")
    got = {r["id"]: r for r in validate(raw, contract_from_dict(spark, plan)).collect()}
    assert {e: got[e]["status"] for e in got} == {**{e: "error" for e in [*bad, "M"]}, "Ok": "valid"}
    assert got["M"]["errors"][0]["detail"] == "mixin gone not found"


def test_error_texts(spark, modes):
    raw = spark.createDataFrame(
        [(1, event('{"age":10,"name":"a","kind":"z","flag":1.5}', context="{}"))], "event_id bigint, payload string")
    got = validate(raw, modes["code"]).select(error_strings().alias("e")).first()["e"]
    assert got == [
        "(root): context.ip is required",
        "properties.age: Must be greater than or equal to 18",
        "properties.flag: Invalid type. Expected: boolean, given: number",
        "properties.kind: properties.kind must be one of the following: x, y",
        "properties.name: String length must be greater than or equal to 2",
    ]


def test_event_given_by_caller(spark, modes):
    raw = spark.createDataFrame(
        [("Free", event('{"age":1}')), ("E", event('{"age":1}', name="Free"))], "stored string, payload string")
    got = validate(raw, modes["code"], event=F.col("stored")).select("stored", "event", "status").collect()
    assert sorted(map(tuple, got)) == [("E", "E", "invalid"), ("Free", "Free", "valid")]


def test_filters_stay_above_one_parse_and_no_shuffle(modes, raw, spark):
    from signalpact.plans import fixtures as fx

    events = fx.raw_events(fx.table(spark, "/root/testdata/sf0.001", "events"))
    plan = validate(events, modes["code"]).filter("status = 'invalid'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(payload") == 1
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in plan


def test_many_distinct_checks_choose_data_mode(spark):
    events = {f"E{i}": {"properties": {f"properties.p{i}": {"type": "number", "rules": {"max": i}}}} for i in range(300)}
    compiled = compile_contract(contract_from_dict(spark, {"events": events}))
    assert compiled.checks is None
    raw = spark.createDataFrame(
        [(i, f'{{"event":"E{i}","properties":{{"p{i}":{i + i % 2}}}}}') for i in range(300)], "i int, payload string")
    got = validate(raw, compiled).select("i", "status").collect()
    assert {r["i"]: r["status"] for r in got} == {i: "invalid" if i % 2 else "valid" for i in range(300)}


def test_more_checks_than_one_word(spark):
    props = {f"properties.p{i}": {"type": "integer", "required": i % 2 == 0} for i in range(80)}
    contract = compile_contract(contract_from_dict(spark, {"events": {"E": {"properties": props}}}))
    assert contract.checks is not None
    raw = spark.createDataFrame([('{"event":"E","properties":{"p1":"x"}}',)], "payload string")
    found = {(e["property"], e["rule"]) for e in validate(raw, contract).first()["errors"]}
    assert found == {("properties.p1", "type")} | {(f"properties.p{i}", "required") for i in range(0, 80, 2)}


def test_custom_mapping(spark):
    mapping = Mapping(("meta.name",), {"account": ("meta.id",)})
    raw = spark.createDataFrame([('{"event":"no","meta":{"name":"yes","id":5}}',)], "payload string")
    row = norm.normalize(raw, mapping=mapping).first()
    assert (row["event"], row["identity"]) == ("yes", {"account": "5"})


@pytest.mark.parametrize("limit", [256, 0])
def test_dotted_leaf_beside_deeper_object(spark, limit):
    plan = {"events": {"E": {"properties": {"properties.a.b": {"type": "integer", "rules": {"max": 5}}}}}}
    compiled = compile_contract(contract_from_dict(spark, plan), max_literal_checks=limit)
    raw = spark.createDataFrame([
        ('{"event":"E","properties":{"a.b":7,"a":{"b":{"c":1}}}}',),
        ('{"event":"E","properties":{"a":{"b":{"c":1}},"a.b":7}}',),
        ('{"event":"E","properties":{"a":{"b":3},"x":{"y":{"z":{}}}}}',)], "payload string")
    assert [r["status"] for r in validate(raw, compiled).collect()] == ["invalid", "invalid", "valid"]


ESCAPES = [
    r'{"event":"E","properties":{"\u0061.b":7}}', r'{"event":"E","properties":{"a.b":7}}', r'{"event":"E","properties":{"a":{"b":7}}}',
    r'{"event":"E","properties":{"a":{"b":7},"\u0061.b":2}}', r'{"event":"E","properties":{"a.b":7,"a":{"b":2}}}',
    r'{"event":"E","\u0070roperties":{"a":{"b":7}}}', r'{"event":"E","properties":{"a":{"b":2}},"\u0070roperties":{"a":{"b":7}}}',
    r'{"event":"E","properties":{"x":"\"","a":{"b":9}}}', r'{"event":"E","properties":{"a":1,"a":{"b":3}}}', r'{"\u0065vent":"E"}', "nonsense", "",
]


def test_modes_agree_on_spelled_keys(spark):
    contract = contract_from_dict(spark, {"events": {"E": {"properties": {
        "properties.a.b": {"type": "integer", "required": True, "rules": {"max": 5}}}}}})
    raw = spark.createDataFrame(list(enumerate(ESCAPES)), "id int, payload string").withColumn("tags", F.create_map(F.lit("k"), "id"))
    results = []
    for options in ({}, {"max_literal_checks": 0}, {"broadcast_bytes": 0}, {"max_literal_checks": 0, "broadcast_bytes": 0}):
        checked = validate(raw, compile_contract(contract, **options), identity_gate=False)
        results.append({r["id"]: (r["event"], r["status"], [e["rule"] for e in r["errors"]]) for r in checked.collect()})
    assert results[0] == results[1] == results[2] == results[3]
    assert results[0][0] == ("E", "invalid", ["max"]) == results[0][1] == results[0][2]
    assert results[0][9] == ("E", "invalid", ["required"])


def test_same_answers_in_a_plain_session(spark):
    contract = contract_from_dict(spark, {"events": {"E": {"properties": {"properties.a": {"type": "integer", "required": True}}}}})
    raw = spark.createDataFrame([('{"event":"E","userId":"u","properties":{"a":1,"a":2}}',)], "payload string")
    plain = spark.newSession()
    plain.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    other = plain.createDataFrame([('{"event":"E","userId":"u","properties":{"a":1,"a":2}}',)], "payload string")
    assert norm.normalize(other).select("event", "identity").collect() == norm.normalize(raw).select("event", "identity").collect()
    assert validate(raw, contract).first()["status"] == "valid"


def test_several_plan_versions_are_refused(spark):
    one = contract_from_dict(spark, {"events": {"E": {}}}, version="1")
    two = contract_from_dict(spark, {"events": {"E": {}}}, version="2")
    both = Contract(*(getattr(one, f).unionByName(getattr(two, f)) for f in ("events", "imports", "props", "enums", "identity")))
    with pytest.raises(ValueError, match="several plan versions"):
        compile_contract(both)
    assert compile_contract(both.at("plan", "2")).rules.count() == 1


def test_output_names_in_any_case(spark):
    raw = spark.createDataFrame([('{"event":"E"}', "old")], "payload string, Status string")
    checked = validate(raw, contract_from_dict(spark, {"events": {"E": {}}}), identity_gate=False)
    assert checked.select("status").first()[0] == "valid"


REPEATED = [
    ('{"properties":{"a":{"b":1},"a":{"c":2}}}', {"properties.a.b": 1, "properties.a.c": 2}),
    ('{"properties":{"a":{"b":1},"a":5}}', {"properties.a.b": 1, "properties.a": 5}),
    ('{"properties":{"a":{"b":1,"b":{"x":2}},"a":{"b":3}}}', {"properties.a.b": 3, "properties.a.b.x": 2}),
    ('{"properties":{"a":{"b":1},"a":{}}}', {"properties.a.b": 1}),
    ('{"properties":{"a":{},"a":{"b":"{"}}}', {"properties.a.b": "{"}),
    ('{"properties":{"a":1,"a":2},"properties":{"z":1}}', {"properties.a": 2}),
    ('{"properties":{"a" : {"b":1}, "\\u0061" :{"c":2}}}', {"properties.a.b": 1, "properties.a.c": 2}),
    ('{"properties":{"a":{"b":1},"a.b":7,"a":{"d":"x\\":y"}}}', {"properties.a.b": 7, "properties.a.d": 'x":y'}),
    ('{"properties":{"i":[{"q":1,"q":2}],"a":{"b":1},"a":{"c":[{"a":1}]}},"traits":{"x":{"y":1}}}',
     {"properties.i": [{"q": 2}], "properties.a.b": 1, "properties.a.c": [{"a": 1}]}),
]


def test_no_member_of_a_repeated_object_is_lost(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in REPEATED)), "event_id long, payload string")
    for r in norm.normalize(rows).select("event_id", F.transform(F.map_entries("properties"), lambda e: F.struct(
            e["key"], F.to_json(e["value"]).alias("value"))).alias("p")).collect():
        text, want = REPEATED[r["event_id"]]
        assert {e["key"]: json.loads(e["value"]) for e in r["p"]} == want, text
    specs = {k: {"type": "string", "required": True} for _, want in REPEATED for k in want}
    wrong = {k for k, v in REPEATED[0][1].items()}
    contract = contract_from_dict(spark, {"events": {"": {"properties": specs}}})
    for options in ({}, {"max_literal_checks": 0}):
        checked = validate(rows, compile_contract(contract, **options), identity_gate=False)
        first = checked.filter("event_id = 0").first()
        assert {e["property"] for e in first["errors"] if e["rule"] == "type"} == wrong


def test_rules_without_properties_count_for_the_broadcast(spark):
    bare = contract_from_dict(spark, {"events": {f"e{n}": {} for n in range(50)}})
    assert not compile_contract(bare, broadcast_bytes=0).broadcast and compile_contract(bare).broadcast
    rows = spark.createDataFrame([('{"event":"e7","userId":"u"}',), ('{"event":"x","userId":"u"}',)], "payload string")
    got = validate(rows, compile_contract(bare, broadcast_bytes=0)).select("event", "status").collect()
    assert sorted(map(tuple, got)) == [("e7", "valid"), ("x", "error")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_other_roots_leave_a_document_parsed(spark):
    """Members of a root that isn't asked for are no lost ones, so decimals stay decimals."""
    text = '{"event":"E","properties":{"a":{"b":1.25},"l":[{"x":1},{"x":2,"y":3}]},"context":{"ip":"i","odd name: ":{"z":1}}}'
    leaves = norm.flatten_events(spark.createDataFrame([(1, text)], "event_id long, payload string"))
    got = {r["key"]: r["tag"] for r in leaves.selectExpr("key", "schema_of_variant(value) AS tag").collect()}
    assert got == {"properties.a.b": "DECIMAL(3,2)", "properties.l": "ARRAY<OBJECT<x: BIGINT, y: BIGINT>>"}


def test_repeated_keys_are_read_from_the_text_once(spark):
    text = '{"properties":{"a":{"b":1},"p":1,"a":{"c":{"d":2}},"p":2,"q":[{"a":1,"a":2}]},"context":{"x":1}}'
    leaves = norm.flatten_events(spark.createDataFrame([(1, text)], "event_id long, payload string"))
    assert {r["key"]: r["v"] for r in leaves.selectExpr("key", "to_json(value) AS v").collect() if r["key"] != "properties.q"} == {
        "properties.a.b": "1", "properties.a.c.d": "2", "properties.p": "2"}
    reading = [line for line in plan_of(leaves).splitlines() if "from_json" in line]
    assert [line.count("get_json_object(payload") for line in reading] == [1]


@pytest.mark.parametrize("levels, deep", [(101, False), (102, True), (103, True)])
def test_depth_looks_past_arrays_and_quoted_marks(spark, levels, deep):
    """Only objects outside arrays count, whatever names and texts hold."""
    pad = '"p":"' + "x{" * 110 + '",'
    plain, held = nest(levels), nest(levels, '{"`<>":"}\\\\\\"}","[":[[{"c":{"e":1}},"]"],[]]}')
    inside = '{"a":[' + nest(levels + 5) + "]}"
    docs = [(0, f'{{"properties":{plain},{pad}"q":1}}'), (1, f'{{"context":{held},{pad}"q":1}}'), (2, f'{{"properties":{inside}}}')]
    guarded = norm.depth_guard(spark.createDataFrame(docs, "event_id long, payload string"))
    assert {r["event_id"]: r["too_deep"] for r in guarded.collect()} == {0: deep, 1: levels + 1 >= 102, 2: False}
    assert "map_entries" not in plan_of(guarded)    # levels are taken off the marks, not opened as documents


def test_rules_held_as_data_pass_one_step(spark):
    """Events are flattened before they meet their rules, and errors of absent values are found beforehand."""
    checks = {f"properties.p{i}": {"type": "string", "required": i % 2 == 0} for i in range(6)}
    compiled = compile_contract(contract_from_dict(spark, {"taxonomy": {"events": {"E": {"properties": checks}}}}), 0)
    rules = compiled.rules.selectExpr("explode(__checks)").selectExpr("key", "size(coalesce(value.absent, array())) AS n")
    assert {r["key"]: r["n"] for r in rules.collect()} == {p: int(c["required"]) for p, c in checks.items()}
    rows = spark.createDataFrame([(1, '{"event":"E","properties":{"p1":"a","p2":3,"p4":"b"}}')], "event_id long, payload string")
    checked = validate(rows, compiled, identity_gate=False)
    assert [(e["property"], e["rule"]) for e in checked.first()["errors"]] == [("properties.p0", "required"), ("properties.p2", "type")]
    plan = plan_of(checked)
    assert "__first_properties" not in plan[:plan.index("Join")]


def test_a_value_in_repeated_objects_is_read_along_its_path(spark):
    """Only objects on the way to the value are read, and what is found is what reading all entries finds."""
    docs = [
        '{"p":{"a":{"b":{"c":1}},"x":"{","a":{"b":{"d":2},"b":{"c":"two","c":"three"}}}}', '{"p":{"a":{"b":{"c":1}},"a":{"b":{"c":{"d":1}}}}}',
        '{"p":{"a":"{\\"b\\":{\\"c\\":9}}","a":{"b":"{\\"c\\":9}"},"a":{}}}', '{"p":{"a":{"b":{"c":1.50}},"a":[{"b":{"c":2}}],"a":null},"p":{"a":{"b":{"c":7}}}}',
        '{"p":{"a":{"b":{"c":[1,{"c":2}]}},"a":{"b":{"c":null}}}}', '{"p":"{\\"a\\":{\\"b\\":{\\"c\\":9}}}"}', '{"p":[]}', '{"q":1}', '{"p":{"a":', "", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string")
    along, whole = fl.repeated_at("t", "p", ["a", "b", "c"]), fl.last_at("t", "p", "p.a.b.c")
    found = rows.selectExpr("i", *[f"concat(schema_of_variant({x}), to_json({x})) AS {n}" for x, n in ((along, "along"), (whole, "whole"))])
    got = {r["i"]: (r["along"], r["whole"]) for r in found.collect()}
    assert [i for i, (a, w) in got.items() if a != w] == []
    assert {i for i, (a, _) in got.items() if a} == {0, 1, 3, 4, 5} and got[0][0] == 'STRING"three"'
    assert "aggregate(" not in along


def test_documents_that_lost_members_are_not_opened_twice(spark):
    """Where the text is read anyway, the parsed document's members are left alone."""
    plan = plan_of(norm.flatten_events(spark.createDataFrame([(1, "{}")], "event_id long, payload string")))
    step = next(line for line in plan.splitlines() if "AS __first_properties" in line)
    assert step.count("AS __more") == 1 and "ELSE CASE WHEN NOT __deep" in step or "THEN null WHEN NOT __deep" in step
