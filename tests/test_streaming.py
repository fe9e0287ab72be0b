import json

import pytest

from signalpact.model import contract_from_dict
from signalpact.operators import lint
from signalpact.operators.compiled import compile_contract
from signalpact.operators.validate import observe_validation, summary, validate
from signalpact.plans import fixtures as fx
from signalpact.session import scratch_path
from signalpact.sources import sinks, snapshots as snap
from signalpact.sources.events import read_events, read_events_stream
from signalpact.sources.outbox import Outbox
from signalpact.streaming import jobs


def plan(**extra):
    return {"events": {"Login": {"properties": {"userId": {"type": "string", "required": True}, **extra}}}}


@pytest.fixture
def folder(tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.jsonl").write_text('{"event":"Login","userId":"u1"}\n{"event":"Login"}\n{"event":"Nope","userId":"u"}\n')
    return tmp_path


def lines(path):
    return [json.loads(x) for f in path.rglob("*.json") for x in f.read_text().splitlines()]


def test_reload_between_batches_and_bad_contract_keeps_the_old(spark, folder):
    versions = [("1", contract_from_dict(spark, plan()))]
    seen = []

    def provider():
        if versions[-1] is None:
            raise RuntimeError("broken plan")
        return versions[-1]

    def collect(checked, batch_id):
        seen.append(sorted((r["status"]) for r in checked.collect()))

    def run():
        stream = read_events_stream(spark, str(folder / "in"))
        jobs.validate_stream(stream, provider, [collect], checkpoint=str(folder / "cp"),
                             available_now=True).awaitTermination()

    run()
    assert seen == [["error", "invalid", "valid"]]
    (folder / "in" / "2.jsonl").write_text('{"event":"Login","userId":"u1"}\n')
    versions.append(("2", contract_from_dict(spark, plan(new_v={"type": "string", "required": True}))))
    run()
    assert seen[-1] == ["invalid"]
    source = jobs.ContractSource(provider)
    first = source.current()
    versions.append(None)
    assert source.current() is first


def test_dead_letters_to_files_and_webhook(spark, folder):
    contract = contract_from_dict(spark, plan())
    stream = read_events_stream(spark, str(folder / "in"), maxFilesPerTrigger="1")
    inbox = folder / "calls"
    inbox.mkdir()
    target = str(inbox)

    def post(body):
        import uuid
        with open(f"{target}/{uuid.uuid4().hex}.json", "w") as out:
            out.write(body)
        return 200

    jobs.validate_stream(
        stream, lambda: ("1", contract),
        [jobs.dlq_sink("files", path=str(folder / "dlq")), jobs.dlq_sink("webhook", post=post),
         jobs.routed_sink(str(folder / "routed"))],
        checkpoint=str(folder / "cp"), available_now=True,
    ).awaitTermination()
    (letter,) = lines(folder / "dlq")
    assert letter["payload"] == {"event": "Login"} and letter["errors"] == ["(root): userId is required"]
    assert letter["ts"] > 1_600_000_000
    (call,) = lines(inbox)
    assert call == {"payload": '{"event":"Login"}', "errors": ["(root): userId is required"], "source": "signalpact"}
    routed = spark.read.parquet(str(folder / "routed"))
    assert {r["status"]: r["count"] for r in routed.groupBy("status").count().collect()} == {
        "valid": 1, "invalid": 1, "error": 1}
    with pytest.raises(ValueError):
        jobs.dlq_sink("queue")


def test_webhook_failures_are_counted(spark, folder):
    raw = read_events(spark, str(folder / "in"))
    checked = validate(raw, contract_from_dict(spark, plan()))

    def refuse(_):
        raise OSError("no route")

    assert sinks.write_dlq_webhook(checked, lambda _: 503).first().asDict() == {
        "delivered": 0, "failed": 1, "first_failure": "status 503"}
    assert sinks.write_dlq_webhook(checked, refuse, workers=2).first()["failed"] == 1
    assert sinks.write_dlq_webhook(checked, lambda _: 204).first()["delivered"] == 1


def test_stream_equals_batch(spark):
    sf_dir = "/root/testdata/sf0.001"
    contract = compile_contract(fx.demo_contract(spark))
    events = fx.table(spark, sf_dir, "events")
    stream = read_events_stream(spark, sf_dir, "parquet", events.schema, pathGlobFilter="events.parquet")
    rows = []
    jobs.validate_stream(
        fx.raw_events(stream), lambda: ("1", fx.demo_contract(spark)),
        [lambda df, _: rows.extend(df.collect())], scratch_path(spark, "cp"), available_now=True).awaitTermination()
    batch = validate(fx.raw_events(events), contract).collect()
    assert sorted(map(str, rows)) == sorted(map(str, batch)) and len(rows) == events.count()


def test_observed_metrics_and_listener(spark):
    events = fx.table(spark, "/root/testdata/sf0.001", "events")
    contract = compile_contract(fx.demo_contract(spark))
    checked = validate(fx.raw_events(events), contract)
    observed, seen = observe_validation(checked)
    observed.write.format("noop").mode("overwrite").save()
    assert seen.get["total"] == events.count() == sum(seen.get[k] for k in ("valid", "invalid", "error"))
    total = summary(checked).groupBy().sum("invalid").first()[0]
    assert total == seen.get["invalid"]
    listener = jobs.ValidationListener()
    spark.streams.addListener(listener)
    try:
        stream = read_events_stream(
            spark, "/root/testdata/sf0.001", "parquet", events.schema, pathGlobFilter="events.parquet")
        query = jobs.observed_stream(
            fx.raw_events(stream), contract, lambda df, _: df.write.format("noop").mode("overwrite").save(),
            scratch_path(spark, "cp"), available_now=True)
        query.awaitTermination()
        for _ in range(50):
            if listener.batches:
                break
            import time
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.batches and listener.batches[0]["total"] == events.count()


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = [(i, "hot" if i < 90 else "cold", f'{{"i":{i}}}') for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, event_name string, payload string")
    snap.save_snapshots(df, path, sha="s1")
    snap.save_snapshots(df.limit(0), path, sha="s2")
    loaded = snap.load_snapshots(spark, path, "s1")
    assert "PartitionFilters: [isnotnull(sha" in loaded._jdf.queryExecution().executedPlan().toString()
    groups = snap.snapshots_by_event(loaded, chunk_rows=20).collect()
    assert max(len(g["payloads"]) for g in groups) < 90
    assert sorted((g["event_name"], p) for g in groups for p in g["payloads"]) == sorted((e, p) for _, e, p in rows)
    assert snap.load_snapshots(spark, path, "s2").count() == 0


def test_dlq_file_and_feed(spark, tmp_path):
    raw = spark.createDataFrame([('{"event":"Login"}',), ('{"event":"Login","userId":"u"}',), ("{}",)], "payload string")
    checked = validate(raw, contract_from_dict(spark, plan()))
    sinks.write_dlq_files(checked, str(tmp_path / "dlq"))
    sinks.write_dlq_files(checked, str(tmp_path / "dlq"))
    assert len(lines(tmp_path / "dlq")) == 2
    feed = {tuple(r)[:2] for r in sinks.result_feed(checked).collect()}
    assert feed == {("Login", True), ("Login", False)}


def test_failed_letters_are_replayed(spark, folder):
    contract = contract_from_dict(spark, plan())
    for n in range(2, 6):
        (folder / "in" / f"{n}.jsonl").write_text(f'{{"event":"Login","n":{n}}}\n{{"event":"Login","userId":"u"}}\n')
    calls = folder / "calls"
    calls.mkdir()
    target = str(calls)

    def run(status):
        def post(body):
            import time
            import uuid
            time.sleep(0.05)  # a slow endpoint
            if status < 400:
                with open(f"{target}/{uuid.uuid4().hex}.json", "w") as out:
                    out.write(body)
            return status

        jobs.validate_stream(
            read_events_stream(spark, str(folder / "in"), maxFilesPerTrigger="1"), lambda: ("1", contract),
            [jobs.dlq_sink("webhook", post=post, workers=2)], checkpoint=str(folder / "cp"), available_now=True,
        ).awaitTermination()

    with pytest.raises(Exception, match="dead letters not delivered"):
        run(503)
    run(200)
    got = sorted(json.loads(x["payload"]).get("n", 0) for x in lines(calls))
    assert got == [0, 2, 3, 4, 5]


def test_unreadable_payload_stays_in_the_letter(spark, folder):
    (folder / "in" / "2.jsonl").write_text('{"event":"Login","userId":\n')
    contract = contract_from_dict(spark, {"identity_properties": ["userId"], **plan()})
    checked = validate(read_events(spark, str(folder / "in")), contract)
    sinks.write_dlq_files(checked, str(folder / "dlq"))
    assert '{"event":"Login","userId":' in [x["payload"] for x in lines(folder / "dlq")]


def test_plan_gate_keeps_the_old_plan(spark):
    flows = {"F": {"nodes": {"Start": {"type": "TriggerNode", "event": "Login", "transitions": [{"target": "End"}]},
                             "End": {"type": "TerminalNode"}}}}
    good = {**plan(), "flows": flows}
    orphan = {**plan(), "flows": flows, "events": {**plan()["events"], "Orphan": {}}}
    versions = [("1", contract_from_dict(spark, good))]
    source = jobs.ContractSource(lambda: versions[-1], gate=True)
    first = source.current()
    versions.append(("2", contract_from_dict(spark, orphan)))
    assert source.current() is first
    with pytest.raises(lint.PlanRefused, match="event Orphan is used by no flow"):
        lint.check_plan(versions[-1][1])
    with pytest.raises(lint.PlanRefused, match="uses event Gone"):
        lint.check_plan(contract_from_dict(spark, {**plan(), "flows": {"F": {"nodes": {
            "A": {"type": "TriggerNode", "event": "Login"}, "B": {"type": "WaitNode", "listen_for": "Gone"}}}}}))


def test_summary_folds_unknown_names(spark, folder):
    name = "folded_" + scratch_path(spark, "q")[-32:]
    jobs.summary_stream(
        read_events_stream(spark, str(folder / "in")), contract_from_dict(spark, plan()), name,
        str(folder / "cp"), available_now=True, known_only=True).awaitTermination()
    assert {r["event"]: r["total"] for r in spark.table(name).collect()} == {"Login": 2, "": 1}


def test_metrics_per_event(spark, folder):
    contract = contract_from_dict(spark, plan())
    jobs.validate_stream(
        read_events_stream(spark, str(folder / "in")), lambda: ("1", contract), [jobs.metrics_sink(str(folder / "metrics"))],
        checkpoint=str(folder / "cp"), available_now=True).awaitTermination()
    got = {r["event"]: (r["total"], r["valid"], r["rule_required"], r["batch_id"])
           for r in spark.read.parquet(str(folder / "metrics")).collect()}
    assert got == {"Login": (2, 1, 1, 0), "": (1, 0, 0, 0)}


def test_chunks_are_bounded_by_bytes(spark):
    rows = spark.range(64).selectExpr("id", "'E' AS event_name", "repeat('x', 100000) AS payload")
    sizes = [len(r["payloads"]) for r in snap.snapshots_by_event(rows, chunk_bytes=800_000).collect()]
    assert sum(sizes) == 64 and len(sizes) >= 6 and max(sizes) < 24


def test_a_replayed_batch_meets_its_own_contract_version(spark, folder):
    plans = {"1": contract_from_dict(spark, plan()),
             "2": contract_from_dict(spark, plan(new_v={"type": "string", "required": True}))}
    now, seen = ["1"], []

    def sink(checked, batch_id):
        statuses = sorted(r["status"] for r in checked.collect())
        if now[0] == "1":
            raise RuntimeError("the driver dies after the batch has begun")
        seen.append((batch_id, statuses))

    def run(history):
        stream = read_events_stream(spark, str(folder / "in"))
        jobs.validate_stream(stream, lambda: (now[0], plans[now[0]]), [sink], checkpoint=str(folder / "cp"),
                             available_now=True, history=history).awaitTermination()

    with pytest.raises(Exception, match="dies"):
        run(None)
    now[0] = "2"
    with pytest.raises(Exception, match="begun with contract version '1'"):
        run(None)
    assert seen == []
    run(plans.__getitem__)
    assert seen == [(0, ["error", "invalid", "valid"])]
    (folder / "in" / "2.jsonl").write_text('{"event":"Login","userId":"u1"}\n')
    run(plans.__getitem__)
    assert seen[1:] == [(1, ["invalid"])]
    ledger = jobs.VersionLedger(spark, str(folder / "cp-contracts"))
    assert {tuple(r) for r in ledger.versions().collect()} == {(0, "1"), (1, "2")}
    (folder / "cp-contracts" / "batch_id=3").mkdir()
    assert (ledger.version(1), ledger.version(3), ledger.version(7)) == ("2", None, None)


def test_a_replay_posts_only_letters_that_were_not_taken(spark, folder):
    (folder / "in" / "1.jsonl").write_text("".join(f'{{"event":"Login","n":{n}}}\n' for n in range(100)))
    calls = folder / "calls"
    calls.mkdir()
    target, bad = str(calls), [True]

    def run():
        refuse = bad[0]

        def post(body):
            import uuid
            with open(f"{target}/{uuid.uuid4().hex}.json", "w") as out:
                out.write(body)
            return 503 if refuse and '\\"n\\":42' in body else 200

        contract = contract_from_dict(spark, plan())
        jobs.validate_stream(
            read_events_stream(spark, str(folder / "in")), lambda: ("1", contract),
            [jobs.dlq_sink("outbox", path=str(folder / "outbox"), post=post, workers=3)], checkpoint=str(folder / "cp"), available_now=True,
        ).awaitTermination()

    with pytest.raises(Exception, match="1 dead letters not delivered"):
        run()
    assert len(lines(calls)) == 100
    bad[0] = False
    run()
    posted = sorted(json.loads(x["payload"])["n"] for x in lines(calls))
    assert posted == sorted([*range(100), 42])
    box = Outbox(spark, str(folder / "outbox"))
    assert box.waiting(0).count() == 0 and box.log(0).count() == 101 and box.log(9).count() == 0
    with pytest.raises(ValueError):
        jobs.dlq_sink("outbox", post=len)


def test_letters_half_written_are_written_again(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"))
    bodies = spark.createDataFrame([("a",), ("a",), ("b",)], "body string")
    box.put(5, bodies.limit(1))
    for f in (tmp_path / "box" / "written" / "batch_id=5").glob("*"):
        f.unlink()
    box.put(5, bodies)
    box.put(5, bodies.limit(0))  # a replay doesn't change what was written
    assert sorted(r["body"] for r in box.letters(5).collect()) == ["a", "a", "b"]
    assert box.deliver(5, lambda body: 200).asDict() == {"delivered": 3, "failed": 0, "first_failure": None}
    assert box.deliver(5, lambda body: 200)["delivered"] == 0


def test_a_save_counts_once_and_only_when_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "Login", "{}", "a"), (2, "Login", "{}", "b")], "id long, event_name string, payload string, sha string")
    snap.save_snapshots(rows, path, save_id="one")
    snap.save_snapshots(rows, path, save_id="one")
    snap.save_snapshots(rows.limit(1), path)
    assert snap.load_snapshots(spark, path).count() == 3
    with monkeypatch.context() as patch:
        patch.setattr(snap, "local_table", lambda *_: 1 / 0)  # the driver dies before the manifest
        with pytest.raises(ZeroDivisionError):
            snap.save_snapshots(rows, path, save_id="two")
    assert snap.load_snapshots(spark, path, "a").count() == 2
    snap.save_snapshots(rows, path, save_id="two")
    assert snap.load_snapshots(spark, path, "a").count() == 3
    with pytest.raises(ValueError):
        snap.save_snapshots(rows, path, save_id="../x")


def test_parity_in_ranges_stops_early(spark):
    from signalpact.operators import impact
    contract = contract_from_dict(spark, plan(age={"type": "number"}))
    samples = spark.createDataFrame(
        [(i, "Login" if i % 3 else "Other", "s", '{"userId":"u","age":1}' if i < 4 else '{"userId":"u"}' if i % 2 else "{}") for i in range(40)],
        "id long, event_name string, sha string, payload string")
    once = {(r["event_name"], r["id"], len(r["errors"])) for r in impact.check_parity(samples, "s", contract).collect()}
    assert once == {("Login", 4, 1), ("Other", 0, 1)}
    for ranges in (2, 7):
        got = impact.check_parity(samples, "s", contract, ranges=ranges).collect()
        assert {(r["event_name"], r["id"], len(r["errors"])) for r in got} == once
