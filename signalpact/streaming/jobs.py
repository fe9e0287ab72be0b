"""Streaming validation: contract reload per batch, dead-letter delivery, running counts."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from signalpact.model import Contract, Mapping, local_table
from signalpact.operators.compiled import CompiledContract, compile_contract
from signalpact.operators.lint import check_plan
from signalpact.operators.validate import event_metrics, observe_validation, summary, validate
from signalpact.sources.outbox import Outbox
from signalpact.sources.sinks import dlq_records, webhook_envelopes, write_dlq_webhook

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], None]


class DeliveryFailed(RuntimeError):
    """Dead letters of a batch did not reach their endpoint."""


class ContractSource:
    """The contract each micro-batch works with.

    ``provider`` returns (version key, contract). A new key is compiled once; if the provider or
    the compilation fails, the last good contract stays in use. With ``gate`` a plan whose flows
    and events don't fit together (see :func:`signalpact.operators.lint.lint_contract`) fails as well.
    """

    def __init__(self, provider: Callable[[], tuple[str, Contract]], gate: bool = False) -> None:
        self._provider = provider
        self._gate = gate
        self._key: str | None = None
        self._compiled: CompiledContract | None = None

    def current(self) -> CompiledContract:
        try:
            key, contract = self._provider()
            if self._compiled is None or key != self._key:
                if self._gate:
                    check_plan(contract)
                self._compiled, self._key = compile_contract(contract), key
        except Exception:
            if self._compiled is None:
                raise
            log.exception("contract reload failed, keeping version %s", self._key)
        return self._compiled

    def for_batch(self, batch_id: int, ledger: VersionLedger, history: Callable[[str], Contract] | None) -> CompiledContract:
        """The contract of a batch: the version it was begun with, if it was begun before, else the current one.

        The version is written down before the batch runs. A batch that is replayed under another version
        asks ``history`` for its own; without one (or when it doesn't know the version) the replay fails
        rather than mix two versions in one batch.
        """
        begun = ledger.version(batch_id)
        if begun is None:
            contract = self.current()
            ledger.begin(batch_id, self._key)
            return contract
        if begun == self._key:
            return self._compiled
        try:
            key, contract = self._provider()
        except Exception:
            key, contract = None, None
        if key != begun:
            if history is None:
                raise VersionGone(f"batch {batch_id} was begun with contract version {begun!r}, the provider has {key!r}")
            contract = history(begun)
        return compile_contract(contract)


class VersionGone(RuntimeError):
    """A batch must be replayed with a contract version that can't be had any more."""


class VersionLedger:
    """Which contract version each batch was begun with: a small file per batch next to the checkpoint.

    The file appears when its writer commits, so an entry is complete or absent; an absent one is a batch that
    was never begun.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def _file(self, batch_id: int) -> str:
        return f"{self._path}/batch_id={batch_id}"

    def begin(self, batch_id: int, version: str) -> None:
        row = local_table(self._spark, [(str(version),)], "version string")
        row.coalesce(1).write.mode("overwrite").json(self._file(batch_id))

    def version(self, batch_id: int) -> str | None:
        try:
            row = self._spark.read.schema("version string").json(self._file(batch_id)).where("version IS NOT NULL").first()
        except AnalysisException:  # no such file: the batch is new
            return None
        return row["version"] if row else None

    def versions(self) -> DataFrame:
        """(batch_id, version) of all batches begun."""
        return self._spark.read.schema("version string, batch_id long").json(self._path).select("batch_id", "version")


def validate_stream(
    events: DataFrame, provider: Callable[[], tuple[str, Contract]], sinks: list[Sink],
    checkpoint: str, payload: str = "payload", mapping: Mapping = Mapping(),
    identity_gate: bool = True, available_now: bool = False, interval: str = "5 seconds",
    name: str | None = None, plan_gate: bool = False, history: Callable[[str], Contract] | None = None,
) -> StreamingQuery:
    """Validate every micro-batch against exactly one contract and hand it to all sinks.

    ``checkpoint`` is where a restarted stream goes on; ``plan_gate`` refuses plans that don't lint. The
    contract version of every batch is kept beside the checkpoint (``<checkpoint>-contracts``), so that a
    batch replayed after a failure meets the version it was begun with; ``history`` gives the contract of
    an earlier version key.
    With several sinks the batch is validated once and kept for them. Delivery is at least once:
    a batch replayed after a failure reaches the sinks again under the same batch id.
    """
    contracts, ledger = ContractSource(provider, plan_gate), VersionLedger(events.sparkSession, f"{checkpoint.rstrip('/')}-contracts")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        checked = validate(batch, contracts.for_batch(batch_id, ledger, history), payload, mapping, identity_gate)
        if len(sinks) > 1:
            checked = checked.persist()
        try:
            for sink in sinks:
                sink(checked, batch_id)
        finally:
            if len(sinks) > 1:
                checked.unpersist()

    writer = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**_trigger(available_now, interval)).start()


def _trigger(available_now: bool, interval: str) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": interval}


def file_sink(path: str, workers: int | None = None) -> Sink:
    """Dead letters of a batch as JSON lines under ``path/batch_id=N``; a replay overwrites them."""
    def sink(checked: DataFrame, batch_id: int) -> None:
        records = dlq_records(checked)
        if workers:
            records = records.repartition(workers)  # coalesce would validate in that many tasks
        records.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")
    return sink


def webhook_sink(post: Callable[[str], int], workers: int = 5) -> Sink:
    """Dead letters of a batch to an HTTP endpoint, with at most ``workers`` senders.

    If any is not delivered the batch fails, so that the stream replays it: letters arrive at least once.
    """
    def sink(checked: DataFrame, batch_id: int) -> None:
        done = write_dlq_webhook(checked, post, workers=workers).first()
        if done["failed"]:
            raise DeliveryFailed(
                f"batch {batch_id}: {done['failed']} dead letters not delivered, first: {done['first_failure']}")
    return sink


def outbox_sink(path: str, post: Callable[[str], int], workers: int = 5, payload: str = "payload") -> Sink:
    """Dead letters of a batch to an HTTP endpoint through an :class:`signalpact.sources.outbox.Outbox` under ``path``.

    A batch with a letter that was not taken fails and is replayed; the replay posts only what is left.
    """
    def sink(checked: DataFrame, batch_id: int) -> None:
        outbox = Outbox(checked.sparkSession, path)
        outbox.put(batch_id, webhook_envelopes(checked, payload))
        done = outbox.deliver(batch_id, post, workers)
        if done["failed"]:
            raise DeliveryFailed(
                f"batch {batch_id}: {done['failed']} dead letters not delivered, first: {done['first_failure']}")
    return sink


def routed_sink(path: str) -> Sink:
    """All outcomes of a batch in one pass, partitioned by status; a replay overwrites the batch."""
    def sink(checked: DataFrame, batch_id: int) -> None:
        checked.write.mode("overwrite").partitionBy("status").parquet(f"{path}/batch_id={batch_id}")
    return sink


def dlq_sink(
    sink: str, path: str | None = None, post: Callable[[str], int] | None = None, workers: int = 5,
) -> Sink:
    """The dead-letter sink by name: ``webhook``, ``outbox`` (a webhook that remembers what it delivered) or ``files``."""
    if sink in ("webhook", "outbox"):
        if post is None:
            raise ValueError(f"the {sink} sink needs a transport")
        if sink == "webhook":
            return webhook_sink(post, workers)
        if path is None:
            raise ValueError("the outbox sink needs a path")
        return outbox_sink(path, post, workers)
    if sink == "files":
        if path is None:
            raise ValueError("the files sink needs a path")
        return file_sink(path, workers)
    raise ValueError(f"unknown sink {sink!r}: use 'webhook', 'outbox' or 'files'")


def summary_stream(
    events: DataFrame, contract: Contract | CompiledContract, query_name: str,
    checkpoint: str, fmt: str = "memory", output_mode: str = "complete", available_now: bool = False,
    interval: str = "5 seconds", known_only: bool = False, **options: str,
) -> StreamingQuery:
    """Running per-event counts over everything seen so far (state: one row per event name).

    Names come from the payloads; ``known_only`` counts those no contract knows under ``''``, which
    bounds the state by the contract.
    """
    checked = validate(events, contract, with_errors=known_only)
    if known_only:
        unknown = F.exists("errors", lambda e: e["rule"] == "unknown_event")
        checked = checked.withColumn("event", F.when(unknown, "").otherwise(F.col("event")))
    counts = summary(checked)
    return counts.writeStream.outputMode(output_mode).format(fmt).queryName(query_name).options(
        **options
    ).option("checkpointLocation", checkpoint).trigger(**_trigger(available_now, interval)).start()


def metrics_sink(path: str) -> Sink:
    """Telemetry per event name of a batch (see :func:`signalpact.operators.validate.event_metrics`); a replay overwrites it."""
    def sink(checked: DataFrame, batch_id: int) -> None:
        event_metrics(checked, batch_id).write.mode("overwrite").parquet(f"{path}/part={batch_id}")
    return sink


def observed_stream(
    events: DataFrame, contract: Contract | CompiledContract, sink: Sink, checkpoint: str,
    metric: str = "validation", available_now: bool = False, interval: str = "5 seconds",
) -> StreamingQuery:
    """Validate with one contract and report outcome counts per batch to a ValidationListener."""
    checked, _ = observe_validation(validate(events, contract), metric)
    return checked.writeStream.foreachBatch(sink).option(
        "checkpointLocation", checkpoint).trigger(**_trigger(available_now, interval)).start()


class ValidationListener(StreamingQueryListener):
    """Collects the outcome counts and the duration of every finished batch."""

    def __init__(self, metric: str = "validation") -> None:
        self.metric = metric
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.metric)
        if seen is not None:
            self.batches.append({
                "batch_id": event.progress.batchId,
                "duration_ms": event.progress.batchDuration, **seen.asDict(),
            })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
