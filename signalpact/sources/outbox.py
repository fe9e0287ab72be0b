"""Dead letters that are posted until each is acknowledged: written once, logged when delivered."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from signalpact.model import local_table
from signalpact.sources.sinks import FAILING_STATUS


def _failure(post: Callable[[str], int], body: str) -> str | None:
    try:
        status = post(body)
    except Exception as exc:  # any transport error is a failed delivery
        return f"post failed: {exc}"
    return f"status {status}" if status >= FAILING_STATUS else None


class Outbox:
    """Letters of batches under ``path`` (on storage all executors reach), and the log of their delivery.

    A batch's letters are numbered when they are written, and written once: a replay posts those, however
    its own rows are split. Every attempt logs (letter, failure) in the job that posts; a later attempt
    takes only letters no attempt has delivered. A letter is posted again after a success only if its
    task, or the driver, dies before the log of that attempt is committed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def _at(self, kind: str, batch_id: int) -> str:
        return f"{self._path}/{kind}/batch_id={batch_id}"

    def _read(self, kind: str, batch_id: int, schema: str) -> DataFrame | None:
        try:
            return self._spark.read.schema(schema).parquet(self._at(kind, batch_id))
        except AnalysisException:  # nothing there yet
            return None

    def put(self, batch_id: int, envelopes: DataFrame) -> None:
        """Write the letters (column ``body``) of a batch, unless that was finished before."""
        done = self._read("written", batch_id, "letters long")
        if done is not None and done.limit(1).count():
            return
        envelopes.select(F.monotonically_increasing_id().alias("letter"), "body").write.mode("overwrite").parquet(self._at("letters", batch_id))
        count = self.letters(batch_id).count()
        local_table(self._spark, [(count,)], "letters long").coalesce(1).write.mode("overwrite").parquet(self._at("written", batch_id))

    def letters(self, batch_id: int) -> DataFrame:
        """(letter, body) of a batch."""
        return self._spark.read.schema("letter long, body string").parquet(self._at("letters", batch_id))

    def log(self, batch_id: int) -> DataFrame:
        """(letter, failure) of every post of a batch; failure is NULL for a delivered letter."""
        found = self._read("log", batch_id, "letter long, failure string")
        return local_table(self._spark, [], "letter long, failure string") if found is None else found.select("letter", "failure")

    def waiting(self, batch_id: int) -> DataFrame:
        """Letters of a batch that no attempt has delivered."""
        return self.letters(batch_id).join(self.log(batch_id).where("failure IS NULL"), "letter", "left_anti")

    def deliver(self, batch_id: int, post: Callable[[str], int], workers: int | None = None) -> Row:
        """Post the waiting letters from the executors, with at most ``workers`` senders; what this attempt did."""
        waiting = self.waiting(batch_id)
        waiting = waiting.repartition(workers) if workers else waiting

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                failures = [_failure(post, body) for body in batch["body"]]
                yield pd.DataFrame({"letter": batch["letter"], "failure": pd.Series(failures, dtype="object", index=batch.index)})

        attempt = f"{self._at('log', batch_id)}/attempt={uuid.uuid4().hex}"
        waiting.mapInPandas(send, "letter long, failure string").write.parquet(attempt)
        return self._spark.read.schema("letter long, failure string").parquet(attempt).agg(
            F.count_if(F.col("failure").isNull()).alias("delivered"), F.count("failure").alias("failed"),
            F.min("failure").alias("first_failure")).first()
