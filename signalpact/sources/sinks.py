"""Where outcomes go: dead-letter files, a webhook, a routed table, a result feed."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from signalpact.operators.validate import error_strings
from signalpact.session import accept_repeated_keys

# --- fixed values: delivery limits of the webhook ---
WEBHOOK_TIMEOUT_S = 2
FAILING_STATUS = 400
# ----------------------------------------------------
WEBHOOK_SOURCE = "signalpact"


def rejected(validated: DataFrame) -> DataFrame:
    """Only invalid events are dead letters; error outcomes are not."""
    return validated.filter(F.col("status") == "invalid")


def dlq_records(validated: DataFrame, payload: str = "payload") -> DataFrame:
    """Dead letters as {payload, errors, ts}; ``ts`` is the processing time in seconds.

    A payload that is no JSON document is kept as it came, as a string.
    """
    accept_repeated_keys(validated.sparkSession)
    return rejected(validated).select(
        F.coalesce(F.try_parse_json(payload), F.col(payload).cast("variant")).alias("payload"), error_strings("errors").alias("errors"),
        F.unix_timestamp(F.current_timestamp()).alias("ts"),
    )


def write_dlq_files(validated: DataFrame, path: str, payload: str = "payload") -> None:
    """Append dead letters as JSON lines, with the payload embedded as JSON."""
    dlq_records(validated, payload).write.mode("append").json(path)


def webhook_envelopes(
    validated: DataFrame, payload: str = "payload", source: str = WEBHOOK_SOURCE
) -> DataFrame:
    """Body of one webhook call per dead letter: {payload, errors, source}, payload as text."""
    return rejected(validated).select(F.to_json(F.struct(
        F.col(payload).alias("payload"), error_strings("errors").alias("errors"),
        F.lit(source).alias("source"),
    )).alias("body"))


def http_post(url: str) -> Callable[[str], int]:
    """Transport that posts a JSON body and returns the status."""
    def post(body: str) -> int:
        request = urllib.request.Request(
            url, data=body.encode(), headers={"Content-Type": "application/json"}
        )
        with urllib.request.urlopen(request, timeout=WEBHOOK_TIMEOUT_S) as response:
            return response.status
    return post


def write_dlq_webhook(
    validated: DataFrame, post: Callable[[str], int], payload: str = "payload",
    workers: int | None = None, source: str = WEBHOOK_SOURCE,
) -> DataFrame:
    """Deliver dead letters from the executors; returns delivered/failed counts lazily.

    ``post`` takes a body and returns a status; raising or a status of 400 and above is a failure.
    ``workers`` bounds the number of concurrent senders.
    """
    bodies = webhook_envelopes(validated, payload, source)
    if workers:
        bodies = bodies.repartition(workers)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            failures = []
            for body in batch["body"]:
                try:
                    status = post(body)
                    failures.append(f"status {status}" if status >= FAILING_STATUS else None)
                except Exception as exc:  # any transport error is a failed delivery
                    failures.append(f"post failed: {exc}")
            yield pd.DataFrame({"failure": pd.Series(failures, dtype="object")})

    return bodies.mapInPandas(send, "failure string").agg(
        F.count_if(F.col("failure").isNull()).alias("delivered"),
        F.count("failure").alias("failed"), F.min("failure").alias("first_failure"),
    )


def write_routed(validated: DataFrame, path: str, mode: str = "append") -> None:
    """Write accepted, rejected and error events in one pass, partitioned by status."""
    validated.write.mode(mode).partitionBy("status").parquet(path)


def result_feed(validated: DataFrame) -> DataFrame:
    """Live messages (name, is_valid, errors); events with an error outcome send none."""
    return validated.filter(F.col("status") != "error").select(
        F.col("event").alias("name"), (F.col("status") == "valid").alias("is_valid"),
        error_strings("errors").alias("errors"),
    )


