"""The worker: raw topic to NDJSON batches, continuously.

Delivery is at least once. Offsets are kept by the checkpoint; every output of a
micro-batch goes to a folder named by the run and the batch id, so a replay after a
failure replaces what the failed attempt left, and nothing that another run delivered.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..config import Settings
from ..functions import agents
from ..operators import enrich, rawcheck, salts
from ..sources import events as sinks
from ..sources.salt_store import SaltStore


def batch_counts(checked: DataFrame) -> DataFrame:
    """M1 of one batch: messages, dead letters, bots and events to deliver."""
    valid = F.col("error").isNull()
    bot = valid & agents.is_bot(F.col("event.meta.`user-agent`"))
    return checked.agg(
        F.count("*").alias("messages"),
        F.count_if(~valid).alias("parse_failures"),
        F.count_if(bot).alias("bots"),
        F.count_if(valid & ~bot).alias("events"),
    )


def process_batch(
    messages: DataFrame,
    batch_id: int,
    out: str,
    store: SaltStore,
    domains: DataFrame,
    day: Column,
    settings: Settings = Settings(),
    lines_per_file: int | None = None,
    run: str = "batch",
) -> None:
    """Validate, enrich and write one batch of messages.

    Writes below ``out``: ``events`` (NDJSON), ``dead`` and ``counts``, each with one
    folder per batch; what is empty is not written. The parsed batch is kept while its outputs are written, so the
    source is read and parsed once.
    """
    checked = rawcheck.validate_raw(messages.select("value")).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        counts = batch_counts(checked).first()
        spark = messages.sparkSession
        spark.createDataFrame([counts]).write.mode("overwrite").json(
            sinks.batch_path(f"{out}/counts", run, batch_id)
        )
        if counts["parse_failures"]:
            sinks.write_dead_letters(
                rawcheck.dead_letters(checked), sinks.batch_path(f"{out}/dead", run, batch_id)
            )
        if not counts["events"]:
            return
        people = rawcheck.valid_events(checked).filter(
            ~agents.is_bot(F.col("meta.`user-agent`"))
        )
        table = store.get_or_create(salts.wanted_keys(people, day))
        processed = enrich.to_processed(people, table, domains, day, settings)
        sinks.write_lines(
            processed, sinks.batch_path(f"{out}/events", run, batch_id), lines_per_file
        )
    finally:
        checked.unpersist()


def _clean(store: SaltStore, seen: dict) -> None:
    """K8 beside the worker, between its batches."""
    if seen["purge"]:
        store.purge()
        seen["purge"] = False
    today = datetime.now(timezone.utc).date()
    if seen["day"] != today:
        seen["day"] = today
        seen["purge"] = store.cleanup(keep_previous=True) > 0


def start_worker(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    store: SaltStore,
    domains: DataFrame,
    settings: Settings = Settings(),
    batch_size: int | None = None,
    flush_ms: int = rules.FLUSH_INTERVAL_MS,
    drain: bool = False,
    salt_day: str = "processing",
    cleanup: bool = False,
) -> StreamingQuery:
    """Start the worker on a stream of messages.

    A batch is flushed every ``flush_ms``; ``batch_size`` caps the events per written
    file (a sink that takes requests of so many may want it), and None leaves files as
    large as the batch makes them. ``drain`` works off what is there and stops. Salts are
    keyed by the ``processing`` day, pinned once per batch, or by the ``event`` day. With
    ``cleanup`` the first batch of a UTC day removes outdated salts; their files go with
    the batch after it, when nothing can read them any more.
    """
    if salt_day not in ("processing", "event"):
        raise ValueError("salt_day must be 'processing' or 'event'")

    seen: dict = {"run": None, "day": None, "purge": False}

    def handle(batch: DataFrame, batch_id: int) -> None:
        if seen["run"] is None:
            seen["run"] = sinks.run_of(batch.sparkSession, checkpoint)
        if cleanup:
            _clean(store, seen)
        if salt_day == "event":
            day = enrich.event_day(F.col("timestamp"))
        else:
            day = F.lit(datetime.now(timezone.utc).date())
        process_batch(
            batch, batch_id, out, store, domains, day, settings, batch_size, seen["run"]
        )

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{flush_ms} milliseconds")
    return writer.start()
