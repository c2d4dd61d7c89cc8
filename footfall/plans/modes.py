"""The two ways a hit gets from request to sink row, and traffic figures on top.

Admission and enrichment are one job: nothing is written in between. An event id that
has to be made derives from the request, so a task that runs again makes the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import admission, enrich, hits, rawcheck
from ..sources import topic


def request_seed() -> Column:
    """What tells requests apart; requests that agree in all of it share a made event id."""
    headers = F.to_json(F.array_sort(F.map_entries("http_headers")))
    parts = ["method", "url", "remote_ip", F.col("received_at").cast("string"), "body", headers]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def admit(
    requests: DataFrame, settings: Settings = Settings(), event_id_seed: Column | None = None
) -> DataFrame:
    """Raw events of the accepted requests, as a table or as a stream."""
    if event_id_seed is None:
        event_id_seed = request_seed()
    return hits.to_raw(admission.classify_requests(requests, settings), settings, event_id_seed)


def process_inline(
    requests: DataFrame,
    salts: DataFrame,
    domains: DataFrame,
    settings: Settings = Settings(),
    event_id_seed: Column | None = None,
) -> DataFrame:
    """T4: requests to processed events without topic and second validation.

    Requests may be a stream as long as both lookup tables are within the broadcast
    bounds; beyond them the keys of a whole table have to be counted first.
    """
    raw = admit(requests, settings, event_id_seed)
    return enrich.to_processed(raw, salts, domains, settings=settings)


def process_in_two_steps(
    requests: DataFrame,
    salts: DataFrame,
    domains: DataFrame,
    topic_path: str,
    settings: Settings = Settings(),
    event_id_seed: Column | None = None,
) -> DataFrame:
    """The queued way: publish JSON messages, then validate and enrich them."""
    topic.publish_raw(admit(requests, settings, event_id_seed), topic_path)
    messages = topic.read_raw(requests.sparkSession, topic_path)
    events = rawcheck.valid_events(rawcheck.validate_raw(messages))
    return enrich.enrich(events, salts, domains, settings=settings)


def traffic(processed: DataFrame) -> DataFrame:
    """Hits and distinct visitors per site and device."""
    return processed.groupBy("site_uuid", F.col("payload.device").alias("device")).agg(
        F.count("*").alias("hits"), F.countDistinct("session_id").alias("sessions")
    )
