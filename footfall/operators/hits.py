"""Accepted requests to raw events: projection P3 with P2, P4 and P5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..functions.clock import epoch_millis, iso_millis, server_timestamp
from ..functions.text import resolve_event_id
from .admission import header


def raw_columns(sent_at: Column, event_id_seed: Column | None = None) -> list[Column]:
    """The members of the raw event of an accepted request."""
    hit = F.col("hit")
    event_id = resolve_event_id(hit["event_id_type"], hit["event_id"], event_id_seed)
    payload = F.struct(
        event_id.alias("event_id"),
        *[
            hit[name].alias(name)
            for name in (
                "member_uuid", "member_status", "post_uuid", "post_type", "gift_link",
                "locale", "location", "referrer",
            )
        ],
        hit["parsedReferrer"].alias("parsedReferrer"),
        *[hit[name].alias(name) for name in ("pathname", "href", *schemas.UTM)],
        F.struct(iso_millis(sent_at).alias("received_timestamp")).alias("meta"),
    )
    return [
        server_timestamp(F.col("received_at")).alias("timestamp"),
        hit["action"].alias("action"),
        hit["version"].alias("version"),
        header("x-site-uuid").alias("site_uuid"),
        payload.alias("payload"),
        F.struct(
            F.col("client_ip").alias("ip"), header("user-agent").alias("user-agent")
        ).alias("meta"),
    ]


def sent_at(settings: Settings) -> Column:
    """The client's send time, from its header."""
    return F.timestamp_millis(epoch_millis(header(settings.start_header)))


def to_raw(
    classified: DataFrame,
    settings: Settings = Settings(),
    event_id_seed: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One raw event per accepted request; unknown members do not survive.

    Time is the server's, site and user agent come from the headers. Event ids that
    have to be made are random unless ``event_id_seed`` gives a unique value per
    row; write the result before using it twice. ``keep`` names request columns that
    are carried along.
    """
    accepted = classified.filter(F.col("outcome") == "accepted")
    accepted = accepted.withColumn("_sent_at", sent_at(settings))
    return accepted.select(*raw_columns(F.col("_sent_at"), event_id_seed), *(keep or []))
