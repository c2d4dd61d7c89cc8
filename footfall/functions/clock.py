"""Event times (P4, P5), epoch arithmetic and the signed-URL window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import leading_integer


def iso_millis(moment: Column) -> Column:
    """UTC text with milliseconds; years outside 0-9999 get a sign and six digits."""
    year = F.year(moment)
    rest = F.date_format(moment, "-MM-dd'T'HH:mm:ss.SSS'Z'")
    signed = F.concat(
        F.when(year < 0, "-").otherwise("+"), F.lpad(F.abs(year).cast("string"), 6, "0"), rest
    )
    plain = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(year.between(1, 9999), plain).when(
        year == 0, F.concat(F.lit("0000"), rest)
    ).otherwise(signed)


def _valid_epoch(number: Column) -> Column:
    limit = F.lit(rules.MAX_EPOCH_MS)
    return F.when(number.between(-limit, limit), number.cast("bigint"))


def epoch_millis(text: Column) -> Column:
    """Leading integer of ``text`` as epoch milliseconds, NULL outside the date range."""
    return _valid_epoch(leading_integer(text))


def epoch_seconds_to_millis(text: Column) -> Column:
    """The same for a text that counts seconds."""
    seconds = leading_integer(text)
    limit = F.lit(rules.MAX_EPOCH_MS // 1000)
    return F.when(seconds.between(-limit, limit), seconds.cast("bigint") * F.lit(1000))


def received_timestamp(text: Column) -> Column:
    """Epoch-ms header to ISO text; missing or unusable gives NULL."""
    return iso_millis(F.timestamp_millis(epoch_millis(text)))


def server_timestamp(received_at: Column) -> Column:
    """P5: the event time is the arrival time, whatever the client claimed."""
    return F.date_format(received_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def timestamp_error(signed_ms: Column, received_at: Column) -> Column:
    """NULL if the signing time is acceptable on arrival, else what is wrong."""
    now = F.unix_millis(received_at)
    inside = signed_ms.between(
        now - F.lit(rules.SIGNED_URL_PAST_MS), now + F.lit(rules.SIGNED_URL_AHEAD_MS)
    )
    return F.when(signed_ms.isNull(), "Invalid timestamp").when(
        ~inside, "Timestamp is not within the allowed range"
    )
