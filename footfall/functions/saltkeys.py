"""Salt keys (K1) and the day a stored salt runs out (K9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import none_if_empty


def salt_key(day: Column, site: Column) -> Column:
    """K1: ``salt:{UTC date}:{site}``."""
    return F.concat(
        F.lit(f"{rules.SALT_PREFIX}:"), F.date_format(day, "yyyy-MM-dd"), F.lit(":"), site
    )


def key_date(key: Column) -> Column:
    """Date inside a salt key, NULL if the key has another shape."""
    parts = F.split(key, ":")
    dated = (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == rules.SALT_PREFIX)
    return F.when(dated, F.get(parts, F.lit(1)).try_cast("date"))


def key_site(key: Column) -> Column:
    """Site inside a well-formed salt key: everything behind the date."""
    return none_if_empty(F.regexp_extract(key, rf"\A{rules.SALT_PREFIX}:[^:]*:(.*)\z", 1))


def expires_at(key: Column, created_at: Column) -> Column:
    """K9: two days after the key's date, or after creation if the key has no date."""
    ttl = F.expr(f"INTERVAL '{rules.SALT_TTL_DAYS}' DAY")
    return F.coalesce(key_date(key).cast("timestamp"), created_at) + ttl
