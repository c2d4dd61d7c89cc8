"""Daily salts per site (K1-K9) as functions on a salt table.

Persistence is :class:`footfall.sources.salt_store.SaltStore`; everything here
takes and returns DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import saltkeys, signing
from . import lookup

COLUMNS = ["key", "salt_date", "site_uuid", "salt", "created_at", "expires_at"]


class SaltExists(ValueError):
    """A create-only insert met a key that is already there."""


def salt_rows(keys: DataFrame, salt: Column, created_at: Column) -> DataFrame:
    """Complete salt records from a ``key`` column and the given values."""
    key = F.col("key")
    df = keys.withColumns({"salt": salt, "created_at": created_at})
    return df.select(
        key,
        saltkeys.key_date(key).alias("salt_date"),
        saltkeys.key_site(key).alias("site_uuid"),
        "salt",
        "created_at",
        saltkeys.expires_at(key, F.col("created_at")).alias("expires_at"),
    )


def one_per_key(salts: DataFrame, first: list[str] | None = None) -> DataFrame:
    """The salt that counts where several are stored for a key: the least by the columns
    ``first``, then the earliest one, then the least."""
    rest = [name for name in COLUMNS if name not in ("salt_date", "key")]
    order = [*(first or []), "created_at", "salt", *[name for name in rest if name not in ("created_at", "salt")]]
    least = salts.groupBy("salt_date", "key").agg(F.min(F.struct(*order)).alias("_least"))
    return least.select(
        *[F.col(name) if name in ("salt_date", "key") else F.col(f"_least.{name}").alias(name) for name in COLUMNS]
    )


def wanted_keys(events: DataFrame, day: Column) -> DataFrame:
    """Distinct salt keys of raw events. Grouping is done before the shuffle, so a
    site with very many hits costs one row per task."""
    return (
        events.select(saltkeys.salt_key(day, F.col("site_uuid")).alias("key"))
        .filter(F.col("key").isNotNull())
        .distinct()
    )


def missing_salts(wanted: DataFrame, salts: DataFrame) -> DataFrame:
    """Wanted keys without a salt."""
    return wanted.join(salts.select("key"), "key", "left_anti")


def create_salts(missing: DataFrame, secret: DataFrame, created_at: Column) -> DataFrame:
    """K2: new records for missing keys.

    ``secret`` is one row with random bytes of this run in ``secret``; a retried
    task derives the same salts from it, and it appears in no plan.
    """
    salt = signing.salt_from(secret.select("secret").scalar(), F.col("key"))
    return salt_rows(missing, salt, created_at)


def get_salts(keys: DataFrame, salts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """K3: salt and creation time per requested key, NULL where there is none."""
    table = salts.select("key", "salt", "created_at")
    return lookup.attach(keys, table, ["key"], F.col("key"), settings=settings)


def all_salts(salts: DataFrame) -> DataFrame:
    """K4: the whole table; the expiry is not shown."""
    return salts.select("key", "salt", "created_at")


def conflicting_keys(new: DataFrame, salts: DataFrame) -> DataFrame:
    """Keys that K5 must refuse: already stored, or more than once in the input."""
    stored = new.join(salts.select("key"), "key", "left_semi").select("key")
    repeated = new.groupBy("key").count().filter(F.col("count") > 1).select("key")
    return stored.union(repeated).distinct()


def checked_insert(new: DataFrame, salts: DataFrame) -> DataFrame:
    """K5: the new records, or :class:`SaltExists` if a key is taken."""
    taken = conflicting_keys(new, salts).limit(1).collect()
    if taken:
        raise SaltExists(f"salt already exists: {taken[0]['key']}")
    return new


def without_keys(salts: DataFrame, keys: DataFrame) -> DataFrame:
    """K6: the table without the given keys; absent keys change nothing."""
    return salts.join(keys.select("key"), "key", "left_anti").select(*salts.columns)


def outdated(created_at: Column, now: Column) -> Column:
    """K8: created before midnight UTC of the day of ``now``; midnight itself stays."""
    return created_at < F.date_trunc("day", now)


def surviving(salts: DataFrame, now: Column) -> DataFrame:
    return salts.filter(~outdated(F.col("created_at"), now))


def count_outdated(salts: DataFrame, now: Column) -> DataFrame:
    return salts.filter(outdated(F.col("created_at"), now)).agg(
        F.count("*").alias("deleted_count")
    )
