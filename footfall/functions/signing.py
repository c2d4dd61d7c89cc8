"""Keyed hashes: URL signatures (V3a), visitor signatures (P9) and salts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha1(secret).digest() if len(secret) > _BLOCK else secret
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_key(spark: SparkSession, secret: str) -> DataFrame:
    """One row holding the two padded keys of an HMAC-SHA1 secret.

    The key stays data: used through a scalar subquery it shows up neither in
    query plans nor in event logs, as a literal would.
    """
    inner, outer = _pads(secret.encode("utf-8"))
    return spark.createDataFrame(
        [(bytearray(inner), bytearray(outer))], "inner_pad binary, outer_pad binary"
    )


def hmac_sha1(text: Column, key: DataFrame) -> Column:
    """Raw HMAC-SHA1 digest of the UTF-8 text, as binary."""
    inner = key.select("inner_pad").scalar()
    outer = key.select("outer_pad").scalar()
    first = F.unhex(F.sha1(F.concat(inner, F.encode(text, "UTF-8"))))
    return F.unhex(F.sha1(F.concat(outer, first)))


def base64_url(digest: Column) -> Column:
    return F.translate(F.base64(digest), "+/", "-_")


def signature_matches(given: Column, digest: Column) -> Column:
    """Whether a base64 or base64url text of the right length decodes to ``digest``."""
    decoded = F.try_to_binary(F.translate(given, "-_", "+/"), F.lit("base64"))
    return (F.length(given) == 28) & F.coalesce(decoded == digest, F.lit(False))


def session_signature(salt: Column, site: Column, ip: Column, agent: Column) -> Column:
    """sha256 of ``salt:site:ip:agent``, NULL without a salt."""
    text = F.concat(salt, F.lit(":"), site, F.lit(":"), ip, F.lit(":"), agent)
    return F.sha2(text, 256)


def salt_from(secret: Column, key: Column) -> Column:
    """A salt of 64 hex digits that only the holder of ``secret`` can repeat."""
    return F.sha2(F.concat(secret, F.lit(":"), key), 256)
