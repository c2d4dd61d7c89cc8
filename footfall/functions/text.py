"""Field predicates (V9) and ECMAScript-compatible text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def is_guid(text: Column) -> Column:
    """UUID shape; any version and variant nibble."""
    return text.rlike(rules.GUID)


def is_iso_millis(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` on a real calendar day."""
    return text.rlike(rules.ISO_MILLIS)


def is_nonempty(text: Column) -> Column:
    return F.length(text) > 0


def is_nonblank(text: Column) -> Column:
    """At least one non-blank character and no line break anywhere."""
    return text.rlike(f"[^{rules.WHITE}]") & ~text.rlike(f"[{rules.LINE_END}]")


def is_guid_or_undefined(text: Column) -> Column:
    return (text == rules.UNDEFINED) | is_guid(text)


def has_ink(text: Column) -> Column:
    """Something is left after trimming white space from both ends."""
    return text.rlike(f"[^{rules.WHITE}]")


def none_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def leading_integer(text: Column) -> Column:
    """The decimal integer a text starts with, as DECIMAL(38,0); NULL if there is none."""
    digits = F.regexp_extract(text, rf"\A[{rules.WHITE}]*([+-]?\d+)", 1)
    return digits.try_cast("decimal(38,0)")


def uuid_from(seed: Column) -> Column:
    """A UUID-shaped text that depends on ``seed`` alone."""
    digest = F.sha2(seed, 256)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-4"),
        F.substring(digest, 14, 3), F.lit("-8"),
        F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def new_event_id(seed: Column | None = None) -> Column:
    """A random UUID, or a repeatable one where the caller has a unique seed."""
    return F.uuid() if seed is None else uuid_from(seed)


def resolve_event_id(kind: Column, text: Column, seed: Column | None = None) -> Column:
    """Keep any non-empty JSON string, replace everything else by a new UUID."""
    usable = (kind == "STRING") & (F.length(text) > 0)
    return F.when(usable, text).otherwise(new_event_id(seed))
