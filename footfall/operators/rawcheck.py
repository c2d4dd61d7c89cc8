"""Strict check of queue messages (V8): no coercion, null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import rules, schemas
from ..functions.once import once
from . import documents
from .documents import Check, Member, Members
from .metrics import counted

ROOT_MEMBERS = ["timestamp", "action", "version", "site_uuid", "payload", "meta"]
PAYLOAD_MEMBERS = [
    "event_id", "member_uuid", "member_status", "post_uuid", "post_type", "gift_link", "locale",
    "location", "referrer", "parsedReferrer", "pathname", "href", *schemas.UTM, "meta",
]
REFERRER_MEMBERS = ["source", "medium", "url"]


CLIENT_MEMBERS = ["ip", "user-agent"]
STAMP_MEMBERS = ["received_timestamp"]

_ALL = [
    *[("", n) for n in ROOT_MEMBERS],
    *[("/payload", n) for n in PAYLOAD_MEMBERS],
    *[("/payload/parsedReferrer", n) for n in REFERRER_MEMBERS],
    *[("/payload/meta", n) for n in STAMP_MEMBERS],
    *[("/meta", n) for n in CLIENT_MEMBERS],
]


def _members(path: str) -> Members:
    places = {name: place for place, (where, name) in enumerate(_ALL) if where == path}
    return Members("_members", places, path, False)


ROOT = _members("")
PAYLOAD = _members("/payload")
REFERRER = _members("/payload/parsedReferrer")
STAMP = _members("/payload/meta")
CLIENT = _members("/meta")


def _open(df: DataFrame) -> DataFrame:
    df = documents.parse_document(df, "value", "_doc")
    doc = F.col("_doc")
    objects = {
        "_root": documents.open_object(doc, "$", ROOT_MEMBERS),
        "_payload": documents.open_object(doc, "$.payload", PAYLOAD_MEMBERS),
        "_parts": documents.open_object(doc, "$.payload.parsedReferrer", REFERRER_MEMBERS),
        "_stamp": documents.open_object(doc, "$.payload.meta", STAMP_MEMBERS),
        "_client": documents.open_object(doc, "$.meta", CLIENT_MEMBERS),
    }
    return df.withColumns(objects).select(
        *[c for c in df.columns if c != "_doc"],
        F.when(doc.isNotNull(), F.when(F.col("_root").isNotNull(), "OBJECT<").otherwise("OTHER")).alias("_type"),
        _described().alias("_members"),
    )


@once
def _described() -> Column:
    source = {
        "": "_root", "/payload": "_payload", "/payload/parsedReferrer": "_parts",
        "/payload/meta": "_stamp", "/meta": "_client",
    }
    opened = {
        ("", "payload"): "_payload", ("", "meta"): "_client",
        ("/payload", "parsedReferrer"): "_parts", ("/payload", "meta"): "_stamp",
    }
    members = [
        Member(
            F.col(f"{source[place[0]]}.`{place[1]}`"),
            F.col(opened[place]) if place in opened else None,
        )
        for place in _ALL
    ]
    return documents.describe_strict(members)


@once
def _checks() -> list[Check]:
    def nullable_optional(name: str) -> list[Check]:
        return PAYLOAD.optional(name, PAYLOAD.nullable(name, PAYLOAD.string(name)))

    parsed_kind = PAYLOAD.kind("parsedReferrer")
    referrer = [
        *REFERRER.object(parsed_kind),
        *REFERRER.required(*REFERRER_MEMBERS),
        *[c for n in REFERRER_MEMBERS for c in REFERRER.nullable(n, REFERRER.string(n))],
    ]
    return [
        *ROOT.object(F.col("_type")),
        *ROOT.required(*ROOT_MEMBERS),
        *ROOT.iso_millis("timestamp"),
        *ROOT.constant("action", rules.ACTION),
        *ROOT.constant("version", rules.VERSION),
        *ROOT.guid("site_uuid"),
        *PAYLOAD.object(ROOT.kind("payload")),
        *PAYLOAD.required(
            "member_uuid", "member_status", "post_uuid", "post_type", "locale", "location",
            "pathname", "href", "meta",
        ),
        *PAYLOAD.optional("event_id", PAYLOAD.string("event_id")),
        *PAYLOAD.guid_or_undefined("member_uuid"),
        *PAYLOAD.nonempty("member_status"),
        *PAYLOAD.guid_or_undefined("post_uuid"),
        *PAYLOAD.one_of("post_type", rules.POST_TYPES),
        *nullable_optional("gift_link"),
        *PAYLOAD.nonempty("locale"),
        *PAYLOAD.nullable("location", PAYLOAD.nonempty("location")),
        *nullable_optional("referrer"),
        *documents.when(parsed_kind.isNotNull(), referrer),
        *PAYLOAD.nonempty("pathname"),
        *PAYLOAD.string("href"),
        *[c for name in schemas.UTM for c in nullable_optional(name)],
        *STAMP.object(PAYLOAD.kind("meta")),
        *STAMP.required("received_timestamp"),
        *STAMP.nullable("received_timestamp", STAMP.iso_millis("received_timestamp")),
        *CLIENT.object(ROOT.kind("meta")),
        *CLIENT.required("ip", "user-agent"),
        *CLIENT.nonempty("ip"),
        *CLIENT.nonempty("user-agent"),
    ]


@once
def _event() -> Column:
    parsed = F.struct(*[REFERRER.text(name).alias(name) for name in REFERRER_MEMBERS])
    return F.struct(
        *[ROOT.text(name).alias(name) for name in ("timestamp", "action", "version", "site_uuid")],
        F.struct(
            *[
                PAYLOAD.text(name).alias(name)
                for name in (
                    "event_id", "member_uuid", "member_status", "post_uuid", "post_type",
                    "gift_link", "locale", "location", "referrer",
                )
            ],
            F.when(PAYLOAD.kind("parsedReferrer").isNotNull(), parsed).alias("parsedReferrer"),
            *[PAYLOAD.text(name).alias(name) for name in ("pathname", "href", *schemas.UTM)],
            F.struct(STAMP.text("received_timestamp").alias("received_timestamp")).alias("meta"),
        ).alias("payload"),
        F.struct(*[CLIENT.text(name).alias(name) for name in CLIENT_MEMBERS]).alias("meta"),
    )


@once
def _error() -> Column:
    said = documents.message_at(_checks(), F.col("_bad"), "data", "_members")
    return F.when(F.col("_type").isNull(), "invalid JSON").otherwise(said)


@once
def _first_broken() -> Column:
    return documents.first_broken(_checks())


def validate_raw(messages: DataFrame, observation: Observation | None = None) -> DataFrame:
    """V8: add ``error`` (NULL if valid) and the typed ``event`` to rows with a ``value``.

    ``observation`` receives the number of valid messages and of parse failures.
    """
    kept = messages.columns
    df = _open(messages).withColumn("_bad", _first_broken())
    df = df.withColumn("error", _error())
    checked = df.select(*kept, "error", F.when(F.col("error").isNull(), _event()).alias("event"))
    failed = F.col("error").isNotNull()
    return counted(checked, {"valid": ~failed, "parse_failures": failed}, observation)


def valid_events(validated: DataFrame) -> DataFrame:
    """Raw events of the valid messages, as columns."""
    return validated.filter(F.col("error").isNull()).select("event.*")


def dead_letters(validated: DataFrame) -> DataFrame:
    """Messages that can never be processed, with the reason."""
    return validated.filter(F.col("error").isNotNull()).select("value", "error")
