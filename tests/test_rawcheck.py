"""Strict validation of queue messages (V8) and dead letters."""

import json

import pytest

from footfall.operators import rawcheck
from samples import GONE, RAW, changed


def message(path, value):
    return json.dumps(changed(RAW, path, value))


CASES = {
    "valid": (json.dumps(RAW), None),
    "no_event_id": (message("payload.event_id", GONE), None),
    "odd_event_id": (message("payload.event_id", ""), None),
    "number_event_id": (message("payload.event_id", 1), "data/payload/event_id must be string"),
    "null_event_id": (message("payload.event_id", None), "data/payload/event_id must be string"),
    "blank_locale": (message("payload.locale", " "), None),
    "empty_locale": (message("payload.locale", ""), "data/payload/locale must NOT have fewer than 1 characters"),
    "null_location": (message("payload.location", None), None),
    "empty_location": (message("payload.location", ""), "data/payload/location must NOT have fewer than 1 characters"),
    "number_version": (message("version", 1), "data/version must be string"),
    "number_utm": (message("payload.utm_source", 123), "data/payload/utm_source must be string"),
    "array_utm": (message("payload.utm_source", ["x"]), "data/payload/utm_source must be string"),
    "no_referrer": (message("payload.parsedReferrer", GONE), None),
    "null_referrer": (message("payload.parsedReferrer", None), "data/payload/parsedReferrer must be object"),
    "partial_referrer": (message("payload.parsedReferrer", {"source": "x"}), "data/payload/parsedReferrer must have required property 'medium'"),
    "no_meta": (message("meta", GONE), "data must have required property 'meta'"),
    "empty_agent": (message("meta.user-agent", ""), "data/meta/user-agent must NOT have fewer than 1 characters"),
    "received": (message("payload.meta.received_timestamp", "2024-01-01T00:00:00.000Z"), None),
    "received_far": (message("payload.meta.received_timestamp", "+010000-01-01T00:00:00.000Z"), 'data/payload/meta/received_timestamp must match format "date-time"'),
    "no_received": (message("payload.meta", {}), "data/payload/meta must have required property 'received_timestamp'"),
    "bad_site": (message("site_uuid", "invalid-uuid"), 'data/site_uuid must match format "uuid"'),
    "extra": (message("extra", {"a": 1}), None),
    "not_json": ("invalid json", "invalid JSON"),
    "empty": ("", "invalid JSON"),
    "trailing": (json.dumps(RAW) + "{}", "invalid JSON"),
    "text": ('"text"', "data must be object"),
    "repeated": (json.dumps(RAW).replace('"version": "1"', '"version": "2", "version": "1"'), None),
}


@pytest.fixture(scope="module")
def checked(spark):
    df = spark.createDataFrame([(n, v) for n, (v, _) in CASES.items()], "case string, value string")
    return rawcheck.validate_raw(df).persist()


def test_errors(checked):
    found = {row["case"]: row["error"] for row in checked.collect()}
    assert found == {name: error for name, (_, error) in CASES.items()}


def test_nulls_stay_null(checked):
    event = checked.filter("case = 'valid'").first()["event"]
    assert event["payload"]["referrer"] is None and event["payload"]["utm_medium"] is None
    assert event["payload"]["parsedReferrer"].asDict() == {"source": None, "medium": None, "url": None}
    assert checked.filter("case = 'no_referrer'").first()["event"]["payload"]["parsedReferrer"] is None


def test_valid_and_dead_cover_all_messages(checked):
    dead = sum(error is not None for _, error in CASES.values())
    assert rawcheck.dead_letters(checked).count() == dead
    assert rawcheck.valid_events(checked).count() == len(CASES) - dead
