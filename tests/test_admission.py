"""Request verdicts (V1-V7, V10) and raw events (P1-P5), case by case in one job."""

import json

import pytest
from pyspark.sql import types as T

from footfall.config import Settings
from footfall.operators import admission, hits
from footfall.schemas import REQUESTS
from samples import AGENT, BODY, GONE, HEADERS, SITE, URL, changed, frame, request

def payload(name, value):
    return request(changed(BODY, f"payload.{name}", value))


def headers(**changes):
    result = dict(HEADERS)
    for name, value in changes.items():
        name = name.replace("_", "-")
        if value is GONE:
            result.pop(name)
        else:
            result[name] = value
    return request(headers=result)


BOT = "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)"
FORMAT = 'must match format "date-time"'
ALLOWED = "must be equal to one of the allowed values"

# name: (request, outcome or context, message)
CASES = {
    "valid": (request(), "accepted", None),
    "odd_href": (payload("href", "not a url #[]+%"), "accepted", None),
    "empty_href": (payload("href", ""), "accepted", None),
    "unknown_member": (payload("extra", {"a": [1]}), "accepted", None),
    "null_location": (payload("location", None), "accepted", None),
    "blank_location": (payload("location", "  "), "body", 'body/payload/location must match pattern "^.*\\S.*$"'),
    "absent_location": (payload("location", GONE), "body", "body/payload must have required property 'location'"),
    "numeric_version": (request(changed(BODY, "version", 1)), "accepted", None),
    "wrong_version": (request(changed(BODY, "version", "2")), "body", "body/version must be equal to constant"),
    "wrapped_locale": (payload("locale", ["de"]), "accepted", None),
    "two_locales": (payload("locale", ["de", "en"]), "body", "body/payload/locale must be string"),
    "line_in_locale": (payload("locale", "en\nUS"), "body", 'body/payload/locale must match pattern "^.*\\S.*$"'),
    "empty_locale": (payload("locale", ""), "body", "body/payload/locale must NOT have fewer than 1 characters"),
    "numeric_utm": (payload("utm_source", 2.50), "accepted", None),
    "exponent_utm": (request(json.dumps(BODY).replace('"locale"', '"utm_source": 1e3, "locale"')), "accepted", None),
    "object_utm": (payload("utm_source", {}), "body", "body/payload/utm_source must be string"),
    "no_millis": (request(changed(BODY, "timestamp", "2025-04-14T22:16:06Z")), "body", f"body/timestamp {FORMAT}"),
    "offset": (request(changed(BODY, "timestamp", "2025-04-14T22:16:06.095+02:00")), "body", f"body/timestamp {FORMAT}"),
    "micros": (request(changed(BODY, "timestamp", "2025-04-14T22:16:06.095123Z")), "body", f"body/timestamp {FORMAT}"),
    "no_such_day": (request(changed(BODY, "timestamp", "2025-02-30T22:16:06.095Z")), "body", f"body/timestamp {FORMAT}"),
    "leap_day": (request(changed(BODY, "timestamp", "2024-02-29T22:16:06.095Z")), "accepted", None),
    "no_leap_day": (request(changed(BODY, "timestamp", "1900-02-29T22:16:06.095Z")), "body", f"body/timestamp {FORMAT}"),
    "click": (request(changed(BODY, "action", "click")), "body", "body/action must be equal to constant"),
    "any_guid": (payload("site_uuid", "ffffffff-ffff-ffff-ffff-ffffffffffff"), "accepted", None),
    "bad_member": (payload("member_uuid", "x"), "body", 'body/payload/member_uuid must match format "uuid"'),
    "article": (payload("post_type", "article"), "body", f"body/payload/post_type {ALLOWED}"),
    "json_null_type": (payload("post_type", None), "body", f"body/payload/post_type {ALLOWED}"),
    "referrer_nulls": (payload("parsedReferrer", {"source": None, "medium": None, "url": None}), "accepted", None),
    "referrer_partial": (payload("parsedReferrer", {"url": "x"}), "body", "body/payload/parsedReferrer must have required property 'source'"),
    "referrer_null": (payload("parsedReferrer", None), "body", "body/payload/parsedReferrer must be object"),
    "no_payload": (request(changed(BODY, "payload", GONE)), "body", "body must have required property 'payload'"),
    "text_payload": (request(changed(BODY, "payload", "x")), "body", "body/payload must be object"),
    "empty_object": (request("{}"), "body", "body must have required property 'timestamp'"),
    "array_body": (request("[1]"), "body", "body must be object"),
    "truncated": (request(json.dumps(BODY)[:-1]), "json", "Body is not valid JSON"),
    "trailing": (request(json.dumps(BODY) + " x"), "json", "Body is not valid JSON"),
    "two_documents": (request(json.dumps(BODY) + ",1"), "json", "Body is not valid JSON"),
    "closing_bracket": (request(json.dumps(BODY) + "],["), "json", "Body is not valid JSON"),
    "no_body": (request(""), "json", "Body is not valid JSON"),
    "large": (payload("oversized_data", "x" * 21 * 1024), "size", "Request body is too large"),
    "large_and_broken": (request("x" * 20481), "size", "Request body is too large"),
    "largest_broken": (request("x" * 20480), "json", "Body is not valid JSON"),
    "no_name": (request(url="/api/v1/page_hit?token=abc123"), "querystring", "querystring must have required property 'name'"),
    "bad_name": (request(url="/api/v1/page_hit?name=nope"), "querystring", f"querystring/name {ALLOWED}"),
    "test_name": (request(url="/api/v1/page_hit?name=analytics_events_test"), "accepted", None),
    "encoded_name": (request(url="/api/v1/page_hit?n%61me=analytics%5Fevents"), "accepted", None),
    "blank_token": (request(url=URL.replace("abc123", "+")), "querystring", 'querystring/token must match pattern "^.*\\S.*$"'),
    "repeated_extra": (request(url=URL + "&a=1&a=2"), "querystring", "querystring/a must be string"),
    "body_before_query": (request(changed(BODY, "action", "x"), url="/api/v1/page_hit"), "body", "body/action must be equal to constant"),
    "no_site": (headers(x_site_uuid=GONE), "headers", "headers must have required property 'x-site-uuid'"),
    "bad_site": (headers(x_site_uuid="not-a-uuid"), "headers", 'headers/x-site-uuid must match format "uuid"'),
    "charset": (headers(content_type="application/json; charset=utf-8"), "headers", "headers/content-type must be equal to constant"),
    "no_agent": (headers(user_agent=GONE), "headers", "headers must have required property 'user-agent'"),
    "blank_agent": (headers(user_agent=" "), "headers", "headers/user-agent must NOT have fewer than 1 characters"),
    "bot": (headers(user_agent=BOT), "bot", None),
    "bad_bot": (request(changed(BODY, "action", "x"), headers={**HEADERS, "user-agent": BOT}), "body", "body/action must be equal to constant"),
    "event_number": (payload("event_id", 123), "accepted", None),
    "event_object": (payload("event_id", {}), "accepted", None),
    "event_empty": (payload("event_id", ""), "accepted", None),
    "event_odd": (payload("event_id", "not-a-uuid"), "accepted", None),
    "event_blank": (payload("event_id", " "), "accepted", None),
    "proxied": (headers(x_forwarded_for="203.0.113.42, 192.168.1.1"), "accepted", None),
    "started": (headers(x_analytics_start="1704067200000"), "accepted", None),
    "started_wrong": (headers(x_analytics_start="invalid-timestamp"), "accepted", None),
    "started_late": (headers(x_analytics_start="9999999999999999"), "accepted", None),
    "started_far": (headers(x_analytics_start="253402300800000"), "accepted", None),
}


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(name, *row) for name, (row, _, _) in CASES.items()]
    schema = T.StructType([T.StructField("case", T.StringType()), *REQUESTS.fields])
    return admission.classify_requests(spark.createDataFrame(rows, schema)).persist()


@pytest.fixture(scope="module")
def verdicts(classified):
    return {row["case"]: row for row in classified.collect()}


@pytest.mark.parametrize("name", CASES)
def test_verdict(verdicts, name):
    _, expected, message = CASES[name]
    row = verdicts[name]
    found = row["context"] if row["outcome"] == "rejected" else row["outcome"]
    assert (found, row["message"]) == (expected, message)
    status = {"size": 413, "accepted": 202, "bot": 202}.get(expected, 400)
    assert row["status"] == status


def test_every_request_has_one_verdict(verdicts):
    assert len(verdicts) == len(CASES)


@pytest.fixture(scope="module")
def raw(classified):
    df = hits.to_raw(classified, keep=["case"])
    return {row["case"]: row for row in df.collect()}


def test_only_accepted_requests_become_events(raw):
    assert set(raw) == {name for name, case in CASES.items() if case[1] == "accepted"}


def test_server_decides_time_site_and_agent(raw):
    event = raw["valid"]
    assert event["timestamp"] == "2025-04-14T22:16:07.123Z"
    assert event["site_uuid"] == SITE
    assert event["meta"].asDict() == {"ip": "10.0.0.9", "user-agent": AGENT}
    assert raw["proxied"]["meta"]["ip"] == "203.0.113.42"


def test_defaults_and_coercion(raw):
    valid = raw["valid"]["payload"]
    assert valid["referrer"] == "" and valid["gift_link"] is None and valid["utm_source"] is None
    assert valid["parsedReferrer"].asDict() == {"source": None, "medium": None, "url": None}
    nulls = raw["referrer_nulls"]["payload"]["parsedReferrer"]
    assert nulls.asDict() == {"source": "", "medium": "", "url": ""}
    assert raw["null_location"]["payload"]["location"] is None
    assert raw["wrapped_locale"]["payload"]["locale"] == "de"
    assert raw["numeric_utm"]["payload"]["utm_source"] == "2.5"
    assert raw["exponent_utm"]["payload"]["utm_source"] == "1000"
    assert raw["numeric_version"]["version"] == "1"


def test_event_ids(raw):
    ids = {name: raw[name]["payload"]["event_id"] for name in raw}
    assert ids["event_odd"] == "not-a-uuid" and ids["event_blank"] == " "
    for name in ("valid", "event_number", "event_object", "event_empty"):
        assert len(ids[name]) == 36 and ids[name].count("-") == 4


def test_received_timestamp(raw):
    stamps = {name: raw[name]["payload"]["meta"]["received_timestamp"] for name in raw}
    assert stamps["started"] == "2024-01-01T00:00:00.000Z"
    assert stamps["started_far"] == "+010000-01-01T00:00:00.000Z"
    assert stamps["started_wrong"] is None and stamps["started_late"] is None
    assert stamps["valid"] is None


def test_untrusted_proxy_uses_peer_address(spark):
    df = frame(spark, [CASES["proxied"][0]])
    assert df.select(admission.client_ip(Settings(trust_proxy=False))).first()[0] == "10.0.0.9"
