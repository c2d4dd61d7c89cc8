"""What rejected requests report: lists of failures, sent queries, codes."""

import json

import pytest
from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.functions import urls
from footfall.operators import admission, reports
from samples import BODY, GONE, HEADERS, URL, changed, frame, request


def rejects(spark, *requests, settings=Settings()):
    classified = admission.classify_requests(frame(spark, list(requests)), settings)
    return reports.reject_records(classified).collect()


def failures(row):
    return [
        (v["instance_path"], v["keyword"], json.loads(v["params"]), v["message"])
        for v in row["validation"]
    ]


TYPE = ("type", {"type": "string"}, "must be string")
NULL = ("type", {"type": "null"}, "must be null")
CONST = ("const", {"allowedValue": "undefined"}, "must be equal to constant")
CHOICE = ("anyOf", {}, "must match a schema in anyOf")
SHORT = ("minLength", {"limit": 1}, "must NOT have fewer than 1 characters")


@pytest.mark.parametrize(
    "path, value, found",
    [
        ("timestamp", "not-a-datetime", [("format", {"format": "date-time"}, 'must match format "date-time"')]),
        ("action", "click", [("const", {"allowedValue": "page_hit"}, "must be equal to constant")]),
        ("payload.utm_term", {}, [TYPE, NULL, CHOICE]),
        ("payload.location", {}, [TYPE, NULL, CHOICE]),
        ("payload.location", " ", [("pattern", {"pattern": r"^.*\S.*$"}, r'must match pattern "^.*\S.*$"'), NULL, CHOICE]),
        ("payload.post_uuid", "x", [("format", {"format": "uuid"}, 'must match format "uuid"'), CONST, CHOICE]),
        ("payload.post_uuid", [], [TYPE, TYPE, CHOICE]),
        ("payload.member_status", "", [SHORT, CONST, CHOICE]),
        ("payload.user-agent", "", [SHORT]),
        ("payload.post_type", "x", [("enum", {"allowedValues": ["null", "post", "page"]}, "must be equal to one of the allowed values")]),
    ],
)
def test_broken_body_rules_list_their_failures(spark, path, value, found):
    (row,) = rejects(spark, request(changed(BODY, path, value)))
    place = "/" + path.replace(".", "/")
    assert failures(row) == [(place, *entry) for entry in found]
    assert row["message"] == ", ".join(f"body{place} {entry[2]}" for entry in found)
    assert (row["type"], row["code"], row["status"]) == ("validation_error", "FST_ERR_VALIDATION", 400)


def test_missing_members_and_wrong_objects(spark):
    gone, text = rejects(
        spark, request(changed(BODY, "payload.locale", GONE)), request(changed(BODY, "payload", "x"))
    )
    assert failures(gone) == [
        ("/payload", "required", {"missingProperty": "locale"}, "must have required property 'locale'")
    ]
    assert failures(text) == [("/payload", "type", {"type": "object"}, "must be object")]


def test_query_and_header_failures(spark):
    rows = rejects(
        spark,
        request(url="/api/v1/page_hit?token=abc123"),
        request(url="/api/v1/page_hit?token=a&name=invalid"),
        request(url=URL + "&b=1&a=1&a=2&b=2"),
        request(headers={k: v for k, v in HEADERS.items() if k != "x-site-uuid"}),
        request(headers={**HEADERS, "x-site-uuid": "not-a-uuid"}),
    )
    assert [(r["validation_context"], *failures(r)[0][:2]) for r in rows] == [
        ("querystring", "", "required"), ("querystring", "/name", "enum"),
        ("querystring", "/b", "type"), ("headers", "", "required"), ("headers", "/x-site-uuid", "format"),
    ]
    assert rows[2]["query"] == {"token": ["abc123"], "name": ["analytics_events"], "b": ["1", "2"], "a": ["1", "2"]}


def test_other_rejects_have_no_list(spark):
    rows = rejects(
        spark, request("{"), request(changed(BODY, "payload.href", "x" * 30000)),
    ) + rejects(spark, request(), settings=Settings(hmac_secret="s"))
    assert [r["validation"] for r in rows] == [None] * 3
    assert [r["code"] for r in rows] == ["FST_ERR_CTP_INVALID_JSON_BODY", "FST_ERR_CTP_BODY_TOO_LARGE", None]
    assert {r["type"] for r in rows} == {"unhandled_error"}


def test_keys_are_grouped_in_order_of_first_appearance(spark):
    queries = ["", "b=1&a=2&b=3&a=4&c=", "a", "=x&=y"]
    df = spark.createDataFrame([(q,) for q in queries], "q string").coalesce(1)
    rows = df.select(urls.grouped(urls.query_pairs(F.col("q"))).alias("g")).collect()
    assert [[(g["key"], g["values"]) for g in r["g"]] for r in rows] == [
        [], [("b", ["1", "3"]), ("a", ["2", "4"]), ("c", [""])], [("a", [""])], [("", ["x", "y"])],
    ]


def test_very_many_keys(spark):
    many = "&".join(f"k{i % 50_000}={i}" for i in range(100_000))
    df = spark.createDataFrame([(many,)], "q string")
    pairs = urls.query_pairs(F.col("q"))
    text = df.select(urls.rewrite_forward_query(pairs, True, True)).first()[0]
    expected = "&".join(f"k{i}={i}%2C{i + 50_000}" for i in range(50_000))
    assert text == expected + "&wait=true"
