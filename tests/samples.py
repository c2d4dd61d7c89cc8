"""Requests and messages that tests start from and change."""

import copy
import json
from datetime import datetime, timezone

from footfall.schemas import REQUESTS

SITE = "940b73e9-4952-4752-b23d-9486f999c47e"
AGENT = "Mozilla/5.0 Test Browser"
RECEIVED = datetime(2025, 4, 14, 22, 16, 7, 123000, tzinfo=timezone.utc)

BODY = {
    "timestamp": "2025-04-14T22:16:06.095Z",
    "action": "page_hit",
    "version": "1",
    "session_id": "9017be4c-3065-484b-b117-9719ad1e3977",
    "payload": {
        "user-agent": AGENT,
        "locale": "en-US",
        "location": "US",
        "referrer": None,
        "pathname": "/",
        "href": "https://www.example.com/",
        "site_uuid": SITE,
        "post_uuid": "undefined",
        "post_type": "null",
        "member_uuid": "undefined",
        "member_status": "free",
    },
}

HEADERS = {"x-site-uuid": SITE, "content-type": "application/json", "user-agent": AGENT}
URL = "/api/v1/page_hit?token=abc123&name=analytics_events"

RAW = {
    "timestamp": "2024-01-01T00:00:00.000Z",
    "action": "page_hit",
    "version": "1",
    "site_uuid": "12345678-1234-1234-1234-123456789012",
    "payload": {
        "event_id": "550e8400-e29b-41d4-a716-446655440000",
        "member_uuid": "undefined",
        "member_status": "free",
        "post_uuid": "undefined",
        "post_type": "post",
        "locale": "en-US",
        "location": "homepage",
        "referrer": None,
        "parsedReferrer": {"source": None, "medium": None, "url": None},
        "pathname": "/blog/post",
        "href": "https://example.com/blog/post",
        "utm_source": None,
        "meta": {"received_timestamp": None},
    },
    "meta": {"ip": "192.168.1.1", "user-agent": "Mozilla/5.0 (Windows NT 10.0) Firefox/89.0"},
}

GONE = object()


def changed(document, path, value):
    """A copy with the member at a dotted path set, or removed for GONE."""
    result = copy.deepcopy(document)
    *parents, last = path.split(".")
    node = result
    for name in parents:
        node = node[name]
    if value is GONE:
        del node[last]
    else:
        node[last] = value
    return result


def request(body=BODY, headers=HEADERS, url=URL, ip="10.0.0.9", method="POST"):
    text = body if isinstance(body, str) else json.dumps(body)
    return (method, url, headers, ip, RECEIVED, text)


def frame(spark, requests):
    return spark.createDataFrame(requests, REQUESTS)
