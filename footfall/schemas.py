"""Table schemas: captured requests, raw events, processed events and salts."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def _struct(name: str, fields: list[T.StructField]) -> T.StructField:
    return T.StructField(name, T.StructType(fields))


UTM = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]

REQUESTS = T.StructType(
    [
        *_strings("method", "url"),
        T.StructField("http_headers", T.MapType(T.StringType(), T.StringType())),
        *_strings("remote_ip"),
        T.StructField("received_at", T.TimestampType()),
        *_strings("body"),
    ]
)

RAW = T.StructType(
    [
        *_strings("timestamp", "action", "version", "site_uuid"),
        _struct(
            "payload",
            [
                *_strings(
                    "event_id", "member_uuid", "member_status", "post_uuid", "post_type",
                    "gift_link", "locale", "location", "referrer",
                ),
                _struct("parsedReferrer", _strings("source", "medium", "url")),
                *_strings("pathname", "href", *UTM),
                _struct("meta", _strings("received_timestamp")),
            ],
        ),
        _struct("meta", _strings("ip", "user-agent")),
    ]
)

PROCESSED = T.StructType(
    [
        *_strings("timestamp", "action", "version", "site_uuid", "session_id"),
        _struct(
            "payload",
            [
                *_strings(
                    "event_id", "site_uuid", "member_uuid", "member_status", "post_uuid",
                    "post_type", "gift_link", "locale", "location", "pathname", "href",
                ),
                _struct("parsedReferrer", _strings("url", "source", "medium")),
                *_strings(
                    "os", "browser", "device",
                    "referrerUrl", "referrerSource", "referrerMedium",
                    *UTM, "user-agent",
                ),
                _struct("meta", _strings("received_timestamp")),
            ],
        ),
    ]
)

# A raw topic carries one JSON document per row and the time it was published.
TOPIC = T.StructType(
    [*_strings("value"), T.StructField("published_at", T.TimestampType())]
)

SALTS = T.StructType(
    [
        *_strings("key"),
        T.StructField("salt_date", T.DateType()),
        *_strings("site_uuid", "salt"),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

REFERRER_DOMAINS = T.StructType(_strings("domain", "source", "medium"))
