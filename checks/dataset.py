"""Captured requests derived from the ``events`` table, one per event.

The expressions below are SQL that Spark and DuckDB read alike, so both engines
build the same requests. Small moduli of the event id decide which request has
which defect; the reference answers are worked out from those moduli, not by
parsing the requests again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import signing
from footfall.session import prepare, workspace

# user agent, operating system, browser, device
AGENTS = [
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36", "macos", "chrome", "desktop"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 14_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.0 Mobile/15E148 Safari/604.1", "ios", "safari", "mobile-ios"),
    ("Mozilla/5.0 (Linux; Android 11; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.120 Mobile Safari/537.36", "android", "chrome", "mobile-android"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:89.0) Gecko/20100101 Firefox/89.0", "windows", "firefox", "desktop"),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:89.0) Gecko/20100101 Firefox/89.0", "linux", "firefox", "desktop"),
    ("Mozilla/5.0 (X11; CrOS x86_64 13816.64.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/90.0.4430.100 Safari/537.36", "chromium os", "chrome", "desktop"),
    ("Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:89.0) Gecko/20100101 Firefox/89.0", "ubuntu", "firefox", "desktop"),
    ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "unknown", "unknown", "bot"),
    ("Mozilla/5.0 (Linux; Android 6.0.1; Nexus 5X Build/MMB29P) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/137.0.7151.119 Mobile Safari/537.36 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "android", "chrome", "bot"),
    ("curl/7.68.0", "unknown", "unknown", "bot"),
    ("invalid-user-agent", "unknown", "unknown", "unknown"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0", "windows", "edge", "desktop"),
]

# referrer URL, host, source and medium found for it
REFERRERS = [
    ("https://www.google.com/search?q=spark", "www.google.com", "Google", "search"),
    ("https://duckduckgo.com/", "duckduckgo.com", "DuckDuckGo", "search"),
    ("https://t.co/abc", "t.co", "Twitter", "social"),
    ("https://news.ycombinator.com/item?id=1", "news.ycombinator.com", "Hacker News", "social"),
    ("https://blog.example.org/post", "blog.example.org", "blog.example.org", None),
    ("not a url", None, None, None),
    ("https://user@WWW.Bing.com:443/x", "www.bing.com", "Bing", "search"),
    ("", None, None, None),
]

SIGNING_SECRET = "signing secret of the derived requests"

# Per dialect: {name} inside an expression is replaced by this.
DIALECTS = {
    "spark": {
        "{iso}": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
        "{epoch_ms}": "unix_millis(CAST(ts AS TIMESTAMP))",
    },
    "duckdb": {
        "{iso}": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')",
        "{epoch_ms}": "epoch_us(ts) // 1000",
    },
}


def _choice(number: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE {number} {arms} END"


def _member(condition: str, name: str, value: str) -> str:
    """A JSON member written only where the condition holds."""
    return f"CASE WHEN {condition} THEN ',\"{name}\":' || {value} ELSE '' END"


# Each layer may use the columns of the layers before it.
LAYERS: list[dict[str, str]] = [
    {
        "row_id": "event_id",
        "e": "event_id",
        "u": "user_id",
        "k": "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)",
        "iso": "{iso}",
        "received_ms": "{epoch_ms}",
    },
    {
        "site": "'00000000-0000-4000-8000-' || lpad(CAST(u % 7 AS STRING), 12, '0')",
        "agent": f"CASE WHEN e % 89 = 0 THEN ' ' ELSE {_choice('e % 12', [a[0] for a in AGENTS])} END",
        "remote_ip": "'192.168.1.' || CAST(u % 250 AS STRING)",
        "forwarded": "CASE WHEN u % 3 = 0 THEN '203.0.113.' || CAST(u % 250 AS STRING) || ', 10.0.0.1' END",
        "post_type": "CASE WHEN e % 67 = 0 THEN 'article' WHEN u % 5 = 0 THEN 'post' WHEN u % 5 = 1 THEN 'page' ELSE 'null' END",
        "member_uuid": "CASE WHEN u % 4 = 0 THEN 'aaaaaaaa-0000-4000-8000-' || lpad(CAST(u AS STRING), 12, '0') ELSE 'undefined' END",
        "member_status": "CASE u % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'undefined' END",
        "post_uuid": "CASE WHEN u % 5 = 0 THEN '11111111-0000-4000-8000-' || lpad(CAST(e % 50 AS STRING), 12, '0') ELSE 'undefined' END",
        "pathname": "'/post-' || CAST(e % 50 AS STRING) || '/'",
        "start_ms": "CASE WHEN e % 23 = 0 THEN NULL WHEN e % 7 = 0 THEN 'abc' WHEN e % 19 = 0 THEN CAST(received_ms - 250 AS STRING) || 'abc' ELSE CAST(received_ms - 250 AS STRING) END",
        "referrer_url": _choice("e % 8", [r[0] for r in REFERRERS]),
        "name_part": "CASE WHEN e % 109 = 0 THEN '' WHEN e % 103 = 0 THEN 'name=analytics_events&name=analytics_events' WHEN e % 79 = 0 THEN 'name=nope' ELSE 'name=analytics_events' END",
        "token_part": "CASE WHEN e % 137 = 0 THEN '&token=' WHEN e % 101 = 0 THEN '&token=%20' WHEN u % 5 = 0 THEN '' ELSE '&token=tok' || CAST(u % 10 AS STRING) END",
        "extra_part": "CASE WHEN e % 139 = 0 THEN '&x=1&x=2' WHEN e % 3 = 0 THEN '&x=a+b' ELSE '' END",
    },
    {
        "method": "CASE WHEN e % 163 = 0 THEN 'GET' ELSE 'POST' END",
        "url": "CASE WHEN e % 157 = 0 THEN '/api/v1/nope?' ELSE '/api/v1/page_hit?' END || name_part || token_part || extra_part",
        "href": "'https://site' || CAST(u % 7 AS STRING) || '.example.com' || pathname",
        "payload": " || ".join(
            [
                "'{\"user-agent\":\"agent\"'",
                _member("e % 11 = 0", "event_id", "CAST(e AS STRING)"),
                _member("e % 11 <> 0 AND e % 13 = 0", "event_id", "'\"\"'"),
                _member("e % 11 <> 0 AND e % 13 <> 0 AND e % 17 <> 0", "event_id", "'\"evt-' || CAST(e AS STRING) || '\"'"),
                _member("e % 131 <> 0", "locale", "'\"en-US\"'"),
                _member("k % 5 = 0", "location", "'null'"),
                _member("k % 5 = 1", "location", "'\"\"'"),
                _member("k % 5 > 1", "location", "'\"US\"'"),
                _member("u % 6 = 0", "referrer", "'null'"),
                _member("u % 6 = 1", "referrer", "'\"' || referrer_url || '\"'"),
                _member("e % 59 = 0", "parsedReferrer", "'{\"url\":\"\"}'"),
                _member(
                    "e % 59 <> 0 AND k % 4 = 0", "parsedReferrer",
                    "'{\"source\":' || CASE WHEN e % 3 = 0 THEN '\"Partner\"' ELSE 'null' END"
                    " || ',\"medium\":' || CASE WHEN e % 5 = 0 THEN '\"paid\"' ELSE '\"\"' END"
                    " || ',\"url\":\"' || referrer_url || '\"}'",
                ),
                _member("e % 59 <> 0 AND k % 4 = 1", "parsedReferrer", "'{\"source\":null,\"medium\":null,\"url\":null}'"),
                _member("TRUE", "pathname", "'\"' || pathname || '\"'"),
                _member("TRUE", "href", "'\"' || href || '\"'"),
                _member("TRUE", "site_uuid", "'\"' || site || '\"'"),
                _member("TRUE", "post_uuid", "'\"' || post_uuid || '\"'"),
                _member("TRUE", "post_type", "'\"' || post_type || '\"'"),
                _member("TRUE", "member_uuid", "'\"' || member_uuid || '\"'"),
                _member("TRUE", "member_status", "'\"' || member_status || '\"'"),
                _member("e % 29 = 0", "gift_link", "'\"gift-' || CAST(e AS STRING) || '\"'"),
                _member("e % 29 <> 0 AND e % 31 = 0", "gift_link", "'null'"),
                _member("k % 3 = 0", "utm_source", "'\"newsletter\"'"),
                _member("k % 3 = 1", "utm_source", "'null'"),
                _member("k % 3 = 0", "utm_medium", "'\"email\"'"),
                _member("e % 5 = 0", "utm_campaign", "'2024'"),
                _member("e % 107 = 0", "utm_term", "'{}'"),
                _member("e % 107 <> 0 AND e % 33 = 0", "utm_term", "'[\"one\"]'"),
                _member("e % 10 = 0", "utm_content", "'true'"),
                _member("e % 1009 = 0", "padding", "'\"' || repeat('x', 21000) || '\"'"),
                "'}'",
            ]
        ),
    },
    {
        "whole_body": " || ".join(
            [
                "'{\"timestamp\":\"' || CASE WHEN e % 73 = 0 THEN replace(iso, substr(iso, 20, 4), '') ELSE iso END",
                "'\",\"action\":\"' || CASE WHEN e % 71 = 0 THEN 'click' ELSE 'page_hit' END",
                "'\",\"version\":' || CASE WHEN e % 2 = 0 THEN '1' ELSE '\"1\"' END",
                "',\"payload\":' || payload || '}'",
            ]
        ),
    },
    {
        "body": "CASE WHEN e % 61 = 0 THEN substr(whole_body, 1, length(whole_body) - 1) WHEN e % 113 = 0 THEN whole_body || ' {}' ELSE whole_body END",
    },
    {
        # Signed URLs: signing time by e % 8, defects by larger moduli.
        "signed_at": "CAST(floor(received_ms / 1000) AS BIGINT) + CASE e % 8 WHEN 0 THEN -301 WHEN 1 THEN -299 WHEN 2 THEN 5 WHEN 3 THEN 6 ELSE 0 END",
    },
    {
        "t_part": "CASE WHEN e % 19 = 0 THEN '' WHEN e % 23 = 0 THEN '&t=abc' ELSE '&t=' || CAST(signed_at AS STRING) END",
        "q_sent": "CASE u % 4 WHEN 0 THEN '&q=a+b%21' WHEN 1 THEN '&q=a%20b!' ELSE '' END",
        "sent_path": "CASE e % 13 WHEN 1 THEN '/api/x/../v1/./page_hit' WHEN 2 THEN '/api/v1/y/%2E%2e/page_hit' WHEN 3 THEN '/../api/v1/page_hit' WHEN 4 THEN '/api/v1/page hit/\u00e9' WHEN 5 THEN '/api/v1/page_hit/.' ELSE '/api/v1/page_hit' END",
        "signed_path": "CASE e % 13 WHEN 4 THEN '/api/v1/page%20hit/%C3%A9' WHEN 5 THEN '/api/v1/page_hit/' ELSE '/api/v1/page_hit' END",
        "q_signed": "CASE WHEN u % 4 < 2 THEN '&q=a+b%21' ELSE '' END",
    },
    {
        "signed_text": "signed_path || '?name=analytics_events&e=evt-' || CAST(e AS STRING) || q_signed || t_part",
        "sent_text": "sent_path || '?name=analytics_events&e=evt-' || CAST(e AS STRING) || q_sent || t_part",
        "unsigned_text": "signed_path || '?name=analytics_events&e=evt-' || CAST(e AS STRING) || q_signed",
    },
]


def _translated(expression: str, dialect: str) -> str:
    return reduce(lambda text, pair: text.replace(*pair), DIALECTS[dialect].items(), expression)


def duckdb_base() -> str:
    """The derived requests as a DuckDB subquery named ``base``."""
    sql = "SELECT * FROM events"
    for layer in LAYERS:
        columns = ", ".join(f"{_translated(e, 'duckdb')} AS {name}" for name, e in layer.items())
        sql = f"SELECT *, {columns} FROM ({sql})"
    return f"base AS ({sql})"


#: Rows of a task that derives or checks requests: fewer where that leaves cores idle,
#: but not so few that a task is over before it has begun.
TASK_ROWS = 50_000
FEW_ROWS = 2_000


def tasks_for(rows: int, cores: int) -> int:
    """How many tasks, and files, so many requests are dealt over."""
    return max(-(-rows // TASK_ROWS), min(2 * cores, -(-rows // FEW_ROWS)), 1)


def spread(stored: DataFrame) -> DataFrame:
    """The rows of a stored table, dealt over tasks by their number.

    An event takes a few bytes in a file and makes a request of a kilobyte that is costly
    to check, so the splits of the file say little about the work in them.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(tasks_for(stored.count(), cores))


def batch_files(spark: SparkSession) -> int:
    """Files of a micro-batch that keeps all cores busy, the last ones included."""
    return 4 * spark.sparkContext.defaultParallelism


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(prepare(spark).read.parquet(f"{sf_dir}/events.parquet"))
    for layer in LAYERS:
        df = df.selectExpr(
            "*", *[f"{_translated(e, 'spark')} AS {name}" for name, e in layer.items()]
        )
    return df


def _headers() -> dict[str, str]:
    return {
        "x-site-uuid": "CASE WHEN e % 149 = 0 THEN NULL WHEN e % 97 = 0 THEN 'not-a-uuid' ELSE site END",
        "content-type": "CASE WHEN e % 83 = 0 THEN 'application/json; charset=utf-8' ELSE 'application/json' END",
        "user-agent": "agent",
        "x-forwarded-for": "forwarded",
        "x-analytics-start": "start_ms",
        "referer": "CASE WHEN e % 4 = 0 THEN href END",
        "content-length": "CASE WHEN e % 9 <> 0 THEN CAST(length(body) AS STRING) END",
        "x-request-id": "CASE WHEN e % 5 = 0 THEN 'req-' || CAST(e AS STRING) END",
        "x-cloud-trace-context": "CASE e % 6 WHEN 0 THEN lpad(CAST(e AS STRING), 32, 'a') || '/1;o=1' WHEN 1 THEN '/1;o=0' WHEN 2 THEN lpad(CAST(e AS STRING), 32, 'a') || '/2' WHEN 5 THEN lpad(CAST(e AS STRING), 32, 'a') END",
        "traceparent": "CASE e % 6 WHEN 2 THEN '00-' || lpad(CAST(e AS STRING), 32, 'b') || '-00f067aa0ba902b7-01' WHEN 3 THEN '00-' || lpad(CAST(e AS STRING), 32, 'b') || '-00f067aa0ba902b7-00' WHEN 4 THEN '01-' || lpad(CAST(e AS STRING), 32, 'b') || '-00f067aa0ba902b7-01' END",
    }


def _as_requests(df: DataFrame, method: Column, url: Column) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("key"), F.expr(value).alias("value"))
            for name, value in _headers().items()
        ]
    )
    present = F.filter(entries, lambda entry: entry["value"].isNotNull())
    return df.select(
        "row_id",
        method.alias("method"),
        url.alias("url"),
        F.map_from_entries(present).alias("http_headers"),
        "remote_ip",
        F.timestamp_millis("received_ms").alias("received_at"),
        "body",
    )


_TABLES: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written once per session: deriving it is not what is measured."""
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        path = workspace(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def derive_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_requests(_derived(spark, sf_dir), F.col("method"), F.col("url"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived requests as the request table, plus ``row_id``."""
    return _stored(spark, sf_dir, "requests", derive_requests)


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived requests as a stream, a few files for each core at a time."""
    schema = requests(spark, sf_dir).schema
    path = _TABLES[(spark.sparkContext.applicationId, sf_dir, "requests")]
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files(spark)).parquet(path)


def derive_salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _derived(spark, sf_dir).select(
        F.concat(F.lit("salt:"), F.substring("iso", 1, 10), F.lit(":"), F.col("site")).alias("key"),
        F.substring("iso", 1, 10).alias("day"),
        F.col("site").alias("site_uuid"),
    ).distinct()
    created = F.to_timestamp(F.col("day"))
    return keys.select(
        "key",
        F.to_date("day").alias("salt_date"),
        "site_uuid",
        F.sha2(F.concat(F.lit("fixture-salt:"), F.col("day"), F.lit(":"), F.col("site_uuid")), 256).alias("salt"),
        created.alias("created_at"),
        (created + F.expr("INTERVAL '2' DAY")).alias("expires_at"),
    )


def fixture_salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One known salt per site and day of the events."""
    return _stored(spark, sf_dir, "salts", derive_salts)


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived requests with signed URLs, some of them wrong in a known way."""
    return _stored(spark, sf_dir, "signed", derive_signed)


def derive_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = signing.hmac_key(spark, SIGNING_SECRET)
    df = _derived(spark, sf_dir).withColumn(
        "digest", signing.base64_url(signing.hmac_sha1(F.col("signed_text"), key))
    )
    e = F.col("e")
    swapped = F.concat(
        F.when(F.substring("digest", 1, 1) == "A", "B").otherwise("A"), F.expr("substr(digest, 2)")
    )
    given = F.when(e % 5 == 0, swapped).otherwise(F.col("digest"))
    signed = F.when(e % 17 == 0, F.col("sent_text")).otherwise(
        F.concat(F.col("sent_text"), F.lit("&hmac="), given)
    )
    return _as_requests(
        df,
        F.when(e % 43 == 0, "GET").otherwise("POST"),
        F.when(e % 47 == 0, F.concat(F.lit("/local-proxy/x?e="), e)).otherwise(signed),
    )
