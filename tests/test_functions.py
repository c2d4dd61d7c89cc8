"""Known vectors of the column functions."""

import base64
import hashlib
import hmac
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.functions import agents, clock, referrers, saltkeys, signing, text, tracing, urls
from footfall.operators import admission, enrich
from samples import RECEIVED, frame, request

SECRET = "c2c5e6a3e644b6f41b947b1f651a4b569eaece5b"


def values(spark, rows, column, schema="x string"):
    """The column for each row, in order."""
    rows = [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [row["y"] for row in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_known_signature(spark):
    signed = "/api/v1/page_hit?name=analytics_events&e=ff2e3da1-2a15-49a4-bb4f-f2ab96efb4fe&t=1761145346"
    column = signing.base64_url(signing.hmac_sha1(F.col("x"), signing.hmac_key(spark, SECRET)))
    assert values(spark, [signed], column) == ["z_uCanKB53mHc2LheZVwY6rzM2k="]


@pytest.mark.parametrize("secret", ["k", "s" * 64, "s" * 65, "é" * 70])
def test_signature_agrees_with_standard_library(spark, secret):
    texts = ["", "a", "/p?q=ü&t=1"]
    expected = [hmac.new(secret.encode(), t.encode(), hashlib.sha1).digest() for t in texts]
    found = values(spark, texts, signing.hmac_sha1(F.col("x"), signing.hmac_key(spark, secret)))
    assert [bytes(d) for d in found] == expected


def test_secret_is_not_in_the_plan(spark):
    df = spark.range(1).select(signing.hmac_sha1(F.lit("x"), signing.hmac_key(spark, SECRET)))
    plan = df._jdf.queryExecution().toString()
    inner = signing._pads(SECRET.encode())[0]
    assert SECRET not in plan and inner.hex().upper() not in plan.upper()


def _signed(seconds_off=0, secret=SECRET, text="/p?a=b+c", extra=""):
    t = int(RECEIVED.timestamp()) + seconds_off
    signed = f"{text}&t={t}"
    digest = hmac.new(secret.encode(), signed.encode(), hashlib.sha1).digest()
    return f"{signed}&hmac={base64.urlsafe_b64encode(digest).decode()}{extra}"


def test_signed_urls(spark):
    good = _signed()
    rows = [
        (good, True, None),
        (_signed(5), True, None),
        (_signed(6), False, "Timestamp is not within the allowed range"),
        (_signed(-299), True, None),
        (_signed(-301), False, "Timestamp is not within the allowed range"),
        (_signed(secret="other"), False, None),
        ("/p?t=1", False, "HMAC parameter not found"),
        ("/p?hmac=x", False, "Timestamp (t) parameter not found"),
        ("/p?hmac=&t=1", False, "HMAC parameter not found"),
        ("/p?hmac=x&t=abc", False, "Invalid timestamp"),
        (good.replace("a=b+c", "a=b%20c"), True, None),
        (good + "&hmac=second", True, None),
    ]
    df = frame(spark, [request(url=row[0]) for row in rows])
    df = df.withColumn("i", F.monotonically_increasing_id())
    result = admission.verify_signature(df, SECRET).orderBy("i").collect()
    assert [(r["hmac_valid"], r["hmac_error"]) for r in result] == [row[1:] for row in rows]
    assert result[0]["cleaned_url"] == "/p?a=b+c"


def test_policy(spark):
    bad = "/p?hmac=x&t=1"
    requests = [request(url=bad), request(url=bad, method="GET"), request(url="/local-proxy/v0")]
    df = frame(spark, requests)

    def run(settings):
        rows = admission.apply_hmac_policy(df, settings).collect()
        return [(r["hmac_status"], r["effective_url"]) for r in rows]

    assert run(Settings()) == [("disabled", bad), ("disabled", bad), ("disabled", "/local-proxy/v0")]
    exempt = [("exempt", bad), ("exempt", "/local-proxy/v0")]
    assert run(Settings(hmac_secret=SECRET)) == [("refused", bad), *exempt]
    assert run(Settings(hmac_secret=SECRET, hmac_log_only=True)) == [("logged", "/p"), *exempt]


def test_filter_query_params(spark):
    rows = {
        "/p?token=valid&name=&extra=x": "/p?token=valid",
        "/p?name=n&token=t": "/p?token=t&name=n",
        "/p?extra=x": "/p",
        "/p": "/p",
        "/p?token=%20&name=a b": "/p?name=a+b",
        "/p?token=a%zz": "/p?token=a%25zz",
    }
    assert values(spark, list(rows), urls.filter_query_params(F.col("x"))) == list(rows.values())


def test_rewrite_forward_query(spark):
    pairs = urls.query_pairs(F.col("x"))
    column = urls.rewrite_forward_query(pairs, drop_token=True, wait=True)
    rows = {
        "token=t&name=n&hmac=h&t=1": "name=n&hmac=h&t=1&wait=true",
        "wait=no&name=n": "wait=true&name=n",
        "a=1&a=2": "a=1%2C2&wait=true",
    }
    assert values(spark, list(rows), column) == list(rows.values())


def test_user_agents(spark):
    rows = {
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36": ("macos", "chrome", "desktop"),
        "Mozilla/5.0 (iPhone; CPU iPhone OS 14_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.0 Safari/605.1.15": ("ios", "safari", "mobile-ios"),
        "Mozilla/5.0 (Linux; Android 11; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.120 Mobile Safari/537.36": ("android", "chrome", "mobile-android"),
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:89.0) Gecko/20100101 Firefox/89.0": ("windows", "firefox", "desktop"),
        "Mozilla/5.0 (X11; Linux x86_64; rv:89.0) Gecko/20100101 Firefox/89.0": ("linux", "firefox", "desktop"),
        "Mozilla/5.0 (X11; CrOS x86_64 13816.64.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/90.0.4430.100 Safari/537.36": ("chromium os", "chrome", "desktop"),
        "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:89.0) Gecko/20100101 Firefox/89.0": ("ubuntu", "firefox", "desktop"),
        "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)": ("unknown", "unknown", "bot"),
        "Mozilla/5.0 (Linux; Android 6.0.1; Nexus 5X Build/MMB29P) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/137.0.7151.119 Mobile Safari/537.36 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)": ("android", "chrome", "bot"),
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36": ("macos", "unknown", "desktop"),
        "curl/7.68.0": ("unknown", "unknown", "bot"),
        "": ("unknown", "unknown", "unknown"),
        "invalid-user-agent": ("unknown", "unknown", "unknown"),
        None: ("unknown", "unknown", "unknown"),
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "i int, agent string")
    found = enrich.parse_user_agent(df, F.col("agent")).orderBy("i").collect()
    assert [(r["os"], r["browser"], r["device"]) for r in found] == list(rows.values())


def test_bots(spark):
    rows = {"WGET/1.2": True, "xx +https://a": True, "Cubot phone": True, "Firefox": False, "": False, None: False}
    assert values(spark, list(rows), agents.is_bot(F.col("x"))) == list(rows.values())


def test_trace_context(spark):
    t = "105445aa7843bc8bf206b12000100000"
    w = "00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7"
    w3c = "projects/p/traces/4bf92f3577b34da6a3ce929d0e0e4736"
    rows = [
        ((f"{t}/1;o=1", None), (f"projects/p/traces/{t}", "1", True)),
        ((f"{t}/1", None), (f"projects/p/traces/{t}", "1", None)),
        ((f"{t}/1;o=0", f"{w}-01"), (f"projects/p/traces/{t}", "1", False)),
        ((None, f"{w}-01"), (w3c, "00f067aa0ba902b7", True)),
        ((None, f"{w}-00"), (w3c, "00f067aa0ba902b7", False)),
        (("/1;o=1", f"{w}-00"), (w3c, "00f067aa0ba902b7", False)),
        (("/1;o=1", None), (None, "1", True)),
        (("malformed-header", None), ("projects/p/traces/malformed-header", None, None)),
        ((None, "malformed-header"), (None, None, None)),
        ((None, f"01{w[2:]}-01"), (None, None, None)),
        ((None, None), (None, None, None)),
    ]
    trace = tracing.trace_context(F.col("c"), F.col("w"), "p")
    found = values(spark, [r[0] for r in rows], F.struct(*[trace[n].alias(n) for n in trace]), "c string, w string")
    assert [tuple(f) for f in found] == [r[1] for r in rows]
    nothing = tracing.trace_context(F.col("c"), F.col("w"), None)
    assert values(spark, [rows[0][0]], nothing["trace"], "c string, w string") == [None]


def test_blank_and_guid_rules(spark):
    rows = {"a": True, " a ": True, " ": False, "": False, "a\nb": False, " ﻿": False, " x": False, "\u0085": True}
    assert values(spark, list(rows), text.is_nonblank(F.col("x"))) == list(rows.values())
    guids = {"940B73e9-4952-0752-023d-9486f999c47e": True, "940b73e9-4952-4752-b23d-9486f999c47e\n": False, "undefined": False}
    assert values(spark, list(guids), text.is_guid(F.col("x"))) == list(guids.values())


def test_epoch_texts(spark):
    rows = {"12": 12, " 12abc": 12, "-5": -5, "+7.9": 7, "abc": None, "": None, "8640000000000000": 8640000000000000, "8640000000000001": None, "9" * 50: None}
    assert values(spark, list(rows), clock.epoch_millis(F.col("x"))) == list(rows.values())


def test_salt_keys(spark):
    made = datetime(2024, 3, 1, 12, 30, tzinfo=timezone.utc)
    rows = [("salt:2024-01-15:site", "2024-01-17T00:00:00.000Z"), ("salt:odd:site", "2024-03-03T12:30:00.000Z"), ("other", "2024-03-03T12:30:00.000Z")]
    column = clock.iso_millis(saltkeys.expires_at(F.col("x"), F.lit(made)))
    assert values(spark, [r[0] for r in rows], column) == [r[1] for r in rows]


def test_signature_of_a_visitor(spark):
    column = signing.session_signature(F.lit("salt"), F.lit("site"), F.lit("ip"), F.col("x"))
    assert values(spark, ["agent"], column) == [hashlib.sha256(b"salt:site:ip:agent").hexdigest()]


def test_referrers(spark):
    rows = [
        (("https://www.google.com/search?q=a", "Google", "search"), ("https://www.google.com/search?q=a", "Google", "search")),
        (("https://www.google.com/", None, ""), ("https://www.google.com/", "Google", "search")),
        (("https://blog.example.org/x", "", None), ("https://blog.example.org/x", "blog.example.org", None)),
        (("https://t.co/x", "mine", "paid"), ("https://t.co/x", "mine", "paid")),
        (("", "Google", "search"), (None, None, None)),
        ((None, "Google", "search"), (None, None, None)),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, p struct<url: string, source: string, medium: string>")
    domains = enrich.known_domains(spark)
    names = ["referrerUrl", "referrerSource", "referrerMedium"]
    found = enrich.parse_referrer(df, F.col("p"), domains).orderBy("i").select(*names).collect()
    assert [tuple(f) for f in found] == [r[1] for r in rows]
    # The same with a table that is too large to broadcast.
    found = enrich.parse_referrer(df, F.col("p"), domains, Settings(broadcast_rows=3)).orderBy("i").select(*names).collect()
    assert [tuple(f) for f in found] == [r[1] for r in rows]


def test_hosts(spark):
    rows = {"HTTPS://User@WWW.Example.com:8080/x": "www.example.com", "/relative": "", "mailto:a@b.c": ""}
    assert values(spark, list(rows), referrers.host_of(F.col("x"))) == list(rows.values())


@pytest.mark.parametrize(
    "path, normal",
    [
        ("/", "/"), ("/a/b", "/a/b"), ("/a//b/", "/a//b/"), ("/a/./b", "/a/b"), ("/a/../b", "/b"),
        ("/../../a", "/a"), ("/a/b/..", "/a/"), ("/a/.", "/a/"), ("/..", "/"), ("/a/%2E%2e/b", "/b"),
        ("/a/.%2e/%2e/b", "/b"), ("/a/...", "/a/..."), ("/a/.b/c..", "/a/.b/c.."), ("/a\\..\\b", "/b"),
        ("/café x", "/caf%C3%A9%20x"), ("/\U0001f600", "/%F0%9F%98%80"), ("/a%20+b", "/a%20+b"),
        ('/"<>`{}^', "/%22%3C%3E%60%7B%7D%5E"), ("/a//../b", "/a/b"),
    ],
)
def test_paths_are_normalised(spark, path, normal):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(urls.normal_path(F.col("p"))).first()[0] == normal


def test_signed_paths_with_dots_and_raw_characters_verify(spark):
    stamp = int(RECEIVED.timestamp())
    sent = [("/a/../ü", "/%C3%BC"), ("/x/./y/..", "/x/")]
    rows = []
    for path, signed in sent:
        digest = hmac.new(b"k", f"{signed}?t={stamp}".encode(), hashlib.sha1).digest()
        rows.append(request(url=f"{path}?t={stamp}&hmac={base64.urlsafe_b64encode(digest).decode()}"))
    checked = admission.verify_signature(frame(spark, rows), "k").collect()
    assert [(r["hmac_valid"], r["cleaned_url"]) for r in checked] == [(True, signed) for _, signed in sent]
