"""One query per operator, on requests derived from the events table.

Results are flat columns so that they can be compared with the SQL in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.functions import clock, saltkeys, signing, text, tracing, urls
from footfall.operators import admission, enrich, hits, rawcheck, reports, salts
from footfall.plans import modes
from footfall.session import workspace
from footfall.sources import events as sinks
from footfall.sources import requests as request_source
from footfall.sources import topic
from footfall.sources.salt_store import SaltStore
from footfall.streaming import admission_worker, worker

from . import dataset

SECRET = Settings(hmac_secret=dataset.SIGNING_SECRET)
LOG_ONLY = Settings(hmac_secret=dataset.SIGNING_SECRET, hmac_log_only=True)
# No table fits, few rows of a key make it hot: the way of very large tables.
SHUFFLED = Settings(broadcast_rows=0, task_rows=50)
TRACED = Settings(trace_project="shop")

Query = Callable[[SparkSession, str], DataFrame]


def _seed() -> Column:
    return F.col("row_id").cast("string")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of all requests, written once per session."""
    return dataset._stored(
        spark, sf, "classified",
        lambda s, d: admission.classify_requests(dataset.requests(s, d)),
    )


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events of the accepted requests, written once per session."""
    return dataset._stored(
        spark, sf, "raw", lambda s, d: hits.to_raw(_classified(s, d), event_id_seed=_seed())
    )


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of the raw topic with their request's number, some broken in a known way."""

    def build(s: SparkSession, d: str) -> DataFrame:
        classified = _classified(s, d).withColumn("_row", F.col("row_id"))
        raw = hits.to_raw(classified, event_id_seed=_seed(), keep=["_row"])
        event = F.struct(*[name for name in raw.columns if name != "_row"])
        value = F.to_json(event, topic.KEEP_NULLS)
        n = F.col("_row")
        broken = (
            F.when(n % 41 == 0, F.substring(value, 1, 100))
            .when(n % 43 == 0, F.concat(value, F.lit(" x")))
            .when(n % 47 == 0, F.regexp_replace(value, '"version":"1"', '"version":1'))
            .when(n % 53 == 0, F.regexp_replace(value, '"locale":"en-US"', '"locale":null'))
            .when(n % 37 == 0, F.regexp_replace(value, '"href":"[^"]*",', ""))
            .when(n % 31 == 0, F.regexp_replace(value, '"ip":"[^"]*"', '"ip":""'))
            .otherwise(value)
        )
        return raw.select(n.alias("row_id"), broken.alias("value"))

    return dataset._stored(spark, sf, "messages", build)


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return dataset._stored(
        spark, sf, "validated", lambda s, d: rawcheck.validate_raw(_messages(s, d))
    )


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.to_processed(
        _raw(spark, sf), dataset.fixture_salts(spark, sf), enrich.known_domains(spark)
    )


def _flat(processed: DataFrame) -> DataFrame:
    payload = F.col("payload")
    names = [
        "event_id", "member_uuid", "member_status", "post_uuid", "post_type", "gift_link", "locale",
        "location", "pathname", "href", "os", "browser", "device", "utm_source", "utm_medium",
        "utm_campaign", "utm_term", "utm_content",
    ]
    return processed.select(
        F.col("timestamp").alias("event_time"), "action", "version", "site_uuid", "session_id",
        *[payload[name].alias(name) for name in names],
        payload["parsedReferrer"]["url"].alias("sent_url"),
        payload["parsedReferrer"]["source"].alias("sent_source"),
        payload["parsedReferrer"]["medium"].alias("sent_medium"),
        payload["referrerUrl"].alias("referrer_url"),
        payload["referrerSource"].alias("referrer_source"),
        payload["referrerMedium"].alias("referrer_medium"),
        payload["user-agent"].alias("agent"),
        payload["meta"]["received_timestamp"].alias("received"),
    )


# --- sources and sinks --------------------------------------------------------


def s1_read_requests(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace(spark, "captured")
    dataset.requests(spark, sf).write.json(path)
    df = request_source.read_requests(spark, path, "json")
    return df.select(
        "method", "url", "remote_ip",
        clock.iso_millis(F.col("received_at")).alias("received"),
        F.octet_length("body").cast("bigint").alias("body_bytes"),
        F.col("http_headers")["content-type"].alias("content_type"),
    )


TOPIC_FILES = 3


def _topic(spark: SparkSession, sf: str, path: str, batches: int) -> DataFrame:
    """The messages as a topic below ``path``, read as a stream of at least so many batches."""
    messages = _messages(spark, sf)
    files = max(dataset.tasks_for(messages.count(), spark.sparkContext.defaultParallelism), TOPIC_FILES)
    messages.select("value", F.current_timestamp().alias("published_at")).repartition(files).write.parquet(path)
    share = min(-(-files // batches), dataset.batch_files(spark))
    return topic.read_raw_stream(spark, path, files_per_trigger=share)


def _drained(spark: SparkSession, sf: str) -> tuple[str, SaltStore]:
    """Run the worker over the topic until it is empty; returns its output folder."""
    root = workspace(spark, "worker")
    store = SaltStore(spark, f"{root}/salts")
    store.append(dataset.fixture_salts(spark, sf))
    stream = _topic(spark, sf, f"{root}/topic", batches=2)
    query = worker.start_worker(
        stream, f"{root}/out", f"{root}/checkpoint", store, enrich.known_domains(spark),
        batch_size=None, drain=True, salt_day="event",
    )
    query.awaitTermination()
    return f"{root}/out", store


def s2_read_raw_stream(spark: SparkSession, sf: str) -> DataFrame:
    root = workspace(spark, "topic")
    stream = _topic(spark, sf, f"{root}/topic", batches=3)
    query = (
        stream.select("value")
        .writeStream.format("parquet")
        .option("path", f"{root}/copy")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    copied = spark.read.schema("value string").parquet(f"{root}/copy")
    return copied.agg(F.count("*").alias("messages"))


def s3_publish_raw(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace(spark, "published")
    topic.publish_raw(_raw(spark, sf), path)
    value = F.try_parse_json("value")

    def at(where: str) -> Column:
        return F.try_variant_get(value, where, "string")

    return topic.read_raw(spark, path).select(
        at("$.timestamp").alias("event_time"),
        at("$.site_uuid").alias("site_uuid"),
        at("$.payload.event_id").alias("event_id"),
        at("$.payload.href").alias("href"),
        at("$.meta.ip").alias("ip"),
        F.col("published_at").isNotNull().alias("is_published"),
    )


def s4_write_events_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace(spark, "ndjson")
    sinks.write_events_ndjson(_processed(spark, sf), path, lines_per_file=5000)
    value = F.try_parse_json("value")

    def at(where: str) -> Column:
        return F.try_variant_get(value, where, "string")

    return sinks.read_events_ndjson(spark, path).select(
        at("$.timestamp").alias("event_time"),
        at("$.session_id").alias("session_id"),
        at("$.payload.event_id").alias("event_id"),
        at("$.payload.device").alias("device"),
        at("$.payload.referrerSource").alias("referrer_source"),
    )


def _salt_view(df: DataFrame) -> DataFrame:
    return df.select(
        "key", F.date_format("salt_date", "yyyy-MM-dd").alias("salt_day"), "site_uuid", "salt",
        clock.iso_millis(F.col("created_at")).alias("created"),
        clock.iso_millis(F.col("expires_at")).alias("expires"),
    )


def _store(spark: SparkSession, sf: str) -> SaltStore:
    store = SaltStore(spark, workspace(spark, "salts"))
    store.append(dataset.fixture_salts(spark, sf))
    return store


def s5_salt_table_io(spark: SparkSession, sf: str) -> DataFrame:
    return _salt_view(_store(spark, sf).load())


def s6_dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace(spark, "dead")
    sinks.write_dead_letters(rawcheck.dead_letters(_validated(spark, sf)), path)
    return (
        spark.read.schema("value string, error string").json(path)
        .groupBy("error").agg(F.count("*").alias("messages"))
    )


def _failures_shown(validation: Column) -> Column:
    parts = ["instance_path", "keyword", "params", "message"]
    shown = F.transform(validation, lambda v: F.concat_ws("|", *[v[part] for part in parts]))
    return F.when(validation.isNotNull(), F.array_join(shown, ";"))


def _query_shown(query: Column) -> Column:
    shown = F.transform(
        F.map_entries(query), lambda q: F.concat(q["key"], F.lit("="), F.array_join(q["value"], ","))
    )
    return F.array_join(shown, "&")


def s7_reject_records(spark: SparkSession, sf: str) -> DataFrame:
    return reports.reject_records(_classified(spark, sf)).select(
        "type", "code", _failures_shown(F.col("validation")).alias("validation"),
        _query_shown(F.col("query")).alias("query"),
        F.col("status").cast("bigint").alias("status"), "error", "message", "validation_context",
        "instance_path", "request_method", "request_url", "user_agent", "remote_ip", "referer",
        "content_type", "site_uuid", "request_body",
    )


# --- admission ------------------------------------------------------------------


def v1_body_size_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf)
    return df.select("row_id", admission.too_large(F.col("body")).alias("too_large"))


def v2_client_ip(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf)
    return df.select(
        "row_id",
        admission.client_ip().alias("client_ip"),
        admission.client_ip(Settings(trust_proxy=False)).alias("peer_ip"),
    )


def v3_hmac_verify(spark: SparkSession, sf: str) -> DataFrame:
    df = admission.verify_signature(dataset.signed_requests(spark, sf), dataset.SIGNING_SECRET)
    return df.select(
        "row_id", "hmac_valid", "hmac_error", "cleaned_url"
    )


def v3a_hmac_sha1_b64url(spark: SparkSession, sf: str) -> DataFrame:
    key = signing.hmac_key(spark, dataset.SIGNING_SECRET)
    df = dataset.requests(spark, sf)
    digest = signing.hmac_sha1(F.concat(F.col("url"), F.lit("&e="), F.col("row_id")), key)
    return df.select("row_id", signing.base64_url(digest).alias("signature"))


def v3b_timestamp_window(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.signed_requests(spark, sf)
    signed = clock.epoch_seconds_to_millis(F.regexp_extract("url", "[?&]t=([^&]*)", 1))
    df = df.select("row_id", "received_at", signed.alias("signed_ms"))
    return df.select(
        "row_id", clock.timestamp_error(F.col("signed_ms"), F.col("received_at")).alias("error")
    )


def v3c_split_signed_url(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.signed_requests(spark, sf).withColumn(
        "pairs", urls.query_pairs(urls.query_of(F.col("url")))
    )
    parts = urls.split_signed_url(F.col("url"), F.col("pairs"))
    return df.select(
        "row_id", parts["hmac"].isNotNull().alias("has_hmac"), parts["t"].alias("t"),
        parts["validation_url"].alias("validation_url"), parts["cleaned_url"].alias("cleaned_url"),
    )


def v3d_hmac_policy(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.signed_requests(spark, sf)
    columns = ["row_id", "hmac_status", "hmac_message", "effective_url"]
    modes_ = {"enforce": SECRET, "log_only": LOG_ONLY, "disabled": Settings()}
    parts = [
        admission.apply_hmac_policy(df, settings).select(F.lit(mode).alias("mode"), *columns)
        for mode, settings in modes_.items()
    ]
    return parts[0].union(parts[1]).union(parts[2])


def _verdicts(spark: SparkSession, sf: str, context: str) -> DataFrame:
    return (
        _classified(spark, sf)
        .filter(F.col("context") == context)
        .select("row_id", F.col("status").cast("bigint").alias("status"), "path", "message")
    )


def v4_validate_body(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, "body")


def v5_validate_query(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf)
    pairs = urls.query_pairs(urls.query_of(F.col("url")), decode=urls.lenient_decode)
    df = df.select("row_id", pairs.alias("pairs"))
    df = df.select("row_id", admission.query_failure(F.col("pairs")).alias("failure"))
    return df.select("row_id", F.col("failure.path").alias("path"), F.col("failure.message").alias("message"))


def v6_validate_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, "headers")


def v7_classify_request(spark: SparkSession, sf: str) -> DataFrame:
    df = admission.classify_requests(dataset.requests(spark, sf))
    return df.select(
        "row_id", "outcome", F.col("status").cast("bigint").alias("status"), "context", "path",
        "message",
    )


def v8_validate_raw(spark: SparkSession, sf: str) -> DataFrame:
    return rawcheck.validate_raw(_messages(spark, sf)).select("row_id", "error")


def v9_field_validators(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf)
    site = F.col("http_headers")["x-site-uuid"]
    stamp = F.regexp_extract("body", '"timestamp":"([^"]*)"', 1)
    member = F.regexp_extract("body", '"member_uuid":"([^"]*)"', 1)
    agent = F.col("http_headers")["user-agent"]
    return df.select(
        "row_id",
        F.coalesce(text.is_guid(site), F.lit(False)).alias("is_guid"),
        text.is_iso_millis(stamp).alias("is_iso_millis"),
        text.is_guid_or_undefined(member).alias("is_guid_or_undefined"),
        text.is_nonblank(agent).alias("is_nonblank"),
        text.is_nonempty(agent).alias("is_nonempty"),
    )


def v10_coerce_request(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("hit")
    return _classified(spark, sf).filter(F.col("outcome") == "accepted").select(
        "row_id",
        *[hit[name].alias(name) for name in ("version", "location", "referrer", "gift_link")],
        *[hit[name].alias(name) for name in ("utm_source", "utm_campaign", "utm_term", "utm_content")],
        hit["parsedReferrer"]["source"].alias("sent_source"),
    )


def v11_check_processed(spark: SparkSession, sf: str) -> DataFrame:
    return reports.contract_report(_processed(spark, sf))


def f1_filter_bots(spark: SparkSession, sf: str) -> DataFrame:
    df = admission.drop_bots(dataset.requests(spark, sf))
    return df.select("row_id", F.col("http_headers")["user-agent"].alias("agent"))


def f2_drop_bot_device(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf).select("row_id", F.col("http_headers")["user-agent"].alias("agent"))
    df = enrich.parse_user_agent(df, F.col("agent"))
    nested = df.withColumn("payload", F.struct("device"))
    return enrich.drop_bot_device(nested).select("row_id", "os", "browser", "device")


# --- projections ----------------------------------------------------------------


def p1_apply_defaults(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.col("payload")
    return _raw(spark, sf).select(
        F.col("timestamp").alias("event_time"),
        F.col("site_uuid"),
        payload["referrer"].alias("referrer"),
        payload["gift_link"].alias("gift_link"),
        payload["parsedReferrer"].isNotNull().alias("has_referrer"),
        payload["parsedReferrer"]["url"].alias("sent_url"),
        *[payload[name].alias(name) for name in ("utm_source", "utm_medium", "utm_term")],
    )


def p2_resolve_event_id(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("hit")
    event_id = text.resolve_event_id(hit["event_id_type"], hit["event_id"], _seed())
    return _classified(spark, sf).filter(F.col("outcome") == "accepted").select(
        "row_id", event_id.alias("event_id")
    )


def p3_to_raw(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.col("payload")
    names = ["event_id", "member_uuid", "member_status", "post_uuid", "post_type", "gift_link",
             "locale", "location", "referrer", "pathname", "href", "utm_source", "utm_medium",
             "utm_campaign", "utm_term", "utm_content"]
    raw = hits.to_raw(_classified(spark, sf), event_id_seed=_seed())
    return raw.select(
        F.col("timestamp").alias("event_time"), "action", "version", "site_uuid",
        *[payload[name].alias(name) for name in names],
        payload["meta"]["received_timestamp"].alias("received"),
        F.col("meta.ip").alias("ip"),
        F.col("meta.user-agent").alias("agent"),
    )


def p4_received_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("http_headers")["x-analytics-start"]
    df = dataset.requests(spark, sf).select("row_id", F.timestamp_millis(clock.epoch_millis(start)).alias("at"))
    return df.select("row_id", clock.iso_millis(F.col("at")).alias("received"))


def p5_server_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.requests(spark, sf).select(
        "row_id", clock.server_timestamp(F.col("received_at")).alias("event_time")
    )


def p6_to_processed(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_processed(spark, sf))


def p7_parse_user_agent(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf).select("row_id", F.col("http_headers")["user-agent"].alias("agent"))
    return enrich.parse_user_agent(df, F.col("agent")).select("row_id", "os", "browser", "device")


def _referrers(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    raw = _raw(spark, sf).select(
        F.col("payload.event_id").alias("event_id"), F.col("payload.parsedReferrer").alias("parsed")
    )
    df = enrich.parse_referrer(raw, F.col("parsed"), enrich.known_domains(spark), settings)
    hosts = enrich.parse_referrer(
        df.drop("referrerSource", "referrerMedium").withColumnRenamed("referrerUrl", "referrer_url"),
        F.col("parsed"), enrich.known_domains(spark), settings, host_only=True,
    )
    return hosts.select(
        "event_id", "referrer_url", F.col("referrerUrl").alias("referrer_host"),
        F.col("referrerSource").alias("referrer_source"),
        F.col("referrerMedium").alias("referrer_medium"),
    )


def p8_parse_referrer(spark: SparkSession, sf: str) -> DataFrame:
    return _referrers(spark, sf, Settings())


def p8_parse_referrer_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return _referrers(spark, sf, SHUFFLED)


def _signatures(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    signed = enrich.attach_signature(
        _raw(spark, sf), dataset.fixture_salts(spark, sf), enrich.event_day(F.col("timestamp")), settings
    )
    return signed.select(F.col("payload.event_id").alias("event_id"), "session_id")


def p9_session_signature(spark: SparkSession, sf: str) -> DataFrame:
    return _signatures(spark, sf, Settings())


def p9_session_signature_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return _signatures(spark, sf, SHUFFLED)


def p10_filter_query_params(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf)
    return df.select("row_id", urls.filter_query_params(F.col("url")).alias("filtered"))


def p11_rewrite_forward_query(spark: SparkSession, sf: str) -> DataFrame:
    df = _classified(spark, sf).filter(F.col("outcome") == "accepted").select(
        "row_id", urls.query_pairs(urls.query_of(F.col("url")), decode=urls.lenient_decode).alias("pairs")
    )
    pairs = F.col("pairs")
    return df.select(
        "row_id",
        urls.rewrite_forward_query(pairs, drop_token=False, wait=False).alias("kept"),
        urls.rewrite_forward_query(pairs, drop_token=True, wait=True).alias("rewritten"),
    )


def p12_trace_context(spark: SparkSession, sf: str) -> DataFrame:
    headers = F.col("http_headers")
    trace = tracing.trace_context(headers["x-cloud-trace-context"], headers["traceparent"], "shop")
    return dataset.requests(spark, sf).select(
        "row_id", *[column.alias(name) for name, column in trace.items()]
    )


def p13_request_log_row(spark: SparkSession, sf: str) -> DataFrame:
    return reports.request_log(dataset.requests(spark, sf), TRACED)


# --- salts ------------------------------------------------------------------------


def _some(salt_rows: DataFrame) -> DataFrame:
    """Salts of the sites with an even last digit."""
    return salt_rows.filter(F.col("site_uuid").rlike("[02468]$"))


def k1_salt_key(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf)
    key = saltkeys.salt_key(F.to_date("received_at"), F.col("http_headers")["x-site-uuid"])
    return df.select("row_id", key.alias("key"))


def k2_get_or_create_salts(spark: SparkSession, sf: str) -> DataFrame:
    store = SaltStore(spark, workspace(spark, "salts"))
    known = dataset.fixture_salts(spark, sf)
    store.append(_some(known))
    wanted = salts.wanted_keys(_raw(spark, sf), enrich.event_day(F.col("timestamp")))
    store.get_or_create(wanted)
    store.get_or_create(wanted)
    after = store.load().select("key", F.col("salt").alias("now"))
    kept = known.select("key", F.col("salt").alias("before"))
    return after.join(kept, "key", "left").select(
        "key",
        (F.length("now") == 64).alias("is_complete"),
        (F.col("now") == F.col("before")).alias("is_kept"),
    )


def k3_get_salt(spark: SparkSession, sf: str) -> DataFrame:
    known = dataset.fixture_salts(spark, sf)
    found = salts.get_salts(known.select("key"), _some(known))
    return found.select("key", "salt", clock.iso_millis(F.col("created_at")).alias("created"))


def k4_get_all_salts(spark: SparkSession, sf: str) -> DataFrame:
    df = salts.all_salts(_store(spark, sf).load())
    return df.select("key", "salt", clock.iso_millis(F.col("created_at")).alias("created"))


def k5_set_salts(spark: SparkSession, sf: str) -> DataFrame:
    known = dataset.fixture_salts(spark, sf)
    store = SaltStore(spark, workspace(spark, "salts"))
    store.insert(_some(known))
    try:
        store.insert(known)
        refused = False
    except salts.SaltExists:
        refused = True
    return store.load().select("key", "salt", F.lit(refused).alias("second_refused"))


def k6_delete_salts(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, sf)
    store.delete(_some(store.load()).select("key"))
    return _salt_view(store.load())


def k7_clear_salts(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, sf)
    before = store.load().count()
    store.clear()
    return store.load().agg(F.count("*").alias("after")).select(
        F.lit(before).cast("bigint").alias("before"), "after"
    )


CLEANUP_AT = "2024-01-15 13:30:00"


def k8_cleanup_salts(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, sf)
    deleted = store.cleanup(F.lit(CLEANUP_AT).cast("timestamp"))
    return store.load().select("key", F.lit(deleted).cast("bigint").alias("deleted_count"))


def k9_salt_expiry(spark: SparkSession, sf: str) -> DataFrame:
    df = dataset.requests(spark, sf)
    site = F.coalesce(F.col("http_headers")["x-site-uuid"], F.lit("none"))
    key = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("odd:"), site)).otherwise(
        saltkeys.salt_key(F.to_date("received_at"), site)
    )
    expiry = saltkeys.expires_at(key, F.col("received_at"))
    return df.select("row_id", clock.iso_millis(expiry).alias("expires"))


# --- streaming --------------------------------------------------------------------


def m1_outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = reports.outcome_counts(_classified(spark, sf))
    return counts.select(
        "outcome", F.col("status").cast("bigint").alias("status"), "site_uuid",
        F.date_format("day", "yyyy-MM-dd").alias("day"), "requests",
    )


def t1_enrich_stream(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _drained(spark, sf)
    lines = spark.read.schema("timestamp string, site_uuid string, session_id string, payload struct<event_id: string, os: string, device: string, referrerSource: string>").json(f"{out}/events")
    return lines.select(
        F.col("timestamp").alias("event_time"), "site_uuid", "session_id",
        F.col("payload.event_id").alias("event_id"), F.col("payload.os").alias("os"),
        F.col("payload.device").alias("device"),
        F.col("payload.referrerSource").alias("referrer_source"),
    )


def t2_flush_policy(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace(spark, "chunks")
    sinks.write_events_ndjson(_processed(spark, sf), path, lines_per_file=50)
    files = (
        sinks.read_events_ndjson(spark, path)
        .groupBy(F.input_file_name().alias("file"))
        .agg(F.count("*").alias("lines"))
    )
    return files.agg(
        F.sum("lines").alias("events"), (F.max("lines") <= 50).alias("within_cap")
    )


def t5_admission_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the admission worker writes, one row per document."""
    root = workspace(spark, "admission")
    admission_worker.start_admission(
        dataset.request_stream(spark, sf), f"{root}/out", f"{root}/checkpoint",
        event_id_seed=_seed(), drain=True,
    ).awaitTermination()
    documents = admission_worker.read_outputs(spark, f"{root}/out")
    value = F.try_parse_json("value")

    def at(where: str) -> Column:
        return F.try_variant_get(value, where, "string")

    return documents.select(
        "output",
        at("$.outcome").alias("outcome"),
        F.try_variant_get(value, "$.status", "bigint").alias("status"),
        at("$.message").alias("message"),
        at("$.code").alias("code"),
        at("$.request_url").alias("request_url"),
        at("$.request_id").alias("request_id"),
        F.coalesce(at("$.remote_ip"), at("$.meta.ip")).alias("ip"),
        at("$.site_uuid").alias("site_uuid"),
        F.coalesce(at("$.user_agent"), at("$.meta['user-agent']")).alias("agent"),
        at("$.payload.event_id").alias("event_id"),
        at("$.payload.href").alias("href"),
        at("$.timestamp").alias("event_time"),
    )


def t3_delivery(spark: SparkSession, sf: str) -> DataFrame:
    root = workspace(spark, "replay")
    store = SaltStore(spark, f"{root}/salts")
    messages = _messages(spark, sf)
    for _ in range(2):
        worker.process_batch(
            messages, 7, f"{root}/out", store, enrich.known_domains(spark),
            enrich.event_day(F.col("timestamp")),
        )
    delivered = sinks.read_events_ndjson(spark, f"{root}/out/events")
    counts = spark.read.schema("messages long, parse_failures long, bots long, events long").json(
        f"{root}/out/counts"
    )
    return counts.select(
        "messages", "parse_failures", "bots", "events",
        F.lit(delivered.count()).cast("bigint").alias("delivered"),
    )


def t4_batch_proxy_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(
        modes.process_inline(
            dataset.requests(spark, sf), dataset.fixture_salts(spark, sf),
            enrich.known_domains(spark), event_id_seed=_seed(),
        )
    )


def traffic_by_site_and_device(spark: SparkSession, sf: str) -> DataFrame:
    processed = modes.process_inline(
        dataset.requests(spark, sf), dataset.fixture_salts(spark, sf), enrich.known_domains(spark)
    )
    return modes.traffic(processed)


def registered() -> dict[str, Query]:
    prefixes = ("s", "v", "f", "p", "k", "m", "t")
    return {
        name: function
        for name, function in globals().items()
        if callable(function)
        and not name.startswith("_")
        and (name == "traffic_by_site_and_device" or (name[0] in prefixes and name[1].isdigit()))
    }
