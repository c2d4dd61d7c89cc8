"""Records about requests and results: rejects, request log, contract, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..config import Settings
from ..functions import text as fields
from ..functions import urls
from ..functions.text import none_if_empty
from ..functions.tracing import trace_context
from .admission import client_ip, header


def joined_message(validation: Column, context: Column) -> Column:
    """All failures as one text; NULL where there is no list of failures."""
    said = F.transform(
        validation,
        lambda entry: F.concat(context, entry["instance_path"], F.lit(" "), entry["message"]),
    )
    return F.when(validation.isNotNull(), F.array_join(said, ", "))


def sent_query(url: Column) -> Column:
    """The query string as a map from key to the list of its values."""
    pairs = urls.query_pairs(urls.query_of(url), decode=urls.lenient_decode)
    return F.map_from_entries(urls.grouped(pairs))


def reject_columns() -> list[Column]:
    """The members of the record of a rejected request.

    ``validation`` lists the failures of a broken rule, and ``message`` joins them; other
    rejects have no list. ``type`` tells the two apart and ``code`` says which check
    refused the request; a signature is refused without a code.
    """
    context = F.col("context")
    code = (
        F.when(F.col("validation").isNotNull(), "FST_ERR_VALIDATION")
        .when(context == "size", "FST_ERR_CTP_BODY_TOO_LARGE")
        .when(context == "json", "FST_ERR_CTP_INVALID_JSON_BODY")
    )
    kind = F.when(F.col("validation").isNotNull(), "validation_error").otherwise("unhandled_error")
    joined = joined_message(F.col("validation"), context)
    return [
        kind.alias("type"),
        code.alias("code"),
        "status",
        F.when(F.col("status") == 401, "Unauthorized")
        .when(F.col("status") == 413, "Payload Too Large")
        .otherwise("Bad Request")
        .alias("error"),
        F.coalesce(joined, F.col("message")).alias("message"),
        "validation",
        sent_query(F.col("url")).alias("query"),
        F.col("context").alias("validation_context"),
        F.col("path").alias("instance_path"),
        F.col("method").alias("request_method"),
        F.col("effective_url").alias("request_url"),
        header("user-agent").alias("user_agent"),
        F.col("client_ip").alias("remote_ip"),
        header("referer").alias("referer"),
        header("content-type").alias("content_type"),
        header("x-site-uuid").alias("site_uuid"),
        F.col("body").alias("request_body"),
    ]


def reject_records(classified: DataFrame) -> DataFrame:
    """One structured record per rejected request."""
    return classified.filter(F.col("outcome") == "rejected").select(*reject_columns())


def log_columns(settings: Settings = Settings()) -> list[Column]:
    """The members of a request's log row."""
    trace = trace_context(
        F.col("http_headers")["x-cloud-trace-context"],
        F.col("http_headers")["traceparent"],
        settings.trace_project,
    )
    size = none_if_empty(header("content-length"))
    return [
        F.col("method").alias("request_method"),
        F.col("url").alias("request_url"),
        header("user-agent").alias("user_agent"),
        client_ip(settings).alias("remote_ip"),
        header("referer").alias("referer"),
        F.coalesce(size, F.lit("0")).alias("request_size"),
        none_if_empty(header("x-request-id")).alias("request_id"),
        none_if_empty(header("x-site-uuid")).alias("site_uuid"),
        *[column.alias(name) for name, column in trace.items()],
    ]


def request_log(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One log row per request, with its trace context."""
    return requests.select(*log_columns(settings))


def _contract() -> list[tuple[str, Column]]:
    payload = F.col("payload")

    def must(holds: Column) -> Column:
        return F.coalesce(holds, F.lit(False))

    def or_null(value: Column, holds: Column) -> Column:
        return value.isNull() | holds

    stamp = payload["meta"]["received_timestamp"]
    return [
        ("timestamp", must(fields.is_iso_millis(F.col("timestamp")))),
        ("action", must(F.col("action") == rules.ACTION)),
        ("version", must(F.col("version") == rules.VERSION)),
        ("site_uuid", must(fields.is_guid(F.col("site_uuid")))),
        ("session_id", F.col("session_id").isNotNull()),
        ("payload.event_id", must(fields.is_guid(payload["event_id"]))),
        ("payload.site_uuid", must(fields.is_guid(payload["site_uuid"]))),
        ("payload.member_uuid", must(fields.is_guid_or_undefined(payload["member_uuid"]))),
        ("payload.member_status", must(fields.is_nonempty(payload["member_status"]))),
        ("payload.post_uuid", must(fields.is_guid_or_undefined(payload["post_uuid"]))),
        ("payload.post_type", must(payload["post_type"].isin(*rules.POST_TYPES))),
        ("payload.locale", must(fields.is_nonempty(payload["locale"]))),
        ("payload.location", or_null(payload["location"], fields.is_nonempty(payload["location"]))),
        ("payload.pathname", must(fields.is_nonempty(payload["pathname"]))),
        *[
            (f"payload.{name}", payload[name].isNotNull())
            for name in ("href", "os", "browser", "device", "user-agent")
        ],
        ("payload.meta", payload["meta"].isNotNull()),
        ("payload.meta.received_timestamp", or_null(stamp, fields.is_iso_millis(stamp))),
    ]


def check_processed(processed: DataFrame) -> DataFrame:
    """Add ``violations``, the fields of each processed event that break the contract."""
    broken = [F.when(~holds, F.lit(name)) for name, holds in _contract()]
    return processed.withColumn("violations", F.array_compact(F.array(*broken)))


def contract_report(processed: DataFrame) -> DataFrame:
    """Number of violations per field, as one row of sums turned into rows."""
    rules_ = _contract()
    sums = processed.agg(
        *[F.count_if(~holds).alias(f"_{number}") for number, (_, holds) in enumerate(rules_)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(f"_{number}").alias("violations"))
            for number, (name, _) in enumerate(rules_)
        ]
    )
    return sums.select(F.inline(entries))


def outcome_counts(classified: DataFrame) -> DataFrame:
    """M1: requests per outcome, site and UTC day of arrival."""
    return (
        classified.groupBy(
            "outcome",
            "status",
            header("x-site-uuid").alias("site_uuid"),
            F.to_date("received_at").alias("day"),
        )
        .agg(F.count("*").alias("requests"))
    )


