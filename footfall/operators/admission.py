"""Request admission: size, JSON, signature, schema and bot checks.

:func:`classify_requests` keeps every request and says what becomes of it. All
checks are column expressions over one row, so it adds no shuffle; the checks of
one part run in order and stop at the first broken rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import rules, schemas
from ..config import Settings
from ..functions import agents, signing, urls
from ..functions.clock import epoch_seconds_to_millis, timestamp_error
from ..functions.once import once
from ..functions.text import none_if_empty
from . import documents
from .documents import Members
from .metrics import counted

ROOT_MEMBERS = ["timestamp", "action", "version", "session_id", "payload"]
PAYLOAD_MEMBERS = [
    "event_id", "user-agent", "locale", "location", "referrer", "parsedReferrer", "pathname",
    "href", "site_uuid", "post_uuid", "post_type", "gift_link", "member_uuid", "member_status",
    *schemas.UTM,
]
REFERRER_MEMBERS = ["source", "medium", "url"]
OPTIONAL_TEXTS = ["referrer", "gift_link", *schemas.UTM]

VERDICT = ["outcome", "status", "context", "path", "message", "validation"]


def header(name: str) -> Column:
    """A request header without the blanks HTTP allows around its value."""
    return F.trim(F.col("http_headers")[name], F.lit(" \t"))


def too_large(body: Column) -> Column:
    """V1: more bytes than a page hit may have."""
    return F.coalesce(F.octet_length(body) > rules.MAX_BODY_BYTES, F.lit(False))


def client_ip(settings: Settings = Settings()) -> Column:
    """V2: left-most forwarded address behind a trusted proxy, else the peer's."""
    if not settings.trust_proxy:
        return F.col("remote_ip")
    first = F.trim(F.substring_index(F.col("http_headers")["x-forwarded-for"], ",", 1))
    return F.coalesce(none_if_empty(first), F.col("remote_ip"))


# --- body -----------------------------------------------------------------------


PLACES = {
    name: place
    for place, name in enumerate(
        [*[f"/{n}" for n in ROOT_MEMBERS], *PAYLOAD_MEMBERS, *[f"referrer/{n}" for n in REFERRER_MEMBERS]]
    )
}
ROOT = Members("_members", {n: PLACES[f"/{n}"] for n in ROOT_MEMBERS}, "", True)
PAYLOAD = Members("_members", {n: PLACES[n] for n in PAYLOAD_MEMBERS}, "/payload", True)
REFERRER = Members(
    "_members", {n: PLACES[f"referrer/{n}"] for n in REFERRER_MEMBERS}, "/payload/parsedReferrer", True
)


@once
def _body_members() -> list[documents.Member]:
    opened = {"/payload": F.col("_payload"), "parsedReferrer": F.col("_parts")}
    sources = [
        *[("/" + n, F.col(f"_root.`{n}`")) for n in ROOT_MEMBERS],
        *[(n, F.col(f"_payload.`{n}`")) for n in PAYLOAD_MEMBERS],
        *[(f"referrer/{n}", F.col(f"_parts.`{n}`")) for n in REFERRER_MEMBERS],
    ]
    return [documents.Member(value, opened.get(name)) for name, value in sources]


@once
def _described() -> Column:
    care = documents.needs_care(F.col("_text"))
    return documents.describe_coerced(_body_members(), F.col("_kinds"), care)


def open_body(df: DataFrame) -> DataFrame:
    """Parse the body and describe its members in ``_members``, with coercion."""
    # Bodies over the limit are refused unread.
    df = df.withColumn("_text", F.when(~too_large(F.col("body")), F.col("body")))
    df = documents.parse_document(df, "_text", "_doc")
    doc = F.col("_doc")
    df = df.withColumns(
        {
            "_root": documents.open_object(doc, "$", ROOT_MEMBERS),
            "_payload": documents.open_object(doc, "$.payload", PAYLOAD_MEMBERS),
        }
    )
    parts = documents.open_object(F.col("_payload.parsedReferrer"), "$", REFERRER_MEMBERS)
    df = df.withColumn("_parts", parts)
    df = df.withColumn("_kinds", documents.kinds_of(_body_members()))
    # An event id is kept or replaced by its own JSON type, so it is never coerced.
    event_id = F.col("_payload.event_id")
    is_object = F.when(F.col("_root").isNotNull(), "OBJECT<").otherwise("OTHER")
    return df.withColumns(
        {
            "_body_type": F.when(doc.isNotNull(), is_object),
            "_members": _described(),
            "_event_id_type": F.schema_of_variant(event_id),
            "_event_id_text": F.try_variant_get(event_id, "$", "string"),
        }
    ).drop("_text", "_doc", "_root", "_payload", "_parts", "_kinds")


@once
def body_checks() -> list[documents.Check]:
    """V4: rules on the body, in the order in which they are reported."""
    parsed_kind = PAYLOAD.kind("parsedReferrer")
    referrer = [
        *REFERRER.object(parsed_kind),
        *REFERRER.required(*REFERRER_MEMBERS),
        *[c for n in REFERRER_MEMBERS for c in documents.either(REFERRER.string(n), "null")],
    ]
    # Null and the empty text both count as an unknown location.
    unknown = F.coalesce(PAYLOAD.text("location") == "", F.lit(False))

    def optional(name: str) -> list[documents.Check]:
        return documents.either(PAYLOAD.optional(name, PAYLOAD.string(name)), "null")

    return [
        *ROOT.object(F.col("_body_type")),
        *ROOT.required("timestamp", "action", "version", "payload"),
        *ROOT.iso_millis("timestamp"),
        *ROOT.constant("action", rules.ACTION),
        *ROOT.constant("version", rules.VERSION),
        *ROOT.optional("session_id", ROOT.string("session_id")),
        *PAYLOAD.object(ROOT.kind("payload")),
        *PAYLOAD.required(
            "user-agent", "locale", "location", "pathname", "href", "site_uuid",
            "post_uuid", "post_type", "member_uuid", "member_status",
        ),
        *PAYLOAD.nonblank("user-agent"),
        *PAYLOAD.nonblank("locale"),
        *documents.either(documents.when(~unknown, PAYLOAD.nonblank("location")), "null"),
        *optional("referrer"),
        *documents.when(parsed_kind.isNotNull(), referrer),
        *PAYLOAD.nonblank("pathname"),
        *PAYLOAD.string("href"),
        *PAYLOAD.guid("site_uuid"),
        *PAYLOAD.guid_or_undefined("post_uuid"),
        *PAYLOAD.one_of("post_type", rules.POST_TYPES),
        *optional("gift_link"),
        *PAYLOAD.guid_or_undefined("member_uuid"),
        *documents.either(PAYLOAD.nonblank("member_status"), rules.UNDEFINED),
        *[c for name in schemas.UTM for c in optional(name)],
    ]


@once
def normal_hit() -> Column:
    """The validated payload with defaults for members the client left out.

    A coerced member has a text whenever it was sent, so NULL means absent and is
    its own default; only ``parsedReferrer`` gets a struct of NULLs.
    """
    plain = ["referrer", "pathname", "href", "site_uuid", "post_uuid", "post_type", "gift_link",
             "member_uuid", "member_status", "locale", *schemas.UTM]
    return F.struct(
        ROOT.text("action").alias("action"),
        ROOT.text("version").alias("version"),
        F.col("_event_id_type").alias("event_id_type"),
        F.col("_event_id_text").alias("event_id"),
        *[PAYLOAD.text(name).alias(name) for name in plain],
        none_if_empty(PAYLOAD.text("location")).alias("location"),
        F.struct(*[REFERRER.text(name).alias(name) for name in REFERRER_MEMBERS]).alias("parsedReferrer"),
    )


# --- query string ---------------------------------------------------------------


def query_failure(pairs: Column) -> Column:
    """V5: NULL or struct(path, message, validation) for the first broken query rule.

    A repeated key reaches the schema as a list, which is not a string.
    """
    keys = pairs["key"]
    others = F.array_remove(F.array_remove(keys, "name"), "token")
    repeated = F.size(F.array_distinct(others)) < F.size(others)
    lists = F.filter(
        urls.grouped(pairs), lambda g: ~g["key"].isin("name", "token") & (F.size(g["values"]) > 1)
    )
    twice = F.get(lists, F.lit(0))["key"]
    token = urls.first_value(pairs, "token")
    name = urls.first_value(pairs, "name")

    def count(key: str) -> Column:
        return F.size(keys) - F.size(F.array_remove(keys, key))

    def failure(path: Column | str, keyword: str, params: dict, message: str) -> Column:
        where = F.lit(path) if isinstance(path, str) else path
        text = F.concat(F.lit("querystring"), where, F.lit(f" {message}"))
        entry = documents.failure(where, keyword, documents.rule_values(**params), message)
        return F.struct(
            where.alias("path"), text.alias("message"), F.array(entry).alias("validation")
        )

    def not_text(path: Column | str) -> Column:
        return failure(path, "type", {"type": "string"}, "must be string")

    return (
        F.when(
            count("name") == 0,
            failure(
                "", "required", {"missingProperty": "name"}, "must have required property 'name'"
            ),
        )
        .when(repeated, not_text(F.concat(F.lit("/"), twice)))
        .when(count("token") > 1, not_text("/token"))
        .when(
            token == "",
            failure("/token", "minLength", {"limit": 1}, "must NOT have fewer than 1 characters"),
        )
        .when(
            ~documents.fields.is_nonblank(token),
            failure(
                "/token", "pattern", {"pattern": rules.NONBLANK_PATTERN},
                f'must match pattern "{rules.NONBLANK_PATTERN}"',
            ),
        )
        .when(count("name") > 1, not_text("/name"))
        .when(
            ~name.isin(*rules.EVENT_NAMES),
            failure(
                "/name", "enum", {"allowedValues": list(rules.EVENT_NAMES)},
                "must be equal to one of the allowed values",
            ),
        )
    )


# --- headers --------------------------------------------------------------------


HEADERS = Members(
    "_headers", {"x-site-uuid": 0, "content-type": 1, "user-agent": 2}, "", True
)


def open_headers(df: DataFrame) -> DataFrame:
    """Describe the headers with rules in ``_headers``; a header is a string or missing."""
    values = [header(name) for name in HEADERS.places]
    return df.withColumn(
        "_headers",
        F.array(
            *[
                F.struct(F.when(v.isNotNull(), "STRING").alias("type"), v.alias("text"))
                for v in values
            ]
        ),
    )


@once
def header_checks() -> list[documents.Check]:
    """V6: site id, exact content type and a non-blank user agent."""
    return [
        *HEADERS.required("x-site-uuid", "content-type", "user-agent"),
        *HEADERS.guid("x-site-uuid"),
        *HEADERS.constant("content-type", rules.CONTENT_TYPE),
        *HEADERS.nonblank("user-agent"),
    ]


# --- signed URLs ----------------------------------------------------------------


def verify_signature(df: DataFrame, secret: str) -> DataFrame:
    """V3: check every signed URL against the secret and the arrival time.

    Adds ``hmac_valid``, ``hmac_error`` (NULL if the URL is valid, and also where
    only the signature itself is wrong) and ``cleaned_url``.
    """
    key = signing.hmac_key(df.sparkSession, secret)
    df = df.withColumn("_pairs", urls.query_pairs(urls.query_of(F.col("url"))))
    parts = urls.split_signed_url(F.col("url"), F.col("_pairs"))
    df = df.withColumns({f"_signed_{name}": column for name, column in parts.items()})
    df = df.withColumns(
        {
            "_digest": signing.hmac_sha1(F.col("_signed_validation_url"), key),
            "_time_error": timestamp_error(
                epoch_seconds_to_millis(F.col("_signed_t")), F.col("received_at")
            ),
        }
    )
    error = (
        F.when(F.col("_signed_hmac").isNull(), "HMAC parameter not found")
        .when(F.col("_signed_t").isNull(), "Timestamp (t) parameter not found")
        .otherwise(F.col("_time_error"))
    )
    matches = F.coalesce(
        signing.signature_matches(F.col("_signed_hmac"), F.col("_digest")), F.lit(False)
    )
    return df.withColumns(
        {
            "hmac_valid": matches & error.isNull(),
            "hmac_error": error,
            "cleaned_url": F.col("_signed_cleaned_url"),
        }
    ).drop("_pairs", "_digest", "_time_error", *[f"_signed_{name}" for name in parts])


def apply_hmac_policy(df: DataFrame, settings: Settings) -> DataFrame:
    """V3d: add ``hmac_status``, ``hmac_message`` and the URL used from here on.

    Status is ``disabled``, ``exempt``, ``valid``, ``logged`` or ``refused``; only a
    refused request has a message.
    """
    if not settings.hmac_secret:
        return df.withColumns(
            {
                "hmac_status": F.lit("disabled"),
                "hmac_message": F.lit(None).cast("string"),
                "effective_url": F.col("url"),
            }
        )
    df = verify_signature(df, settings.hmac_secret)
    exempt = F.col("method").isin(*rules.UNSIGNED_METHODS) | F.col("url").startswith(
        rules.UNSIGNED_PREFIX
    )
    bad = "logged" if settings.hmac_log_only else "refused"
    status = F.when(exempt, "exempt").when(F.col("hmac_valid"), "valid").otherwise(bad)
    return df.withColumns(
        {
            "hmac_status": status,
            "hmac_message": F.when(
                status == "refused", F.coalesce(F.col("hmac_error"), F.lit("HMAC validation failed"))
            ),
            "effective_url": F.when(exempt | (status == "refused"), F.col("url")).otherwise(
                F.col("cleaned_url")
            ),
        }
    ).drop("hmac_valid", "hmac_error", "cleaned_url")


# --- verdict --------------------------------------------------------------------


@once
def _body_bad() -> Column:
    return documents.first_broken(body_checks())


@once
def _head_bad() -> Column:
    return documents.first_broken(header_checks())


@once
def _query_bad() -> Column:
    return query_failure(F.col("_query"))


@once
def _stages() -> list[tuple[Column, int, str, Column | str, Column | str, Column | None]]:
    """Failed, status, context, path, message and failures of each stage, in order."""
    body, head = body_checks(), header_checks()
    unparsed = F.col("_body_type").isNull()
    refused = F.col("hmac_status") == "refused"
    return [
        (F.col("_no_route"), 404, "route", "", "Route not found", None),
        (F.col("_size_bad"), 413, "size", "", "Request body is too large", None),
        (unparsed, 400, "json", "", "Body is not valid JSON", None),
        (refused, 401, "hmac", "", F.col("hmac_message"), None),
        (
            F.col("_body_bad").isNotNull(), 400, "body",
            documents.path_at(body, F.col("_body_bad")),
            documents.message_at(body, F.col("_body_bad"), "body", "_members"),
            documents.failures_at(body, F.col("_body_bad"), "_members"),
        ),
        (
            F.col("_query_bad").isNotNull(), 400, "querystring",
            F.col("_query_bad.path"), F.col("_query_bad.message"), F.col("_query_bad.validation"),
        ),
        (
            F.col("_head_bad").isNotNull(), 400, "headers",
            documents.path_at(head, F.col("_head_bad")),
            documents.message_at(head, F.col("_head_bad"), "headers", "_headers"),
            documents.failures_at(head, F.col("_head_bad"), "_headers"),
        ),
    ]


@once
def _stage() -> Column:
    """Number of the first stage that failed."""
    chain = F
    for number, (failed, *_) in enumerate(_stages()):
        chain = chain.when(failed, F.lit(number))
    return chain


@once
def _verdict() -> list[Column]:
    def pick(position: int, otherwise) -> Column:
        chain = F
        for number, entry in enumerate(_stages()):
            if entry[position] is not None:
                chain = chain.when(F.col("_stage") == number, entry[position])
        return chain if otherwise is None else chain.otherwise(otherwise)

    bot = agents.is_bot(HEADERS.text("user-agent"))
    outcome = (
        F.when(F.col("_stage") == 0, "not_found")
        .when(F.col("_stage").isNotNull(), "rejected")
        .when(bot, "bot")
        .otherwise("accepted")
    )
    nothing = F.lit(None).cast("string")
    return [
        outcome.alias("outcome"),
        pick(1, F.lit(202)).alias("status"),
        pick(2, nothing).alias("context"),
        pick(3, nothing).alias("path"),
        pick(4, nothing).alias("message"),
        pick(5, None).alias("validation"),
    ]


def is_hit_route() -> Column:
    """Whether a request is for the page-hit route; other routes and methods are no hits."""
    path = F.regexp_extract("url", r"^([^?#]*)", 1)
    return F.coalesce((F.col("method") == rules.HIT_METHOD) & (path == rules.HIT_PATH), F.lit(False))


def classify_requests(
    requests: DataFrame, settings: Settings = Settings(), observation: Observation | str | None = None
) -> DataFrame:
    """V7: the first failure of every request, or the normalised hit.

    Adds ``client_ip``, ``hmac_status``, ``effective_url``, ``hit`` and the verdict:
    ``outcome`` (accepted, bot, rejected or not_found), ``status``, ``context``, ``path``,
    ``message`` and ``validation``. Order: route, size, JSON, signature, body, query string,
    headers, bot. ``path`` and ``message`` are of the first broken rule; ``validation`` lists
    every failure found up to there: for a choice, those of its branches and its own.
    ``observation`` receives the number of requests per outcome.
    """
    kept = requests.columns
    df = apply_hmac_policy(requests.withColumn("client_ip", client_ip(settings)), settings)
    df = open_headers(open_body(df))

    # The signature hook rewrites the URL late; the query was taken from the original.
    pairs = urls.query_pairs(urls.query_of(F.col("url")), decode=urls.lenient_decode)
    df = df.withColumn("_query", pairs).withColumns(
        {
            "_no_route": ~is_hit_route(),
            "_size_bad": too_large(F.col("body")),
            "_body_bad": _body_bad(),
            "_head_bad": _head_bad(),
            "_query_bad": _query_bad(),
        }
    )

    df = df.withColumn("_stage", _stage())
    verdict = df.select(
        *kept,
        "client_ip",
        "hmac_status",
        "effective_url",
        normal_hit().alias("hit"),
        *_verdict(),
    )
    outcomes = ("accepted", "bot", "rejected", "not_found")
    return counted(
        verdict, {name: F.col("outcome") == name for name in outcomes}, observation
    )


def drop_bots(df: DataFrame, agent: Column | None = None) -> DataFrame:
    """rows whose user agent is not a known bot."""
    return df.filter(~agents.is_bot(header("user-agent") if agent is None else agent))
