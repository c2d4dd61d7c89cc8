"""DuckDB SQL for the registered queries.

Expected values follow from the moduli that shaped the derived requests; JSON, URLs,
signatures of rules and user agents are not interpreted a second time.
"""

from __future__ import annotations

from . import dataset


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    values = ", ".join(
        "(" + ", ".join([str(i), *[_text(v) for v in row]]) + ")" for i, row in enumerate(rows)
    )
    return f"{name}({columns}) AS (VALUES {values})"


BASE = dataset.duckdb_base()
AGENTS = _rows("agents", "i, agent_text, os, browser, device", dataset.AGENTS)
REFERRERS = _rows("refs", "i, ref_url, ref_host, ref_source, ref_medium", dataset.REFERRERS)

# code -> status, context, path, message; codes are in order of precedence
VERDICTS = [
    ("e % 163 = 0 OR e % 157 = 0", 404, "route", "", "Route not found"),
    ("e % 1009 = 0", 413, "size", "", "Request body is too large"),
    ("e % 61 = 0 OR e % 113 = 0", 400, "json", "", "Body is not valid JSON"),
    ("e % 73 = 0", 400, "body", "/timestamp", 'body/timestamp must match format "date-time"'),
    ("e % 71 = 0", 400, "body", "/action", "body/action must be equal to constant"),
    ("e % 131 = 0", 400, "body", "/payload", "body/payload must have required property 'locale'"),
    ("e % 59 = 0", 400, "body", "/payload/parsedReferrer", "body/payload/parsedReferrer must have required property 'source'"),
    ("e % 67 = 0", 400, "body", "/payload/post_type", "body/payload/post_type must be equal to one of the allowed values"),
    ("e % 107 = 0", 400, "body", "/payload/utm_term", "body/payload/utm_term must be string"),
    ("e % 109 = 0", 400, "querystring", "", "querystring must have required property 'name'"),
    ("e % 139 = 0", 400, "querystring", "/x", "querystring/x must be string"),
    ("e % 137 = 0", 400, "querystring", "/token", "querystring/token must NOT have fewer than 1 characters"),
    ("e % 101 = 0", 400, "querystring", "/token", 'querystring/token must match pattern "^.*\\S.*$"'),
    ("e % 103 = 0", 400, "querystring", "/name", "querystring/name must be string"),
    ("e % 79 = 0", 400, "querystring", "/name", "querystring/name must be equal to one of the allowed values"),
    ("e % 149 = 0", 400, "headers", "", "headers must have required property 'x-site-uuid'"),
    ("e % 97 = 0", 400, "headers", "/x-site-uuid", 'headers/x-site-uuid must match format "uuid"'),
    ("e % 83 = 0", 400, "headers", "/content-type", "headers/content-type must be equal to constant"),
    ("e % 89 = 0", 400, "headers", "/user-agent", "headers/user-agent must NOT have fewer than 1 characters"),
]


# condition -> keyword, params and message of each failure, where a rule is broken
_ENUM = "must be equal to one of the allowed values"
FAILURES = {
    "e % 73 = 0": [("format", '{"format":"date-time"}', 'must match format "date-time"')],
    "e % 71 = 0": [("const", '{"allowedValue":"page_hit"}', "must be equal to constant")],
    "e % 131 = 0": [("required", '{"missingProperty":"locale"}', "must have required property 'locale'")],
    "e % 59 = 0": [("required", '{"missingProperty":"source"}', "must have required property 'source'")],
    "e % 67 = 0": [("enum", '{"allowedValues":["null","post","page"]}', _ENUM)],
    "e % 107 = 0": [
        ("type", '{"type":"string"}', "must be string"),
        ("type", '{"type":"null"}', "must be null"),
        ("anyOf", "{}", "must match a schema in anyOf"),
    ],
    "e % 109 = 0": [("required", '{"missingProperty":"name"}', "must have required property 'name'")],
    "e % 139 = 0": [("type", '{"type":"string"}', "must be string")],
    "e % 137 = 0": [("minLength", '{"limit":1}', "must NOT have fewer than 1 characters")],
    "e % 101 = 0": [("pattern", '{"pattern":"^.*\\\\S.*$"}', 'must match pattern "^.*\\S.*$"')],
    "e % 103 = 0": [("type", '{"type":"string"}', "must be string")],
    "e % 79 = 0": [("enum", '{"allowedValues":["analytics_events","analytics_events_test"]}', _ENUM)],
    "e % 149 = 0": [("required", '{"missingProperty":"x-site-uuid"}', "must have required property 'x-site-uuid'")],
    "e % 97 = 0": [("format", '{"format":"uuid"}', 'must match format "uuid"')],
    "e % 83 = 0": [("const", '{"allowedValue":"application/json"}', "must be equal to constant")],
    "e % 89 = 0": [("minLength", '{"limit":1}', "must NOT have fewer than 1 characters")],
}


def _failures(shown) -> str:
    """CASE over the verdicts with what ``shown`` makes of context, path and failures."""
    arms = " ".join(
        f"WHEN {condition} THEN {_text(shown(context, path, FAILURES.get(condition)))}"
        for condition, _, context, path, _ in VERDICTS
    )
    return f"CASE {arms} END"


VALIDATION = _failures(
    lambda context, path, found: found and ";".join("|".join([path, *entry]) for entry in found)
)
JOINED = _failures(
    lambda context, path, found: found and ", ".join(f"{context}{path} {entry[2]}" for entry in found)
)
SENT_QUERY = """concat_ws('&',
 CASE WHEN e % 109 = 0 THEN NULL WHEN e % 103 = 0 THEN 'name=analytics_events,analytics_events'
  WHEN e % 79 = 0 THEN 'name=nope' ELSE 'name=analytics_events' END,
 CASE WHEN e % 137 = 0 THEN 'token=' WHEN e % 101 = 0 THEN 'token= ' WHEN u % 5 <> 0 THEN 'token=tok' || (u % 10) END,
 CASE WHEN e % 139 = 0 THEN 'x=1,2' WHEN e % 3 = 0 THEN 'x=a b' END)"""


def _case(position: int, wrap=lambda v: _text(v), only: str | None = None) -> str:
    arms = " ".join(
        f"WHEN {entry[0]} THEN {wrap(entry[position])}"
        for entry in VERDICTS
        if only is None or entry[2] == only
    )
    return f"CASE {arms} END"


IS_BOT = "(e % 89 <> 0 AND e % 12 IN (7, 8, 9))"
CLIENT = "CASE WHEN u % 3 = 0 THEN '203.0.113.' || (u % 250) ELSE remote_ip END"
SITE_HEADER = "CASE WHEN e % 149 = 0 THEN NULL WHEN e % 97 = 0 THEN 'not-a-uuid' ELSE site END"
CONTENT_TYPE = "CASE WHEN e % 83 = 0 THEN 'application/json; charset=utf-8' ELSE 'application/json' END"
REFERER = "CASE WHEN e % 4 = 0 THEN href END"
DAY = "substr(iso, 1, 10)"
SALT = f"sha256('fixture-salt:' || {DAY} || ':' || site)"
HASH = "sha256(CAST(e AS VARCHAR))"
MADE_ID = (
    f"substr({HASH}, 1, 8) || '-' || substr({HASH}, 9, 4) || '-4' || substr({HASH}, 14, 3)"
    f" || '-8' || substr({HASH}, 18, 3) || '-' || substr({HASH}, 21, 12)"
)

VERDICT = f"""verdict AS (SELECT *, {CLIENT} AS client, {_case(1, str)} AS bad_status,
 {_case(2)} AS context, {_case(3)} AS path, {_case(4)} AS message,
 {SITE_HEADER} AS site_header, {DAY} AS day, trim(agent) AS shown_agent FROM base)"""

OUTCOME = f"CASE WHEN bad_status = 404 THEN 'not_found' WHEN bad_status IS NOT NULL THEN 'rejected' WHEN {IS_BOT} THEN 'bot' ELSE 'accepted' END"

ACCEPTED = f"""accepted AS (SELECT * EXCLUDE (event_id),
 CASE WHEN e % 11 = 0 OR e % 13 = 0 OR e % 17 = 0 THEN {MADE_ID} ELSE 'evt-' || e END AS event_id,
 CASE WHEN k % 5 > 1 THEN 'US' END AS location,
 CASE u % 6 WHEN 0 THEN '' WHEN 1 THEN referrer_url END AS referrer,
 CASE WHEN e % 29 = 0 THEN 'gift-' || e WHEN e % 31 = 0 THEN '' END AS gift_link,
 CASE k % 3 WHEN 0 THEN 'newsletter' WHEN 1 THEN '' END AS utm_source,
 CASE WHEN k % 3 = 0 THEN 'email' END AS utm_medium,
 CASE WHEN e % 5 = 0 THEN '2024' END AS utm_campaign,
 CASE WHEN e % 33 = 0 THEN 'one' END AS utm_term,
 CASE WHEN e % 10 = 0 THEN 'true' END AS utm_content,
 CASE k % 4 WHEN 0 THEN referrer_url WHEN 1 THEN '' END AS sent_url,
 CASE k % 4 WHEN 0 THEN CASE WHEN e % 3 = 0 THEN 'Partner' ELSE '' END WHEN 1 THEN '' END AS sent_source,
 CASE k % 4 WHEN 0 THEN CASE WHEN e % 5 = 0 THEN 'paid' ELSE '' END WHEN 1 THEN '' END AS sent_medium,
 CASE WHEN e % 23 <> 0 AND e % 7 <> 0 THEN strftime(make_timestamp((received_ms - 250) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS received,
 sha256({SALT} || ':' || site || ':' || client || ':' || agent) AS session_id
 FROM verdict WHERE {OUTCOME} = 'accepted')"""

PROCESSED = """processed AS (SELECT a.*, g.os, g.browser, g.device,
 CASE WHEN sent_url <> '' THEN sent_url END AS out_url,
 CASE WHEN sent_url <> '' THEN ref_host END AS out_host,
 CASE WHEN sent_url <> '' THEN coalesce(nullif(sent_source, ''), ref_source) END AS out_source,
 CASE WHEN sent_url <> '' THEN coalesce(nullif(sent_medium, ''), ref_medium) END AS out_medium
 FROM accepted a JOIN agents g ON g.i = a.e % 12 JOIN refs r ON r.i = a.e % 8)"""

MESSAGE_ERROR = """CASE WHEN e % 41 = 0 OR e % 43 = 0 THEN 'invalid JSON'
 WHEN e % 47 = 0 THEN 'data/version must be string'
 WHEN e % 53 = 0 THEN 'data/payload/locale must be string'
 WHEN e % 37 = 0 THEN 'data/payload must have required property ''href'''
 WHEN e % 31 = 0 THEN 'data/meta/ip must NOT have fewer than 1 characters' END"""

SALTS = f"""salts AS (SELECT DISTINCT 'salt:' || {DAY} || ':' || site AS key, {DAY} AS salt_day,
 site AS site_uuid, {SALT} AS salt, {DAY} || 'T00:00:00.000Z' AS created,
 strftime(CAST({DAY} AS DATE) + INTERVAL 2 DAY, '%Y-%m-%dT00:00:00.000Z') AS expires FROM base)"""
EVEN = "regexp_matches(site_uuid, '[02468]$')"

# HMAC by its definition: the key, filled to a block of 64 bytes, against 0x36 and 0x5c.
_BLOCK = dataset.SIGNING_SECRET.encode().ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ mask for b in _BLOCK).hex() for mask in (0x36, 0x5C))


def _hmac(message: str) -> str:
    inner = f"unhex(sha1(unhex('{_INNER}') || encode({message})))"
    return f"replace(replace(to_base64(unhex(sha1(unhex('{_OUTER}') || {inner}))), '+', '-'), '/', '_')"


SIGNED = f"""signed AS (SELECT *, {_hmac('signed_text')} AS sig, e % 47 = 0 AS is_local,
 CASE WHEN e % 43 = 0 THEN 'GET' ELSE 'POST' END AS sent_method,
 CASE WHEN signed_at * 1000 < received_ms - 300000 OR signed_at * 1000 > received_ms + 5000
  THEN 'Timestamp is not within the allowed range' END AS window_error FROM base),
checked AS (SELECT *,
 CASE WHEN is_local THEN '/local-proxy/x?e=' || e WHEN e % 17 = 0 THEN sent_text ELSE sent_text || '&hmac=' ||
  CASE WHEN e % 5 = 0 THEN CASE WHEN sig[1] = 'A' THEN 'B' ELSE 'A' END || substr(sig, 2) ELSE sig END END AS sent_url,
 CASE WHEN e % 17 = 0 THEN 'HMAC parameter not found' WHEN e % 19 = 0 THEN 'Timestamp (t) parameter not found'
  WHEN e % 23 = 0 THEN 'Invalid timestamp' ELSE window_error END AS error FROM signed),
policy AS (SELECT *, is_local OR sent_method = 'GET' AS exempt, error IS NULL AND e % 5 <> 0 AS good FROM checked)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join([BASE, *parts]) + "\n"


FULL = _with(AGENTS, REFERRERS, VERDICT, ACCEPTED, PROCESSED)
HITS = _with(VERDICT, ACCEPTED)
JUDGED = _with(VERDICT)

FLAT = """SELECT iso AS event_time, 'page_hit' AS action, '1' AS version, site AS site_uuid, session_id,
 event_id, member_uuid, member_status, post_uuid, post_type, gift_link, 'en-US' AS locale, location,
 pathname, href, os, browser, device, utm_source, utm_medium, utm_campaign, utm_term, utm_content,
 sent_url, sent_source, sent_medium, out_url AS referrer_url, out_source AS referrer_source,
 out_medium AS referrer_medium, agent, received FROM processed"""

TRACE = """CASE WHEN e % 6 IN (0, 2, 5) THEN 'projects/shop/traces/' || lpad(CAST(e AS VARCHAR), 32, 'a')
 WHEN e % 6 = 3 THEN 'projects/shop/traces/' || lpad(CAST(e AS VARCHAR), 32, 'b') END AS trace,
 CASE e % 6 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '00f067aa0ba902b7' END AS span_id,
 CASE e % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN FALSE END AS sampled"""

DEVICE = """coalesce(os, 'unknown') AS os, coalesce(browser, 'unknown') AS browser,
 coalesce(device, 'unknown') AS device FROM base LEFT JOIN agents ON i = e % 12 AND e % 89 <> 0"""

CONTRACT_FIELDS = [
    "timestamp", "action", "version", "site_uuid", "session_id", "payload.event_id",
    "payload.site_uuid", "payload.member_uuid", "payload.member_status", "payload.post_uuid",
    "payload.post_type", "payload.locale", "payload.location", "payload.pathname", "payload.href",
    "payload.os", "payload.browser", "payload.device", "payload.user-agent", "payload.meta",
    "payload.meta.received_timestamp",
]
_FIELDS = ", ".join(f"({_text(f)})" for f in CONTRACT_FIELDS)

ORACLES = {
    "s1_read_requests": _with() + f"""SELECT method, url, remote_ip, iso AS received,
 length(body) AS body_bytes, {CONTENT_TYPE} AS content_type FROM base""",
    "s2_read_raw_stream": HITS + "SELECT count(*) AS messages FROM accepted",
    "s3_publish_raw": HITS + """SELECT iso AS event_time, site AS site_uuid, event_id, href, client AS ip,
 TRUE AS is_published FROM accepted""",
    "s4_write_events_ndjson": FULL + """SELECT iso AS event_time, session_id, event_id, device,
 out_source AS referrer_source FROM processed""",
    "s5_salt_table_io": _with(SALTS) + "SELECT * FROM salts",
    "s6_dead_letter": HITS + f"""SELECT error, count(*) AS messages FROM
 (SELECT {MESSAGE_ERROR} AS error FROM accepted) WHERE error IS NOT NULL GROUP BY error""",
    "s7_reject_records": JUDGED + f"""SELECT CAST(bad_status AS BIGINT) AS status,
 CASE WHEN context IN ('size', 'json') THEN 'unhandled_error' ELSE 'validation_error' END AS type,
 CASE context WHEN 'size' THEN 'FST_ERR_CTP_BODY_TOO_LARGE' WHEN 'json' THEN 'FST_ERR_CTP_INVALID_JSON_BODY'
  ELSE 'FST_ERR_VALIDATION' END AS code, {VALIDATION} AS validation, {SENT_QUERY} AS query,
 CASE WHEN bad_status = 413 THEN 'Payload Too Large' ELSE 'Bad Request' END AS error,
 coalesce({JOINED}, message) AS message,
 context AS validation_context, path AS instance_path, method AS request_method, url AS request_url,
 shown_agent AS user_agent, client AS remote_ip, {REFERER} AS referer, {CONTENT_TYPE} AS content_type,
 site_header AS site_uuid, body AS request_body FROM verdict WHERE bad_status <> 404""",
    "v1_body_size_gate": _with() + "SELECT row_id, length(body) > 20480 AS too_large FROM base",
    "v2_client_ip": JUDGED + "SELECT row_id, client AS client_ip, remote_ip AS peer_ip FROM verdict",
    "v3_hmac_verify": _with(SIGNED) + """SELECT row_id, good AND NOT is_local AS hmac_valid,
 CASE WHEN is_local THEN 'HMAC parameter not found' ELSE error END AS hmac_error,
 CASE WHEN is_local THEN sent_url ELSE unsigned_text END AS cleaned_url FROM policy""",
    "v3a_hmac_sha1_b64url": _with() + f"""SELECT row_id, {_hmac("url || '&e=' || row_id")} AS signature FROM base""",
    "v3b_timestamp_window": _with(SIGNED) + """SELECT row_id, CASE WHEN is_local OR e % 19 = 0 OR e % 23 = 0
 THEN 'Invalid timestamp' ELSE window_error END AS error FROM policy""",
    "v3c_split_signed_url": _with(SIGNED) + """SELECT row_id, NOT is_local AND e % 17 <> 0 AS has_hmac,
 CASE WHEN is_local OR e % 19 = 0 THEN NULL WHEN e % 23 = 0 THEN 'abc' ELSE CAST(signed_at AS VARCHAR) END AS t,
 CASE WHEN is_local THEN sent_url ELSE signed_text END AS validation_url,
 CASE WHEN is_local THEN sent_url ELSE unsigned_text END AS cleaned_url FROM policy""",
    "v3d_hmac_policy": _with(SIGNED) + """SELECT 'enforce' AS mode, row_id,
 CASE WHEN exempt THEN 'exempt' WHEN good THEN 'valid' ELSE 'refused' END AS hmac_status,
 CASE WHEN NOT exempt AND NOT good THEN coalesce(error, 'HMAC validation failed') END AS hmac_message,
 CASE WHEN exempt OR NOT good THEN sent_url ELSE unsigned_text END AS effective_url FROM policy
 UNION ALL SELECT 'log_only', row_id, CASE WHEN exempt THEN 'exempt' WHEN good THEN 'valid' ELSE 'logged' END,
 NULL, CASE WHEN exempt THEN sent_url ELSE unsigned_text END FROM policy
 UNION ALL SELECT 'disabled', row_id, 'disabled', NULL, sent_url FROM policy""",
    "v4_validate_body": JUDGED + """SELECT row_id, CAST(bad_status AS BIGINT) AS status, path, message
 FROM verdict WHERE context = 'body'""",
    "v5_validate_query": _with() + f"""SELECT row_id, {_case(3, only='querystring')} AS path,
 {_case(4, only='querystring')} AS message FROM base""",
    "v6_validate_headers": JUDGED + """SELECT row_id, CAST(bad_status AS BIGINT) AS status, path, message
 FROM verdict WHERE context = 'headers'""",
    "v7_classify_request": JUDGED + f"""SELECT row_id, {OUTCOME} AS outcome,
 CAST(coalesce(bad_status, 202) AS BIGINT) AS status, context, path, message FROM verdict""",
    "v8_validate_raw": HITS + f"SELECT row_id, {MESSAGE_ERROR} AS error FROM accepted",
    "v9_field_validators": _with() + """SELECT row_id, e % 149 <> 0 AND e % 97 <> 0 AS is_guid,
 e % 73 <> 0 AS is_iso_millis, TRUE AS is_guid_or_undefined, e % 89 <> 0 AS is_nonblank,
 TRUE AS is_nonempty FROM base""",
    "v10_coerce_request": HITS + """SELECT row_id, '1' AS version, location, referrer, gift_link, utm_source,
 utm_campaign, utm_term, utm_content, sent_source FROM accepted""",
    "v11_check_processed": HITS + f"""SELECT field, CASE WHEN field = 'payload.event_id' THEN
 (SELECT count(*) FROM accepted WHERE event_id LIKE 'evt-%') ELSE 0 END AS violations
 FROM (VALUES {_FIELDS}) f(field)""",
    "f1_filter_bots": _with() + f"SELECT row_id, agent FROM base WHERE NOT {IS_BOT}",
    "f2_drop_bot_device": _with(AGENTS) + f"SELECT row_id, {DEVICE} WHERE coalesce(device, '') <> 'bot'",
    "p1_apply_defaults": HITS + """SELECT iso AS event_time, site AS site_uuid, referrer, gift_link,
 TRUE AS has_referrer, sent_url, utm_source, utm_medium, utm_term FROM accepted""",
    "p2_resolve_event_id": HITS + "SELECT row_id, event_id FROM accepted",
    "p3_to_raw": HITS + """SELECT iso AS event_time, 'page_hit' AS action, '1' AS version, site AS site_uuid,
 event_id, member_uuid, member_status, post_uuid, post_type, gift_link, 'en-US' AS locale, location, referrer,
 pathname, href, utm_source, utm_medium, utm_campaign, utm_term, utm_content, received, client AS ip, agent
 FROM accepted""",
    "p4_received_timestamp": _with() + """SELECT row_id, CASE WHEN e % 23 <> 0 AND e % 7 <> 0 THEN
 strftime(make_timestamp((received_ms - 250) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS received FROM base""",
    "p5_server_timestamp": _with() + "SELECT row_id, iso AS event_time FROM base",
    "p6_to_processed": FULL + FLAT,
    "p7_parse_user_agent": _with(AGENTS) + f"SELECT row_id, {DEVICE}",
    "p8_parse_referrer": FULL + """SELECT event_id, out_url AS referrer_url, out_host AS referrer_host,
 out_source AS referrer_source, out_medium AS referrer_medium FROM processed""",
    "p9_session_signature": HITS + "SELECT event_id, session_id FROM accepted",
    "p10_filter_query_params": _with() + """SELECT row_id, CASE WHEN e % 157 = 0 THEN '/api/v1/nope' ELSE '/api/v1/page_hit' END || CASE WHEN q = '' THEN '' ELSE '?' || q END
 AS filtered FROM (SELECT row_id, e, concat_ws('&',
  CASE WHEN e % 137 = 0 OR e % 101 = 0 OR u % 5 = 0 THEN NULL ELSE 'token=tok' || (u % 10) END,
  CASE WHEN e % 109 = 0 THEN NULL WHEN e % 103 <> 0 AND e % 79 = 0 THEN 'name=nope' ELSE 'name=analytics_events' END)
  AS q FROM base)""",
    "p11_rewrite_forward_query": HITS + """SELECT row_id, concat_ws('&', 'name=analytics_events',
 CASE WHEN u % 5 <> 0 THEN 'token=tok' || (u % 10) END, CASE WHEN e % 3 = 0 THEN 'x=a+b' END) AS kept,
 concat_ws('&', 'name=analytics_events', CASE WHEN e % 3 = 0 THEN 'x=a+b' END, 'wait=true') AS rewritten
 FROM accepted""",
    "p12_trace_context": _with() + f"SELECT row_id, {TRACE} FROM base",
    "p13_request_log_row": JUDGED + f"""SELECT method AS request_method, url AS request_url,
 shown_agent AS user_agent, client AS remote_ip, {REFERER} AS referer,
 CASE WHEN e % 9 <> 0 THEN CAST(length(body) AS VARCHAR) ELSE '0' END AS request_size,
 CASE WHEN e % 5 = 0 THEN 'req-' || e END AS request_id, site_header AS site_uuid, {TRACE} FROM verdict""",
    "k1_salt_key": JUDGED + "SELECT row_id, 'salt:' || day || ':' || site_header AS key FROM verdict",
    "k2_get_or_create_salts": _with(SALTS, VERDICT, ACCEPTED) + f"""SELECT key, TRUE AS is_complete, {EVEN} AS is_kept
 FROM salts WHERE {EVEN} OR key IN (SELECT 'salt:' || day || ':' || site FROM accepted)""",
    "k3_get_salt": _with(SALTS) + f"""SELECT key, CASE WHEN {EVEN} THEN salt END AS salt,
 CASE WHEN {EVEN} THEN created END AS created FROM salts""",
    "k4_get_all_salts": _with(SALTS) + "SELECT key, salt, created FROM salts",
    "k5_set_salts": _with(SALTS) + f"SELECT key, salt, TRUE AS second_refused FROM salts WHERE {EVEN}",
    "k6_delete_salts": _with(SALTS) + f"SELECT * FROM salts WHERE NOT {EVEN}",
    "k7_clear_salts": _with(SALTS) + "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM salts",
    "k8_cleanup_salts": _with(SALTS) + """SELECT key, (SELECT count(*) FROM salts WHERE salt_day < '2024-01-15')
 AS deleted_count FROM salts WHERE salt_day >= '2024-01-15'""",
    "k9_salt_expiry": _with() + f"""SELECT row_id, CASE WHEN e % 3 = 0 THEN
 strftime(make_timestamp(received_ms * 1000) + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE
 strftime(CAST({DAY} AS DATE) + INTERVAL 2 DAY, '%Y-%m-%dT00:00:00.000Z') END AS expires FROM base""",
    "m1_outcome_counts": JUDGED + f"""SELECT {OUTCOME} AS outcome, CAST(coalesce(bad_status, 202) AS BIGINT) AS status,
 site_header AS site_uuid, day, count(*) AS requests FROM verdict GROUP BY ALL""",
    "t1_enrich_stream": FULL + f"""SELECT iso AS event_time, site AS site_uuid, session_id, event_id, os, device,
 out_source AS referrer_source FROM processed WHERE {MESSAGE_ERROR} IS NULL""",
    "t2_flush_policy": HITS + "SELECT count(*) AS events, TRUE AS within_cap FROM accepted",
    "t5_admission_outputs": _with(VERDICT, ACCEPTED, f"""lines AS (
 SELECT 'log' AS output, {OUTCOME} AS outcome, CAST(coalesce(bad_status, 202) AS BIGINT) AS status, NULL AS message,
  NULL AS code, url AS request_url, CASE WHEN e % 5 = 0 THEN 'req-' || e END AS request_id, client AS ip,
  site_header AS site_uuid, shown_agent AS agent FROM verdict)""") + f"""SELECT *, NULL AS event_id, NULL AS href, NULL AS event_time FROM lines
UNION ALL SELECT 'bots', * EXCLUDE (output), NULL, NULL, NULL FROM lines WHERE outcome = 'bot'
UNION ALL SELECT 'rejects', NULL, CAST(bad_status AS BIGINT), coalesce({JOINED}, message),
 CASE context WHEN 'size' THEN 'FST_ERR_CTP_BODY_TOO_LARGE' WHEN 'json' THEN 'FST_ERR_CTP_INVALID_JSON_BODY'
  ELSE 'FST_ERR_VALIDATION' END, url, NULL, client, site_header, shown_agent, NULL, NULL, NULL
 FROM verdict WHERE bad_status <> 404
UNION ALL SELECT 'raw', NULL, NULL, NULL, NULL, NULL, NULL, client, site, shown_agent, event_id, href, iso
 FROM accepted""",
    "t3_delivery": HITS + f"""SELECT count(*) AS messages, count(error) AS parse_failures, CAST(0 AS BIGINT) AS bots,
 count(*) - count(error) AS events, count(*) - count(error) AS delivered
 FROM (SELECT {MESSAGE_ERROR} AS error FROM accepted)""",
    "t4_batch_proxy_mode": FULL + FLAT,
    "traffic_by_site_and_device": FULL + """SELECT site AS site_uuid, device, count(*) AS hits,
 count(DISTINCT session_id) AS sessions FROM processed GROUP BY ALL""",
}

# The same results where the lookup table is taken for too large to broadcast.
for _name in ("p8_parse_referrer", "p9_session_signature"):
    ORACLES[f"{_name}_shuffled"] = ORACLES[_name]
