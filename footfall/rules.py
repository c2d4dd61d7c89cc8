"""Fixed values of the page-hit format: names, words, limits and patterns.

These have to be exactly what the producers and the sink of page hits use, so
they are kept together here as plain text and used by name everywhere else.
"""

ACTION = "page_hit"
VERSION = "1"
CONTENT_TYPE = "application/json"
EVENT_NAMES = ["analytics_events", "analytics_events_test"]
POST_TYPES = ["null", "post", "page"]
UNDEFINED = "undefined"

HIT_METHOD = "POST"
HIT_PATH = "/api/v1/page_hit"

MAX_BODY_BYTES = 20 * 1024

SIGNED_URL_PAST_MS = 5 * 60 * 1000
SIGNED_URL_AHEAD_MS = 5 * 1000
UNSIGNED_METHODS = ["GET", "HEAD", "OPTIONS", "TRACE"]
UNSIGNED_PREFIX = "/local-proxy"

BATCH_SIZE = 50
FLUSH_INTERVAL_MS = 1000

SALT_PREFIX = "salt"
SALT_TTL_DAYS = 2

# Largest instant an ECMAScript date can hold, in epoch milliseconds.
MAX_EPOCH_MS = 8_640_000_000_000_000

# Case-insensitive, anywhere in the user agent.
BOT_WORDS = [
    "wget",
    "ahrefsbot",
    "curl",
    "bot",
    "crawler",
    "spider",
    "urllib",
    "bitdiscovery",
    "+https://",
    "googlebot",
]

DESKTOP_SYSTEMS = ["macos", "windows", "linux", "chrome os", "chromium os", "ubuntu"]

# Java regular expressions. \A and \z because $ would let a final newline through.
GUID = r"\A[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"

# Three fraction digits, Z only, and only days that the calendar has.
ISO_MILLIS = (
    r"\A(?:"
    r"\d{4}-(?:"
    r"(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)"
    r"|02-(?:0[1-9]|1\d|2[0-8]))"
    r"|(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29"
    r")T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3}Z\z"
)

# How a failed non-blank rule is reported.
NONBLANK_PATTERN = r"^.*\S.*$"

# What ECMAScript counts as white space, and which of it ends a line.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
LINE_END = r"\n\r\u2028\u2029"
