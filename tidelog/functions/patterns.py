"""Patterns, word lists and tables that decide the results.

They must equal the collector's for the same lines to give the same rows, so they are kept
as plain text in one place. Written for java.util.regex: `\\z` is the end of the text (Java's
`$` would also match before a last newline), and `\\d \\s \\b` keep their ASCII meaning.
"""

# -- terminal escapes, removed in this order -----------------------------------------------
ESCAPE_OSC = r"\x1b\][^\x07\x1b]*(\x07|\x1b\\)"
ESCAPE_CSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
ESCAPE_TWO_BYTE = r"\x1b[@-Z\\-_]"

# -- file names ---------------------------------------------------------------------------
STREAM_SUFFIX = r"-(out|error)(-\d+)?(__[^/]*)?\.log\z"
NGINX_PREFIX = "/var/log/nginx"
STDERR_MARK = "-error"
ROTATED_ARCHIVE = r"(__\d{4}-\d{2}-\d{2}_.*|\.gz|\.zip)\z"
DEFAULT_LOG_DIR = r"^(/root|/home/[^/]+)/\.pm2/logs\z"

# -- records and time stamps ----------------------------------------------------------------
RECORD_START = r"^\S"
# Groups: date, separator, time, fraction, white space, offset hours, offset minutes. A line
# matches as a whole, so that replacing the match leaves only the groups.
TS_BRACKETED = (
    r"(?s)^\[(\d{4}-\d{2}-\d{2})([ T])(\d{2}:\d{2}:\d{2})(?:\.(\d{1,6})\d*)?"
    r"(?:(\s*)([+-]\d{2}):?(\d{2}))?\].*\z"
)
# Groups: date, time, fraction, UTC mark.
TS_BARE = (
    r"(?s)^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})\.(\d{1,6})\d*(?:\s*(UTC|Z))?.*\z"
)

# -- severity: words looked up in the upper-cased line, first hit wins -----------------------
SEVERITY_WORDS = [
    ("FATAL", ["FATAL", "CRITICAL"]),
    ("ERROR", ["ERROR"]),
    ("WARN", ["WARNING", "WARN"]),
    ("DEBUG", ["DEBUG", "TRACE"]),
    ("INFO", ["INFO", "NOTICE"]),
]
WARN_SIGN = "⚠"
ERROR_SIGNS = ["❌", "🔴"]
ERROR_LEVELS = ["ERROR", "FATAL"]

# -- request facts --------------------------------------------------------------------------
HTTP_TAIL = r"\((\d+) ms\)\s+(\d{3})\s*\z"
DURATION_KEYED = (
    r"(?i)\b(?:response_?time(?:_?ms)?|duration_?(?:ms)?|elapsed(?:_?ms)?|latency(?:_?ms)?|took|rt)"
    r"\b\"?\s*[=:]\s*\"?(\d+(?:\.\d+)?)\s*(ms|s\b)?"
)
DURATION_PAREN = r"\((\d+(?:\.\d+)?) ?ms\)"
DURATION_TAIL = r"-\s+(\d+(?:\.\d+)?)\s*ms\s*\z"
STATUS_KEYED = r"(?i)\b(?:status(?:_?code)?|statuscode)\b\"?\s*[=:]\s*\"?(\d{3})\b"
REQUEST_ID = (
    r"(?i)\b(?:request_?id|req_?id|correlation_?id|trace_?id|x-request-id)\"?\s*[=:]\s*\"?"
    r"([A-Za-z0-9_\-]{6,64})"
)
REQUEST_ID_WORD = r"(?i)(request_?id|req_?id|correlation_?id|trace_?id|x-request-id)"
# Wording of the two ends of a request, looked up in the upper-cased line (START also finds
# STARTED, COMPLETE finds COMPLETED, END finds ENDED).
PHASE_START = ["INCOMING REQUEST", "REQUEST START", "REQUEST RECEIVED", "REQUEST BEGIN"]
PHASE_END = ["REQUEST COMPLETE", "REQUEST FINISHED", "REQUEST END", "RESPONSE SENT"]
METHOD = r"(?i)\bmethod\"?\s*[=:]\s*\"?(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
URL = r"(?i)\burl\"?\s*[=:]\s*\"?(/[^\s\",]*)"

ROUTE_IDS = [
    r"/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"/[0-9a-fA-F]{16,}",
    r"/\d+",
]
ROUTE_PLACEHOLDER = "/:id"

# Words of which one must occur (in the upper-cased line) before a pattern above can match;
# looking for a word costs a small part of what a failing pattern search costs.
DURATION_WORDS = ["RESPONSE", "DURATION", "ELAPSED", "LATENCY", "TOOK", "RT"]
STATUS_WORDS = ["STATUS"]
REQUEST_ID_WORDS = ["REQ", "CORRELATION", "TRACE"]
METHOD_WORDS = ["METHOD"]
URL_WORDS = ["URL"]

# Guards for request facts that arrive as text.
DURATION_TEXT = r"^[0-9]+(\.[0-9]+)?\z"
STATUS_TEXT = r"^[0-9]{3}\z"
NO_JSON_FIELDS = r"^\s*(\{\s*\}|null)?\s*\z"

# -- redaction, applied in this order ---------------------------------------------------------
REDACTIONS = [
    (
        r"(?i)(password|passwd|pwd|secret|api[_-]?key|apikey|token|authorization)\s*[=:]\s*\S+",
        "$1=***",
    ),
    (r"(?i)bearer\s+[A-Za-z0-9\-\._~\+/]+=*", "Bearer ***"),
    (r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*", "***"),
    (r"AKIA[0-9A-Z]{16}", "***"),
    (r"://([^:/@\s]+):([^@/\s]+)@", "://$1:***@"),
]
# One of these words, or both parts of one of these pairs, must occur before anything is
# redacted (the words in the upper-cased text).
REDACTION_WORDS = ["PASSW", "PWD", "SECRET", "TOKEN", "AUTHORIZATION", "BEARER"]
REDACTION_PAIRS = [("API", "KEY"), ("EYJ", "."), ("AKIA", "A"), ("://", "@")]
SECRET_WORDS = r"(?i)(password|secret|token|bearer|AKIA|eyJ)"

# -- error fingerprint: variable parts and their stand-ins, in this order ---------------------
FINGERPRINT_PARTS = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b[0-9a-fA-F]{12,}\b", "<hex>"),
    (r"\"[^\"]*\"", "<str>"),
    (r"\b\d+\b", "<n>"),
]

# -- diagnostics --------------------------------------------------------------------------------
TIMING_FIELD = (
    r"([A-Za-z_.]*(?:[Dd]uration|[Ee]lapsed|[Ll]atency|[Rr]esponse[Tt]ime|[Tt]ook|_ms|[Mm]illis)"
    r"[A-Za-z_.]*)\"?\s*[=:]\s*\"?([0-9]+(?:\.[0-9]+)?)"
)
REQUEST_RECORD_LIKE = ["%request completed%", "%statusCode%", "%HTTP/1.%"]

# -- snapshots -----------------------------------------------------------------------------------
SIZE_TEXT = r"^([\d.]+)\s*([A-Za-z]+)"
SIZE_UNITS = {
    "B": 1,
    "KIB": 1024,
    "MIB": 1024**2,
    "GIB": 1024**3,
    "KB": 1000,
    "MB": 1000**2,
    "GB": 1000**3,
}
SERVER_NAME = r"^\s*server_name\s+([^;]+)"
SKIPPED_DOMAIN = r"^(_|localhost|\*)"

# What a rotation adds to the name of a log file.
ROTATION_MARK = r"__[^/]*(?=\.log$)"
