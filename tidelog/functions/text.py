"""Facts read out of one log line, each as a Column built from a Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import patterns as P


def extract(col: Column, pattern: str, group: int) -> Column:
    """`regexp_extract` with NULL, not '', where nothing matched."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def any_contains(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` uses it.

    It also keeps expressions small where a filter on a derived column is pushed down: the
    optimiser then copies every column such a filter is built from into the filter.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_escapes(col: Column) -> Column:
    """Text without terminal escapes: window titles, colours, two-byte sequences."""

    def strip(text: Column) -> Column:
        plain = text
        for pattern in (P.ESCAPE_OSC, P.ESCAPE_CSI, P.ESCAPE_TWO_BYTE):
            plain = F.regexp_replace(plain, pattern, "")
        return F.when(F.contains(text, F.lit("\x1b")), plain).otherwise(text)

    return let(col, strip)


# -- file names ---------------------------------------------------------------------------


def basename(path: Column) -> Column:
    """Text behind the last slash; a path that ends with one is its own name."""
    return F.when(F.endswith(path, F.lit("/")), path).otherwise(F.substring_index(path, "/", -1))


def file_stem(path: Column) -> Column:
    """Path without stream, instance and rotation suffix."""
    return F.regexp_replace(path, P.STREAM_SUFFIX, "")


def is_rotated(path: Column) -> Column:
    return basename(path).rlike(P.ROTATED_ARCHIVE)


# -- time stamps ----------------------------------------------------------------------------


_MARK = "\x00"


def _stamp_parts(line: Column) -> Column:
    """Array of date, separator, time, fraction, white space, offset hours and minutes, UTC
    mark, read at the start of a line; NULL for a line that starts with no time stamp."""
    first = F.left(line, F.lit(1))
    found = F.when(
        first == "[", F.regexp_replace(line, P.TS_BRACKETED, _MARK + "$1|$2|$3|$4|$5|$6|$7|")
    ).when(
        first.between("0", "9"), F.regexp_replace(line, P.TS_BARE, _MARK + "$1|B|$2|$3||||$4")
    )
    return let(
        found,
        lambda f: F.when(
            F.startswith(f, F.lit(_MARK)), F.split(F.substr(f, F.lit(2)), r"\|", 8)
        ),
    )


def line_timestamp(line: Column, source_tz: str = "UTC", honour_utc_suffix: bool = False) -> Column:
    """The instant at the start of a line, bracketed or bare; NULL if there is none.

    A stamp without an offset is in `source_tz`. The ISO form needs its offset, directly
    behind the time; the spaced form may have one behind white space. `honour_utc_suffix`
    makes a bare stamp followed by `UTC` or `Z` an UTC one; by default that is not looked at.
    """

    def instant(parts: Column) -> Column:
        def part(i: int) -> Column:
            return F.get(parts, F.lit(i))

        spaced, iso, has_offset = part(1) == " ", part(1) == "T", part(5) != ""
        well_formed = F.when(iso, has_offset & (part(4) == "")).otherwise(
            ~(spaced & has_offset & (part(4) == ""))
        )
        zone = F.when(has_offset, F.concat(part(5), F.lit(":"), part(6)))
        if honour_utc_suffix:
            zone = zone.when(part(7) != "", F.lit(" UTC"))
        zone = zone.otherwise(F.lit(f" {source_tz}"))
        fraction = F.when(part(3) == "", F.lit("0")).otherwise(part(3))
        # Zone-qualified text is cast to an instant: the session time zone plays no part.
        text = F.concat(part(0), F.lit(" "), part(2), F.lit("."), fraction, zone)
        return F.when(well_formed, text.try_cast("timestamp"))

    return let(let(line, _stamp_parts), instant)


# -- severity -------------------------------------------------------------------------------


def http_tail(line: Column) -> Column:
    """The `(n ms) ddd` at the end of an access line; NULL or '' without one."""
    return F.when(F.contains(line, F.lit(" ms)")), F.regexp_extract(line, P.HTTP_TAIL, 0))


def tail_status(tail: Column) -> Column:
    return F.regexp_extract(tail, P.HTTP_TAIL, 2).try_cast("int")


def severity(line: Column, upper: Column, tail: Column) -> Column:
    """Level word, else warning/error sign, else the HTTP status at the end, else INFO.

    `upper` is the upper-cased line, `tail` what `http_tail` found.
    """
    by_word = F.lit(None).cast("string")
    for level, words in reversed(P.SEVERITY_WORDS):
        by_word = F.when(any_contains(upper, words), F.lit(level)).otherwise(by_word)
    by_sign = F.when(any_contains(line, P.ERROR_SIGNS), F.lit("ERROR")).when(
        F.contains(line, F.lit(P.WARN_SIGN)), F.lit("WARN")
    )
    code = tail_status(tail)
    by_code = F.when(code >= 500, F.lit("ERROR")).when(code >= 400, F.lit("WARN"))
    return F.coalesce(by_word, by_sign, by_code, F.lit("INFO"))


def is_error(level: Column) -> Column:
    return level.isin(*P.ERROR_LEVELS)


# -- request facts ----------------------------------------------------------------------------


def given(text: Column) -> Column:
    """NULL for an empty text. `text` should be a plain column: it is looked at twice."""
    return F.when(text != "", text)


def if_any(upper: Column, words: list[str], found: Column) -> Column:
    """`found` only for lines that hold one of the words."""
    return F.when(any_contains(upper, words), found)


def with_request_facts(df: DataFrame, line: str, upper: str, whole_segment: bool = False) -> DataFrame:
    """Adds duration_ms, status, method, route, req_id, phase and `_tail` (see `http_tail`).

    In two projections: the first finds the piece of text that holds a fact, once per line;
    the second takes the pieces apart.
    """
    text, up = F.col(line), F.col(upper)

    def find(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    found = df.withColumns(
        {
            "_keyed": if_any(up, P.DURATION_WORDS, find(P.DURATION_KEYED, 0)),
            "_tail": http_tail(text),
            "_rid": if_any(up, P.REQUEST_ID_WORDS, find(P.REQUEST_ID, 1)),
            "_method": F.upper(if_any(up, P.METHOD_WORDS, find(P.METHOD, 1))),
            "_url": if_any(up, P.URL_WORDS, find(P.URL, 1)),
        }
    )
    keyed = F.regexp_extract("_keyed", P.DURATION_KEYED, 1).try_cast("double")
    in_seconds = F.regexp_extract("_keyed", P.DURATION_KEYED, 2) == "s"
    duration = F.coalesce(
        F.when(in_seconds, keyed * 1000.0).otherwise(keyed),
        F.when(
            F.contains(text, F.lit("ms)")), find(P.DURATION_PAREN, 1).try_cast("double")
        ),
        F.when(F.contains(text, F.lit("ms")), find(P.DURATION_TAIL, 1).try_cast("double")),
    )
    status = F.coalesce(
        if_any(up, P.STATUS_WORDS, find(P.STATUS_KEYED, 1).try_cast("int")),
        tail_status(F.col("_tail")),
    )
    phase = F.when(
        F.col("_rid") != "",
        F.when(any_contains(up, P.PHASE_START), F.lit("start")).when(
            any_contains(up, P.PHASE_END), F.lit("end")
        ),
    )
    return found.withColumns(
        {
            "duration_ms": duration,
            "status": status,
            "method": given(F.col("_method")),
            "route": F.when(F.col("_url") != "", normalise_route(F.col("_url"), whole_segment)),
            "req_id": given(F.col("_rid")),
            "phase": phase,
        }
    )


FACTS = ["duration_ms", "status", "method", "route", "req_id", "phase"]


def pack_facts() -> Column:
    """The facts as one struct; NULL when there is none (a method alone is none)."""
    present = F.lit(False)
    for name in ("duration_ms", "status", "route", "req_id"):
        present = present | F.col(name).isNotNull()
    return F.when(present, F.struct(*FACTS))


def normalise_route(path: Column, whole_segment: bool = False) -> Column:
    """Path without query string, ids collapsed to `/:id` (UUID, long hex, digits).

    By default an id may be the beginning of a segment (`/2fa` gives `/:idfa`);
    `whole_segment` asks for the id to fill its segment.
    """
    path = F.substring_index(path, "?", 1)
    for pattern in P.ROUTE_IDS:
        if whole_segment:
            pattern += r"(?=/|\z)"
        path = F.regexp_replace(path, pattern, P.ROUTE_PLACEHOLDER)
    return path


def attrs_from_json(text: Column) -> Column:
    """Request facts of a JSON object (parsed once), malformed durations and statuses as NULL.
    No object, or one without fields, gives NULL."""
    as_texts = "struct<" + ", ".join(f"{name}: string" for name in FACTS) + ">"

    def guarded(given_facts: Column) -> Column:
        def field(name: str) -> Column:
            return given_facts.getField(name)

        duration = F.when(field("duration_ms").rlike(P.DURATION_TEXT), field("duration_ms"))
        status = F.when(field("status").rlike(P.STATUS_TEXT), field("status"))
        return F.struct(
            duration.try_cast("double").alias("duration_ms"),
            status.try_cast("int").alias("status"),
            *[field(n).alias(n) for n in ("method", "route", "req_id", "phase")],
        )

    is_object = text.isNotNull() & ~text.rlike(P.NO_JSON_FIELDS)
    return F.when(is_object, let(F.from_json(text, as_texts), guarded))


def may_hold_secret(text: Column) -> Column:
    def maybe(upper: Column) -> Column:
        found = any_contains(upper, P.REDACTION_WORDS)
        for one, other in P.REDACTION_PAIRS:
            found = found | (F.contains(upper, F.lit(one)) & F.contains(upper, F.lit(other)))
        return found

    return let(F.upper(text), maybe)


def redact(text: Column) -> Column:
    """Secrets replaced by `***`; texts without any secret word are passed on as they are."""

    def clean(t: Column) -> Column:
        out = t
        for pattern, stand_in in P.REDACTIONS:
            out = F.regexp_replace(out, pattern, stand_in)
        return F.when(may_hold_secret(t), out).otherwise(t)

    return let(text, clean)


# -- identities -----------------------------------------------------------------------------


def first_line(body: Column) -> Column:
    return F.substring_index(body, "\n", 1)


def error_fp(service: Column, body: Column) -> Column:
    """Fingerprint of an error: md5 of service and first line with variable parts replaced."""
    text = first_line(body)
    for pattern, stand_in in P.FINGERPRINT_PARTS:
        text = F.regexp_replace(text, pattern, stand_in)
    return F.md5(F.concat(service, F.lit("|"), text))


def content_hash(ts_text: Column, service: Column, body: Column) -> Column:
    return F.sha1(F.concat(ts_text, F.lit("|"), service, F.lit("|"), body))


def id_from_hash(fp: Column) -> Column:
    """63-bit id out of a content hash: the same row always gets the same id, no shuffle."""
    return F.conv(F.substring(fp, 1, 15), 16, 10).cast("bigint")


# -- small texts --------------------------------------------------------------------------------


def human_window(secs: Column) -> Column:
    """300 -> 5m, 7200 -> 2h, 86400 -> 1d."""

    def whole(unit: int, mark: str) -> Column:
        return F.concat(F.floor(secs / F.lit(unit)).cast("string"), F.lit(mark))

    return (
        F.when(secs >= 86400, whole(86400, "d"))
        .when(secs >= 3600, whole(3600, "h"))
        .otherwise(whole(60, "m"))
    )


def size_bytes(text: Column) -> Column:
    """`1.5GiB` -> bytes; unknown unit counts as bytes, no number as 0."""
    unit = F.upper(extract(F.trim(text), P.SIZE_TEXT, 2))
    factor = F.lit(1)
    for name, size in P.SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    number = extract(F.trim(text), P.SIZE_TEXT, 1).try_cast("double")
    return F.coalesce((number * factor).try_cast("bigint"), F.lit(0).cast("bigint"))
