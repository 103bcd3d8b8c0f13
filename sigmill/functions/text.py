"""Text, date and display expressions, all native columns."""

from __future__ import annotations

from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigmill.functions.expr import let, lookup

SHORT_TEXT_CHARS = 200

# Unicode white space plus the four separator controls.
_BLANK = r"[\s\x1C-\x1F]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim Unicode white space on both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(text), rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def has_text(text: Column | str) -> Column:
    return _c(text).rlike(r"(?U)[^\s\x1C-\x1F]")


def is_short(text: Column | str) -> Column:
    return F.length(_c(text)) < SHORT_TEXT_CHARS


# --- HTML -----------------------------------------------------------------------------------

# What may be a reference; a name needn't end in a semicolon.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_CLOSED_ENTITY = _ENTITY.replace(";?", ";")
# Names that count without one, the longest first: what follows such a name is text.
_OPEN_NAMES = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
# Numbers 128 to 159 are read as bytes of this code page, where it has a character.
_BYTES = {str(c): bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}


def _codepoint_char(code: Column) -> Column:
    """The character of a number; none for numbers that aren't characters, a mark for those that can't be."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    safe = F.when(valid, code).otherwise(F.lit(0xFFFD))
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    none = control | code.between(0xFDD0, 0xFDEF) | (valid & (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (
        F.when(code.between(0x80, 0x9F), F.try_element_at(lookup(_BYTES), code.cast("string")))
        .when(none, F.lit(""))
        .otherwise(char)
    )


def decode_entities(text: Column | str, closed: bool = False) -> Column:
    """Decode numeric and HTML 5 named references in one pass; unknown names stay as text.

    With ``closed`` references without a semicolon, such as one that a page's title was cut in, stay as text too.
    """
    text = _c(text)
    names = lookup(html5)

    def number(digits: Column) -> Column:
        # Numbers beyond a long are beyond every character.
        return _codepoint_char(F.coalesce(digits.try_cast("bigint"), F.lit(0x110000).cast("bigint")))

    def named(body: Column) -> Column:
        start = F.regexp_extract(body, _OPEN_NAMES, 0)
        rest = F.concat(F.try_element_at(names, start), F.substr(body, F.length(start) + 1))
        opened = F.lit(None).cast("string") if closed else F.when(start != "", rest)
        return F.coalesce(F.try_element_at(names, body), opened, F.concat(F.lit("&"), body))

    def decoded(entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"^&#([0-9]+);?$", 1)
        hexes = F.regexp_extract(entity, r"^&#[xX]0*([0-9a-fA-F]+);?$", 1)
        return (
            F.when(entity == "&amp;", F.lit("&"))
            .when(entity == "&quot;", F.lit('"'))
            .when(entity == "&lt;", F.lit("<"))
            .when(entity == "&gt;", F.lit(">"))
            .when(digits != "", number(digits))
            .when(hexes != "", number(F.when(F.length(hexes) <= 8, F.conv(hexes, 16, 10))))
            .otherwise(named(F.substr(entity, F.lit(2))))
        )

    entity = _CLOSED_ENTITY if closed else _ENTITY
    pieces = F.split(text, entity, -1)
    entities = F.transform(F.regexp_extract_all(text, F.lit(entity), 0), decoded)
    joined = F.array_join(
        F.transform(
            F.arrays_zip(pieces.alias("p"), entities.alias("e")),
            lambda z: F.concat(z["p"], F.coalesce(z["e"], F.lit(""))),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def _without_blocks(markup: Column) -> Column:
    # Scripts go before tags: a script may hold "</p>" inside a string.
    markup = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "noscript"):
        markup = F.regexp_replace(markup, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return markup


def _region(markup: Column, tag: str) -> Column:
    return F.regexp_extract(markup, rf"(?is)<{tag}(?:\s[^>]*)?>(.*)</{tag}>", 1)


def _visible(markup: Column, closed: bool) -> Column:
    spaced = F.regexp_replace(markup, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(spaced, closed), r"\s+", " "))


def main_text(markup: Column | str, closed: bool = False) -> Column:
    """Readable text of a page: the ``<article>`` if it has text, else ``<body>``, else everything.

    ``closed`` is that of ``decode_entities``.
    """
    clean = _without_blocks(_c(markup))
    article = F.nullif(_visible(_region(clean, "article"), closed), F.lit(""))
    body = F.nullif(_visible(_region(clean, "body"), closed), F.lit(""))
    return F.coalesce(article, body, _visible(clean, closed))


# --- model answers --------------------------------------------------------------------------


_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def is_fenced(text: Column | str) -> Column:
    stripped = strip(text)
    return stripped.startswith("```") & stripped.endswith("```")


def unfence(text: Column | str) -> Column:
    """Text inside a code fence (its first and last lines dropped), or the stripped text.

    A fence of fewer than three lines holds nothing.
    """

    def inside(stripped: Column) -> Column:
        fenced = stripped.startswith("```") & stripped.endswith("```")
        inner = let(
            F.split(stripped, _LINE_END, -1),
            lambda lines: F.when(
                F.size(lines) >= 3,
                strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")),
            ).otherwise(F.lit("")),
        )
        return F.when(fenced, inner).otherwise(stripped)

    return let(strip(text), inside)


def braces_slice(text: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; empty when there is no such span."""
    return F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)


def strict_json(text: Column | str) -> Column:
    """The text as one JSON value, or NULL.

    The built-in parser stops after the first value and ignores what follows. Parsing the text as
    the first of exactly two array items makes trailing text an error.
    """

    def first_of_two(raw: Column) -> Column:
        guard = F.xxhash64(raw)
        wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), guard.cast("string"), F.lit("]")))

        def checked(items: Column) -> Column:
            last = F.try_variant_get(F.try_element_at(items, F.lit(2)), "$", "bigint")
            return F.when((F.size(items) == 2) & (last == guard), F.try_element_at(items, F.lit(1)))

        return let(F.try_variant_get(wrapped, "$", "array<variant>"), checked)

    return let(_c(text), first_of_two)


# --- dates ----------------------------------------------------------------------------------

# Zone names of RFC 822 and their offsets in minutes.
ZONE_MINUTES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
_RFC822 = (
    r"(?i)^\s*(?:[A-Z]+\s*,\s*)?(\d{1,2})\s+([A-Z]{3})[A-Z]*\s+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Z]+)?\s*$"
)


def rfc822_utc(text: Column | str) -> Column:
    """RFC 822 date as a UTC timestamp; NULL when unparsable, a missing zone means UTC."""
    text = _c(text)

    def part(group: int) -> Column:
        return F.regexp_extract(text, _RFC822, group)

    month_at = F.position(F.lower(part(2)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    month = F.when((month_at > 0) & ((month_at - 1) % 3 == 0), ((month_at + 2) / 3).cast("int"))
    raw_year = part(3).cast("int")
    year = (
        F.when(F.length(part(3)) == 4, raw_year).when(raw_year < 69, raw_year + 2000).otherwise(raw_year + 1900)
    )
    zone = F.upper(part(7))
    signed = F.regexp_extract(zone, r"^([+-])(\d{2})(\d{2})$", 2).cast("int") * 60 + F.regexp_extract(
        zone, r"^([+-])(\d{2})(\d{2})$", 3
    ).cast("int")
    offset = (
        F.when(zone.startswith("+"), signed)
        .when(zone.startswith("-"), -signed)
        .otherwise(F.coalesce(F.try_element_at(lookup(ZONE_MINUTES), zone).cast("int"), F.lit(0)))
    )
    local = F.try_make_timestamp(
        year, month, part(1).cast("int"), part(4).cast("int"), part(5).cast("int"),
        F.coalesce(F.nullif(part(6), F.lit("")), F.lit("0")).cast("decimal(8,6)"), F.lit("UTC"),
    )
    return F.when(text.rlike(_RFC822), F.timestamp_seconds(F.unix_seconds(local) - offset * 60))


def coarse_age(ts: Column, now: Column) -> Column:
    """Display age: just now, minutes, hours, else the date. ``now`` is a parameter so that a
    report is reproducible."""
    age = F.greatest(F.unix_seconds(now) - F.unix_seconds(ts), F.lit(0))
    # Fixed display texts.
    return (
        F.when(age < 60, F.lit("только что"))
        .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit(" мин назад")))
        .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit(" ч назад")))
        .otherwise(F.date_format(ts, "dd.MM.yyyy"))
    )


def duration_seconds(start: Column, end: Column) -> Column:
    return F.unix_seconds(end) - F.unix_seconds(start)


# --- display and hashing --------------------------------------------------------------------


def mask_secret(secret: Column | str) -> Column:
    """Four stars and the last four characters; short secrets are hidden entirely."""
    secret = _c(secret)
    return F.when(F.length(secret) > 4, F.concat(F.lit("****"), F.right(secret, F.lit(4)))).otherwise(F.lit("****"))


# Fixed display labels.
KIND_LABELS = {"demand": "заказ", "complaint": "жалоба", "discussion": "обсуждение"}


def kinds_label(kind_mix: Column | str, labels: Mapping[str, str] = KIND_LABELS) -> Column:
    """``"label count, ..."`` over the non-zero counters, a dash when there are none."""
    names = lookup(labels)
    shown = F.filter(F.map_entries(_c(kind_mix)), lambda e: e["value"] != 0)
    text = F.array_join(
        F.transform(
            shown,
            lambda e: F.concat(
                F.coalesce(F.try_element_at(names, e["key"]), e["key"]), F.lit(" "), e["value"].cast("string")
            ),
        ),
        ", ",
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))


def hash_bucket(text: Column | str, buckets: int) -> Column:
    """First four bytes of SHA-256, big-endian, modulo ``buckets``."""
    head = F.conv(F.substring(F.sha2(_c(text), 256), 1, 8), 16, 10).cast("bigint")
    return head % F.lit(buckets)


def keep_if_blank(new: Column, old: Column) -> Column:
    """An empty new value keeps the stored one."""
    return F.when(new == "", old).otherwise(new)


def append_once(text: Column, marker: str, addition: str) -> Column:
    """Append ``addition`` unless ``marker`` already occurs: applying it twice changes nothing."""
    return F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(text, F.lit(addition)))
