"""URL expressions. All native columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigmill.functions.expr import let

# Tracking parameters dropped by the canonical form (case-sensitive).
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("fbclid", "gclid")

# Schemes whose last path segment may carry ";params".
SCHEMES_WITH_PARAMS = (
    "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
)

# RFC 3986 appendix B, narrowed to absolute URLs: scheme, authority, path, query, fragment.
_ABSOLUTE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _clean(url: Column) -> Column:
    # Leading control characters and blanks are ignored, as are tabs and line breaks anywhere.
    return F.regexp_replace(url, r"\A[\x00-\x20]+|[\t\r\n]", "")


def _decode(part: Column) -> Column:
    # A '%' that starts no escape is literal text, so it is escaped before decoding.
    literal_safe = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(literal_safe), F.replace(part, F.lit("+"), F.lit(" ")))


def _encode(part: Column) -> Column:
    # Form encoding with '~' kept and '*' escaped.
    encoded = F.url_encode(part)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _kept_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda pair: pair != "")

    def parsed(pair: Column) -> Column:
        # Cut at the first '='; a name alone has an empty value.
        name, value = F.substring_index(pair, "=", 1), F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1)
        return F.struct(_decode(name).alias("name"), _decode(value).alias("value"))

    kept = F.filter(
        F.transform(pairs, parsed),
        lambda p: ~(p["name"].startswith(TRACKING_PREFIX) | p["name"].isin(*TRACKING_PARAMS)),
    )
    return F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))), "&")


# Separates the parts of a matched URL. A URL with this control character inside is malformed.
_MARK = "\u0001"


def _path(path: Column) -> Column:
    trimmed = F.regexp_replace(path, r"/+$", "")
    return F.when(~path.endswith("/") | (F.length(path) <= 1), path).otherwise(
        F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("/"))
    )


def _path_and_params(scheme: Column, path: Column) -> Column:
    """Path without trailing slashes; parameters of its last segment are kept apart and put back."""

    def split_off(p: Column) -> Column:
        params = F.regexp_extract(p, r";([^/]*)$", 1)
        bare = _path(F.regexp_replace(p, r";[^/]*$", ""))
        # Parameters without a path still need the separating slash.
        return F.when(params == "", bare).otherwise(
            F.concat(F.coalesce(F.nullif(bare, F.lit("")), F.lit("/")), F.lit(";"), params)
        )

    has_params = scheme.isin(*SCHEMES_WITH_PARAMS) & path.rlike(r";[^/]*$")
    return F.when(F.contains(path, F.lit(";")) & has_params, split_off(path)).otherwise(_path(path))


def canonical_url(url: Column | str) -> Column:
    """Canonical form used as the dedup key; NULL for a relative, blank or malformed URL.

    Lower-case scheme and authority; tracking parameters dropped and the others re-encoded; no
    trailing slashes except on the root path; path parameters and fragment kept.
    """

    def optional(mark: str, part: Column) -> Column:
        return F.when(part != "", F.concat(F.lit(mark), part)).otherwise(F.lit(""))

    def rebuilt(part: Column) -> Column:
        scheme, authority, path, query, fragment = (F.get(part, F.lit(i)) for i in range(5))
        kept = F.when(query == "", F.lit("")).otherwise(let(_kept_query(query), lambda q: optional("?", q)))
        return F.when(
            F.size(part) == 5,
            F.concat(
                F.lower(scheme), F.lit("://"), F.lower(authority),
                let(path, lambda p: _path_and_params(F.lower(scheme), p)), kept, optional("#", fragment),
            ),
        )

    cleaned = _clean(F.col(url) if isinstance(url, str) else url)
    # One match per URL; a URL that does not match stays in one piece.
    parts = F.split(F.regexp_replace(cleaned, _ABSOLUTE, _MARK.join(f"${i}" for i in range(1, 6))), _MARK, -1)
    return let(parts, rebuilt)


def url_host(url: Column | str) -> Column:
    """Lower-case host without user info and port; NULL when there is none."""
    cleaned = _clean(F.col(url) if isinstance(url, str) else url)
    authority = F.regexp_extract(cleaned, _ABSOLUTE, 2)
    host = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^\[|\]$", ""), F.lit(""))


def safe_domain(domain: Column | str) -> Column:
    """Domain as a safe folder name: anything but ``a-z 0-9 . -`` becomes ``_``."""
    col = F.col(domain) if isinstance(domain, str) else domain
    return F.regexp_replace(F.lower(F.trim(col)), r"[^a-z0-9.\-]", "_")


def review_url(app_id: Column, review_id: Column) -> Column:
    """Address of one store review: the app page plus a review fragment."""
    return F.concat(
        F.lit("https://play.google.com/store/apps/details?id="), app_id, F.lit("#review="), review_id
    )
