"""Scalar column functions (F1-F15). All are ``pyspark.sql.functions``
expressions: they run inside whole-stage codegen, no Python per row.

Regex notes: Java's ``$`` also matches before a final newline, JavaScript's
does not, so end anchors are written ``\\z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the reference: roles accepted by the user handlers, the
# text that marks an itinerary object, and the object key prefixes.
ROLES = ["user", "admin", "superadmin"]
ITINERARY_MARK = "itinerary"
TRIPS_PREFIX = "trips/"
ITINERARIES_PREFIX = "itineraries/"
BANNERS_PREFIX = "banners/"
CATALOG_FALLBACK_IMAGE = "/kashmir_lightbox_4.jpg"

# Fixed values from JavaScript: the characters String.prototype.trim removes
# (white space and line terminators of ECMAScript).
JS_WHITESPACE = ("\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                 "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
_WS_CLASS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"  # the same set in a regex
LEADING_INT = rf"^[{_WS_CLASS}]*([+-]?[0-9]+)"
LEADING_HEX = rf"^[{_WS_CLASS}]*([+-]?)0[xX]([0-9a-fA-F]+)"
LEADING_FLOAT = rf"^[{_WS_CLASS}]*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"
EMAIL = rf"^[^{_WS_CLASS}@]+@[^{_WS_CLASS}@]+\.[^{_WS_CLASS}@]+\z"
PLAIN_EMAIL = r"^[!-?A-~]+@[!-?A-~]+\.[!-?A-~]+\z"  # in printable ASCII: most texts, at a tenth of the time
# JSON.parse: double-quoted names and texts only, no NaN.
JSON_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
               "allowUnquotedFieldNames": "false"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """String.prototype.trim: strips all leading / trailing white space
    (``btrim`` over the JS white-space set; no regex)."""
    return F.btrim(_c(c).cast("string"), F.lit(JS_WHITESPACE))


def slug(c) -> Column:
    """trim, lower, runs of [^a-z0-9] -> '-', outer '-' stripped. (Outer
    white space becomes an outer '-', so the trim is implied.)"""
    return F.btrim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def epoch_to_ts(c) -> Column:
    """epoch seconds -> timestamp."""
    return F.timestamp_seconds(_c(c))


def epoch_month(c) -> Column:
    """calendar month (1-12, UTC session zone) of epoch seconds."""
    return F.month(F.timestamp_seconds(_c(c)))


def epoch_iso(c) -> Column:
    """epoch seconds -> ISO-8601 UTC text with milliseconds."""
    return F.date_format(F.timestamp_seconds(_c(c)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _all_digits(t: Column) -> Column:
    return (F.length(t) > 0) & (F.translate(t, "0123456789", "") == "")


def js_parse_int(c) -> Column:
    """JavaScript parseInt(text): leading integer (``0x`` reads
    hexadecimal), null if none or beyond 64 bits. Plain digit texts take a cast;
    only the rest pay for the regexes."""
    s = _c(c).cast("string")
    t = F.regexp_extract(s, LEADING_INT, 1)
    x = F.regexp_extract(s, LEADING_HEX, 2)
    hexed = F.concat(F.regexp_extract(s, LEADING_HEX, 1), F.conv(x, 16, 10)).try_cast("bigint")
    return (F.when(_all_digits(s), s.try_cast("bigint")).when(x != "", hexed)
            .otherwise(F.when(t != "", t.try_cast("bigint"))))


def js_parse_float(c) -> Column:
    """JavaScript parseFloat: leading decimal number as double, null if
    none (NaN never results). Plain digit texts take a cast."""
    s = _c(c).cast("string")
    t = F.regexp_extract(s, LEADING_FLOAT, 1)
    return F.when(_all_digits(s), s.try_cast("double")).otherwise(F.when(t != "", t.try_cast("double")))


def to_money(c) -> Column:
    """Numbers stored as money: decimal(12,2); null beyond it (callers give
    such a number an error code)."""
    return _c(c).try_cast("decimal(12,2)")


def is_email(c) -> Column:
    """x@y.z without white space or a further @ (JavaScript's white space
    and end anchor). Texts in plain ASCII match the first, cheap pattern; only the
    rest pay for the second."""
    s = _c(c).cast("string")
    return F.coalesce(s.rlike(PLAIN_EMAIL) | s.rlike(EMAIL), F.lit(False))


def is_phone10(c) -> Column:
    """exactly 10 ASCII digits."""
    s = _c(c).cast("string")
    return F.coalesce((F.length(s) == 10) & _all_digits(s), F.lit(False))


def norm_code(c) -> Column:
    """F8: coupon code as looked up: trim + upper; blank -> null."""
    t = F.upper(js_trim(c))
    return F.when(t != "", t)


def norm_role(c) -> Column:
    """role text as stored: trim + lower."""
    return F.lower(js_trim(c))


def is_role(c) -> Column:
    """role is one of the accepted roles."""
    return F.coalesce(norm_role(c).isin(*ROLES), F.lit(False))


def looks_like_json(c) -> Column:
    s, t = _c(c).cast("string"), js_trim(c)
    held = s.contains("{") | s.contains("[")  # most texts hold neither and need no trim
    return F.coalesce(held & (t.startswith("{") | t.startswith("[")), F.lit(False))


def ref_id(c) -> Column:
    """id from plain text, or the ``id`` member of a JSON object text.
    A JSON array (or object without id) gives null."""
    return F.when(looks_like_json(c), F.get_json_object(_c(c), "$.id")).otherwise(_c(c))


def ref_malformed(c) -> Column:
    """true when the text looks like JSON but does not parse."""
    return looks_like_json(c) & ~json_text_ok(c)


def file_name(c) -> Column:
    """last part after '/'."""
    return F.element_at(F.split(_c(c), "/"), -1)


def file_ext(c) -> Column:
    """last part after '.' (the whole text when there is no '.')."""
    return F.element_at(F.split(_c(c), "[.]"), -1)


def media_kind(c) -> Column:
    """'itinerary' when the key contains the mark in any case, else 'image'."""
    return F.when(F.lower(_c(c)).contains(ITINERARY_MARK), "itinerary").otherwise("image")


def media_key(kind: str, name, token=None, ext=None) -> Column:
    """object key as written by the upload paths.

    kind: 'trip_image' -> trips/{slug}_{token}.{ext}; 'trip_itinerary' ->
    trips/{slug}_itinerary.{ext}; 'itinerary_dir' -> itineraries/{slug}_itinerary.{ext};
    'banner' -> banners/{slug}; 'invoice' -> {name}.{ext} (name = booking id).
    The reference's token is random hex, a new one for each image; here the
    caller passes a token that tells its images apart (``media_changes`` hashes
    the upload), so re-runs give equal keys."""
    s = slug(name)
    if kind == "trip_image":
        if token is None:
            raise ValueError("a trip image needs a token of its own")
        return F.concat(F.lit(TRIPS_PREFIX), s, F.lit("_"), _c(token), F.lit("."), _c(ext))
    if kind == "trip_itinerary":
        return F.concat(F.lit(TRIPS_PREFIX), s, F.lit("_itinerary."), _c(ext))
    if kind == "itinerary_dir":
        return F.concat(F.lit(ITINERARIES_PREFIX), s, F.lit("_itinerary."), _c(ext))
    if kind == "banner":
        return F.concat(F.lit(BANNERS_PREFIX), s)
    if kind == "invoice":
        return F.concat(_c(name).cast("string"), F.lit("."), _c(ext))
    raise ValueError(f"unknown media key kind {kind!r}")


def banner_key(c) -> Column:
    """key the banner reader looks up: trim + lower, 'banners/' added
    unless present (no slug, unlike the writer)."""
    t = F.lower(js_trim(c))
    return F.when(t.startswith(BANNERS_PREFIX), t).otherwise(F.concat(F.lit(BANNERS_PREFIX), t))


def json_text_ok(c, options: dict | None = None) -> Column:
    """JSON.parse would accept the text. As the only element of an array it must
    give exactly one element, so text after it does not pass, and repeated names
    do."""
    t = js_trim(c)
    options = {**(options or JSON_STRICT), "mode": "PERMISSIVE"}
    one = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", options)
    return F.coalesce((F.size(one) == 1) & (t != ""), F.lit(False))
