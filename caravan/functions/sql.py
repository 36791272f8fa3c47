"""The column functions as SQL temporary functions, so SQL users can call
them (``SELECT slug(destination_name) FROM trips``). They are SQL-bodied,
so Catalyst inlines them like any built-in expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from caravan.functions.columns import EMAIL, JS_WHITESPACE, LEADING_HEX, LEADING_INT, ROLES


def _text(s: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# the patterns and characters are those of the column functions
_TRIM = f"btrim(s, {_text(JS_WHITESPACE)})"
_ROLES = ", ".join(map(_text, ROLES))
_HEX = (f"try_cast(concat(regexp_extract(s, {_text(LEADING_HEX)}, 1), "
        f"conv(regexp_extract(s, {_text(LEADING_HEX)}, 2), 16, 10)) AS BIGINT)")

FUNCTIONS = {
    "slug": ("s STRING", "STRING", "btrim(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '-')"),
    "js_parse_int": ("s STRING", "BIGINT",
                     f"CASE WHEN regexp_extract(s, {_text(LEADING_HEX)}, 2) <> '' THEN {_HEX} "
                     f"ELSE try_cast(nullif(regexp_extract(s, {_text(LEADING_INT)}, 1), '') AS BIGINT) END"),
    "is_email": ("s STRING", "BOOLEAN", f"coalesce(s RLIKE {_text(EMAIL)}, false)"),
    "is_phone10": ("s STRING", "BOOLEAN", "coalesce(s RLIKE '^[0-9]{10}\\\\z', false)"),
    "norm_code": ("s STRING", "STRING", f"nullif(upper({_TRIM}), '')"),
    "norm_role": ("s STRING", "STRING", f"lower({_TRIM})"),
    "is_role": ("s STRING", "BOOLEAN", f"coalesce(lower({_TRIM}) IN ({_ROLES}), false)"),
    "file_name": ("s STRING", "STRING", "element_at(split(s, '/'), -1)"),
    "file_ext": ("s STRING", "STRING", "element_at(split(s, '[.]'), -1)"),
    "media_kind": ("s STRING", "STRING",
                   "CASE WHEN lower(s) LIKE '%itinerary%' THEN 'itinerary' ELSE 'image' END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary functions; returns their names."""
    for name, (params, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
