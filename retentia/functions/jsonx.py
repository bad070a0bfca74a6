"""JSON field extraction with the dashboards' string semantics.

``json_str`` returns the string at ``path`` and ``''`` when the path is
missing, the value is not a string (a number, object, array, null) or the
document is not JSON at all. Array indexes in paths are 0-based
(``$.ctx[0].userId``).

Strict mode parses once to VARIANT and checks the value type; fast mode uses
``get_json_object`` (which renders numbers as text, e.g. ``5`` -> ``'5'``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(col: Column | str) -> Column:
    """JSON text -> VARIANT; NULL for malformed text (never fails the query)."""
    return F.try_parse_json(F.col(col) if isinstance(col, str) else col)


def variant_str(v: Column, path: str) -> Column:
    """String at ``path`` of a VARIANT, else ''."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.lit(""))


def json_str(col: Column | str, path: str, strict: bool = True) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if strict:
        return variant_str(parse(c), path)
    return F.coalesce(F.get_json_object(c, path), F.lit(""))


def identity(v: Column, user_path: str, fallback_path: str) -> Column:
    """``coalesce(nullif(user_id, ''), context user id)``; '' when both are missing."""
    return F.coalesce(F.nullif(variant_str(v, user_path), F.lit("")), variant_str(v, fallback_path))


# SQL-text forms of the same rules, for building many fields in one
# ``selectExpr`` (one plan-building call instead of one per sub-expression).


def variant_str_sql(v: str, path: str) -> str:
    x = f"try_variant_get({v}, '{path}', 'variant')"
    return f"CASE WHEN schema_of_variant({x}) = 'STRING' THEN try_variant_get({x}, '$', 'string') ELSE '' END"


def identity_sql(v: str, user_path: str, fallback_path: str) -> str:
    # CASE rather than coalesce(nullif(..)): nullif is planned as a separate
    # projection, which would parse the payload twice per row; inside one
    # projection the repeated parse is a common subexpression, computed once
    top = variant_str_sql(v, user_path)
    return f"CASE WHEN {top} = '' THEN {variant_str_sql(v, fallback_path)} ELSE {top} END"
