"""JSON columns of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def robust_json(x: Column) -> Column:
    """FN-22: text as a variant, null when it is not JSON."""
    return F.try_parse_json(x)


def json_field(x: Column, path: str) -> Column:
    """FN-22: the text under a path of a JSON text, null when absent or malformed."""
    return F.try_variant_get(robust_json(x), path, "string")
