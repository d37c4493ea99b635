"""Tolerant reading of model output that should be JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


# Follows the value inside an array: it is only found there if the value before it ended where the text ends.
_END = "end of reply \u241c"


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value; white space around it doesn't count."""
    parsed = F.try_parse_json(F.concat(F.lit("["), strip(c), F.lit(f', "{_END}"]')))
    return F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == _END, F.lit(False))


def is_json_object(c: Column) -> Column:
    """Whether the whole text is one JSON object; white space around it doesn't count."""
    return F.coalesce(strip(c).startswith("{"), F.lit(False)) & is_json(c)


def extract_json_object(c: Column) -> Column:
    """JSON text from the first ``{`` to the last ``}``, or ``{}`` where there is none that parses."""
    return let(
        F.regexp_extract(strip(F.coalesce(c, F.lit(""))), r"(?s)\{.*\}", 0),
        lambda blob: F.when((blob != "") & is_json(blob), blob).otherwise(F.lit("{}")),
    )


def field(c: Column, path: str, spark_type: str) -> Column:
    """One field of a JSON column, null when absent, malformed or of another type."""
    return F.try_variant_get(F.when(is_json(c), F.try_parse_json(strip(c))), path, spark_type)


def has_field(c: Column, path: str) -> Column:
    return F.try_variant_get(F.when(is_json(c), F.try_parse_json(strip(c))), path, "variant").isNotNull()
