"""Metadata carried by nodes and edges as JSON text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_metadata(members: Mapping[str, Column]) -> Column:
    """JSON object of ``members`` in order; missing values stay as null members."""
    return F.to_json(F.struct(*[value.alias(key) for key, value in members.items()]), {"ignoreNullFields": "false"})


def parse_metadata(text: Column) -> Column:
    """Map of the JSON object in ``text``: none when missing, ``{"raw": text}`` when not an object."""
    parsed = F.from_json(text, "map<string,string>")
    return (
        F.when(text.isNull(), F.from_json(F.lit("{}"), "map<string,string>"))
        .when(parsed.isNotNull(), parsed)
        .otherwise(F.create_map(F.lit("raw"), text))
    )
