"""Attributes of a unit's variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_lang(attrs: Column) -> Column:
    """A variant's language as exports read it: the first attribute whose name ends with ``lang``."""
    return F.coalesce(F.get(F.filter(F.map_entries(attrs), lambda e: e["key"].endswith("lang")), F.lit(0))["value"], F.lit(""))
