"""JSON helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_key(c: Column, *keys: str) -> Column:
    """First non-blank value of alternative keys, then of the same keys in a JSON text under ``body``."""
    body = F.get_json_object(c, "$.body")
    found = [F.nullif(F.trim(F.get_json_object(x, f"$.{k}")), F.lit("")) for x in (c, body) for k in keys]
    return F.coalesce(*found, F.lit(""))


def parse_vector(c: Column) -> Column:
    """A JSON list as a vector; a bad or empty one gives null."""
    v = F.from_json(c, "array<double>")
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), v)
