"""JSON, maps and vectors. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_nulls(m: Column) -> Column:
    """A map without its null values; false, zero and empty texts stay."""
    return F.map_filter(m, lambda k, v: v.isNotNull())


def map_total(m: Column) -> Column:
    """The sum of a map's values; null for an empty or null map."""
    return F.when(F.size(m) > 0, F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))))


def json_or_raw(c: Column) -> Column:
    """The text if it is JSON, else {"_raw": text}."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.to_json(F.struct(c.alias("_raw"))))


def json_array(c: Column, schema: str) -> Column:
    """An array parsed from a text; empty if it is no JSON array of that schema."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit("[]"), schema))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
