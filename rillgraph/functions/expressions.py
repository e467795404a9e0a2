"""Scalar rules as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(uri: Column) -> Column:
    """After the only ``#``, else the last ``/`` segment; null gives the text ``None``."""
    parts = F.split(uri, "#")
    return F.when(uri.isNull(), "None").when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.element_at(F.split(uri, "/"), -1))


def qualified(uri: Column, base: str | None, points: str) -> Column:
    """Absolute names stay; others get the base namespace, or the point namespace without one."""
    space = points if base is None else base if base.endswith(("/", "#")) else base + "/"
    return F.when(uri.contains("://") | uri.startswith("urn:"), uri).otherwise(F.concat(F.lit(space), uri))


def is_name(value: object) -> bool:
    """Whether a filter value stands for an IRI; everything else is a plain string literal."""
    return isinstance(value, str) and ("://" in value or value.startswith("urn:"))


def stream_handle(uri: Column) -> Column:
    return F.substring(F.sha1(uri.cast("binary")), 1, 10)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; two empty ones are alike, one empty one is like nothing."""
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def initialism(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def parsed_time(text: Column) -> Column:
    """ISO text (zone, ``Z`` or none: UTC; also without separators), else a number: seconds, above 1e11 milliseconds. Else null."""
    number = text.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    day = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    short = F.when(text.rlike(r"^\d{8}T\d{6}Z?$"), F.try_to_timestamp(F.substring(text, 1, 15), F.lit("yyyyMMdd'T'HHmmss")))
    long = F.when(number.isNull() & text.rlike(r"^\s*\d{4}-"), F.try_to_timestamp(text))
    return F.coalesce(day, short, F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")), long)


def strict_number(text: Column, kind: str) -> Column:
    """Numeric text as double or long; null for anything else, such as suffixes or padding that a cast would accept."""
    form = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$" if kind == "double" else r"^[+-]?\d+$"
    special = text.isin("NaN", "inf", "-inf", "Infinity", "-Infinity") if kind == "double" else F.lit(False)
    return F.when(text.rlike(form) | special, text.try_cast(kind))


def converted(value: Column, from_mul: Column, from_off: Column, to_mul: Column, to_off: Column) -> Column:
    """Unit conversion in double arithmetic: (x + offset) * factor, back through the target's."""
    return (value + from_off) * from_mul / to_mul - to_off
