"""Typed access to JSON text and VARIANT columns: a value of another type is missing, never converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member_text(doc: Column, path: str) -> Column:
    """A string at a path of a VARIANT; null for other types."""
    value = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, path, "string"))


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def finite_number(doc: Column, path: str) -> Column:
    """A finite number; null for flags, strings, infinite and missing values."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    value = F.try_variant_get(doc, path, "double")
    return F.when(_is_number(kind) & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def whole_number(doc: Column, path: str, fallback: Column | None = None) -> Column:
    """An integer, also one written as 3.0; else the fallback."""
    value = finite_number(doc, path)
    return F.coalesce(F.when((value == F.floor(value)) & (F.abs(value) < 2**53), value.cast("long")), fallback if fallback is not None else F.lit(None).cast("long"))


def flag(doc: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(doc, path, "boolean"))


def same_keys(text: Column, keys: list[str]) -> Column:
    """Whether a JSON object has exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))
