"""Nested metadata as VARIANT: reading by path, key tests, merging and nested setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """The variant of a JSON text; null where it is none."""
    return F.try_parse_json(text)


def read(meta: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``a.b`` as ``kind``; null where there is none or it cannot be one."""
    return F.try_variant_get(meta, f"$.{path}", kind)


def has_key(meta: Column, key: str) -> Column:
    """Whether an object has the key, be its value null; false for other values, null for null."""
    return F.when(meta.isNotNull(), F.try_variant_get(meta, f"$.{key}", "variant").isNotNull())


def _entries(meta: Column) -> Column:
    return F.coalesce(F.try_variant_get(meta, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _object(entries: Column) -> Column:
    return F.to_variant_object(entries)


def merged(old: Column, new: Column) -> Column:
    """Both objects' keys; those of ``new`` win, whole.  A side that is null or no object counts as empty."""
    over = F.map_keys(_entries(new))
    return _object(F.map_concat(F.map_filter(_entries(old), lambda k, _: ~F.array_contains(over, k)), _entries(new)))


def with_value(meta: Column, path: list[str], value: Column) -> Column:
    """``meta`` with ``value`` (of any type that JSON has) at ``path``; a missing last key is made, a missing or plain value on the way leaves all as it was."""
    made = F.parse_json(F.to_json(F.struct(value.alias("v"))))
    inner = F.try_variant_get(made, "$.v", "variant")
    return _set(meta, path, inner)


def _set(meta: Column, path: list[str], value: Column) -> Column:
    key = path[0]
    is_object = F.try_variant_get(meta, "$", "map<string,variant>").isNotNull()
    if len(path) == 1:
        entry = F.map_from_arrays(F.array(F.lit(key)), F.array(value))
    else:
        below = F.try_variant_get(meta, f"$.{key}", "variant")
        entry = F.map_from_arrays(F.array(F.lit(key)), F.array(_set(below, path[1:], value)))
        is_object = is_object & F.try_variant_get(below, "$", "map<string,variant>").isNotNull()
    kept = F.map_filter(_entries(meta), lambda k, _: k != F.lit(key))
    return F.when(is_object, _object(F.map_concat(kept, entry))).otherwise(meta)


def text(meta: Column) -> Column:
    """The metadata as JSON text, for search."""
    return F.to_json(meta)


def search(content: Column, meta: Column, pattern: str) -> Column:
    """Whether the content or the metadata's text is like ``pattern``, whatever the case; wildcards stay live."""
    like = lambda c: F.coalesce(c.ilike(pattern), F.lit(False))
    return like(content) | like(text(meta))
