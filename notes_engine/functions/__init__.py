"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


def canonical_tags(tags: Column) -> Column:
    """Sorted, distinct, without nulls; a null array is empty."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(tags, F.array().cast("array<string>")))))


def contains_text(query: Column, *fields: Column) -> Column:
    """Whether query, in lower case, is in one of the fields in lower case; literally, without wildcards."""
    found = F.lit(False)
    for f in fields:
        found = found | F.lower(text_or_empty(f)).contains(F.lower(query))
    return found


def any_tag(tags: Column, wanted: Column) -> Column:
    """Whether the arrays share an element; false where either is null."""
    return F.coalesce(F.arrays_overlap(tags, wanted), F.lit(False))


def without_prefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def in_order(entries: Column, field: str, between: str) -> Column:
    """The texts in a field of collected structs, in the structs' order, joined."""
    return F.array_join(F.transform(F.array_sort(entries), lambda x: x[field]), between)
