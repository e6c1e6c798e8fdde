"""Higher-order-function helpers for nested documents.

All of them are JVM-side array expressions (``filter``, ``transform``,
``exists``, ``flatten``), so flattening a document never leaves whole-stage
codegen and never needs a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_preferred(arr: Column, pred: Callable[[Column], Column]) -> Column:
    """First element matching ``pred``, else the first element, else NULL."""
    return F.coalesce(F.try_element_at(F.filter(arr, pred), F.lit(1)), F.try_element_at(arr, F.lit(1)))


def matching_values(arr: Column, inner: str, keep: Callable[[Column], Column],
                    value: Callable[[Column], Column]) -> Column:
    """Flattened ``value(d)`` for every ``d`` in ``x.inner`` (for x in ``arr``)
    with ``keep(d)``, in document order.  NULL arrays count as empty."""
    return F.flatten(F.transform(F.coalesce(arr, F.array()),
                                 lambda x: F.transform(F.filter(F.coalesce(x[inner], F.array()), keep), value)))


def first_or(arr: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(arr, F.lit(1)), F.lit(default))


def size0(arr: Column) -> Column:
    """Array length with NULL as 0."""
    return F.coalesce(F.size(F.coalesce(arr, F.array())), F.lit(0))


def token_distinct_count(strings: Column, sep: str, index: int, min_tokens: int) -> Column:
    """Distinct count of the ``index``-th (0-based) ``sep`` token of every string
    that has at least ``min_tokens`` tokens (a naive split, no escapes)."""
    parts = F.transform(F.coalesce(strings, F.array()), lambda s: F.split(s, sep))
    keep = F.filter(parts, lambda p: F.size(p) >= min_tokens)
    return F.size(F.array_distinct(F.transform(keep, lambda p: p[index])))


def any_tag(arr: Column, tags_field: str, tag: str) -> Column:
    """1 if any element's ``tags_field`` array contains ``tag``, else 0."""
    hit = F.exists(F.coalesce(arr, F.array()),
                   lambda r: F.coalesce(F.array_contains(r[tags_field], F.lit(tag)), F.lit(False)))
    return F.coalesce(hit, F.lit(False)).cast("int")


def year_prefix(s: Column) -> Column:
    """Integer of the first four characters, NULL when unparsable."""
    return F.substring(s, 1, 4).try_cast("int")


def once(value: Column) -> Column:
    """``value`` as a column of its own in a ``select``: the optimizer copies a plain expression into every use
    of its column (filters, fields), and so computes it again for each; it does not copy a generated one."""
    return F.explode(F.array(value))
