"""Small scalar helpers shared by the ingest and feature operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(col: str | Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Label by descending thresholds: first ``col >= cut`` wins, else last name.

    ``band(score, [9, 7, 4], ["Critical", "High", "Medium", "Low"])``.
    """
    if len(names) != len(cuts) + 1:
        raise ValueError("need one more name than cuts")
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for cut, name in zip(cuts, names):
        cond = c >= F.lit(float(cut))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(names[-1]))


def coerce_double(col: str | Column, default: float = 0.0) -> Column:
    """Parse to double; unparsable, NULL or NaN becomes ``default`` (never raises)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nanvl(F.coalesce(c.cast("string").try_cast("double"), F.lit(float(default))), F.lit(float(default)))


def coerce_flag(col: str | Column, default: int = 0) -> Column:
    """Parse to a whole number, cut towards zero; what is no finite number becomes ``default`` (never raises)."""
    c = F.col(col) if isinstance(col, str) else col
    number = c.cast("string").try_cast("double")
    whole = F.when(~F.isnan(number), number).try_cast("bigint")
    return F.coalesce(whole, F.lit(int(default)).cast("bigint"))


def fill_category(col: str | Column, missing: str = "UNKNOWN") -> Column:
    """Category as string with NULL replaced by ``missing``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(missing))
