"""Feature preparation (F01-F08): valid-label filter, top-N folding, fills,
numeric coercion, one-hot, assembly and population standardisation.

``FeaturePrep.fit`` runs three small jobs (top-N values, category levels,
mean/population-sd) and keeps their results as literals; ``transform`` is then a
single projection, so the encoded table is one narrow stage over the input.
Levels are fitted once, so a later (rebalanced) table keeps the same width;
an unseen level encodes as all zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions.scalar import coerce_double, coerce_flag, fill_category

MAX_LEVELS = 10_000


def keep_valid_labels(df: DataFrame, label: str, valid: Sequence[str] | None) -> DataFrame:
    """rows whose label is in ``valid`` (all non-NULL labels when None)."""
    if valid is None:
        return df.where(F.col(label).isNotNull())
    return df.where(F.col(label).isin(*list(valid)))


def top_values(df: DataFrame, column: str, n: int) -> list:
    """The ``n`` most frequent non-NULL values (ties: value ascending)."""
    rows = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
            .orderBy(F.col("_c").desc(), F.col(column).asc()).limit(n).collect())
    return [r[0] for r in rows]


def fold_top_n(column: str, keep: Sequence, other: str = "OTHER"):
    """values outside ``keep`` (and NULL) become ``other``."""
    c = F.col(column)
    if not keep:
        return F.lit(other)
    return F.when(c.isin(*list(keep)), c.cast("string")).otherwise(F.lit(other))


def one_hot_name(column: str, value: str, sep: str = "_") -> str:
    return f"{column}{sep}{value}"


@dataclass
class FeaturePrep:
    """Roles of the input columns.  ``fold`` maps a source column to
    ``(new_name, n)``: the new categorical keeps the top ``n`` values."""

    label: str
    categorical: Sequence[str] = ()
    numeric: Sequence[str] = ()
    binary: Sequence[str] = ()
    valid_labels: Sequence[str] | None = None
    fold: dict = field(default_factory=dict)
    scale: bool = True
    keep: Sequence[str] = ()
    features_col: str = "features"
    other: str = "OTHER"
    unknown: str = "UNKNOWN"

    def fit(self, df: DataFrame) -> "FittedPrep":
        d = keep_valid_labels(df, self.label, self.valid_labels)
        if not d.limit(1).collect():
            raise ValueError("no rows with a valid label")
        folds = {src: (name, top_values(d, src, n)) for src, (name, n) in self.fold.items()}
        base = self._filled(d, folds)
        levels = self._levels(base)
        stats = {}
        if self.scale and self.numeric:
            aggs = []
            for c in self.numeric:
                aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
            r = base.agg(*aggs).first()
            for c in self.numeric:
                sd = r[f"s_{c}"]
                stats[c] = (float(r[f"m_{c}"] or 0.0), float(sd) if sd else 1.0)
        return FittedPrep(self, folds, levels, stats)

    def _filled(self, d: DataFrame, folds) -> DataFrame:
        """F02-F04 applied: folded/filled categoricals, coerced numerics and binaries."""
        cols = [F.col(self.label)] + [F.col(k) for k in self.keep]
        for src, (name, keep) in folds.items():
            d = d.withColumn(name, fold_top_n(src, keep, self.other))
        cols += [fill_category(c, self.unknown).alias(c) for c in self.categorical]
        cols += [coerce_double(c).alias(c) for c in self.numeric]
        cols += [coerce_flag(c).alias(c) for c in self.binary]
        return d.select(*cols)

    def _levels(self, base: DataFrame) -> dict[str, list[str]]:
        if not self.categorical:
            return {}
        pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in self.categorical])
        rows = (base.select(F.explode(pairs).alias("p")).select("p.k", "p.v").distinct()
                .limit(MAX_LEVELS + 1).collect())
        if len(rows) > MAX_LEVELS:
            raise ValueError("too many category levels to one-hot encode; fold them first")
        out: dict[str, list[str]] = {c: [] for c in self.categorical}
        for r in rows:
            out[r["k"]].append(r["v"])
        return {c: sorted(v) for c, v in out.items()}


@dataclass
class FittedPrep:
    spec: FeaturePrep
    folds: dict
    levels: dict
    stats: dict

    @property
    def feature_names(self) -> list[str]:
        """F06 order: numeric, binary, then one-hot (column order, levels ascending)."""
        s = self.spec
        names = list(s.numeric) + list(s.binary)
        for c in s.categorical:
            names += [one_hot_name(c, v) for v in self.levels[c]]
        return names

    def transform(self, df: DataFrame, assemble: bool = True, wide: bool = True) -> DataFrame:
        """label, kept columns, wide features and (optionally) a vector."""
        s = self.spec
        d = keep_valid_labels(df, s.label, s.valid_labels)
        base = s._filled(d, self.folds)
        cols = [F.col(s.label)] + [F.col(k) for k in s.keep]
        for c in s.numeric:
            if c in self.stats:
                m, sd = self.stats[c]
                cols.append(((F.col(c) - F.lit(m)) / F.lit(sd)).alias(c))
            else:
                cols.append(F.col(c))
        cols += [F.col(c) for c in s.binary]
        for c in s.categorical:
            for v in self.levels[c]:
                cols.append((F.col(c) == F.lit(v)).cast("int").alias(one_hot_name(c, v)))
        out = base.select(*cols)
        if assemble:
            names = self.feature_names
            out = VectorAssembler(inputCols=names, outputCol=s.features_col).transform(out)
            if not wide:
                out = out.drop(*names)
        return out


def catalog(spark, prep: FeaturePrep) -> DataFrame:
    """Feature catalog: name and role of every input column."""
    rows = ([(prep.label, "target")] + [(c, "categorical") for c in prep.categorical]
            + [(c, "numeric") for c in prep.numeric] + [(c, "binary") for c in prep.binary])
    return spark.createDataFrame(rows, "name string, type string")
