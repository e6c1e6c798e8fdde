"""Class probabilities from one-vs-rest margins.

For each pair of classes a sigmoid of the difference of their margins is fitted
(Platt 1999, with his softened targets) on margins of rows that the model was not
trained on; the pairwise probabilities of a row are then coupled to one distribution
over the classes (Wu, Lin and Weng 2004).

The sigmoids of all pairs are fitted together: a Newton step is one aggregation
over (pair, row), whose result is a handful of sums per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.session import ship_package


def pair_rows(margins: DataFrame, label: str, raw: str, classes: int) -> DataFrame:
    """(i, j, z, own): for every row and other class, the margin difference of the pair (i < j), and whether the row is of class i."""
    x = margins.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("_y"), F.col(raw).alias("_m"))
    others = F.filter(F.array(*[F.lit(c) for c in range(classes)]), lambda c: c != F.col("_y"))
    x = x.select("_y", "_m", F.explode(others).alias("_o"))
    i, j = F.least("_y", "_o"), F.greatest("_y", "_o")
    return x.select(i.alias("i"), j.alias("j"), (F.get("_m", i) - F.get("_m", j)).alias("z"), (F.col("_y") == i).alias("own"))


@dataclass
class PairSigmoids:
    """P(i | i or j) = 1 / (1 + exp(a[i, j] z + b[i, j])) of the margin difference z."""

    a: np.ndarray
    b: np.ndarray

    def pairs(self, margins: np.ndarray) -> np.ndarray:
        """[row, i, j]: the probability of i against j."""
        n, k = margins.shape
        r = np.full((n, k, k), 0.5)
        for i in range(k):
            for j in range(i + 1, k):
                e = np.clip(self.a[i, j] * (margins[:, i] - margins[:, j]) + self.b[i, j], -500, 500)
                r[:, i, j] = np.clip(1 / (1 + np.exp(e)), 1e-7, 1 - 1e-7)
                r[:, j, i] = 1 - r[:, i, j]
        return r


def fit_sigmoids(margins: DataFrame, label: str, raw: str, classes: int, steps: int = 25, tolerance: float = 1e-5) -> PairSigmoids:
    """Fit every pair's sigmoid on the rows of ``margins`` (array column ``raw``); a pair of which a class has no rows stays at even odds
    shifted towards the class that is there."""
    rows = pair_rows(margins, label, raw, classes).persist()
    counts = {(r["i"], r["j"]): (r["p"], r["n"]) for r in rows.groupBy("i", "j").agg(
        F.sum(F.col("own").cast("long")).alias("p"), F.sum((~F.col("own")).cast("long")).alias("n")).collect()}
    a, b = np.zeros((classes, classes)), np.zeros((classes, classes))
    for (i, j), (p, n) in counts.items():
        b[i, j] = np.log((n + 1) / (p + 1))
    table = "i int, j int, a double, b double, hi double, lo double"
    spark = margins.sparkSession

    def sums(places: list[tuple[int, int]], at: dict) -> dict:
        """Loss, gradient and Hessian sums of each pair at its parameters."""
        params = spark.createDataFrame(
            [(i, j, float(at[i, j][0]), float(at[i, j][1]), (counts[i, j][0] + 1) / (counts[i, j][0] + 2), 1 / (counts[i, j][1] + 2))
             for i, j in places], table)
        x = rows.join(F.broadcast(params), ["i", "j"])
        f = F.col("a") * F.col("z") + F.col("b")
        t = F.when(F.col("own"), F.col("hi")).otherwise(F.col("lo"))
        p = F.when(f >= 0, F.exp(-f) / (1 + F.exp(-f))).otherwise(1 / (1 + F.exp(f)))
        loss = F.when(f >= 0, t * f + F.log1p(F.exp(-f))).otherwise((t - 1) * f + F.log1p(F.exp(f)))
        d, w, z = t - p, p * (1 - p), F.col("z")
        got = x.groupBy("i", "j").agg(*(F.sum(c).alias(n) for n, c in (
            ("loss", loss), ("ga", z * d), ("gb", d), ("haa", z * z * w), ("hab", z * w), ("hbb", w)))).collect()
        return {(r["i"], r["j"]): r for r in got}

    todo = [p for p, (m, n) in counts.items() if m and n]
    now = {p: (a[p], b[p]) for p in todo}
    state = sums(todo, now) if todo else {}
    for _ in range(steps):
        step, todo = {}, [p for p in todo if max(abs(state[p]["ga"]), abs(state[p]["gb"])) >= tolerance * max(1, sum(counts[p]))]
        if not todo:
            break
        for p in todo:
            s = state[p]
            h11, h22, h21 = s["haa"] + 1e-12, s["hbb"] + 1e-12, s["hab"]
            det = h11 * h22 - h21 * h21
            step[p] = (-(h22 * s["ga"] - h21 * s["gb"]) / det, -(-h21 * s["ga"] + h11 * s["gb"]) / det)
        size, left = {p: 1.0 for p in todo}, list(todo)
        while left:  # halve the steps of the pairs whose loss does not fall
            tried = {p: (now[p][0] + size[p] * step[p][0], now[p][1] + size[p] * step[p][1]) for p in left}
            got, rest = sums(left, tried), []
            for p in left:
                if got[p]["loss"] <= state[p]["loss"] + 1e-12 * abs(state[p]["loss"]):
                    now[p], state[p] = tried[p], got[p]
                elif size[p] > 1e-8:
                    size[p] /= 2
                    rest.append(p)
                else:
                    todo.remove(p)
            left = rest
    rows.unpersist()
    for (i, j), (x, y) in now.items():
        a[i, j], b[i, j] = x, y
    return PairSigmoids(a, b)


def couple(pairs: np.ndarray, steps: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """One distribution per row that agrees best with the pairwise probabilities [row, i, j] of i against j."""
    n, k, _ = pairs.shape
    q = -np.swapaxes(pairs, 1, 2) * pairs
    own = pairs ** 2
    at = np.arange(k)
    own[:, at, at] = 0
    q[:, at, at] = own.sum(1)
    p = np.full((n, k), 1 / k)
    for _ in range(steps):
        qp = np.einsum("nij,nj->ni", q, p)
        pqp = (p * qp).sum(1)
        if n == 0 or np.abs(qp - pqp[:, None]).max() < tolerance:
            break
        for t in range(k):
            diff = (pqp - qp[:, t]) / q[:, t, t]
            p[:, t] += diff
            pqp = (pqp + diff * (diff * q[:, t, t] + 2 * qp[:, t])) / (1 + diff) ** 2
            qp = (qp + diff[:, None] * q[:, t, :]) / (1 + diff)[:, None]
            p /= (1 + diff)[:, None]
    return p


def with_probability(df: DataFrame, sigmoids: PairSigmoids, raw: str = "rawPrediction", out: str = "probability") -> DataFrame:
    """Add the coupled probabilities as a vector; ``raw`` is a vector of margins."""
    ship_package(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(col: pd.Series) -> pd.Series:
        m = np.stack(col.to_numpy()) if len(col) else np.zeros((0, len(sigmoids.a)))
        return pd.Series(list(couple(sigmoids.pairs(m))))

    return df.withColumn(out, array_to_vector(score(vector_to_array(raw))))
