"""Smoothing splines: banded penalised least squares over a chosen number of even knots.

Rows never meet in one task: each row adds its products of basis values to its cell between two knots, so a key's rows are reduced by a
pre-aggregated sum to one row a cell. Only these are solved for, a key at a time, as a banded system, and the coefficients are joined back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basis(degree: int, deriv: int = 0) -> np.ndarray:
    """A row for each basis function that isn't zero between two knots: its polynomial there by rising powers of the way from one knot to the next, or its derivative's."""
    parts = {0: np.ones(1)}
    for d in range(1, degree + 1):
        new = {}
        for i in range(-d, 1):
            p = np.zeros(d + 1)
            for part, line in ((parts.get(i), (-i, 1)), (parts.get(i + 1), (i + d + 1, -1))):
                if part is not None:
                    p += np.convolve(part, np.array(line, float))[: d + 1] / d
            new[i] = p
        parts = new
    rows = np.array([parts[i] for i in range(-degree, 1)])
    for _ in range(deriv):
        rows = rows[:, 1:] * np.arange(1, rows.shape[1])
    return rows


def banded_solve(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of A x = right, for a positive definite A with bands[i, k] = A[i, i + k]. Rows are a few numbers wide, so plain floats are many times faster than arrays of them."""
    a, x, (n, width) = bands.tolist(), right.astype(float).tolist(), bands.shape
    for i in range(n):
        row, own = a[i], x[i]
        for k in range(1, min(width, n - i)):
            f, below = row[k] / row[0], a[i + k]
            for j in range(k, width):
                below[j - k] -= f * row[j]
            x[i + k] -= f * own
    for i in range(n - 1, -1, -1):
        row, left = a[i], x[i]
        for k in range(1, min(width, n - i)):
            left -= row[k] * x[i + k]
        x[i] = left / row[0]
    return np.array(x)


def _times(bands: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = bands[:, 0] * x
    for k in range(1, bands.shape[1]):
        out[:-k] += bands[:-k, k] * x[k:]
        out[k:] += bands[:-k, k] * x[:-k]
    return out


def penalty(n: int, width: int) -> np.ndarray:
    """Bands of D'D, D the second differences of n coefficients."""
    out = np.zeros((n, width))
    for i in range(n - 2):
        for a, x in enumerate((1.0, -2.0, 1.0)):
            for b, y in enumerate((1.0, -2.0, 1.0)):
                if b >= a:
                    out[i + a, b - a] += x * y
    return out


def smoothest(gram: np.ndarray, moment: np.ndarray, square: float, most: float) -> tuple[np.ndarray, float, float]:
    """(coefficients, residual sum of squares, weight): of the splines whose residual sum is at most ``most`` the one of the largest penalty weight,
    found by bisection between 1e-9 and 1e9 of the mean diagonal. Where none is, that of the least weight."""
    rough = penalty(len(moment), gram.shape[1])
    unit = gram[:, 0].mean() or 1.0

    def fit(power: float):
        c = banded_solve(gram + rough * (unit * 10.0**power) + np.eye(1, gram.shape[1])[0] * unit * 1e-12, moment)
        return c, float(max(0.0, square - 2 * c @ moment + c @ _times(gram, c)))

    low, high = -9.0, 9.0
    best, rss = fit(low)
    if rss > most:
        return best, rss, unit * 10.0**low
    top = fit(high)
    if top[1] <= most:
        return *top, unit * 10.0**high
    for _ in range(40):
        mid = (low + high) / 2
        c, r = fit(mid)
        if r <= most:
            low, best, rss = mid, c, r
        else:
            high = mid
    return best, rss, unit * 10.0**low


def smoothing_spline(df: DataFrame, key: str, time: str, value: str, degree: int = 3, noise: float = 0.5, rows_a_knot: float = 6.0, most_knots: int = 4096, null_keys: bool = True) -> DataFrame:
    """df with spline (value), slope (its derivative by time), rss and fits of each row.

    The smoothest spline of each key whose squared residuals sum to at most noise * rows; fits is false where even the roughest one of these knots has more (then that
    one is taken). There is a cell of even width for each rows_a_knot rows, at most most_knots. Rows with a null time or value don't count; with fewer than degree + 2 rows
    or no span of time a key has null results, as rows without a time have. A null key is a group of its own; without null_keys there are none (their rows are left out),
    and rows that are dealt by key already are joined where they are: a join that takes nulls for equal shuffles all of them."""
    df = df if null_keys else df.where(F.col(key).isNotNull())
    same = Column.eqNullSafe if null_keys else Column.__eq__
    known = F.col(time).isNotNull() & F.col(value).isNotNull()
    t, y = (F.when(known, F.col(c).cast("double")) for c in (time, value))
    shape = df.groupBy(F.col(key).alias("_k")).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.count(t).alias("_n"), F.avg(y).alias("_mean"))
    cells = F.least(F.lit(float(most_knots)), F.greatest(F.lit(1.0), F.ceil(F.col("_n") / rows_a_knot)))
    shape = shape.withColumn("_cells", F.when((F.col("_n") >= degree + 2) & (F.col("_t1") > F.col("_t0")), cells))
    span = F.when(F.col("_t1") > F.col("_t0"), F.col("_t1") - F.col("_t0"))
    placed = df.join(shape, same(df[key], shape["_k"])).withColumn("_u", (F.col(time).cast("double") - F.col("_t0")) / span * F.col("_cells"))
    placed = placed.withColumn("_cell", F.greatest(F.lit(0.0), F.least(F.floor("_u"), F.col("_cells") - 1))).withColumn("_x", F.col("_u") - F.col("_cell"))

    def poly(row: np.ndarray) -> Column:
        out = F.lit(float(row[-1]))
        for c in row[-2::-1]:
            out = out * F.col("_x") + float(c)
        return out

    width = degree + 1
    b = [poly(r) for r in basis(degree)]
    z = F.col(value).cast("double") - F.col("_mean")
    sums = [F.sum(b[i] * b[j]).alias(f"g{i}{j}") for i in range(width) for j in range(i, width)] + [F.sum(b[i] * z).alias(f"m{i}") for i in range(width)] + [F.sum(z * z).alias("zz")]
    cells_ = placed.where(known & F.col("_cells").isNotNull()).groupBy("_k", "_cell", "_cells", "_n").agg(*sums)
    kind = dict(df.dtypes)[key]

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        n = int(f["_cells"].iloc[0]) + degree
        at, gram, moment = f["_cell"].to_numpy().astype(int), np.zeros((n, width)), np.zeros(n)
        for i in range(width):
            np.add.at(moment, at + i, f[f"m{i}"].to_numpy())
            for j in range(i, width):
                np.add.at(gram, (at + i, j - i), f[f"g{i}{j}"].to_numpy())
        c, rss, _ = smoothest(gram, moment, float(f["zz"].sum()), noise * float(f["_n"].iloc[0]))
        return pd.DataFrame({"_key": f["_k"].iloc[:1].to_numpy(), "_c": [c.tolist()], "rss": [rss], "fits": [rss <= noise * float(f["_n"].iloc[0])]})

    solved = cells_.groupBy("_k").applyInPandas(solve, f"_key {kind}, _c array<double>, rss double, fits boolean")
    out = placed.join(solved, same(placed["_k"], solved["_key"]), "left")
    near = [F.get("_c", (F.col("_cell") + i).cast("int")) for i in range(width)]
    total = lambda rows: sum((poly(r) * c for r, c in zip(rows, near)), F.lit(0.0))
    slope = total(basis(degree, 1)) * F.col("_cells") / span
    return out.select(*(df[c] for c in df.columns), (total(basis(degree)) + F.col("_mean")).alias("spline"), slope.alias("slope"), "rss", "fits")
