"""Least squares with HAC errors on many small groups.

A group here is one (series or pair, horizon, window) and is bounded by the
calendar; Spark spreads the groups, numpy solves one at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from statloom.operators.ordered import spread


def solve_hac(y: np.ndarray, X: np.ndarray, lags: int, small_sample: bool = True):
    """Coefficients, covariance and residuals.

    Coefficient j is a weighted sum of y with weights W[j]; row t moves it by
    W[j, t] * resid[t].  The covariance sums the products of these pulls with a
    weight that falls to zero ``lags`` + 1 rows apart.
    """
    n, k = X.shape
    weights = np.linalg.pinv(X)
    beta = weights @ y
    resid = y - X @ beta
    pull = weights * resid
    cov = pull @ pull.T
    for apart in range(1, min(lags, n - 1) + 1):
        near = pull[:, apart:] @ pull[:, :-apart].T
        cov += (1 - apart / (lags + 1)) * (near + near.T)
    return beta, cov * (n / max(n - k, 1)) if small_sample else cov, resid


def automatic_lags(n: int, horizon: int = 0) -> int:
    return horizon + math.floor(4 * (n / 100) ** (2 / 9))


def grouped_hac(df: DataFrame, keys: list[str], y: str, xs: list[str], order: str, lags: str = "lags", min_n: int = 24) -> DataFrame:
    """OLS of y on a constant and ``xs`` per group, rows with a missing value left out.

    ``lags`` names an integer column: the truncation lag, or -1-h for the
    automatic rule at horizon h.  One row per coefficient.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    names = ["const", *xs]
    result = [*keys, "term", "beta", "se", "n", "r2"]

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        data = np.column_stack([group[c].to_numpy().astype(float) for c in (y, *xs)])
        data = data[np.isfinite(data).all(axis=1)]
        n = len(data)
        if n < max(min_n, len(names) + 1):
            return empty
        wanted = group[lags][0].as_py()
        Y, X = data[:, 0], np.column_stack([np.ones(n), data[:, 1:]])
        b, cov, u = solve_hac(Y, X, automatic_lags(n, -1 - wanted) if wanted < 0 else wanted)
        total = float(((Y - Y.mean()) ** 2).sum())
        r2 = 1 - float(u @ u) / total if total > 0 else None
        head = [[group[k][0].as_py()] * len(names) for k in keys]
        columns = [*head, names, b, np.sqrt(np.clip(np.diag(cov), 0, None)), [n] * len(names), [r2] * len(names)]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=result)

    schema = f"{fields}, term string, beta double, se double, n bigint, r2 double"
    types = to_arrow_schema(StructType.fromDDL(schema)).types
    empty = pa.table({k: pa.array([], t) for k, t in zip(result, types)})
    return spread(df.select(*keys, y, *xs, order, lags), *keys).groupBy(*keys).applyInArrow(fit, schema)


def window_slopes(y: np.ndarray, X: np.ndarray, first: np.ndarray, last: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and HAC error of the first column of X, beside a constant and the others, in every window of rows first..last-1.

    Cross products run along the rows once; a window's are the difference of two.
    The other columns are taken out of y and of the first column, so the error
    needs only one score for each row and window.
    """
    if not len(first):
        return np.zeros(0), np.zeros(0)
    columns = np.column_stack([np.ones(len(y)), X[:, 1:], X[:, 0], y])
    centre = np.concatenate(([0.0], columns[:, 1:].mean(axis=0)))  # moves the constant only
    columns = columns - centre
    products = np.concatenate((np.zeros((1, columns.shape[1], columns.shape[1])), np.cumsum(columns[:, :, None] * columns[:, None], axis=0)))
    gram = products[last] - products[first]
    k, n = X.shape[1], last - first
    others = np.linalg.pinv(gram[:, :k, :k], hermitian=True)
    out = others @ gram[:, :k, k:]  # what the others explain of x and of y
    left = gram[:, k:, k:] - np.swapaxes(gram[:, :k, k:], 1, 2) @ out
    with np.errstate(invalid="ignore", divide="ignore"):
        slope = left[:, 0, 1] / left[:, 0, 0]
    rest = np.einsum("tk,wkc->wtc", columns[:, :k], out)
    x, u = columns[:, k] - rest[..., 0], columns[:, k + 1] - rest[..., 1]
    score = x * (u - slope[:, None] * x)
    rows = np.arange(len(y))
    score[(rows < first[:, None]) | (rows >= last[:, None])] = 0.0
    total = (score * score).sum(axis=1)
    for apart in range(1, min(int(lags.max()), len(y) - 1) + 1):
        total += 2 * np.maximum(0.0, 1 - apart / (lags + 1)) * (score[:, apart:] * score[:, :-apart]).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return slope, np.sqrt(np.maximum(total, 0.0) * n / np.maximum(n - k - 1, 1)) / left[:, 0, 0]


def specification_grid(df: DataFrame, keys: list[str], y: str, specs: dict[str, list[str]], order: str, long: str, short: str) -> DataFrame:
    """Slopes of every specification with errors under two truncation lags, and what each adds to the first one.

    The first specification is the base; a later one adds one regressor, its
    last, and gets the gain in r2 and the Wald statistic of that regressor.
    """
    out, base = None, None
    for name, xs in specs.items():
        wide = grouped_hac(df, keys, y, xs, order, long).filter("term <> 'const'").withColumnRenamed("se", "se_long")
        narrow = grouped_hac(df, keys, y, xs, order, short).select(*keys, "term", F.col("se").alias("se_short"))
        fit = wide.join(narrow, [*keys, "term"]).withColumn("spec", F.lit(name))
        if base is None:
            base = fit.select(*keys, F.col("r2").alias("_r2")).distinct()
            fit = fit.withColumn("delta_r2", F.lit(None).cast("double")).withColumn("wald", F.lit(None).cast("double"))
        else:
            added = fit.filter(F.col("term") == xs[-1]).select(*keys, F.pow(F.col("beta") / F.col("se_long"), F.lit(2.0)).alias("wald"))
            fit = fit.join(base, keys).join(added, keys).withColumn("delta_r2", F.col("r2") - F.col("_r2")).drop("_r2")
        out = fit if out is None else out.unionByName(fit)
    return out.select(*keys, "spec", "term", "n", "beta", "se_long", "se_short", "r2", "delta_r2", "wald")


def rolling_slope_error(df: DataFrame, key: str, order: str, y: str, x: str, rows: int = 24, lags: int = 6) -> DataFrame:
    """key, order, beta, se of y on x over the last ``rows`` rows of a series, HAC with ``lags``.

    A row carries the array of its window, so nothing is copied through a
    shuffle; everything after that is array arithmetic inside the row.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    seen = df.select(key, order, F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w).alias("v")).filter(F.size("v") == rows)

    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda a, b: a + b)

    means = seen.withColumn("mx", total(F.transform("v", lambda v: v["x"])) / rows).withColumn("my", total(F.transform("v", lambda v: v["y"])) / rows)
    centred = means.select(key, order, F.transform("v", lambda v: v["x"] - F.col("mx")).alias("dx"), F.transform("v", lambda v: v["y"] - F.col("my")).alias("dy"))
    sums = centred.withColumn("sxx", total(F.transform("dx", lambda v: v * v))).withColumn("sxy", total(F.zip_with("dx", "dy", lambda a, b: a * b)))
    fit = sums.filter("sxx > 0").withColumn("beta", F.col("sxy") / F.col("sxx"))
    scored = fit.withColumn("z", F.zip_with("dx", "dy", lambda a, b: a * (b - F.col("beta") * a)))
    meat = total(F.transform("z", lambda v: v * v))
    for apart in range(1, lags + 1):
        near = F.zip_with(F.slice("z", 1, rows - apart), F.slice("z", apart + 1, rows - apart), lambda a, b: a * b)
        meat = meat + 2 * (1 - apart / (lags + 1)) * total(near)
    error = F.sqrt(F.greatest(meat, F.lit(0.0)) * rows / (rows - 2)) / F.col("sxx")
    return scored.select(key, order, "beta", error.alias("se"))
