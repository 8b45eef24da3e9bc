"""Lead-lag networks: all ordered pairs of nodes, lagged correlation, screening, stability, cascades."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.ordered import order_bucket, shared, spread, top_k, value_ranks, with_one_row

# Screening and stability rules of the network.
RHO_MIN, FDR, MIN_WINDOWS, LAG_SPREAD = 0.25, 0.05, 3, 2
NODE_COVERAGE, MONTH_COVERAGE = 0.80, 0.60


def window_slabs(panel: DataFrame, windows: list[tuple[str, int, int]], min_coverage: float = NODE_COVERAGE) -> DataFrame:
    """Rows of each named month window, for nodes with enough of the window's months: panel(node, m, x, ...)."""
    spec = panel.sparkSession.createDataFrame(windows, "win string, lo int, hi int")
    rows = panel.filter("x IS NOT NULL").join(F.broadcast(spec), F.col("m").between(F.col("lo"), F.col("hi")))
    good = rows.groupBy("win", "node", "lo", "hi").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= (F.col("hi") - F.col("lo") + 1) * min_coverage)
    return rows.join(good.select("win", "node"), ["win", "node"], "left_semi").drop("lo", "hi")


def covered_months(panel: DataFrame, min_coverage: float = MONTH_COVERAGE) -> DataFrame:
    """Months where nodes carrying enough of the total weight have a value: panel(node, m, x, w)."""
    total = panel.groupBy("node").agg(F.max("w").alias("w")).agg(F.sum("w").alias("_t"))
    month = panel.filter("x IS NOT NULL").groupBy("m").agg(F.sum("w").alias("_w"))
    good = month.join(F.broadcast(total.limit(1)), F.lit(True)).filter(F.col("_w") >= F.col("_t") * min_coverage)
    return panel.join(good.select("m"), "m", "left_semi")


def remove_common_factor(slabs: DataFrame, headline: DataFrame, min_obs: int = 60) -> DataFrame:
    """Residual of each node on the headline without the node itself, fitted inside the window.

    slabs(win, node, m, x, w percent); headline(m, h).  The headline is centred
    and a missing month counts as its mean.
    """
    mean = headline.agg(F.avg("h").alias("_hm"))
    rows = slabs.join(headline, "m", "left").join(F.broadcast(mean.limit(1)), F.lit(True))
    share = F.coalesce("w", F.lit(0.0)) / 100
    rest = (F.coalesce(F.col("h") - F.col("_hm"), F.lit(0.0)) - share * F.col("x")) / F.greatest(1 - share, F.lit(1e-6))
    rows = rows.withColumn("_g", rest)
    fit = rows.groupBy("win", "node").agg(F.count(F.lit(1)).alias("_n"), F.regr_slope("x", "_g").alias("_b"), F.regr_intercept("x", "_g").alias("_a")).filter(F.col("_n") >= min_obs)
    joined = rows.join(fit, ["win", "node"])
    return joined.select("win", "node", "m", (F.col("x") - F.col("_a") - F.col("_b") * F.col("_g")).alias("x"), "w")


def _blocks(slabs: DataFrame, nodes_per_block: int) -> DataFrame:
    """One row per (window, node) with its dated values, sent to every block pair it takes part in.

    The number of blocks follows the number of nodes, so a block pair holds about
    twice ``nodes_per_block`` short series, however many nodes there are.
    """
    rows = slabs.filter("x IS NOT NULL")
    node = rows.groupBy("win", "node").agg(F.sort_array(F.collect_list(F.struct("m", "x"))).alias("s"))
    packed = node.select("win", "node", F.transform("s", lambda v: v["m"]).alias("ms"), F.transform("s", lambda v: v["x"]).alias("xs"))
    count = rows.select("node").distinct().agg(F.greatest(F.ceil(F.count(F.lit(1)) / nodes_per_block), F.lit(1)).cast("int").alias("_k"))
    packed = with_one_row(packed, count).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    packed = packed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    src = packed.select("win", "node", "ms", "xs", F.col("_b").alias("sb"), F.col("_o").alias("db"), F.lit(True).alias("is_src"))
    dst = packed.select("win", "node", "ms", "xs", F.col("_o").alias("sb"), F.col("_b").alias("db"), F.lit(False).alias("is_src"))
    return src.unionByName(dst)


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Names and centred (time, node) matrices of the sources and destinations of a block pair."""
    src, dst = (pdf[pdf["is_src"] == side].sort_values("node").reset_index(drop=True) for side in (True, False))
    if not len(src) or not len(dst):
        return None
    first = min(int(np.min(v)) for v in pdf["ms"])
    length = max(int(np.max(v)) for v in pdf["ms"]) - first + 1
    A, B = _matrix(src, first, length), _matrix(dst, first, length)
    # centring changes no correlation and no slope, and keeps the closed forms accurate
    return src["node"].to_numpy(), dst["node"].to_numpy(), A - np.nanmean(A, axis=0), B - np.nanmean(B, axis=0)


def _matrix(pdf: pd.DataFrame, first: int, length: int) -> np.ndarray:
    out = np.full((length, len(pdf)), np.nan)
    for j, (ms, xs) in enumerate(zip(pdf["ms"], pdf["xs"])):
        out[np.asarray(ms, int) - first, j] = xs
    return out


def _powers(values: np.ndarray) -> np.ndarray:
    """(time, 3, series): 1, x and x^2 where x is known, zeros elsewhere."""
    known = np.isfinite(values)
    x = np.where(known, values, 0.0)
    return np.stack([known.astype(float), x, x * x], axis=1)


def _lag_grid(A: np.ndarray, B: np.ndarray, max_lag: int, min_obs: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and number of common rows at [lag - 1, source, destination]."""
    rho, rows = [], []
    for k in range(1, min(max_lag, len(A) - 1) + 1):
        # one product of the stacked powers (1, x, x^2) holds every moment of every pair
        moments = np.einsum("tpi,tqj->pqij", _powers(A[:-k]), _powers(B[k:]), optimize=True)
        n = moments[0, 0]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean_a, mean_b = moments[1, 0] / n, moments[0, 1] / n
            var_a, var_b = moments[2, 0] / n - mean_a**2, moments[0, 2] / n - mean_b**2
            r = (moments[1, 1] / n - mean_a * mean_b) / np.sqrt(var_a * var_b)
        r[~((n >= min_obs) & (var_a > 0) & (var_b > 0))] = np.nan
        rho.append(r)
        rows.append(n.astype(np.int64))
    shape = (0, A.shape[1], B.shape[1])
    return (np.stack(rho), np.stack(rows)) if rho else (np.zeros(shape), np.zeros(shape, np.int64))


_EDGES = "win string, src string, dst string, lag int, n bigint, rho double"


def _per_block_pair(slabs: DataFrame, nodes_per_block: int, edges) -> DataFrame:
    """``edges(A, B)`` gives (source, destination, lag, n, rho) arrays of one block pair."""

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(pdf)
        if sides is None:
            return pd.DataFrame(columns=["win", "src", "dst", "lag", "n", "rho"])
        i, j, lag, n, rho = edges(*sides[2:])
        out = pd.DataFrame({"win": pdf["win"].iloc[0], "src": sides[0][i], "dst": sides[1][j], "lag": lag, "n": n, "rho": rho})
        return out[out["src"] != out["dst"]]

    return spread(_blocks(slabs, nodes_per_block), "win", "sb", "db").groupBy("win", "sb", "db").applyInPandas(per_block, _EDGES)


def lagged_correlations(slabs: DataFrame, max_lag: int = 12, min_obs: int = 60, nodes_per_block: int = 64) -> DataFrame:
    """corr(x_src at t-k, x_dst at t) for every ordered pair and lag 1..max_lag, pairwise complete.

    The result itself is all ordered pairs; each task multiplies two bounded
    blocks of node series, so no month's pairs are ever written out.
    """

    def every(A, B):
        rho, rows = _lag_grid(A, B, max_lag, min_obs)
        k, i, j = np.nonzero(rows)
        return i, j, k + 1, rows[k, i, j], rho[k, i, j]

    out = _per_block_pair(slabs, nodes_per_block, every)
    return out.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


def strongest_lag(slabs: DataFrame, max_lag: int = 12, min_obs: int = 60, nodes_per_block: int = 64) -> DataFrame:
    """Lag of the largest |rho| of every ordered pair that has one, the shortest on ties; a block returns one row a pair."""

    def best(A, B):
        rho, rows = _lag_grid(A, B, max_lag, min_obs)
        size = np.where(np.isnan(rho), -1.0, np.round(np.abs(rho), 12))
        if not len(size):
            return (np.zeros(0, np.int64),) * 5
        k = size.argmax(axis=0)
        i, j = np.nonzero(size.max(axis=0) >= 0)
        at = k[i, j]
        return i, j, at + 1, rows[at, i, j], rho[at, i, j]

    return _per_block_pair(slabs, nodes_per_block, best).select("win", "src", "dst", "lag", "rho", "n")


def f_upper_tail(f, d1, d2) -> np.ndarray:
    """P(F > f) by the continued fraction of the incomplete beta function; arrays or numbers."""
    f, d1, d2 = np.broadcast_arrays(np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float))
    f = np.maximum(f, 0.0)
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    inner = (x > 0) & (x < 1)
    safe = np.where(inner, x, 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.where(inner, np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(safe) + b * np.log1p(-safe)), 0.0)
    direct = safe < (a + 1) / (a + b + 2)
    part = front * _beta_fraction(np.where(direct, a, b), np.where(direct, b, a), np.where(direct, safe, 1 - safe)) / np.where(direct, a, b)
    return np.where(x >= 1, 1.0, np.where(direct, part, 1 - part))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    def off_zero(v):
        return np.where(np.abs(v) > 1e-300, v, 1e-300)

    c, d = np.ones_like(x), 1 / off_zero(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / off_zero(1 + num * d)
            c = off_zero(1 + num / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return h


def _lags_of(values: np.ndarray, lags: int) -> np.ndarray:
    """(time, lag, node): each series 1..lags rows earlier."""
    out = np.full((len(values), lags, values.shape[1]), np.nan)
    for q in range(1, min(lags, len(values) - 1) + 1):
        out[q:, q - 1] = values[:-q]
    return out


def granger_grid(A: np.ndarray, B: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """F at [destination, source], and the number of complete rows, for every pair of two blocks at once.

    Every sum over a pair's complete rows is a product of a destination part and a
    source part, so the normal equations of all pairs are a few matrix products.
    The own lags are taken out first: what is left of the source's lags is the
    Schur complement of their block.  The middle of the HAC covariance comes from
    products of the scores at each distance; a pair's rows are moved together
    first, because distance counts complete rows.
    """
    own, theirs = _lags_of(B, lags), _lags_of(A, lags)
    has_dst = (np.isfinite(B) & np.isfinite(own).all(axis=1)).astype(float)
    has_src = np.isfinite(theirs).all(axis=1).astype(float)
    y = np.where(has_dst > 0, B, 0.0)
    D = np.concatenate((has_dst[:, None], np.where(has_dst[:, None] > 0, own, 0.0)), axis=1)
    S = np.where(has_src[:, None] > 0, theirs, 0.0)

    def over_time(left, right):
        """Sums over time at [destination, source, ..., ...]."""
        total = np.tensordot(left, right, axes=(0, 0))
        p, q = left.ndim - 2, right.ndim - 2
        return np.moveaxis(total, (p, p + 1 + q), (0, 1))

    n = over_time(has_dst, has_src)
    shared_, cross = over_time(D[:, :, None] * D[:, None], has_src), over_time(D, S)
    added = over_time(has_dst, S[:, :, None] * S[:, None])
    with_y, s_with_y = over_time(D * y[:, None], has_src), over_time(y, S)

    solve = np.linalg.pinv(shared_, hermitian=True)
    G, h = solve @ cross, np.einsum("jiab,jib->jia", solve, with_y)
    schur = added - np.swapaxes(cross, 2, 3) @ G
    g = s_with_y - np.einsum("jiab,jia->jib", cross, h)
    beta = np.einsum("jibc,jic->jib", np.linalg.pinv(schur, hermitian=True), g)

    ok = has_dst[:, :, None] * has_src[:, None]
    left = S[:, :, None] - np.einsum("taj,jiab->tbji", D, G)
    rest = y[:, :, None] - np.einsum("taj,jia->tji", D, h) - np.einsum("tbji,jib->tji", left, beta)
    score = left * (rest * ok)[:, None]
    together = np.argsort(ok < 1, axis=0, kind="stable")
    score = np.take_along_axis(score, together[:, None], axis=0)
    most = np.maximum(1, np.floor(4 * (n / 100) ** (2 / 9)))
    middle = np.einsum("tbji,tcji->jibc", score, score)
    for apart in range(1, min(int(most.max()), len(B) - 1) + 1):
        near = np.einsum("tbji,tcji->jibc", score[apart:], score[:-apart])
        middle += np.maximum(0.0, 1 - apart / (most + 1))[:, :, None, None] * (near + np.swapaxes(near, 2, 3))
    form = np.einsum("jib,jibc,jic->ji", g, np.linalg.pinv(middle, hermitian=True), g)
    k = 1 + 2 * lags
    with np.errstate(invalid="ignore", divide="ignore"):
        return form * np.maximum(n - k, 1) / n / lags, n.astype(np.int64)


def granger(slabs: DataFrame, lags: int = 6, min_obs: int = 60, nodes_per_block: int = 64) -> DataFrame:
    """F test (HAC) that the source's lags add to the destination's own, for every ordered pair."""

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["win", "src", "dst", "f", "p", "n"]
        sides = _sides(pdf)
        if sides is None:
            return pd.DataFrame(columns=names)
        src, dst, A, B = sides
        f, n = granger_grid(A, B, lags)
        k = 1 + 2 * lags
        j, i = np.nonzero((n >= min_obs) & (n > k) & np.isfinite(f) & (f >= 0) & (dst[:, None] != src[None]))
        f, n = f[j, i], n[j, i]
        return pd.DataFrame({"win": pdf["win"].iloc[0], "src": src[i], "dst": dst[j], "f": f, "p": f_upper_tail(f, lags, n - k), "n": n})[names]

    return spread(_blocks(slabs, nodes_per_block), "win", "sb", "db").groupBy("win", "sb", "db").applyInPandas(per_block, "win string, src string, dst string, f double, p double, n bigint")


def benjamini_hochberg(df: DataFrame, group, p: str = "p", name: str = "q") -> DataFrame:
    """q = min over larger p of m * p / rank, clipped to 1; NULL p stays NULL.

    Ties share their highest rank.  The running minimum goes over order buckets
    first and inside a bucket second, so a group is never one task.
    """
    group = [group] if isinstance(group, str) else list(group)
    ranked = value_ranks(df.filter(F.col(p).isNotNull()), group, p)
    steps = ranked.select(*group, p, (F.col("group_n") * F.col(p) / F.col("rank_high")).alias("_a")).withColumn("_bucket", order_bucket(p))
    after = Window.partitionBy(*group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    heads = steps.groupBy(*group, "_bucket").agg(F.min("_a").alias("_m")).withColumn("_later", F.min("_m").over(after))
    inside = Window.partitionBy(*group, "_bucket").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = steps.join(heads, [*group, "_bucket"]).select(*group, p, F.least(F.min("_a").over(inside), F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias(name))
    kept = df.filter(F.col(p).isNotNull()).join(q, [*group, p])
    return kept.unionByName(df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")).select(*kept.columns))


def screen(edges: DataFrame, rho_min: float = RHO_MIN, fdr: float = FDR) -> DataFrame:
    """Edges with |rho| above the bar or q below the rate."""
    hit = (F.abs("rho") > rho_min) | (F.col("q") < fdr) if "q" in edges.columns else F.abs("rho") > rho_min
    return edges.withColumn("passed", F.coalesce(hit, F.lit(False)))


def stable_edges(screened: DataFrame, min_windows: int = MIN_WINDOWS, spread: int = LAG_SPREAD) -> DataFrame:
    """Passing windows, sign agreement and lag spread around the median per edge (a handful of windows each)."""
    ok = screened.filter("passed")
    out = ok.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min(F.signum("rho")).alias("_lo"),
        F.max(F.signum("rho")).alias("_hi"),
        F.median("lag").alias("median_lag"),
        F.min("lag").alias("_l0"),
        F.max("lag").alias("_l1"),
    )
    near = F.greatest(F.col("median_lag") - F.col("_l0"), F.col("_l1") - F.col("median_lag")) <= spread
    flag = (F.col("n_windows") >= min_windows) & (F.col("_lo") == F.col("_hi")) & near
    return out.select("src", "dst", "n_windows", "median_lag", flag.alias("stable"))


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree and upstreamness = sum |rho| out - sum |rho| in, over edges(src, dst, rho)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.abs("rho").alias("r")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), (-F.abs("rho")).alias("r")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("r").alias("upstreamness"))


def cascade(edges: DataFrame, first: int = 6) -> DataFrame:
    """Two levels from every node: its strongest ``first`` edges, then up to twice as many onward edges to nodes not yet visited."""
    strength = [F.round(F.abs("rho"), 12).desc(), F.col("dst")]
    level1 = shared(top_k(edges, "src", strength, first, "r1"))
    visited = level1.groupBy("src").agg(F.collect_set("dst").alias("_seen"))
    hop = edges.select(F.col("src").alias("via"), F.col("dst").alias("dst2"), F.col("lag").alias("lag2"), F.col("rho").alias("rho2"))
    onward = (
        level1.join(visited, "src")
        .withColumnRenamed("dst", "via")
        .join(hop, "via")
        .filter((F.col("dst2") != F.col("src")) & ~F.array_contains("_seen", F.col("dst2")))
    )
    order = [F.col("r1"), F.round(F.abs("rho2"), 12).desc(), F.col("dst2")]
    level2 = top_k(onward, "src", order, first * 2, "r2")
    a = level1.select("src", F.lit(1).alias("level"), F.lit(None).cast("string").alias("via"), "dst", "lag", F.col("lag").alias("cum_lag"), "rho", F.col("r1").alias("rank"))
    b = level2.select("src", F.lit(2).alias("level"), "via", F.col("dst2").alias("dst"), F.col("lag2").alias("lag"), (F.col("lag") + F.col("lag2")).alias("cum_lag"), F.col("rho2").alias("rho"), F.col("r2").alias("rank"))
    return a.unionByName(b)


def expected_pairs(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """Named expectations with what was found: expected(name, src, dst)."""
    return expected.join(edges.select("src", "dst", "lag", "rho", "stable"), ["src", "dst"], "left").withColumn("found", F.coalesce("stable", F.lit(False)))
