import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag
from statloom.operators import indexes, network, panel, regress, timeseries, vintages, xsection


def test_gap_month_leaves_lags_null(spark):
    df = spark.createDataFrame([("a", m, float(m)) for m in range(1, 30) if m != 10], "item string, m int, x double")
    got = {r.m: (r.l1, r.l12) for r in df.select("m", calendar_lag("x", "item", "m", 1).alias("l1"), calendar_lag("x", "item", "m", 12).alias("l12")).collect()}
    assert got[11][0] is None and got[22][1] is None and got[12][0] == 11.0 and got[23][1] == 11.0


def test_step_percentile_and_trimmed_mean(spark):
    rows = [(1, 1.0, 30.0), (1, 2.0, 20.0), (1, 2.0, 10.0), (1, 5.0, 40.0), (1, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "m int, x double, w double")
    r = xsection.weighted_distribution(df, "m", "x", "w", min_items=1, min_weight=1).collect()[0]
    assert (r.n, r.p50, r.p25, r.p75) == (4, 2.0, 1.0, 5.0)
    assert r.trim16 == pytest.approx((1 * 0.14 + 2 * 0.30 + 5 * 0.24) / 0.68)


def test_variance_shares_sum_to_one(spark):
    rng = np.random.default_rng(0)
    rows = [(f"i{i}", m, float(rng.normal())) for i in range(4) for m in range(1, 31) if not (i == 2 and m == 7)]
    shares = xsection.variance_shares(spark.createDataFrame(rows, "item string, m int, c double"), "item", "m", windows=(24,))
    for r in shares.groupBy("m").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_chain_skips_thin_months_and_restarts(spark):
    dec = 12
    cells = [("a", dec, 100.0), ("b", dec, 100.0)] + [("a", dec + k, 100.0 + k) for k in range(1, 13)] + [("b", dec + k, 100.0) for k in range(1, 13) if k != 3]
    df = spark.createDataFrame(cells, "item string, m int, idx double")
    schemes = spark.createDataFrame([("s", 0, "a", 50.0), ("s", 0, "b", 50.0)], "scheme string, weight_year int, item string, w double")
    pub = spark.createDataFrame([(dec, 200.0)], "m int, level double")
    got = {r.m: r.level for r in indexes.chain(df, schemes, pub).collect()}
    assert dec + 3 not in got
    assert got[dec + 12] == pytest.approx(200 * (112 + 100) / 200)


def test_zero_weight_fan_out_is_split_equally(spark):
    conc = spark.createDataFrame([("1", "FA01"), ("1", "FB02"), ("2", "FA01"), ("2", "ZZ99")], "code string, target string")
    leaf = spark.createDataFrame([("SEFA01", 0.0), ("SEFB", 0.0), ("SEFA", 3.0)], "item string, w double")
    got = {(r.code, r.item): r.share for r in indexes.map_codes(conc, leaf).collect()}
    assert got == {("1", "SEFA01"): 0.5, ("1", "SEFB"): 0.5, ("2", "SEFA01"): 0.5}


def test_revision_table(spark):
    rows = [("s", "2020-01-01", 1, 0.5), ("s", "2020-02-01", 1, 0.6), ("s", "2021-03-01", 1, 0.9), ("s", "2020-02-01", 2, 0.1), ("s", "2020-01-01", 0, 9.0)]
    df = spark.createDataFrame(rows, "series string, v string, obs_m int, mom double").withColumn("vintage", F.to_date("v"))
    got = {r.obs_m: r for r in vintages.revisions(df).collect()}
    assert got[1].first_print == 0.5 and got[1].after_1y == 0.9 and got[1].rev_latest == pytest.approx(0.4)
    assert got[2].after_1y is None and got[0].true_first is False and got[1].true_first is True


def test_as_of_falls_back_to_earliest(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9)], "key string, y int")
    right = spark.createDataFrame([("k", 4, 0.4), ("k", 8, 0.8)], "key string, yr int, se double")
    got = {r.y: (r.matched, r.se) for r in vintages.as_of(left, right, "key", "y", "yr", "se").collect()}
    assert got == {1: (4, 0.4), 5: (4, 0.4), 9: (8, 0.8)}


def test_known_lag_is_found(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=160)
    y = np.concatenate([rng.normal(size=2), x[:-2]]) * 0.9 + rng.normal(size=160) * 0.2
    rows = [("x", m, float(v)) for m, v in enumerate(x, 1) if m != 50] + [("y", m, float(v)) for m, v in enumerate(y, 1)]
    slabs = spark.createDataFrame([("w", n, m, v) for n, m, v in rows], "win string, node string, m int, x double")
    best = {(r.src, r.dst): r for r in network.strongest_lag(slabs, 6, 60, nodes_per_block=1).collect()}
    assert best[("x", "y")].lag == 2 and best[("x", "y")].rho > 0.9
    tests = {(r.src, r.dst): r.p for r in network.granger(slabs, 3, 60, nodes_per_block=1).collect()}
    assert tests[("x", "y")] < 1e-6 < tests[("y", "x")]


def gappy_slabs(spark, nodes, months, seed=4):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(months, nodes)).cumsum(axis=0) * 0.1 + rng.normal(size=(months, nodes))
    values[2:, 1] += 0.8 * values[:-2, 0]
    values[rng.random(values.shape) < 0.03] = np.nan
    rows = [("w", f"n{j:02d}", m + 7, float(values[m, j])) for m in range(months) for j in range(nodes) if np.isfinite(values[m, j])]
    return values, spark.createDataFrame(rows, "win string, node string, m int, x double")


def test_granger_blocks_equal_one_regression_a_pair(spark):
    values, slabs = gappy_slabs(spark, 7, 110)
    lags, want = 3, {}
    for i in range(7):
        for j in range(7):
            back = [np.concatenate([np.full(q, np.nan), v[:-q]]) for v in (values[:, j], values[:, i]) for q in range(1, lags + 1)]
            Z = np.column_stack([np.ones(110), *back])
            ok = np.isfinite(values[:, j]) & np.isfinite(Z).all(axis=1)
            n = int(ok.sum())
            if i != j and n >= 40:
                b, cov, _ = regress.solve_hac(values[ok, j], Z[ok], max(1, regress.automatic_lags(n)))
                tail = b[1 + lags :]
                want[f"n{i:02d}", f"n{j:02d}"] = (float(tail @ np.linalg.inv(cov[1 + lags :, 1 + lags :]) @ tail) / lags, n)
    for per_block in (2, 64):
        got = {(r.src, r.dst): r for r in network.granger(slabs, lags, 40, nodes_per_block=per_block).collect()}
        assert got.keys() == want.keys() and len(got) > 30
        for edge, (f, n) in want.items():
            assert got[edge].f == pytest.approx(f, rel=1e-8) and got[edge].n == n
            assert got[edge].p == pytest.approx(float(network.f_upper_tail(f, lags, n - 1 - 2 * lags)), rel=1e-7)


def test_blocks_follow_the_nodes_and_return_one_row_a_pair(spark):
    values, slabs = gappy_slabs(spark, 9, 80)
    sizes = network._blocks(slabs, 2).groupBy("sb", "db", "is_src").count().collect()
    assert max(r.sb for r in sizes) > 1 and sum(r["count"] for r in sizes if r.is_src) == 9 * 5
    every = network.lagged_correlations(slabs, 5, 30, nodes_per_block=3).collect()
    best = {(r.src, r.dst): r for r in network.strongest_lag(slabs, 5, 30, nodes_per_block=4).collect()}
    assert len(best) == 72
    for edge, row in best.items():
        own = [r for r in every if (r.src, r.dst) == edge and r.rho is not None]
        want = min(own, key=lambda r: (-round(abs(r.rho), 12), r.lag))
        assert (row.lag, row.n) == (want.lag, want.n) and row.rho == pytest.approx(want.rho)


def test_f_tail_known_values():
    assert network.f_upper_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert network.f_upper_tail(2.8661, 4, 20) == pytest.approx(0.05, abs=1e-4)


def test_grouped_hac_matches_direct_formula(spark):
    rng = np.random.default_rng(2)
    n = 80
    x = rng.normal(size=n)
    y = 1 + 2 * x + rng.normal(size=n)
    df = spark.createDataFrame([("g", i, float(a), float(b), 3) for i, (a, b) in enumerate(zip(x, y))], "k string, m int, x double, y double, lags int")
    got = {r.term: r for r in regress.grouped_hac(df, ["k"], "y", ["x"], "m").collect()}
    X = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    g = X * (y - X @ b)[:, None]
    S = g.T @ g
    for lag in (1, 2, 3):
        c = g[lag:].T @ g[:-lag]
        S += (1 - lag / 4) * (c + c.T)
    se = np.sqrt(np.diag(inv @ S @ inv) * n / (n - 2))
    assert got["x"].beta == pytest.approx(b[1]) and got["x"].se == pytest.approx(se[1]) and got["const"].beta == pytest.approx(b[0])


def test_parents_and_partition(spark):
    rows = [("t", "ALL", "0", 0), ("t", "food", "1", 1), ("t", "bread", "2", 2), ("t", "skip", "3", 3), ("t", "energy", "4", 1), ("t", "odd", "5", 3)]
    got = {r.item: r.parent for r in panel.parents_from_levels(spark.createDataFrame(rows, "scope string, item string, o string, level int"), "scope", "item", "o", "level").collect()}
    assert got == {"ALL": None, "food": "ALL", "bread": "food", "skip": "bread", "energy": "ALL", "odd": None}
    tree = spark.createDataFrame([("ALL", None), ("a", "ALL"), ("b", "ALL"), ("a1", "a"), ("a2", "a"), ("b1", "b")], "item string, parent string")
    w = spark.createDataFrame([("ALL", 100.0), ("a", 60.0), ("b", 40.0), ("a1", 30.0), ("a2", 30.0), ("b1", 10.0)], "item string, w double")
    assert {r.item for r in panel.complete_partition(tree, w).collect()} == {"a1", "a2", "b"}


def test_pressure_counts_only_what_is_left(spark):
    pairs = spark.createDataFrame([("p", "s", "d", 2, 1.0, 0.1, 99.0)], "pair string, src string, dst string, best_lag int, beta12 double, se12 double, weight double")
    weights = spark.createDataFrame([("d", -1, 10.0)], "dst string, weight_year int, w double")
    betas = spark.createDataFrame([("p", 0, 0.25), ("p", 1, None)], "pair string, h int, beta double")
    series = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 0.0), ("s", 3, 3.0)], "series string, m int, v double")
    parts, total = timeseries.pressure(pairs, betas, series, weights, months=1)
    base = 1.0
    want = ((3 - base) * 0.75 + (0 - base) * 1.0) * 10
    assert parts.collect()[0].contribution == pytest.approx(want) and total.collect()[0].total == pytest.approx(want)


def test_ancestors_of_a_chain_deeper_than_one_hundred(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(110)], "item string, parent string")
    rows = panel.ancestors(chain).filter("item = '109'").collect()
    assert sorted(r.depth for r in rows) == list(range(1, 110))
    with pytest.raises(ValueError):
        panel.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "item string, parent string"))


def test_event_regression_matches_dummies_with_hac(spark):
    rng = np.random.default_rng(4)
    rel = np.array([r for r in range(-24, 25) if r not in (-20, 3, 12)])
    gap = rng.normal(size=len(rel))
    df = spark.createDataFrame([(7, int(r), float(g)) for r, g in zip(rel, gap)], "event_m int, rel int, gap double")
    steps = [h for h in range(-6, 13) if h in rel]
    X = np.column_stack([np.ones(len(rel))] + [(rel == h).astype(float) for h in steps])
    b, cov, _ = regress.solve_hac(gap, X, 6, small_sample=False)
    post = [i + 1 for i, h in enumerate(steps) if h >= 0]
    got = timeseries.event_regression(df).first()
    assert got.cum == pytest.approx(b[post].sum()) and got.cum_se == pytest.approx(np.sqrt(cov[np.ix_(post, post)].sum()))
    coefficients = {r.rel: (r.beta, r.se) for r in timeseries.event_coefficients(df).collect()}
    assert set(coefficients) == set(steps)
    assert all(coefficients[h] == pytest.approx((b[i + 1], np.sqrt(cov[i + 1, i + 1]))) for i, h in enumerate(steps))
    pre = (rel >= -6) & (rel <= -1)
    pb, pc, _ = regress.solve_hac(gap[pre], np.column_stack([np.ones(pre.sum()), rel[pre]]), 2, small_sample=False)
    assert got.pre_slope == pytest.approx(pb[1]) and got.pre_t == pytest.approx(pb[1] / np.sqrt(pc[1, 1]))


def test_rolling_windows_match_one_regression_each(spark):
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.normal(size=60)) * 0.3 + rng.normal(size=60)
    x[[11, 40, 59 - 3]] = np.nan
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x) if np.isfinite(v)], "k string, m int, v double")
    got = {r.m: r for r in timeseries.rolling_ar3_and_errors(df, "k", "v", 30, 20, 4).collect()}
    for end in range(29, 60):
        w = x[end - 29 : end + 1]
        if (np.isfinite(w[1:]) & np.isfinite(w[:-1])).sum() < 20:
            assert end not in got
            continue
        rows = [(1.0, w[i - 1], w[i - 2], w[i - 3], w[i]) for i in range(3, 30)]
        data = np.array([r for r in rows if np.isfinite(r).all()])
        coef = np.linalg.lstsq(data[:, :4], data[:, 4], rcond=None)[0]
        assert got[end].ar3sum == pytest.approx(coef[1:].sum())
        pairs = [(i, w[i], w[i + 4]) for i in range(26) if np.isfinite(w[i]) and np.isfinite(w[i + 4])]
        a, y = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
        slope, dx = np.polyfit(a, y, 1)[0], a - a.mean()
        z = dict(zip([p[0] for p in pairs], dx * (y - y.mean() - slope * dx)))
        total = sum(u * v * (1 - abs(i - j) / 6) for i, u in z.items() for j, v in z.items() if abs(i - j) <= 5)
        n = len(pairs)
        assert got[end].lp_se == pytest.approx(np.sqrt(total * n / (n - 2)) / (dx @ dx))


def test_expanding_percentile_counts_by_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [("a", m, None if m % 11 == 3 else float(rng.integers(-40, 40))) for m in range(150)] + [("b", m, 1.0) for m in range(20)] + [("c", 5, 2.0)]
    rows += [("d", m // 2, float(rng.normal())) for m in range(60)]  # two values a month
    df = spark.createDataFrame(rows, "s string, m int, v double")
    from statloom.operators import xsection

    got = sorted(map(tuple, xsection.expanding_percentile(df, "s", "m", "v", 12).collect()), key=repr)
    want = []
    for s, m, v in rows:
        past = [x for t, k, x in rows if t == s and k <= m and x is not None]
        want.append((s, m, v, sum(x <= v for x in past) * 100.0 / len(past) if v is not None and len(past) >= 12 else None))
    assert got == sorted(want, key=repr)


def test_window_slopes_equal_one_regression_a_window(spark):
    rng = np.random.default_rng(6)
    n = 140
    X = rng.normal(size=(n, 4)).cumsum(axis=0) * 0.2 + rng.normal(size=(n, 4)) + [5.0, -3.0, 0.0, 40.0]
    y = 2 + X @ [0.7, -0.2, 0.1, 0.3] + rng.normal(size=n)
    first = np.array([0, 11, 40, 90])
    last = first + np.array([60, 48, 100, 50])
    lags = np.array([3, 0, 12, 1])
    beta, se = regress.window_slopes(y, X, first, last, lags)
    for w, (a, b) in enumerate(zip(first, last)):
        want, cov, _ = regress.solve_hac(y[a:b], np.column_stack([np.ones(b - a), X[a:b]]), int(lags[w]))
        assert beta[w] == pytest.approx(want[1], rel=1e-9) and se[w] == pytest.approx(np.sqrt(cov[1, 1]), rel=1e-9)
    assert len(regress.window_slopes(y, X, first[:0], last[:0], lags[:0])[0]) == 0


def test_node_universes_of_a_deep_tree(spark):
    tree = [("r", None), ("a", "r"), ("b", "r"), ("a1", "a"), ("a2", "a"), ("a11", "a1"), ("a12", "a1"), ("b1", "b"), ("b11", "b1"), ("c", "r"), ("c1", "c"), ("c2", "c"), ("c11", "c1")]
    off = {"r", "b", "c1"}  # c11 lies below a node that is of no use
    w = {"r": 100, "a": 50, "a1": 30, "a2": 18, "a11": 20, "a12": 9, "b": 30, "b1": 30, "b11": 28, "c": 20, "c1": 10, "c2": 10, "c11": 10}
    nodes = spark.createDataFrame([(i, i not in off, float(w[i])) for i, _ in tree], "item string, usable boolean, w double")
    got = {r.item: r for r in panel.node_universes(spark.createDataFrame(tree, "item string, parent string"), nodes, 0.9).collect()}
    assert {i for i, r in got.items() if r.coarse} == {"a", "b1", "c"}
    assert {i for i, r in got.items() if r.fine} == {"a11", "a12", "a2", "b11", "c2", "c11"}
    # a opens (48 of 50), a1 too (29 of 30), b1 too (28 of 30), c does not (10 of 20)
    assert {i for i, r in got.items() if r.hybrid} == {"a11", "a12", "a2", "b11", "c"}
