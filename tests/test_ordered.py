import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import network, ordered, peers


def hot_rows(n=4000, seed=3):
    """A third of all rows share one group, and half of that group shares one value."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{i % 40}"
        v = 7.25 if (g == "hot" and i % 2 == 0) else float(np.round(rng.normal(0, 1000), 3))
        rows.append((i, g, v, float(rng.integers(1, 5))))
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    rows = hot_rows()
    return rows, spark.createDataFrame(rows, "id long, g string, v double, w double").repartition(5)


@pytest.mark.parametrize("method", ["inclusive", "exclusive", "upper"])
def test_exact_quantiles_match_brute_force(hot, method):
    rows, df = hot
    stats = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    got = {r.g: r for r in ordered.exact_quantiles(df, "g", "v", stats, method).collect()}
    for g in {r[1] for r in rows}:
        vals = sorted(r[2] for r in rows if r[1] == g)
        if method == "inclusive":
            want = np.percentile(vals, [25, 50, 75])
        elif method == "exclusive":
            want = statistics.quantiles(vals, n=4)
        else:
            want = [vals[int(len(vals) * p)] for p in (0.25, 0.5, 0.75)]
        assert got[g].n == len(vals)
        assert [got[g].q1, got[g].q2, got[g].q3] == pytest.approx(list(want))


def test_bucket_is_monotone(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, 0.9999999999999999, 1.0000000000000002, 2.0, 1023.999, 1024.0, -5.5, -5.25, 1e18, -1e18, 3.3, 3.3000001])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("b", ordered.order_bucket("v"))
    buckets = [r.b for r in df.orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_running_totals_and_positions(hot):
    rows, df = hot
    run = {(r.g, r.v): r.w_run for r in ordered.running_totals(df, "g", "v", "w").collect()}
    pos = {r.id: r.position for r in ordered.with_position(df, "g", "v", "id").collect()}
    for g in ("hot", "g1"):
        members = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        total = 0.0
        for place, r in enumerate(members, 1):
            total += r[3]
            assert pos[r[0]] == place
            if place == len(members) or members[place][2] != r[2]:
                assert run[(g, r[2])] == pytest.approx(total)


def test_false_discovery_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    p = [float(x) for x in np.round(rng.uniform(0, 1, 300) ** 3, 3)]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(p)] + [(999, "a", None)], "i int, fam string, p double")
    got = {r.i: r.q for r in network.benjamini_hochberg(df, "fam").collect()}
    order = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(0, 1)
    assert [got[int(i)] for i in order] == pytest.approx(list(adj))
    assert got[999] is None


def brute_peers(units, k, weights=(1.5, 1.5, 1.5, 1.5, 1.0)):
    out = {}
    for a in units:
        cand = []
        for b in units:
            if b[0] == a[0] or not b[8]:
                continue
            d = sum(w for x, y, w in zip(a[3:8], b[3:8], weights) if x != y)
            d += abs(np.log2(b[1]) - np.log2(a[1]))
            d += abs(a[2] - b[2]) / 10 if a[2] is not None and b[2] is not None else 1.0
            cand.append((round(d, 9), b[0]))
        out[a[0]] = [p for _, p in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_peers_match_brute_force_with_a_hot_point(spark, seed):
    rng = np.random.default_rng(seed)
    units = []
    for i in range(150):
        if i % 3 == 0:
            units.append((i, 200000.0, 100.0, False, False, False, False, False, True))
        else:
            flags = [bool(x) for x in rng.random(5) < 0.3]
            units.append((i, float(10 ** rng.uniform(5, 7)), None if i % 7 == 0 else float(rng.uniform(80, 120)), *flags, bool(rng.random() < 0.8)))
    names = list(peers.STRUCTURE_WEIGHTS)
    df = spark.createDataFrame(units, "pid long, pop double, rpp double, " + ", ".join(f"{n} boolean" for n in names) + ", complete boolean")
    got = {}
    for r in peers.nearest_peers(df).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append(r.peer_pid)
    assert got == brute_peers(units, 8)


def test_peers_of_a_lone_class_under_heavier_weights(spark):
    units = [(0, 3.0e6, 90.0, True, True, True, True, True, True)]
    units += [(i, 1000.0 * i, 90.0 + i, False, False, False, False, False, True) for i in range(1, 13)]
    names = list(peers.STRUCTURE_WEIGHTS)
    weights = {k: v * 1.5 for k, v in peers.STRUCTURE_WEIGHTS.items()}
    df = spark.createDataFrame(units, "pid long, pop double, rpp double, " + ", ".join(f"{n} boolean" for n in names) + ", complete boolean")
    got = {}
    for r in peers.nearest_peers(df, weights=weights).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append(r.peer_pid)
    assert got == brute_peers(units, 8, tuple(weights.values())) and len(got[0]) == 8


def test_points_off_all_candidates_meet_few_of_them(spark):
    rng = np.random.default_rng(5)
    names = list(peers.STRUCTURE_WEIGHTS)
    # a twentieth of the units are no candidates, and smaller than all that are
    units = [(i, float(rng.uniform(100, 600) if i % 20 == 0 else rng.uniform(700, 11000)), float(rng.uniform(80, 120)), *[False] * 5, i % 20 != 0) for i in range(20000)]
    df = spark.createDataFrame(units, "pid long, pop double, rpp double, " + ", ".join(f"{n} boolean" for n in names) + ", complete boolean")
    spots = df.selectExpr("0 AS cls", "true AS priced", "log2(pop) AS x", "rpp / 10 AS y", "IF(complete, array(pid), array()) AS pids")
    blocks = peers.written(peers._blocks(spots).withColumn("block", F.monotonically_increasing_id()))
    met = peers._near_blocks(blocks, peers.STRUCTURE_WEIGHTS, 8).groupBy("block").agg(F.sum("points").alias("met"))
    far = blocks.filter("n = 0").join(met, "block").agg(F.avg("met").alias("met"), F.count(F.lit(1)).alias("n")).collect()[0]
    # ten blocks here are wide, about one unit a side; they still meet less than a quarter of the candidates
    assert far.n > 0 and far.met < 19000 / 4 and blocks.selectExpr("max(size(xs))").collect()[0][0] <= peers.BLOCK
    got = {}
    for r in peers.nearest_peers(df).filter("pid % 2000 = 0").orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append(r.peer_pid)
    away = lambda a, b: round(abs(np.log2(a[1]) - np.log2(b[1])) + abs(a[2] - b[2]) / 10, 9)
    assert got == {a[0]: [p for _, p in sorted((away(a, b), b[0]) for b in units if b[8] and b[0] != a[0])[:8]] for a in units[::2000]}


def test_points_of_crowded_blocks_search_on_their_own(spark, monkeypatch):
    rng = np.random.default_rng(6)
    units = [(i, float(10 ** rng.uniform(5, 7)), None if i % 7 == 0 else float(rng.uniform(80, 120)), *[bool(x) for x in rng.random(5) < 0.2], i % 5 != 0) for i in range(200)]
    names = list(peers.STRUCTURE_WEIGHTS)
    df = spark.createDataFrame(units, "pid long, pop double, rpp double, " + ", ".join(f"{n} boolean" for n in names) + ", complete boolean")
    monkeypatch.setattr(peers, "CROWD", 30)
    got = {}
    for r in peers.nearest_peers(df).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append(r.peer_pid)
    assert got == brute_peers(units, 8)


def test_fewer_candidates_than_peers(spark):
    names = list(peers.STRUCTURE_WEIGHTS)
    units = [(i, 1000.0 * (i + 1), 90.0, False, False, False, False, False, i < 3) for i in range(5)]
    df = spark.createDataFrame(units, "pid long, pop double, rpp double, " + ", ".join(f"{n} boolean" for n in names) + ", complete boolean")
    got = {}
    for r in peers.nearest_peers(df).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append(r.peer_pid)
    assert got == {0: [1, 2], 1: [2, 0], 2: [1, 0], 3: [2, 1, 0], 4: [2, 1, 0]}


def test_prior_max_with_a_hot_group(hot):
    rows, df = hot
    got = {r.id: r.best for r in ordered.with_prior_max(df, "g", "id", "v", "best").collect()}
    for g in ("hot", "g1"):
        best = None
        for r in sorted(r for r in rows if r[1] == g):
            assert got[r[0]] == best
            best = r[2] if best is None else max(best, r[2])


def test_false_discovery_with_mostly_missing_values(spark):
    rows = [(i, "f", None if i % 3 else i / 1000) for i in range(600)] + [(900 + i, "g", None) for i in range(50)]
    got = {r.id: r.q for r in network.benjamini_hochberg(spark.createDataFrame(rows, "id int, f string, p double"), "f").collect()}
    assert len(got) == len(rows)
    known = sorted(p for _, _, p in rows if p is not None)
    for i, _, p in rows:
        want = None if p is None else min(1, min(len(known) * b / (known.index(b) + 1) for b in known if b >= p))
        assert got[i] == (None if want is None else pytest.approx(want))
