import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import mixing

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, source string, size int, rate string"


def targets(sizes, weights=mixing.WEIGHTS, cap=3.0):
    """Sizes by source: shares by weight, capped, excess dealt again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        share = {s: cap * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and share[s] > cap * sizes[s]}
        if not over:
            return share
        capped |= over


def check(rows, texts, weights=mixing.WEIGHTS, near=0.01):
    sizes, want, taken, largest = {}, {}, {}, {}
    for source, text in texts:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(n, largest.get(source, 0))
    goal = targets(sizes, weights) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    return sizes, goal


def by_source(docs, out):
    return {r["source"]: r for r in docs.select("doc_id", "source").join(out, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("source_size")).collect()}


def test_given_table_meets_its_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixture(docs)
    rows = out.collect()
    sizes, goal = check(rows, [(r["source"], r["text"]) for r in docs.collect()])
    for source, r in by_source(docs, out).items():
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(goal[source])
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"] + 5
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_rates_are_tilted_and_meet_the_token_constraint(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.select("doc_id", "source").join(mixing.mixture(docs), "doc_id").collect() if r["source"] == "src0" and r["size"]]
    mean = rows[0]["source_size"] / sum(1 for r in rows)
    assert sum(r["rate"] * r["size"] for r in rows) == pytest.approx(rows[0]["target"], rel=1e-3)
    duals = [np.log(r["rate"]) * mean / r["size"] for r in rows if 0.01 < r["rate"] < 2.99 and r["size"] > 30]
    assert max(duals) - min(duals) < 1e-2


def test_capped_targets_null_sources_and_repeats(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("w" for _ in range(n))
    data = [(i, words(rng.randrange(1, 60)), "big", 0, "x") for i in range(300)]
    data += [(1000 + i, words(3), "a", 0, "x") for i in range(5)] + [(2000 + i, words(10), None, 0, "x") for i in range(9)]
    data += [(3000, None, "blank", 0, "x"), (3001, "", "blank", 0, "x"), (None, words(7), "big", 0, "x"), (5, words(5), "big", 0, "x"), (5, words(5), "big", 0, "x")]
    docs = spark.createDataFrame(data, SCHEMA)
    out = mixing.mixture(docs).collect()
    sizes, goal = check(out, [(s, t) for _, t, s, *_ in data])
    assert len(out) == len(data)
    assert {(r["source_size"], round(r["target"], 6)) for r in out} == {(sizes[s], round(goal[s], 6)) for s in sizes}
    assert all(r["taken"] == 9 for r in out if r["source_size"] == 15)
    assert mixing.mixture(docs.limit(0)).collect() == []
    blank = mixing.mixture(docs.where("source = 'blank'")).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in blank] == [(0, 0, 0.0)] * 2


def test_every_row_appears_as_often_as_the_mixture_takes_it(spark):
    data = [(i % 40, f"text number {i % 40} " * (1 + i % 5), "s" + str(i % 3), 0, "x") for i in range(50)] + [(None, None, None, 0, "x")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    want = sum(r["copies"] for r in mixing.mixture(docs).collect())
    assert got.count() == want
    words = sum(len(r["text"].split()) for r in got.collect() if r["text"])
    assert words == sum(r["taken"] for r in mixing.mixture(docs).collect())


def test_rounding_carries_the_error_on():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 500, 2000))[::-1]
    rates = rng.random(2000) * 2.5
    copies = mixing.copies_of(sizes, rates, 3)
    assert abs((copies * sizes).sum() - (rates * sizes).sum()) <= sizes[-1] and copies.max() <= 3
