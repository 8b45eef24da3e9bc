import random
from zlib import crc32

import numpy as np

from statloom.llm import nbsvm

SF = "/root/testdata/sf0.01"


def slow_indicators(text):
    found = {(text[i] << 8) | text[i + 1] for i in range(len(text) - 1)}
    for i in range(len(text) - 2):
        code = (text[i] << 16 | text[i + 1] << 8 | text[i + 2]) * 2654435761 % 2**32
        found.add(nbsvm.TRIPLE_BASE + (code >> 32 - nbsvm.HASH_BITS))
    words = text.split()
    codes = [nbsvm.REPEAT if i and words[i] == words[i - 1] else crc32(w) for i, w in enumerate(words)]
    for order in range(3):
        for i in range(len(codes) - order):
            gram = codes[i]
            for k in range(1, order + 1):
                gram = (gram * 31 + codes[i + k]) % 2**32
            mixed = (gram ^ gram >> 15) * (2246822519 + 2 * order) % 2**32
            found.add(nbsvm.WORD_BASE + (mixed >> 32 - nbsvm.HASH_BITS))
    return sorted(found)


def test_indicators_equal_a_plain_loop():
    rng = random.Random(6)
    mask = np.zeros(nbsvm.DIMS, bool)
    for text in ["", "a", "ab", "a b", "x x x x y", "é ü  \n z", *(" ".join(rng.choice("abcde") * rng.randrange(1, 4) for _ in range(60)) for _ in range(20))]:
        assert nbsvm.indicators(text.encode(), mask).tolist() == slow_indicators(text.encode())
    assert not mask.any()


def test_descent_reaches_the_optimum_of_the_dual():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    labels = np.array([int(r[0] < 3) for r in rows])
    scale = rng.normal(size=nbsvm.DIMS)
    weights, intercept = nbsvm.dual_descent(rows, scale, labels, 1.0, 2000)
    signs = np.where(labels == 1, 1, -1)
    boxes = len(labels) / 2 / np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum())
    dense = np.zeros((60, 40))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r] / np.sqrt(scale[r] @ scale[r])

    def primal(w, b):
        return (w @ w + b * b) / 2 + (boxes * np.maximum(0, 1 - signs * (dense @ w + b))).sum()

    w = weights[:40]
    best = primal(w, intercept)
    assert all(primal(w + rng.normal(0, 0.01, 40), intercept + rng.normal(0, 0.01)) >= best - 1e-3 for _ in range(300))


def test_held_out_accuracy_and_contract(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = nbsvm.quality_scores(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    again = {r["doc_id"]: r["score"] for r in nbsvm.quality_scores(docs, labels).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(nbsvm.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = nbsvm.fit(docs, labels), nbsvm.fit(docs, turned)
    assert (one.weights == two.weights).all() and (one.slope, one.offset) == (two.slope, two.offset)


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "word word", 9.0), (2, "x " * 90_000, 9.0)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in nbsvm.quality_scores(docs, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 1)], "doc_id bigint, quality int")
    assert len(nbsvm.quality_scores(docs, one).collect()) == 4
    assert nbsvm.quality_scores(docs.limit(0), one).collect() == []
    assert nbsvm.accepted(docs, none, threshold=0.4).columns == docs.columns
