import random

import numpy as np
import pytest
from test_simhash import slow_fingerprint

from statloom.llm import jaccard

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_ids(rows):
    """Smallest id of every class, all pairs compared."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        least[find(i)] = min(x, least.get(find(i), x))
    return sorted(least.values())


def run(spark, rows):
    return sorted(r["doc_id"] for r in jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())


def edited(rng, words, edits, name):
    out = list(words)
    for k in rng.sample(range(len(words)), edits):
        out[k] = f"{name}{k}"
    return out


def test_classes_equal_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for size in (12, 30, 60, 200, 600):
        for g in range(6):
            base = [rng.choice(words) for _ in range(size)]
            rows.append(" ".join(base))
            # chains and groups around the limit of 0.8, far more than four bits apart
            for i in range(6):
                base = edited(rng, base, rng.randrange(max(2, size // 40)), f"e{g}{i}") if i % 2 else base
                rows.append(" ".join(edited(rng, base, rng.randrange(1, max(2, size // 30)), f"c{g}{i}")))
    rows += [None, "", " \n", "a b c", "A b  c", "a b c d"]
    numbered = list(enumerate(rows))
    rng.shuffle(numbered)
    assert run(spark, numbered) == kept_ids(numbered)


def test_copies_out_of_reach_of_four_bits_are_found(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    copy = list(base)
    copy[30] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(copy))]
    assert (slow_fingerprint(rows[0][1]) ^ slow_fingerprint(rows[1][1])).bit_count() > 4
    assert run(spark, rows) == [1]
    assert run(spark, []) == []


def test_sets_link_as_python_sets_do():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = []
    for _ in range(150):
        kept = base[rng.random(len(base)) < rng.choice([0.8, 0.9, 0.95])]
        sets.append(np.unique(np.concatenate((kept, rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)))))
    sets += [np.array([1], np.uint64), np.array([1], np.uint64), np.array([1, 2, 3, 4], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)]
    a, b = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    plain = [set(s.tolist()) for s in sets]
    want = [5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j]) for i, j in zip(a, b)]
    assert jaccard.Sets(sets).linked(a, b).tolist() == want and 300 < sum(want) < 15_000


def hot_group(rng, copies):
    """Copies of one text, edited at random: some pairs above 0.8, most below."""
    base = [f"b{i}" for i in range(150)]
    return [" ".join(edited(rng, base, rng.randrange(0, 9), f"x{i}n")) for i in range(copies)]


@pytest.mark.parametrize("hashes", [2_000_000, 9_000, 2_500])
def test_a_hot_group_in_one_shard_or_in_pieces(spark, monkeypatch, hashes):
    monkeypatch.setattr(jaccard, "SHARD_HASHES", hashes)
    rng = random.Random(11)
    rows = list(enumerate([*hot_group(rng, 120), *(" ".join(f"o{rng.randrange(5000)}" for _ in range(40)) for _ in range(60)), *["same words in every one of these"] * 90]))
    rng.shuffle(rows)
    want = kept_ids(rows)
    assert run(spark, rows) == want and 62 < len(want) < 180


def test_a_task_gives_one_link_a_member_at_most(spark):
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(hot_group(rng, 150))]
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = jaccard.marked(docs)
    dealt = jaccard.shards(prints.groupBy("node").agg(jaccard.F.any_value("size").alias("size"), jaccard.F.any_value("keys").alias("keys")))
    sets = docs.select(jaccard.text_bytes("text").alias("t")).select(jaccard.mark_columns("t").alias("m"), jaccard.set_column("t").alias("hashes")).select("m.node", "hashes")
    assert dealt.count() <= 150 and jaccard.verified_links(dealt.join(sets.dropDuplicates(["node"]), "node")).count() < dealt.count()


def test_null_ids_repeated_rows_long_texts_and_clashing_columns(spark):
    long_ = " ".join(f"l{i % 7000}" for i in range(60_000))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (7, None), (6, ""), (None, None), (8, long_), (9, long_ + " end"), (9, long_ + " end"), (None, "only null")]
    docs = spark.createDataFrame([(i, t, n, "x", n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, node int, key string, whole int")
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, (r["text"] or "")[:9]) for r in got.collect()) == [(-1, "only null"), (4, "a b c d e"), (6, ""), (8, long_[:9])]


def test_equal_rows_are_reduced_before_they_meet(spark):
    docs = spark.createDataFrame([(None, None)] * 500 + [(1, "x y z")] * 500, SCHEMA)
    assert sorted(map(tuple, jaccard.one_of_each(docs).collect()), key=repr) == [(1, "x y z"), (None, None)]
