import hashlib
import os
import random
from collections import defaultdict

from statloom.llm import exact

SCHEMA = "doc_id bigint, text string, kept string, digest string, shard string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda x: x is None):
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in exact.exact_duplicates(docs).collect()), key=repr)


def test_groups_nulls_ties_and_long_texts(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é"), (5, "é"), (None, "b"), (None, "b"), (7, None), (8, "x" * 300_000), (9, "x" * 300_000)]
    assert run(spark, rows) == brute(rows)


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(2000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shard_grows_deletes_and_survives_a_round_trip():
    rng = random.Random(5)
    shard, live = exact.CuckooShard(4), {}
    keys = [os.urandom(32) for _ in range(3000)]
    for step in range(9000):
        key = rng.choice(keys)
        if rng.random() < 0.35:
            assert shard.delete(key, 1) == (key in live)
            if key in live:
                live[key] -= 1
                if not live[key]:
                    del live[key]
        else:
            shard.insert(key, step, 1)
            live[key] = live.get(key, 0) + 1
    assert {d: c for d, _, c in shard.live()} == live
    assert shard.buckets > 4
    row = type("Row", (), shard.dump(0))
    again = exact.CuckooShard.load(row)
    assert sorted(again.live()) == sorted(shard.live())
    assert all((again.find(k) >= 0) == (k in live) for k in keys)


def test_equal_fingerprints_are_verified_against_content():
    shard = exact.CuckooShard(4)
    one, two = bytes([7, 7]) + bytes(30), bytes([7, 7]) + bytes(29) + b"\x01"
    shard.insert(one, 1, 1)
    assert shard.find(two) < 0


def test_index_takes_later_batches_and_deletions(spark):
    def reps(rows):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        return exact.representatives(exact.digest_rows(docs))

    index = exact.build_index(reps([(1, "a"), (2, "b")]), 8)
    index = exact.update_index(index, reps([(9, "a"), (4, "c")]), 8)
    index = exact.update_index(index, reps([(2, "b"), (5, "never seen")]), 8, delete=True)
    found = {r["keep_id"]: r["group_size"] for r in exact.probe_index(index, reps([(0, "a"), (0, "b"), (0, "c"), (0, "d")]), 8).collect()}
    assert found == {9: 2, 4: 1}
