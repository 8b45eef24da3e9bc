import random

import numpy as np
import pytest
import xxhash

from statloom.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, ids, radius=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(prints))]


def expected(rows):
    prints = [slow_fingerprint(t or "") for _, t in rows]
    return sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], classes(prints, [i for i, _ in rows])), key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, fp int, root string")
    return sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)


def test_copies_nulls_blanks_and_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(50, " ".join(base)), (51, " ".join(base).upper())]
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(300)] = "changed" + str(i)
        rows.append((100 + i, " ".join(copy)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (None, "a b c"), (None, "a b c"), (7, "A b\xa0c d e"), (7, "A b\xa0c d e"), (903, "v " * 50_000)]
    assert run(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr) == expected(rows)


def chained(rng, n):
    """Fingerprints in chains and balls around a few centres."""
    out = {rng.getrandbits(64) for _ in range(n // 3)}
    at = rng.getrandbits(64)
    while len(out) < n:
        for _ in range(rng.randrange(1, 6)):
            at ^= 1 << rng.randrange(64)
        out.add(at)
        if rng.random() < 0.02:
            at = rng.getrandbits(64)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_forest_links_every_component_of_a_shard(seed):
    rng = random.Random(seed)
    prints = chained(rng, 300)
    shard = np.array(sorted(p % 3 for p in prints))
    values = np.array(sorted(prints, key=lambda p: p % 3), np.uint64)
    label = simhash.Forest(shard, values).components(4)
    for s in range(3):
        rows = np.flatnonzero(shard == s)
        want = classes([int(v) for v in values[rows]], rows.tolist())
        groups = {}
        for i, w in zip(rows, want):
            groups.setdefault(label[i], set()).add(w)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


@pytest.mark.parametrize("shared", [1, 2, 3])
def test_every_link_survives_tables_pieces_and_rounds(spark, monkeypatch, shared):
    prints = chained(random.Random(9), 400)
    monkeypatch.setattr(simhash, "shared_blocks", lambda *_: shared)
    monkeypatch.setattr(simhash, "MAX_TREE", 8)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    roots = {r["v"]: r["root"] for r in simhash.component_roots(simhash.near_links(nodes, 4, len(prints))).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert [roots.get(s, s) for s in signed] == classes(prints, signed)


def test_dense_group_is_a_star_not_all_pairs():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)})
    a, b = simhash.shard_stars(np.zeros(len(prints), np.int64), np.array(prints, np.uint64), 4)
    assert len(a) == len(prints) - 1 and len(set(b.tolist())) == 1
