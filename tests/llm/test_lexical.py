import random
import re

import pytest
from oracle import compare, connect

from statloom.llm import lexical
from statloom.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    """Every document against every item, one by one."""
    split = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in split if w]
    n, total = len(held), sum(len(w) for _, w in held)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        weight = {t: lexical.term_weight(n, sum(t in w for _, w in held)) for t in words}
        scores = []
        for doc, own in held:
            m = 100 - 50 + (50 * len(own) * n) // total
            score = sum(weight[t] * ((1000000000 * own.count(t)) // (1000 * own.count(t) + 20 * m)) for t in words if t in own)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k=5, parts=3):
    table = spark.createDataFrame(docs, DOCS).repartition(parts) if docs else spark.createDataFrame([], DOCS)
    return sorted((tuple(r) for r in lexical.ranked(table, spark.createDataFrame(items, ITEMS), k).collect()), key=repr)


def mixture(seed, size=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "a1", "it"]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(0, 40)))) for i in range(size)]
    docs += [(1000 + i, "w0 w1, W1-w5") for i in range(100)]  # a third of the rows are copies
    return docs + [(7, "w3 w3 again"), (None, "w1 w59"), (None, "w59"), (5000, None), (5001, " .,"), (5002, "w2 " * 5000)]


@pytest.mark.parametrize("sizes", [(16, 2), (100, 3), (16_384, 1024)])
def test_equals_every_document_against_every_item(spark, monkeypatch, sizes):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", sizes[0])
    monkeypatch.setattr(lexical, "BLOCK_DOCS", sizes[1])
    items = [(1, "W1 w5 w59"), (2, "w0 w0 w2 É"), (3, "日本 nowhere"), (4, None), (5, "!"), (6, "w3"), (6, "again"), (None, "it w7 w8 w9 w10 w11 w12"), (8, "é a1 w40")]
    docs = mixture(sizes[0])
    assert run(spark, docs, items) == brute(docs, items, 5)
    assert run(spark, docs, items, k=200) == brute(docs, items, 200)


def test_many_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = mixture(9, 80), [(i, f"w{i} w{i + 1} w2") for i in range(6)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 20)
    assert run(spark, docs, items) == whole == brute(docs, items, 5)


def test_blocks_that_cannot_enter_are_skipped(monkeypatch):
    """Most of a long list is never weighed once the best are held."""
    import numpy as np

    writer = lexical.SegmentWriter({b"common": 0, b"rare": 1})
    for i in range(8192):
        writer.add(i, b"common rare" if i < 60 else b"common " * (1 + i % 3))
    batch = writer.segment()
    segment = lexical.Segment({n: batch.column(j)[0].as_py() for j, n in enumerate(batch.schema.names)}, 8192, 16_000)
    looked = []
    whole = lexical._search_block
    monkeypatch.setattr(lexical, "_search_block", lambda *a: (looked.append(a[3]), whole(*a)))
    best = lexical.Best(50)
    lexical.search_segment(segment, np.array([0, 1]), np.array([5, 9000]), best)
    assert looked == [0] and best.ids.tolist() == list(range(50))


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], [(1, "w1")]) == [] and run(spark, [(1, "w1")], []) == []
    docs = spark.createDataFrame([(1, "w1", 3, "x")], "doc_id bigint, text string, score bigint, item_id string")
    items = spark.createDataFrame([(4, "w1", "z")], "item_id bigint, text string, doc_id string")
    assert [tuple(r)[:3] for r in lexical.ranked(docs, items).collect()] == [(4, 1, 1)]


def test_query_equals_duckdb(spark):
    assert compare(spark, connect(SF), SF, "op13_lexical_search", LLM_QUERIES, LLM_ORACLES) == ""
