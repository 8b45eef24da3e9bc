"""Every stage of the pipeline on its own input, against a brute-force version of it."""

import os
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from test_jaccard import kept_ids
from test_lines import brute
from tokenizers import Tokenizer

import corpus_pipeline
from statloom.llm import mixing, nbsvm
from statloom.llm.common import stored
from statloom.session import ensure_checkpoint_dir, working

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_are_the_named_ones_and_keep_the_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(t.dtypes == tables[0].dtypes for t in tables[1:-1])


def test_quality_stage(spark, tables):
    model = nbsvm.fit(tables[0], spark.read.parquet(f"{SF}/labels.parquet"))
    mask = np.zeros(nbsvm.DIMS, bool)
    want = [r for r in tables[0].collect() if model.score(nbsvm.indicators((r["text"] or "").encode(), mask)) >= 0.7]
    assert sorted(want) == sorted(tables[1].collect()) and len(want) < tables[0].count()


def test_line_stage(tables):
    want = brute([(r["doc_id"], r["text"]) for r in tables[1].collect()], 40, 5)
    assert sorted((i, t, len(t)) for i, _, _, t in want) == sorted((r["doc_id"], r["text"], r["n_chars"]) for r in tables[2].collect())


def test_near_duplicate_stage(tables):
    rows = [(r["doc_id"], r["text"]) for r in tables[2].collect()]
    assert kept_ids(rows) == sorted(r["doc_id"] for r in tables[3].collect()) and tables[3].count() < len(rows)
    assert set(tables[3].collect()) <= set(tables[2].collect())


def test_mixing_stage(tables):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(tables[3]).collect()}
    got = Counter(r["doc_id"] for r in tables[4].collect())
    assert got == {i: n for i, n in copies.items() if n}
    assert set(tables[4].collect()) <= set(tables[3].collect())


def test_packing_stage(tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1] for r in tables[4].collect()}
    want = Counter()
    for r in tables[4].collect():
        want.update(ids[r["doc_id"]])
    got, lengths = Counter(), Counter()
    for p in tables[5].collect():
        piece = np.frombuffer(p["ids"], "<u4").tolist()
        assert piece == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        got.update(piece)
        lengths[p["sequence_id"]] += p["length"]
    assert got == want and all(n == 2048 for s, n in lengths.items() if s != max(lengths))


def left(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith("statloom-")}


def test_run_gives_the_last_stage_and_leaves_nothing_in_a_scope(spark, tables):
    before, tables_before = left(spark), {t.name for t in spark.catalog.listTables()}
    with working(spark):
        assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, tables[-1].collect()))
        # the last stage's own folders and its input; what earlier stages wrote is gone already
        assert 0 < len(left(spark) - before) <= 5
    assert left(spark) == before and {t.name for t in spark.catalog.listTables()} == tables_before


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string"


def test_repeated_null_and_extra_rows_pass_through_every_stage(spark):
    rows = [(1, "plain words here", "en", "s", 3, "x"), (1, "plain words here", "en", "s", 3, "x"), (None, None, None, None, None, None), (None, "", "en", None, 0, "y")]
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        got = stored(stage(spark, docs, SF), "odd")
        if name != "packing":
            assert got.columns == docs.columns
            # a stage that drops every odd row says nothing about the next one
            docs = got if got.count() else docs
    assert {"doc_id", "sequence_id", "length"} <= set(got.columns) and got.count() >= docs.count()


def test_empty_table_passes_through_every_stage(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "none")
        assert docs.count() == 0
