import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "It's THE end<|endoftext|>of it", "<|startoftext|> a", "é ́x a b　c d\x85e\x1cf", "don't 'S 'tis 12345 ½ ß İ ΑΣ ΑΣ. ſ",
    "\x00\x01 \x07a", "日本語 テキスト 👍🏽 a‍b", "é\ń", "ａｂｃ 'll'd''ve", "ﬁ ǅ 힣각", "x" * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_by_word_equals_whole_text(tokenizer):
    words = packing.WordTokenizer(PATH)
    for text in [*ODD, "\n\t".join(ODD)]:
        assert words.ids([text.encode()], 1)[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 2)
    words = packing.WordTokenizer(PATH)
    for text in ["one two three four", "four five one", "one two"] * 2:
        assert words.ids([text.encode()], 1)[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def check(rows, pieces, tokenizer, length):
    want = sorted(([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows), key=repr)
    docs, by_sequence = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
    for spans in by_sequence.values():
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    totals = [sum(n for _, n in by_sequence[s]) for s in sorted(by_sequence)]
    assert all(t == length for t in totals[:-1]) and (not totals or 0 < totals[-1] <= length)
    assert sum(map(len, want)) == sum(totals)
    if len({i for i, _ in rows}) == len(rows):
        got = [np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])]).tolist() for parts in docs.values()]
        assert sorted(got, key=repr) == want


def test_given_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, packing.pack(docs, PATH).collect(), tokenizer, 2048)


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tokenizer):
    rows = [(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, "c d e"), (2**62 + 1, "long text here " * 20_000), *((i, "same again") for i in range(50, 90))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, row int, ids int")
    pieces = packing.pack(docs, PATH, length=64).collect()
    check(rows, pieces, tokenizer, 64)
    assert {p["doc_id"] for p in pieces} == {i for i, _ in rows}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_sequences_are_padded_except_at_a_power_of_two(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([3, 70, 9, 40])], "doc_id bigint, text string")
    rows = {r["sequence_id"]: (len(r["ids"]) // 4, r["tokens"]) for r in packing.sequences(packing.pack(docs, PATH, length=64), 64).collect()}
    assert rows == {0: (64, 64), 1: (64, 62)}
    one = packing.sequences(packing.pack(docs.where("doc_id = 0"), PATH, length=64), 64).first()
    assert (len(one["ids"]) // 4, one["tokens"]) == (4, 4)
