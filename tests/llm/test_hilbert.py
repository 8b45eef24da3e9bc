import zlib
from itertools import product

from pyspark.sql import functions as F

from statloom.llm import hilbert

SF = "/root/testdata/sf0.001"


def test_neighbours_on_the_curve_are_neighbours_in_space(spark):
    bits, n = 3, 3
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), "a int, b int, c int")
    rows = sorted((r["h"], (r["a"], r["b"], r["c"])) for r in cells.select("*", hilbert.hilbert_index(["a", "b", "c"], bits).alias("h")).collect())
    assert [h for h, _ in rows] == list(range(1 << bits * n))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for (_, p), (_, q) in zip(rows, rows[1:]))


def check_law(rows, n, shards):
    counts = {}
    slots = {}
    for r in rows:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(counts.values()) == n
    if n >= shards:
        assert set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    layout = hilbert.hilbert_shards(docs)
    rows = hilbert.contract_rows(layout).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_law(rows, len(texts), 40)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    in_order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert all(x["hilbert"] <= y["hilbert"] for x, y in zip(in_order, in_order[1:]))
    manifest = hilbert.shard_manifest(layout).collect()
    assert sum(m["rows"] for m in manifest) == len(texts)


def plain_index(cells, bits):
    """The curve's number by loops over bits and axes."""
    x, n = list(cells), len(cells)
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for i in range(n):
            if x[i] >> q & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for q in range(bits - 1, 0, -1):
        if x[-1] >> q & 1:
            turn ^= (1 << q) - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = 2 * out + ((v ^ turn) >> b & 1)
    return out


def plain_layout(rows, shards=40, bits=6):
    """shard, slot and curve number of (doc_id, text, lang, source) rows, in one list."""
    cells = 1 << bits

    def category(values):
        known = sorted({v for v in values if v is not None})
        step = cells // len(known) if len(known) <= cells else None
        place = {v: i * step if step else i * cells // len(known) for i, v in enumerate(known)}
        return lambda v: 0 if v is None else place[v]

    lang, source = category(r[2] for r in rows), category(r[3] for r in rows)
    ids = [r[0] for r in rows]
    width = (max(ids) - min(ids)) // cells + 1
    keyed = []
    for doc_id, text, a, b in rows:
        data = (text or "").encode()
        size = len(data) + 16
        length = size.bit_length()
        step = 4 * (length - 1) + (size >> max(length - 3, 0) & 3) - 16
        h = plain_index([lang(a), source(b), min(max(step, 0), cells - 1), (doc_id - min(ids)) // width], bits)
        keyed.append((h, zlib.crc32(data), size, doc_id))
    out, first = {}, {}
    for rank, (h, _, _, doc_id) in enumerate(sorted(keyed)):
        shard = rank * shards // len(rows)
        out[doc_id] = (shard, rank - first.setdefault(shard, rank), h)
    return out


def test_whole_table_equals_a_plain_numbering(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    want = plain_layout([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["shard"], r["slot"], r["hilbert"]) for r in hilbert.contract_rows(hilbert.hilbert_shards(docs)).collect()}
    assert got == want


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, 1), (1, "", "en", "s", 2), (1, "", "en", "s", 2), (-(2**63), "é" * 9, None, "t", 3), (2**63 - 1, "x" * 200_000, "fr", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, shard int").withColumn("hilbert", F.lit("x"))
    out = hilbert.hilbert_shards(docs, shards=3).collect()
    check_law(out, 5, 3)
    assert sorted(r["size"] for r in out) == [16, 16, 16, 34, 200_016]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert hilbert.hilbert_shards(docs).collect() == []


def test_written_shards_hold_every_document(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hilbert.write_shards(docs, hilbert.hilbert_shards(docs, shards=5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("_shard").distinct().count() == 5
