import base64
import gzip
import hashlib
import random

from statloom.llm import warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, payload string, path int"


def brute(rows, least=0):
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        best = largest.get(html or "")
        response = best is None or page == best or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if response else "revisit", None if response else best))
    return sorted(out, key=repr)


def run(spark, rows, least=0, split=1000):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in warc.archived_pages(spark, pages, least, split).collect()), key=repr)


def test_revisits_nulls_ties_and_ranges_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, f"http://a/{i}", "<p>same</p>" if i % 3 == 0 else f"page {i} " * rng.randrange(1, 400)) for i in range(150)]
    rows += [(None, None, "<p>same</p>"), (None, "u v", "only here"), (200, "u", None), (201, "u", ""), (7, "u", "again"), (7, "u", "again"), (300, "u", "é" * 200_000)]
    rows.append((301, "u", "".join(rng.choice("abcdefgh\n") for _ in range(300_000))))
    for split in (97, 5000, 1 << 22):
        assert run(spark, rows, 0, split) == brute(rows)
    assert run(spark, rows, 100) == brute(rows, 100)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert sorted((tuple(r) for r in warc.archived_pages(spark, pages).collect()), key=repr) == brute(rows)


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.at += n
        return self.data[self.at - n : self.at]


def test_every_cut_gives_every_record_once(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    rng = random.Random(8)
    members = [warc.record_bytes(str(i), None, bytes(rng.randrange(256) for _ in range(rng.randrange(0, 300))), "D", None) for i in range(12)]
    decoy = warc.MAGIC + b"\x00" * 20 + gzip.compress(b"not a record") + warc.MAGIC
    data = decoy + b"".join(m + (decoy if i % 4 == 0 else b"") for i, m in enumerate(members))
    for width in (1, 7, 50, 333, 10_000):
        ids = []
        for start in range(0, len(data), width):
            reader = warc.RangeReader(Bytes(data), len(data), start, min(len(data), start + width))
            ids += [fields["warc-record-id"] for _, fields, _ in reader.records()]
        assert ids == [f"<urn:page:{i}>" for i in range(12)], width


def test_archives_are_plain_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x", "body")], "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.planned(pages), str(tmp_path)).collect()
    text = gzip.open(manifest[0]["path"]).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response") and text.endswith(b"body\r\n\r\n")
    assert manifest[0]["records"] == 1


def test_ranges_are_read_by_tasks_of_their_own(spark, tmp_path):
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, "http://x", "".join(chr(rng.randrange(33, 900)) for _ in range(4000))) for i in range(60)], "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.planned(pages).repartition(3, "page_id"), str(tmp_path))
    split = 20_000
    wanted = sum(-(-r["bytes"] // split) for r in manifest.collect())
    read = warc.read_archives(manifest, split)
    tasks = read.select("page_id", warc.F.spark_partition_id().alias("task")).collect()
    assert wanted > 10 and read.rdd.getNumPartitions() == wanted
    assert sorted(int(r["page_id"]) for r in tasks) == list(range(60)) and len({r["task"] for r in tasks}) > wanted // 2


def test_a_path_and_its_uris_are_one_place():
    assert warc.SCHEMES["s3a"] == "s3"
    assert warc.file_system("file:///tmp/x")[1] == "/tmp/x" and warc.file_system("/tmp/x")[1] == "/tmp/x" and warc.file_system("file:/tmp/x")[1] == "/tmp/x"
