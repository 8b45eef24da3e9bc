import hashlib
import random
from collections import defaultdict

from statloom.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_length, least_docs):
    holders = defaultdict(list)
    for n, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_length:
                holders[k].append(doc_id)
    out = []
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        stay = []
        for x in parts:
            ids = holders.get(key(x), [])
            largest = max((i for i in ids if i is not None), default=None)
            if len(ids) < least_docs or largest is None or doc_id == largest:
                stay.append(x)
        out.append((doc_id, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def run(spark, rows, least_length=5, least_docs=3, batches=4):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, n_lines int, row string, kept int")
    out = lines.with_kept_lines(docs, least_length, least_docs, batches)
    return sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


def test_random_tables_equal_brute_force(spark):
    rng = random.Random(2)
    pool = ["shared line one", " Shared LINE one\t", "another line", "ÀÉ upper stays", "tiny", "", "naïve line long", "x" * 40_000]
    for batches in (1, 5):
        rows = [(i % 37, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randrange(0, 6)))) for i in range(120)]
        rows += [(None, "shared line one\nmine"), (None, None), (99, ""), (99, "\n\n")]
        assert run(spark, rows, batches=batches) == brute(rows, 5, 3)


def test_only_null_ids_keep_their_lines(spark):
    rows = [(None, "the same line")] * 4
    assert run(spark, rows) == brute(rows, 5, 3)


def test_hot_line(spark):
    rows = [(i, f"one very common line\nown {i} and more text") for i in range(900)]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_runs_stay_disjoint_in_fresh_keys_and_leave_no_tables(spark):
    before = len(spark.catalog.listTables())
    runs = lines.LineRuns(spark, 4)
    seen = set()
    for batch in range(5):
        keys = [(k, 0, 1, batch) for k in range(batch, batch + 4)]
        table = runs.add(spark.createDataFrame(keys, "h1 bigint, h2 bigint, docs bigint, largest bigint"))
        if table in runs.runs():
            fresh = {r["h1"] for r in spark.table(table).where("fresh").collect()}
            assert fresh == {k[0] for k in keys} - seen
        seen |= {k[0] for k in keys}
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    totals = {r["h1"]: (r["docs"], r["largest"]) for r in runs.totals().collect()}
    assert totals == {k: (len(b), max(b)) for k in range(8) if (b := [b for b in range(5) if b <= k < b + 4])}
    plan = runs.totals()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.drop()
    assert len(spark.catalog.listTables()) == before


def test_hash_is_that_of_the_kept_text(spark):
    text = "only\nlines"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = lines.with_kept_lines(docs).selectExpr("sha2(cast(kept AS binary), 256) AS h").first()
    assert row["h"] == hashlib.sha256(text.encode()).hexdigest()
