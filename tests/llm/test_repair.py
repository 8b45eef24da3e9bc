import hashlib
import itertools
import random
import re
import zlib

import pytest
from oracle import compare, connect

from statloom.llm import repair
from statloom.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_search(rows):
    """(cost, audit, lines) by trying every edit of every row with up to two turns inserted before each row and at the end."""
    seen, choices = set(), []
    for role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        gone = not kept or (role, text) in seen
        seen.add((role, text))
        cut = 5 if kept and kept[-1] not in ".!?" else 0
        options = [("D", 2, None)]
        if not gone:
            options += [("K", cut, (role, text)), ("R", 1 + cut, ("user", text)), ("R", 1 + cut, ("assistant", text))]
        choices.append(options)
    added = [()] + [tuple((r, "") for r in x) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    # all ways so far, grouped by what they have written last (enough to judge what may follow)
    ways = {"": (0, "", ())}

    def grow(ways, options):
        out = {}
        for cost, audit, lines in ways.values():
            for letter, price, turns in options:
                new = lines + turns
                initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in new)
                if not re.fullmatch(r"(s?(ua)*u?)?", initials):
                    continue
                key, found = ("s" if initials == "s" else initials[-1:]), (cost + price, audit + letter, new)
                if key not in out or found[:2] < out[key][:2]:
                    out[key] = found
        return out

    for options in choices:
        ways = grow(ways, [("I" * len(x), 5 * len(x), x) for x in added])
        ways = grow(ways, [(letter, price, () if turn is None else (turn,)) for letter, price, turn in options])
    ways = grow(ways, [("I" * len(x), 5 * len(x), x) for x in added])
    ends = [w for w in ways.values() if LEGAL.fullmatch("".join(r[0] for r, _ in w[2]))]
    return min(ends, key=lambda w: w[:2])


def exhaustive(initials, faults):
    """All audits with at most three inserted turns at a place, no pruning at all."""
    best = None

    def go(row, state, cost, audit, run):
        nonlocal best
        if row == len(initials) and state in repair.ENDS and (best is None or (cost, audit) < best):
            best = cost, audit
        if run < 3:
            for letter, price, then in repair._inserts(state):
                go(row, then, cost + price, audit + letter, run + 1)
        if row < len(initials):
            for letter, price, then in repair._edits(initials[row], faults[row], state):
                go(row + 1, then, cost + price, audit + letter, 0)

    go(0, repair.NOTHING, 0, "", 0)
    return best


def test_search_equals_every_audit():
    for n in range(4):
        for initials in itertools.product("suao", repeat=n):
            for faults in itertools.product("-tb", repeat=n):
                assert repair.search("".join(initials), "".join(faults)) == exhaustive(initials, faults)


def test_long_conversations_are_searched_in_steps_by_their_length():
    rng = random.Random(3)
    initials, faults = ("".join(rng.choices(x, k=2000)) for x in ("suao", "--tbd"))
    cost, audit = repair.search(initials, faults)
    assert len(audit.replace("I", "")) == 2000 and cost == repair.suffix_bounds(initials, faults, repair.ENDS)[0][0]


def test_pieces_fold_to_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        initials, faults = ("".join(rng.choices(x, k=rng.randrange(2, 14))) for x in ("suao", "--tb"))
        initials = initials[: len(faults)]
        faults = faults[: len(initials)]
        at = sorted(rng.sample(range(len(initials) + 1), 2)) if len(initials) > 1 else [0, 0]
        cuts = [0, *at, len(initials)]
        tables = [[repair.search(initials[a:b], faults[a:b], s, (t,)) for s in range(4) for t in range(4)] for a, b in zip(cuts, cuts[1:])]
        cost, audit = repair.fold(tables)
        assert (cost, audit) == repair.search(initials, faults)
        sizes = [b - a for a, b in zip(cuts, cuts[1:]) if a < b]
        audits, states, starts = repair.cut(audit, initials, sizes)
        assert "".join(audits) == audit and [len(a.replace("I", "")) for a in audits] == sizes
        assert starts == [len("".join(audits[:i]).replace("D", "")) for i in range(len(sizes))] and states[0] == repair.NOTHING


def report(rows):
    """Every conversation by the contract, damage included."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            left += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
        counts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in left:
            kept = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        cost, audit, lines = plain_search([r[1:] for r in left])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def mixture():
    rng = random.Random(8)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, rng.choice(["Yes.", "no", " \n", "", None, "Long " * 50 + "?", f"t{turn}!", "end. \t"])))
    return rows + [(None, None, None, None), (None, 4, "user", "x"), (None, 4, "user", "x"), (-5, 1, "system", "only.")]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(spark, rows):
    found = repair.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}


@pytest.mark.parametrize("sizes", [(512, 2048), (3, 5)])
def test_odd_conversations_equal_a_plain_version(spark, monkeypatch, sizes):
    monkeypatch.setattr(repair, "PIECE_ROWS", sizes[0])
    monkeypatch.setattr(repair, "WHOLE_ROWS", sizes[1])
    rows = mixture()
    assert run(spark, rows) == report(rows)


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_conversation_is_cut_into_pieces(spark, apart, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 64)
    monkeypatch.setattr(repair, "WHOLE_ROWS", 256)
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"t {i}.", f"cut {i}"])) for i in range(1500)]
    rows += [(c, i, "user", "hi.") for c in range(2, 100) for i in range(3)]
    assert run(spark, rows) == report(rows)


def test_repaired_turns_are_numbered_and_legal(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 4)
    _, turns = repair.repaired(spark.createDataFrame(mixture(), SCHEMA))
    by_conv = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    assert len(by_conv) > 50
    for own in by_conv.values():
        assert [r["turn"] for r in own] == list(range(len(own))) and LEGAL.fullmatch("".join(r["role"][0] for r in own))
        assert all(r["text"] == "" for r in own if r["edit"] == "I")


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == {}
    table = spark.createDataFrame([(1, 0, "user", "t.", "x", 5)], SCHEMA + ", place string, cost int")
    assert repair.repair_report(table).count() == 1


def test_query_equals_duckdb(spark):
    assert compare(spark, connect(SF), SF, "op12_structure_repair", LLM_QUERIES, LLM_ORACLES) == ""
