"""Conversation structure repair by depth-first branch and bound.

A conversation's rows are edited (Keep, Rerole to user or assistant, Delete, Insert
of an empty user or assistant turn) until its role initials read ``(s?(ua)+)?``.
The search walks an explicit stack of (row, role state, cost, audit).  Suffix
bounds hold the least cost to finish from every (row, state); a prefix is cut when
cost and bound exceed the incumbent, or equal it with an audit that cannot become
smaller, and by the dominance table of its node, which keeps the least (cost,
audit) that arrived there.  Of two prefixes of one node and cost none begins the
other (audits with the same rows differ by inserted turns, which cost), so the
smaller stays smaller whatever follows, and the search ends with the optimum.

Rows are range-sorted by (conversation, turn, digest), so a conversation of a third
of all rows spreads over tasks.  Faults are found there; the first row of a role and
text is an aggregate with map-side combine, joined back by the row's place.  Only
one letter pair for a row goes to the search.  Conversations of at most
``WHOLE_ROWS`` rows are searched whole; a longer one is cut where its stored pieces
end, every piece is searched from each state to each state, and the pieces' least
(cost, audit) are folded in order.  That fold and the one running digest of a
conversation are sequential by what they return; both hold about 16 bytes a row at
most, no texts.

Nulls and edge cases: a null role or text is one space; null turns come first,
equal turns in the order of the digest of role and text, equal rows side by side;
null conversation ids are one conversation; a role other than s, u, a by its initial
(also an empty one) is reroled or deleted; an empty table gives no rows; only the
four columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from statloom.llm.common import in_range_order, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Role states: nothing yet, behind s, behind u, behind a; a conversation may end in ENDS.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Where a turn of an initial leads from each state; absent where it may not stand.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
BLANK, DUPLICATE, CUT, FINE = "b", "d", "t", "-"
PIECE_ROWS, WHOLE_ROWS = 512, 2048
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60


def _edits(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of everything one row may become."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if state in STEPS.get(initial, ()):
        yield "K", KEEP + more, STEPS[initial][state]
    for role in "ua":
        if state in STEPS[role]:
            yield "R", REROLE + more, STEPS[role][state]


def _inserts(state: int) -> Iterator[tuple[str, int, int]]:
    for role in "ua":
        if state in STEPS[role]:
            yield "I", INSERT, STEPS[role][state]


def suffix_bounds(initials: str, faults: str, ends: tuple[int, ...]) -> list[list[int]]:
    """Least cost to finish from every (row, state), whatever the audit."""

    def with_inserts(cost: list[int]) -> list[int]:
        for _ in range(3):  # the longest useful run of inserted turns passes three states
            for state in range(4):
                for _, price, then in _inserts(state):
                    cost[state] = min(cost[state], price + cost[then])
        return cost

    bounds = [with_inserts([0 if s in ends else _FAR for s in range(4)])]
    for initial, fault in zip(reversed(initials), reversed(faults)):
        after = bounds[-1]
        bounds.append(with_inserts([min(price + after[then] for _, price, then in _edits(initial, fault, s)) for s in range(4)]))
    return bounds[::-1]


@lru_cache(maxsize=50_000)
def search(initials: str, faults: str, begin: int = NOTHING, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The least (cost, audit) that brings the rows from ``begin`` to one of ``ends``."""
    n, bounds = len(initials), suffix_bounds(initials, faults, ends)
    best: tuple[int, str] | None = None
    seen: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, begin, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        least = cost + bounds[row][state]
        if least >= _FAR or best is not None and (least > best[0] or least == best[0] and audit > best[1][: len(audit)]):
            continue
        known = seen[row].get(state)
        if known is not None and known <= (cost, audit):
            continue
        seen[row][state] = (cost, audit)
        if row == n and state in ends and (best is None or (cost, audit) < best):
            best = cost, audit
        grown = [(row, then, cost + price, audit + letter) for letter, price, then in _inserts(state)]
        if row < n:
            grown += [(row + 1, then, cost + price, audit + letter) for letter, price, then in _edits(initials[row], faults[row], state)]
        grown.sort(key=lambda x: (x[2] + bounds[x[0]][x[1]], x[3]), reverse=True)  # the most promising on top
        stack += grown
    return best


def _behind(letter: str, initial: str, state: int) -> int:
    """The state behind a turn that an edit leaves."""
    return STEPS[initial][state] if letter == "K" else ASSISTANT if state == USER else USER


def cut(audit: str, initials: str, sizes: list[int]) -> tuple[list[str], list[int], list[int]]:
    """Audit, entry state and number of turns before it of every piece; inserted turns go with the row behind them."""
    audits: list[list[str]] = [[] for _ in sizes]
    states, starts = [NOTHING] * len(sizes), [0] * len(sizes)
    piece, left, row, state, written = 0, sizes[0], 0, NOTHING, 0
    for letter in audit:
        if not left and piece + 1 < len(sizes):
            piece += 1
            left, states[piece], starts[piece] = sizes[piece], state, written
        audits[piece].append(letter)
        if letter != "D":
            state, written = _behind(letter, initials[row : row + 1], state), written + 1
        if letter != "I":
            row, left = row + 1, left - 1
    return ["".join(a) for a in audits], states, starts


def fold(tables: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
    """Cost and audit of a conversation cut into pieces.

    ``tables`` holds for every piece the 16 results from state s to state t at 4 s + t.
    """
    held = {NOTHING: (0, "")}
    for table in tables:
        then: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in held.items():
            for end, step in enumerate(table[4 * state : 4 * state + 4]):
                if step is not None:
                    new = cost + step[0], audit + step[1]
                    then[end] = min(then.get(end, new), new)
        held = then
    return min(held[s] for s in ENDS if s in held)


_PLAN = T.StructType().add("cost", T.LongType()).add("audits", T.ArrayType(T.StringType())).add("states", T.ArrayType(T.IntegerType())).add("starts", T.ArrayType(T.LongType()))
_RESULT = T.StructType().add("cost", T.LongType()).add("audit", T.StringType())


def _plans(found: list[tuple[int, str]], initials: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = [(cost, *cut(audit, i, [int(n) for n in s])) for (cost, audit), i, s in zip(found, initials, sizes)]
    return pd.DataFrame(rows, columns=_PLAN.names)


@pandas_udf(_PLAN)
def _whole_plan(initials: pd.Series, faults: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    return _plans([search(i, f) for i, f in zip(initials, faults)], initials, sizes)


@pandas_udf(T.ArrayType(_RESULT))
def _piece_table(initials: pd.Series, faults: pd.Series) -> pd.Series:
    def table(i: str, f: str) -> list[dict | None]:
        found = [search(i, f, s, (t,)) for s in range(4) for t in range(4)]
        return [None if x is None else {"cost": x[0], "audit": x[1]} for x in found]

    return pd.Series([table(i, f) for i, f in zip(initials, faults)])


@pandas_udf(_PLAN)
def _folded_plan(tables: pd.Series, initials: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    return _plans([fold([[None if x is None else (x["cost"], x["audit"]) for x in piece] for piece in t]) for t in tables], initials, sizes)


def damaged(convs: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or reroled by the checksum of ``conv_id:turn``, as the contract says; nulls are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = convs.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.where("fate <> 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("c"))
    return out.drop("c")


def _fault(stripped: Column, first: Column) -> Column:
    fault = F.when(stripped == "", BLANK).when(~first, DUPLICATE)
    return fault.when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)


def repaired(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conv_id, gaps, fault counts, illegal, cost and audit of each conversation; its repaired turns.

    A turn has conv_id, turn (its new number from 0), role, text and edit (K, R or I).
    """
    plain = convs.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    digest = F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("input")]
    rows = in_range_order(plain.withColumn("digest", digest).withColumn("input", F.monotonically_increasing_id()), keys, "rows").drop("input")

    firsts = rows.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min(F.struct("part", "place")).alias("at"))
    firsts = firsts.select("at.part", "at.place", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    letters = rows.select(
        "conv_id", "part", "place", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), F.trim(F.col("text"), F.lit(_SPACE)).alias("stripped")
    )
    letters = letters.join(firsts, ["part", "place"], "left").withColumn("fault", _fault(F.col("stripped"), F.coalesce("first", F.lit(False)))).drop("stripped", "first")
    letters = letters.withColumn("piece", F.floor(F.col("place") / PIECE_ROWS))

    # at most PIECE_ROWS rows to a piece
    row = F.sort_array(F.collect_list(F.struct("place", "initial", "fault")))
    pieces = letters.groupBy("conv_id", "part", "piece").agg(row.alias("r"), F.min("place").alias("place"))
    spelled = [F.array_join(F.col(f"r.{n}"), "").alias(f"{n}s") for n in ("initial", "fault")]
    pieces = stored(pieces.select("conv_id", "part", "place", *spelled, F.size("r").alias("n")), "pieces")
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pieces"))
    named = pieces.withColumnRenamed("conv_id", "c").join(sizes, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c")

    in_order = F.sort_array(F.collect_list(F.struct("part", "place", "initials", "faults", "n")))
    joined = [F.array_join(F.col(f"p.{n}"), "").alias(n) for n in ("initials", "faults")]
    at = F.transform("p", lambda x: F.struct(x["part"].alias("part"), x["place"].alias("place"))).alias("at")
    short = named.where(F.col("rows") <= WHOLE_ROWS).groupBy("conv_id").agg(in_order.alias("p"))  # at most WHOLE_ROWS letters
    short = short.select("conv_id", at, *joined, F.col("p.n").alias("sizes")).withColumn("plan", _whole_plan("initials", "faults", "sizes"))
    tabled = named.where(F.col("rows") > WHOLE_ROWS).withColumn("table", _piece_table("initials", "faults"))
    long_ = tabled.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "place", "initials", "faults", "n", "table"))).alias("p"))
    long_ = long_.select("conv_id", at, *joined, F.col("p.n").alias("sizes"), F.col("p.table").alias("tables"))
    long_ = long_.withColumn("plan", _folded_plan("tables", "initials", "sizes")).drop("tables")
    plans = stored(short.union(long_), "plans")

    each = F.explode(F.arrays_zip("at", F.col("plan.audits").alias("edits"), F.col("plan.states").alias("state"), F.col("plan.starts").alias("start")))
    spread = plans.select(each.alias("x")).select("x.at.part", "x.at.place", "x.edits", "x.state", "x.start")
    edited = rows.join(spread, ["part", "place"], "left").withColumn("piece", F.floor(F.col("place") / PIECE_ROWS))
    edited = edited.select("conv_id", "part", "piece", "place", "role", "text", "edits", "state", "start")

    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))

    def count(letter: str) -> Column:
        return (F.length("faults") - F.length(F.translate("faults", letter, ""))).cast("bigint")

    pairs = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: F.substring(F.col("initials"), i, F.lit(2)))
    illegal = F.when(F.length("initials") < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))))
    told = plans.select(
        F.col("conv_id").alias("c"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT).alias("truncated"), illegal.cast("bigint").alias("illegal"),
        "plan.cost", F.array_join("plan.audits", "").alias("audit"),
    )
    return gaps.join(told, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"), _turns(edited)


TURNS = "conv_id bigint, turn bigint, role string, text string, edit string"


def _frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ddl.split(", ")]).astype({"conv_id": "Int64"})


def _turns(edited: DataFrame) -> DataFrame:
    """Repaired turns; pieces are independent, so a long conversation is written by many tasks."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, edits, state, turn = None, "", NOTHING, 0
        at = 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, turn
            while at < len(edits) and edits[at] == "I":
                state = _behind("I", "", state)
                yield conv, turn, "user" if state == USER else "assistant", "", "I"
                at, turn = at + 1, turn + 1

        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if row.edits is not None:  # a piece begins; what the last one inserts at its end comes first
                    out += inserted()
                    conv, edits, state, turn, at = (None if pd.isna(row.conv_id) else int(row.conv_id)), row.edits, int(row.state), int(row.start), 0
                out += inserted()
                letter, at = edits[at], at + 1
                if letter != "D":
                    state = _behind(letter, row.role[:1], state)
                    out.append((conv, turn, row.role if letter == "K" else "user" if state == USER else "assistant", row.text, letter))
                    turn += 1
            yield _frame(out, TURNS)
        yield _frame(list(inserted()), TURNS)

    return edited.repartition("part", "piece").sortWithinPartitions("part", "place").mapInPandas(apply, TURNS)


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id and the digest of its newline-joined ``role:text``; one running digest in a stream of sorted turns."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, ddl = None, None, "conv_id bigint, repaired_sha256 string"
        for frame in frames:
            done = []
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, joint = conv, hashlib.sha256(), ""
                digest.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            yield _frame(done, ddl)
        if digest is not None:
            yield _frame([(now, digest.hexdigest())], ddl)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInPandas(stream, "conv_id bigint, repaired_sha256 string")


def repair_report(convs: DataFrame) -> DataFrame:
    """One row for every conversation of ``convs`` after damage and repair."""
    found, turns = repaired(damaged(convs))
    digests = turn_digests(turns).withColumnRenamed("conv_id", "d")
    found = found.join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left").drop("d").withColumnRenamed("conv_id", "c")
    every = convs.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})
