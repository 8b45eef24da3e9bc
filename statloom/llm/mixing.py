"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it should appear.  Among all
rates that meet each source's token target the ones closest to 1 in relative
entropy are exponentially tilted: rate = min(cap, exp(lambda * size / mean size)),
with one dual variable per source.  The dual is convex; its Newton iterations are
distributed: documents are first counted per (source, size), and every iteration
sums tokens and slopes per source over those counts, with a bracket that replaces
a Newton step leaving it.  Sums are whole numbers, so reruns agree.

Rates become copies by carrying the rounding error from document to document, in
decreasing size, within buckets of about ``BUCKET_ROWS`` documents of a source; what
a bucket is off by is at most about half its smallest document.  Buckets split hot
sources; a source's targets, statistics and duals are one row each.

Nulls and edge cases: a null text has size 0; documents of size 0 add nothing to
any sum and appear once; a null source is a source of its own, last in order; a
source without tokens has target 0; equal or repeated rows are rounded one by one
(ties by id, then text); an empty table gives no rows; only the id, text and
source are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import stored, text_or_empty, with_global_rank

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BUCKET_ROWS = 2_000
ROUNDS = 60
CLOSE = 1e-6
#: Tokens times rates are summed in these fractions of a token.
GRAIN = 1000


def text_size(text: Column) -> Column:
    """Number of runs of characters other than blank and \\x09-\\x0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, is_null, rows, source_size, target; sources in code point order, null last.

    Shares of the total go by weight; a target stops at ``cap`` times its source's
    size and the excess goes to the others.  Ordering the sources by size over
    weight puts the capped ones first, so one running sum finds them: those before
    the first source whose share of what is left stays within its limit.
    """
    stats = stored(
        sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").cast("bigint").alias("source_size")).withColumn("is_null", F.col("source").isNull()),
        "source-sizes",
    )
    ranked, n = with_global_rank(stats, ["is_null", "source"], "source-order")
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(wheel, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    totals = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    if not n or not totals[0]:
        return weighed.withColumn("target", F.lit(0.0)).drop("weight")
    tight = [(F.col("source_size") / F.col("weight")).alias("tightness")]
    ordered = stored(weighed.select("*", *tight), "source-weights")
    level = _fill_level(ordered, float(totals[0]), float(totals[1]), cap)
    return ordered.withColumn("target", F.least(cap * F.col("source_size"), level * F.col("weight"))).drop("weight", "tightness")


def _fill_level(ordered: DataFrame, total: float, weight: float, cap: float) -> float:
    """Tokens per unit of weight of the sources below their cap; repeated until no further source is above it."""
    level = total / weight
    while True:
        over = ordered.where(cap * F.col("tightness") <= level).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        free = weight - float(over[1])
        new = (total - cap * float(over[0])) / free if free > 1e-12 else float("inf")
        if not new > level:
            return level
        level = new


def tilt(size: Column, dual: Column, mean: Column, cap: float) -> Column:
    return F.least(F.exp(F.least(dual * size / mean, F.lit(50.0))), F.lit(cap))


def _whole_sum(value: Column) -> Column:
    """A sum of rounded terms: the same in whatever order tasks add them."""
    return F.sum(F.round(value).cast("decimal(38,0)")).cast("double")


def solve_duals(counts: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """source, mean, dual, full for every source with tokens, by Newton steps for all sources at once.

    ``counts`` holds (source, size, n).  A source whose target is its
    size times the cap keeps every document at the cap, whatever the dual.
    """
    live = targets.where("source_size > 0").select(
        "source", "target", (F.col("source_size") / F.col("rows")).alias("mean"), (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full")
    )
    state = stored(live.select("*", F.lit(0.0).alias("dual"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high")), "duals")
    for _ in range(ROUNDS):
        both = F.col("c.source").eqNullSafe(F.col("s.source"))
        rate = tilt(F.col("c.size"), F.col("s.dual"), F.col("s.mean"), cap)
        moving = F.col("s.dual") * F.col("c.size") / F.col("s.mean") < F.log(F.lit(cap))
        mass = F.col("c.n") * F.col("c.size") * rate * GRAIN
        sums = counts.alias("c").join(state.alias("s"), both).groupBy("s.source").agg(
            _whole_sum(mass).alias("tokens"), _whole_sum(F.when(moving, mass * F.col("c.size") / F.col("s.mean")).otherwise(0.0)).alias("slope")
        )
        joined = state.alias("s").join(sums.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")))
        gap = F.col("target") * GRAIN - F.col("tokens")
        low = F.when(gap > 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") + gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        step = F.when(inside, newton).otherwise((low + high) / 2)
        done = F.col("full") | (F.abs(gap) <= F.greatest(CLOSE * F.col("target") * GRAIN, F.lit(0.05 * GRAIN)))
        new = joined.select(
            "s.source", "target", "mean", "full", F.when(done, F.col("dual")).otherwise(step).alias("dual"), low.alias("low"), high.alias("high"), (~done).alias("open")
        )
        new = stored(new, "duals")
        unfinished = new.where("open").limit(1).count()
        state = new.drop("open")
        if not unfinished:
            break
    return state.select("source", "mean", "dual", "full")


def copies_of(sizes: np.ndarray, rates: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies in the given order; the tokens owed so far are carried on."""
    owed, out = 0.0, np.zeros(len(sizes), np.int64)
    for i, (size, rate) in enumerate(zip(sizes.tolist(), rates.tolist())):
        want = rate + owed / size
        out[i] = min(max(int(np.floor(want + 0.5)), 0), cap)
        owed = (want - out[i]) * size
    return out


def document_copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """row, size, source_size, target, rate and copies of stored (row, doc_id, k1, source, size) rows."""
    targets = stored(source_targets(rows, weights, float(cap)), "source-targets")
    counts = stored(rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    duals = solve_duals(counts, targets, float(cap)).withColumnRenamed("source", "d_source")
    known = targets.select(F.col("source").alias("t_source"), F.col("rows").alias("source_rows"), "source_size", "target")
    known = known.join(duals, F.col("t_source").eqNullSafe(F.col("d_source")), "left")
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("t_source")))
    tilted = tilt(F.col("size"), F.col("dual"), F.col("mean"), float(cap))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).otherwise(tilted)
    bucket = F.pmod(F.xxhash64("k1"), F.ceil(F.col("source_rows") / BUCKET_ROWS)).cast("bigint")
    rated = joined.select(
        "row", "k1", F.xxhash64("k1", F.lit("order")).alias("spread"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("is_null"),
        bucket.alias("bucket"), "size", "source_size", "target", F.round(rate, 6).alias("rate"),
    )

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "spread", "k1", "row"], ascending=[False, True, True, True])
        size, rate = frame["size"].to_numpy(), frame["rate"].to_numpy()
        copies = np.ones(len(frame), np.int64)
        copies[size > 0] = copies_of(size[size > 0], rate[size > 0], cap)
        return frame.assign(copies=copies)[["row", "size", "source_size", "target", "rate", "copies"]]

    schema = "row bigint, size bigint, source_size bigint, target double, rate double, copies bigint"
    # dealt out anew: the join left all buckets of a source in one partition
    return rated.repartition("s", "is_null", "bucket").groupBy("s", "is_null", "bucket").applyInPandas(deal, schema)


def _row_keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """128 bits that tell different rows apart; rows that share them are equal in id, text and source."""
    what = [F.col(f"`{id_col}`"), F.col(f"`{source_col}`").isNull(), F.col(f"`{source_col}`").cast("string"), text_or_empty(text_col)]
    return [F.xxhash64(*what).alias("k1"), F.xxhash64(F.lit("second"), *what).alias("k2")]


def mixing_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Stored (row, doc_id, k1, k2, source, size) of every document."""
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{id_col}`").alias("doc_id"),
            *_row_keys(id_col, text_col, source_col),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            text_size(text_or_empty(text_col)).alias("size"),
        ),
        "mixing-rows",
    )


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3, **columns) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate and copies of every document."""
    rows = mixing_rows(docs, **columns)
    joined = rows.select("row", "doc_id").join(document_copies(rows, weights, cap), "row")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mixture takes it."""
    rows = mixing_rows(docs, id_col, text_col, source_col)
    dealt = rows.select("row", "k1", "k2").join(document_copies(rows, weights, cap).select("row", "copies"), "row")
    dealt = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("row"))).drop("row")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("whole"), *_row_keys(id_col, text_col, source_col))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64("whole"))))
    taken = keyed.join(dealt, ["k1", "k2", "nth"]).where("copies > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("whole.*")
