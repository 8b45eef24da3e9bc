"""Exact nearest peers on structure, size and price level, without comparing all pairs.

Distance = sum of weights of differing structure flags + |log2 size ratio| +
|price difference| / scale (a fixed 1.0 when either price is missing).

1. Units with identical features collapse to one point that keeps its k+1
   smallest candidate ids: with ties broken by id nobody else can be among
   anyone's k.  A third of all units sharing one point costs one search.
2. Points are sorted by class and locality and cut, an Arrow batch at a time, by
   halving the wider side of the box: blocks of at most ``BLOCK`` points of a
   class with the boxes of their points and of their candidates.  A batch's share
   of a class is a region.
3. The farthest any point of a searching box can be from a box with k+1
   candidates bounds the distance of its k+1-th candidate; boxes that begin
   beyond it are out.  Regions are compared with regions first, then blocks inside
   the regions that are left, then the single points of blocks with many
   candidates left.  So points far off all candidates, or of a rare class, see the
   few blocks they can have peers in.
4. A block meets its candidate blocks in one group, where the distances are one
   matrix product of bounded size at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.ordered import shared, spread, top_k, written

# Structure weights, size weight, price scale, peers per unit.
STRUCTURE_WEIGHTS = {
    "consolidated_or_independent": 1.5,
    "runs_schools": 1.5,
    "fire_external": 1.5,
    "police_contracted": 1.5,
    "county_like_functions": 1.0,
}
SIZE_WEIGHT, PRICE_SCALE, N_PEERS = 1.0, 10.0, 8

BLOCK = 128  # points of a block
CROWD = 1 << 16  # candidates above which a block's points search on their own
CELLS = 1 << 20  # distances held at a time
TIE = 2e-9  # distances are compared at nine digits


def nearest_peers(
    units: DataFrame,
    weights: dict[str, float] | None = None,
    size_weight: float = SIZE_WEIGHT,
    price_scale: float = PRICE_SCALE,
    k: int = N_PEERS,
) -> DataFrame:
    """units(pid, pop, rpp nullable, one boolean per weight, complete) to (pid, rank, peer_pid, distance, ...)."""
    weights = weights or STRUCTURE_WEIGHTS
    flags = list(weights)
    code = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    points = shared(
        units.select(
            "pid",
            "complete",
            code.alias("cls"),
            (F.log2(F.col("pop").cast("double")) * size_weight).alias("x"),
            F.nanvl(F.col("rpp").cast("double") / price_scale, F.lit(None).cast("double")).alias("r"),
        ).withColumn("priced", F.col("r").isNotNull()).withColumn("y", F.coalesce("r", F.lit(0.0)))
    )
    feature = ["cls", "priced", "x", "y"]
    # a size that is missing or not positive has no distance to anybody
    sized = points.filter("abs(x) < double('infinity')").withColumn("_c", F.coalesce("complete", F.lit(False)))
    first = top_k(sized, feature, [F.desc("_c"), F.col("pid")], k + 1)
    spots = first.groupBy(*feature).agg(F.sort_array(F.collect_list(F.when(F.col("_c"), F.col("pid")))).alias("pids"))
    # the cuts of range partitioning are sampled, so the blocks are written before anything refers to them
    blocks = written(_blocks(spots).withColumn("block", F.monotonically_increasing_id()))

    pairs = _near_blocks(blocks, weights, k)
    # a searching point of a crowded block is a block of its own
    load = pairs.groupBy("block").agg(F.sum("points").alias("_load"))
    crowded = F.col("_load") > CROWD
    pairs = shared(pairs.join(load, "block"))
    sought = blocks.select("block", "cls", "priced", "xs", "ys").join(load, "block")
    alone = sought.filter(crowded & (F.size("xs") > 1)).select("block", "cls", "priced", F.posexplode(F.arrays_zip("xs", "ys")).alias("part", "_p"))
    alone = alone.select("block", "part", "cls", "priced", F.array("_p.xs").alias("xs"), F.array("_p.ys").alias("ys"), *[F.col(f"_p.{v}s").alias(f"{v}{e}") for v in "xy" for e in "01"])
    whole = sought.join(alone.select("block").distinct(), "block", "left_anti")
    boxes = blocks.select(F.col("block").alias("c_block"), *[f"c_{v}{e}" for v in "xy" for e in "01"])
    picked = pairs.filter(crowded).drop("_load").join(boxes, "c_block")
    single = _within(_spans(alone.drop("cls", "priced", "xs", "ys").join(picked, "block")), ["block", "part"], k)

    meets = pairs.join(whole.select("block"), "block").withColumn("part", F.lit(-1)).select("block", "part", "c_block", "miss", "both", "code")
    meets = meets.unionByName(single.select(*meets.columns))
    theirs = blocks.select(F.col("block").alias("c_block"), "c_xs", "c_ys", "c_ns", "pids")
    meets = meets.join(theirs, "c_block").withColumnsRenamed({"block": "m_block", "part": "m_part"}).drop("c_block")
    seekers = whole.withColumn("part", F.lit(-1)).select("block", "part", "cls", "priced", "xs", "ys")
    seekers = seekers.unionByName(alone.select(*seekers.columns))
    near = "array<struct<pid: bigint, distance: double, size_component: double, price_component: double, code: int>>"
    best = seekers.groupBy("block", "part").cogroup(meets.groupBy("m_block", "m_part")).applyInArrow(_search(k), f"cls int, priced boolean, x double, y double, near {near}")
    order = F.transform("near", lambda s: F.struct(F.round(s["distance"], 9).alias("_order"), s["pid"].alias("peer_pid"), s["distance"], s["size_component"], s["price_component"], s["code"].alias("mismatch_code")))
    # every unit of the point drops itself and keeps k
    answers = sized.select("pid", *feature).join(best.select(*feature, F.slice(F.array_sort(order), 1, k + 1).alias("_all")), feature)
    mine = F.slice(F.filter("_all", lambda s: s["peer_pid"] != F.col("pid")), 1, k)
    rows = answers.select("pid", F.posexplode(mine).alias("_i", "_s"))
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col("_s.mismatch_code").bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(flags)])), "|")
    return rows.select(
        "pid",
        (F.col("_i") + 1).alias("rank"),
        F.col("_s.peer_pid").alias("peer_pid"),
        F.col("_s.distance").alias("distance"),
        F.col("_s.size_component").alias("size_component"),
        F.col("_s.price_component").alias("price_component"),
        names.alias("structure_mismatches"),
    )


def _blocks(spots: DataFrame) -> DataFrame:
    """Blocks of points in a locality order: interleaved-digit cells of both coordinates, class by class."""
    digits = [(F.shiftright(F.floor(F.col(c) * 64).cast("bigint"), i).bitwiseAND(1), c, i) for i in range(11, -1, -1) for c in ("x", "y")]
    order = F.concat(*[d.cast("string") for d, _, _ in digits])
    laid = spots.withColumn("_z", order).repartitionByRange("cls", "priced", "_z", "x", "y").sortWithinPartitions("cls", "priced", "_z", "x", "y").drop("_z")
    lists = "xs array<double>, ys array<double>, c_xs array<double>, c_ys array<double>, c_ns array<int>, pids array<bigint>"
    box = ", ".join(f"{side}{v}{e} double" for side in ("", "c_") for v in "xy" for e in "01")
    return laid.mapInArrow(_cut, f"region bigint, cls int, priced boolean, {lists}, {box}, points int, n int")


def _halves(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows in blocks of at most ``BLOCK``, by halving the wider side."""
    todo, done = [rows], []
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        side = x if np.ptp(x[part]) >= np.ptp(y[part]) else y
        middle = len(part) // 2
        part = part[np.argpartition(side[part], middle)]
        todo += [part[middle:], part[:middle]]
    return done


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    region = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, priced, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "priced", "x", "y"))
        pids = batch.column("pids")
        held = pids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        lane = cls.astype(np.int64) * 2 + priced
        starts = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
        parts, regions = [], []
        for a, b in zip(starts, np.r_[starts[1:], len(lane)], strict=True):
            blocks = _halves(x, y, np.arange(a, b))
            parts += blocks
            regions += [region] * len(blocks)
            region += 1
        at = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        begins = np.r_[0, ends[:-1]]
        mine, n = held[at] > 0, held[at]
        counts, ids = np.add.reduceat(mine.astype(np.int32), begins), np.add.reduceat(n, begins)
        few = at[mine]
        lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)
        sizes = ends - begins
        out = {
            "region": pa.array(regions, pa.int64()), "cls": pa.array(cls[at[begins]], pa.int32()), "priced": pa.array(priced[at[begins]].astype(bool)),
            "xs": lists(pa.array(x[at]), sizes), "ys": lists(pa.array(y[at]), sizes),
            "c_xs": lists(pa.array(x[few]), counts), "c_ys": lists(pa.array(y[few]), counts), "c_ns": lists(pa.array(held[few]), counts),
            "pids": lists(pids.take(pa.array(few)).flatten(), ids),
        }
        for prefix, inside in (("", np.ones(len(at), bool)), ("c_", mine)):
            for v, values in (("x", x[at]), ("y", y[at])):
                out[f"{prefix}{v}0"] = pa.array(np.minimum.reduceat(np.where(inside, values, np.inf), begins))
                out[f"{prefix}{v}1"] = pa.array(np.maximum.reduceat(np.where(inside, values, -np.inf), begins))
        yield pa.RecordBatch.from_pydict({**out, "points": pa.array(counts, pa.int32()), "n": pa.array(ids, pa.int32())})


def _spans(met: DataFrame) -> DataFrame:
    """``lo`` and ``hi``: the least and largest distance of a point of the searching box to one of the other's candidates."""
    gap = lambda v: F.greatest(F.col(f"{v}0") - F.col(f"c_{v}1"), F.col(f"c_{v}0") - F.col(f"{v}1"), F.lit(0.0))
    far = lambda v: F.greatest(F.col(f"{v}1") - F.col(f"c_{v}0"), F.col(f"c_{v}1") - F.col(f"{v}0"))
    side = lambda f: F.col("miss") + f("x") + F.when(F.col("both"), f("y")).otherwise(1.0)
    return met.withColumns({"lo": side(gap), "hi": side(far)})


def _within(spans: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The pairs that can hold one of the k+1 nearest candidates."""
    reach = spans.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("n") > k, F.col("hi"))), F.lit(float("inf"))).alias("_reach"))
    return spans.join(reach, keys).filter(F.col("lo") <= F.col("_reach") + TIE).drop("_reach", "lo", "hi")


def _near_blocks(blocks: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """(block, c_block, points, n, miss, both, code): blocks and the candidate blocks their peers can be in."""
    box = [f"{v}{e}" for v in "xy" for e in "01"]
    edge = lambda c: (F.min if c.endswith("0") else F.max)(c).alias(c)
    regions = blocks.groupBy("region", "cls", "priced").agg(*[edge(f"{side}{c}") for side in ("", "c_") for c in box], F.sum("n").alias("n"))
    # ten thousand points a region, so their pairs are few
    other = regions.filter("n > 0").select(F.col("region").alias("c_region"), F.col("cls").alias("c_cls"), F.col("priced").alias("c_priced"), *[f"c_{c}" for c in box], "n")
    code = F.col("cls").bitwiseXOR(F.col("c_cls"))
    miss = sum((F.when(code.bitwiseAND(1 << i) != 0, w).otherwise(0.0) for i, w in enumerate(weights.values())), F.lit(0.0))
    met = regions.select("region", "cls", "priced", *box).crossJoin(other)
    met = met.withColumns({"code": code, "miss": miss, "both": F.col("priced") & F.col("c_priced")})
    close = shared(_within(_spans(met), ["region"], k).select("region", "c_region", "miss", "both", "code"))
    theirs = blocks.filter("n > 0").select(F.col("region").alias("c_region"), F.col("block").alias("c_block"), *[f"c_{c}" for c in box], "points", "n")
    mine = spread(blocks.select("region", "block", *box), "block")
    # the pairs of regions reach every block of theirs: the block's own bound comes from them
    return _within(_spans(mine.join(close, "region").join(theirs, "c_region")), ["block"], k).select("block", "c_block", "points", "n", "miss", "both", "code")


def _search(k: int):
    """The k+1 nearest candidates of every point of a block, and what ties with the last."""

    def nearest(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x, y = flat(mine, "xs"), flat(mine, "ys")
        sizes = theirs.column("c_xs").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        each = lambda c: np.repeat(theirs.column(c).to_numpy(), sizes)
        cx, cy, cn, pids = (flat(theirs, c) for c in ("c_xs", "c_ys", "c_ns", "pids"))
        miss, both, code = each("miss"), each("both").astype(bool), each("code")
        first = np.cumsum(cn) - cn
        found = []
        step = max(1, CELLS // max(1, len(cx)))
        for a in range(0, len(x), step):
            size = np.abs(x[a : a + step, None] - cx)
            price = np.where(both, np.abs(y[a : a + step, None] - cy), 1.0)
            d = miss + size + price
            last = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(d), np.inf)
            row, col = np.nonzero(d <= last[:, None] + TIE)
            # a row for each id of the points that are left
            n = cn[col]
            pick = np.repeat(np.arange(len(col)), n)
            pid = pids[np.repeat(first[col], n) + np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)]
            row, col = row[pick], col[pick]
            dist = d[row, col]
            o = np.lexsort((pid, dist, row))
            row, col, pid, dist = row[o], col[o], pid[o], dist[o]
            # places in the point and, among equal distances, in the tie
            place = np.arange(len(row))
            begin = np.searchsorted(row, np.arange(len(d)))
            new = np.r_[True, (row[1:] != row[:-1]) | (dist[1:] != dist[:-1])] if len(row) else np.zeros(0, bool)
            tie = place - np.maximum.accumulate(np.where(new, place, 0))
            total = np.diff(np.r_[begin, len(row)])
            limit = np.full(len(d), np.inf)
            limit[total > k] = dist[begin[total > k] + k]
            keep = (dist <= limit[row] + TIE) & (tie <= k)
            row, col, pid, dist = row[keep], col[keep], pid[keep], dist[keep]
            found.append((np.bincount(row, minlength=len(d)), pid, dist, size[row, col], price[row, col], code[col]))
        counts, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
        types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
        names = ("pid", "distance", "size_component", "price_component", "code")
        near = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), near)
        same = lambda c, t: pa.array(np.full(len(x), mine.column(c)[0].as_py()), t)
        return pa.table({"cls": same("cls", pa.int32()), "priced": same("priced", pa.bool_()), "x": pa.array(x), "y": pa.array(y), "near": lists})

    return nearest


def group_quality(links: DataFrame) -> DataFrame:
    """weak / close / loose per unit from the upper median distance and whether every peer differs somewhere."""
    summary = links.groupBy("pid").agg(
        F.sort_array(F.collect_list("distance")).alias("_d"), F.every(F.col("structure_mismatches") != "").alias("_all"), F.count(F.lit(1)).alias("n_peers")
    )
    med = F.element_at("_d", (F.floor(F.size("_d") / 2) + 1).cast("int"))
    quality = F.when((med >= 3.0) | F.col("_all"), "weak").when(med < 1.5, "close").otherwise("loose")
    return summary.select("pid", "n_peers", med.alias("upper_median"), quality.alias("group_quality"))


def peer_overlap(base: DataFrame, other: DataFrame, k: int = N_PEERS) -> DataFrame:
    """Share of the default peer set kept under other weights, per unit."""
    a = base.groupBy("pid").agg(F.collect_set("peer_pid").alias("_a"))
    b = other.groupBy("pid").agg(F.collect_set("peer_pid").alias("_b"))
    return a.join(b, "pid").select("pid", (F.size(F.array_intersect("_a", "_b")) / F.lit(float(k))).alias("overlap"))
