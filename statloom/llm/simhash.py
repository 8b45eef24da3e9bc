"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius through BK-trees.

Distinct fingerprints are dealt into shards by the pigeonhole rule: the 64 bits
are cut into ``radius + shared`` blocks, and two fingerprints within the radius
agree on at least ``shared`` of them, so they meet in the table of those blocks.
A shard is one value of a table's bits.  Its BK-tree (children keyed by their
Hamming distance to the parent) and its queries are brought together by the
shuffle; a broadcast of all trees would grow with the corpus.  A query follows
only the edges within the radius, and only into subtrees that still hold
fingerprints no earlier query of its component has reached, so a dense group
costs about one visit per member and yields a star of links, not all pairs.
A shard above ``MAX_TREE`` fingerprints is cut into pieces, and every two pieces
meet in a task, so no task holds more than two pieces of a shard.

Stars are joined into components by large-star and small-star rounds.

Nulls and edge cases: a null or blank text has fingerprint zero and is linked
like any other; rows repeating an id or a text get the same class; a null id is
never the smallest, a class of null ids has a null class id; an empty table
gives no rows; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from statloom.llm.common import stored, text_bytes, text_or_empty

SEED = 42
MAX_TREE = 65_536
#: Fingerprints a shard should hold on average; more blocks are shared once a table has more.
SHARD_SIZE = 64
#: Rows of whole shards searched at once in a task, and pairs looked at in one step.
FOREST_ROWS = 200_000
STEP_PAIRS = 2_000_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_BASE = np.arange(8) * 256


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority of every bit over the hashes of all word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.bincount((octets + _BYTE_BASE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int((2 * ones.ravel() > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


@pandas_udf(T.LongType())
def fingerprint_column(texts: pd.Series, width: pd.Series) -> pd.Series:
    values = [fingerprint(t, int(w)) for t, w in zip(texts, width)]
    return pd.Series(np.array(values, np.uint64).view(np.int64))


class Forest:
    """BK-trees of many shards in flat arrays; rows of a shard are adjacent, its first row is the root."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        self.prints = prints
        n = len(prints)
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        self.begin, self.end = first, np.concatenate((first[1:], [n]))
        self.number = np.repeat(np.arange(len(first)), self.end - self.begin)
        self.parent = np.full(n, -1, np.int64)
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.begin[self.number[waiting]]
        keys, kids = [], []
        while len(waiting):
            key = at * 65 + np.bitwise_count(prints[waiting] ^ prints[at]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, waiting, at = key[order], waiting[order], at[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            kid = waiting[new]
            self.parent[kid] = at[new]
            keys.append(key[new])
            kids.append(kid)
            below = kid[np.cumsum(new) - 1]
            waiting, at = waiting[~new], below[~new]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.edges = keys[order]
        self.kids = np.concatenate(kids)[order] if kids else np.zeros(0, np.int64)
        self.alive = np.ones(n, bool)
        self.left = np.zeros(n, np.int64)
        self._count(np.arange(n), 1)

    def _count(self, rows: np.ndarray, by: int) -> None:
        """Adds to the live rows of every subtree that holds ``rows``."""
        while len(rows):
            np.add.at(self.left, rows, by)
            rows = self.parent[rows]
            rows = rows[rows >= 0]

    def take(self, rows: np.ndarray) -> None:
        self.alive[rows] = False
        self._count(rows, -1)

    def near(self, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, live row) pairs within the radius; only edges within it of the query's distance are followed."""
        asked, found = [], []
        query, node = rows, self.begin[self.number[rows]]
        while len(query):
            open_ = self.left[node] > 0
            query, node = query[open_], node[open_]
            distance = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
            hit = (distance <= radius) & self.alive[node]
            asked.append(query[hit])
            found.append(node[hit])
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), side="right")
            spread = high - low
            query = np.repeat(query, spread)
            offset = np.arange(len(query)) - np.repeat(np.cumsum(spread) - spread, spread)
            node = self.kids[np.repeat(low, spread) + offset]
        if not asked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(asked), np.concatenate(found)

    def components(self, radius: int) -> np.ndarray:
        """For every row the first-reached row of its component within its shard.

        One component per shard grows at a time, so a live row is never in
        another unfinished component and no link between components is missed.
        """
        label = np.full(len(self.prints), -1, np.int64)
        step = max(16, STEP_PAIRS // int((self.end - self.begin).max()))
        pointer = self.begin.copy()
        busy = np.zeros(len(self.begin), bool)
        front = np.zeros(0, np.int64)
        while True:
            idle = np.flatnonzero(~busy & (pointer < self.end))
            while len(idle):
                stale = ~self.alive[pointer[idle]]
                pointer[idle[stale]] += 1
                if not stale.any():
                    break
                idle = idle[pointer[idle] < self.end[idle]]
            seeds = pointer[idle]
            label[seeds] = seeds
            self.take(seeds)
            asking = np.concatenate((front, seeds))
            if not len(asking):
                return label
            reached = []
            for i in range(0, len(asking), step):
                query, row = self.near(asking[i : i + step], radius)
                row, where = np.unique(row, return_index=True)
                label[row] = label[query[where]]
                self.take(row)
                reached.append(row)
            front = np.concatenate(reached)
            busy[:] = False
            busy[self.number[front]] = True


def shard_stars(shard: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, centre) that connect all fingerprints within the radius inside each shard."""
    label = Forest(shard, prints).components(radius)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return prints[linked], prints[label[linked]]


def table_masks(radius: int, shared: int) -> list[int]:
    """One mask for every choice of ``shared`` of the ``radius + shared`` blocks, as signed 64-bit integers."""
    blocks = radius + shared
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shared_blocks(prints: int, radius: int) -> int:
    """Fewest shared blocks for which a shard holds about ``SHARD_SIZE`` fingerprints; the links do not depend on it."""
    shared = 1
    while shared < 4 and prints > SHARD_SIZE << (64 * shared // (radius + shared)):
        shared += 1
    return shared


def near_links(nodes: DataFrame, radius: int, count: int) -> DataFrame:
    """(a, b) links over distinct fingerprints ``fp`` that connect everything within the radius."""
    masks = table_masks(radius, shared_blocks(count, radius))
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    members = nodes.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.v")
    sizes = members.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_TREE)
    pieces = sizes.select("t", "v", F.ceil(F.col("n") / MAX_TREE).cast("int").alias("pieces"))
    members = members.join(pieces, ["t", "v"], "left").fillna(1, ["pieces"])
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    members = members.withColumn("p", piece).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    members = members.where((F.col("pieces") == 1) | (F.col("q") != F.col("p")))
    keys = ["t", "v", "i", "j"]
    members = members.select("fp", "t", "v", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))

    def search(frames):
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows >= FOREST_ROWS:
                whole = pd.concat(held)
                last = (whole[keys] == whole[keys].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield stars(whole[~last])
                held, rows = [whole[last]], int(last.sum())
        if rows:
            yield stars(pd.concat(held))

    def stars(frame: pd.DataFrame) -> pd.DataFrame:
        parts = frame[keys].to_numpy()
        changes = np.concatenate(([0], (parts[1:] != parts[:-1]).any(axis=1).cumsum()))
        a, b = shard_stars(changes, frame["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(search, "a bigint, b bigint").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(v, root) for every linked node but the root itself, the root being the smallest node of its component."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("root").alias("v"), F.col("v").alias("root"))).withColumnRenamed("root", "w")
        low = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("w > v").select(F.col("w").alias("v"), F.col("m").alias("root")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v").where("root <> m").select(F.col("root").alias("v"), F.col("m").alias("root"))
        edges = stored(small.union(low.select("v", F.col("m").alias("root"))).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Stored (doc_id, fp) of every row, and k1, k2: 128 bits of the id and text."""
    return stored(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_row_keys(id_col, text_col), fingerprint_column(text_bytes(text_col), F.lit(width)).alias("fp")),
        "simhash",
    )


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    what = [F.col(f"`{id_col}`"), text_or_empty(text_col)]
    return [F.xxhash64(*what).alias("k1"), F.xxhash64(F.lit("second"), *what).alias("k2")]


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """fp, root of its class and the smallest id that has it, for every distinct fingerprint; stored."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = component_roots(near_links(nodes.select("fp"), radius, nodes.count()))
    joined = nodes.join(roots, F.col("fp") == F.col("v"), "left")
    return stored(joined.select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest id of the class, of every row."""
    prints = fingerprinted(docs, id_col, text_col, width)
    found = classes(prints, radius)
    named = found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of every class: that of the smallest id, and of equal ids the one with the smallest key."""
    prints = fingerprinted(docs, id_col, text_col, width)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("best")
    picked = prints.join(classes(prints, radius).select("fp", "root"), "fp").groupBy("root").agg(best).select("best.k1", "best.k2").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *_row_keys(id_col, text_col)).join(picked, ["k1", "k2"], "left_semi")
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64("whole")))
    return rows.withColumn("nth", first).where("nth = 1").select("whole.*")
