"""Near-duplicates by the Jaccard similarity of five-word shingles, for stages without a contract of their own.

Texts with the same set of shingle hashes are one node.  Every node has ``BANDS``
keys of ``ROWS`` minima of its set under fixed permutations; two sets of similarity
``s`` share no key with probability ``(1 - s**ROWS)**BANDS``, about 1e-7 at 0.8 and
less above (calculated).  Nodes that hang together by keys are one shard; a shard
above ``SHARD_HASHES`` is dealt by key instead, and a key above that is cut into
pieces that meet in pairs, so a task holds two pieces at most and nothing is left out.

In a task the nodes of a shard are a BK-tree of SimHash fingerprints of their sets.
One component grows at a time: its new members follow the edges within ``RADIUS``,
what they find is verified on the whole sets (in integers, so no link is false),
and reached members leave the tree.  Fingerprints of sets of similarity 0.8 differ
in ``RADIUS`` bits or more with probability below 1e-5 (calculated, 12 bits on
average for sets of five, 10 for large ones).  Before the sets are compared, a pair
must share a bit of its rarest shingles: two similar sets have one in common
among the rarest fifth of either, and one more.  A task so gives one verified link
for each member at most, whatever pairs it has looked at.

Two unrelated sets get the same 64-bit number, and so one class, with probability
2^-64 a pair (about three pairs among 10 billion sets).

Nulls and edge cases: null and blank texts have the empty set and are one class;
a text below five words is one shingle; rows repeating an id or a text are one
class, and of rows equal in both that with the smallest hash of all columns stays;
null ids come after all others; an empty table gives no rows; any other columns
pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from statloom.llm.common import stored, text_bytes
from statloom.llm.simhash import _BITS, _BYTE_BASE, MAX_TREE, SEED, Forest, _row_keys, component_roots

WIDTH = 5
#: Similarity from which two texts are linked, as a fraction.
OVER, UNDER = 4, 5
ROWS, BANDS = 5, 40
RADIUS = 26
#: Hashes of a shard that come to one task, and of whole shards searched at once.
SHARD_HASHES = 2_000_000
#: Bits of a set's rarest shingles, and pairs held against them at once.
RARE_BITS, PAIRS = 4096, 65_536
#: Hashes compared with one set at once (one set may have more).
COMPARED = 1 << 18
#: Hashes permuted at once.
STEP = 4096
_RANDOM = np.random.Generator(np.random.PCG64(SEED))
_FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles in ascending order; empty without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band from the minima of the set under every permutation."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), STEP):
        part = _FACTORS[:, None] * hashes[None, i : i + STEP] + _OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def set_print(hashes: np.ndarray) -> int:
    """Majority of every bit over the hashes of a set."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.bincount((octets + _BYTE_BASE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int((2 * ones.ravel() > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


_MARKS = T.StructType().add("node", T.LongType()).add("size", T.LongType()).add("keys", T.ArrayType(T.LongType()))


@pandas_udf(_MARKS)
def mark_columns(texts: pd.Series) -> pd.DataFrame:
    """Number and size of the set of shingles, and its keys; an empty set has no keys."""
    out = []
    for text in texts:
        hashes = shingle_hashes(text)
        number = np.array(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED), np.uint64).view(np.int64)
        out.append((number, len(hashes), band_keys(hashes).view(np.int64) if len(hashes) else np.zeros(0, np.int64)))
    return pd.DataFrame(out, columns=_MARKS.names).astype({"node": np.int64, "size": np.int64})


@pandas_udf(T.ArrayType(T.LongType()))
def set_column(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_hashes(t).view(np.int64) for t in texts], dtype=object)


class Sets:
    """Sorted sets end to end, with a bitmap of the rarest members of each."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.flat = np.concatenate(sets)
        _, which, df = np.unique(self.flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((which, df[which], row))  # the rarest first, ties by the hash
        nth = np.arange(len(order)) - self.begin[row]  # rows are adjacent, so this is the place in the set
        least = -(-OVER * self.size // UNDER)
        rare = order[nth < (self.size - least + 1)[row]]
        self.bits = np.zeros((len(sets), RARE_BITS // 64), np.uint64)
        bit = which[rare] % RARE_BITS
        np.bitwise_or.at(self.bits, (row[rare], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))

    def linked(self, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which pairs are similar enough: |a & b| / |a | b| >= OVER / UNDER."""
        a, b = self.size[query], self.size[row]
        open_ = np.flatnonzero(OVER * np.maximum(a, b) <= UNDER * np.minimum(a, b))
        for i in range(0, len(open_), PAIRS):
            part = open_[i : i + PAIRS]
            open_[i : i + PAIRS] = np.where((self.bits[query[part]] & self.bits[row[part]]).any(axis=1), part, -1)
        open_ = open_[open_ >= 0]
        out = np.zeros(len(query), bool)
        open_ = open_[np.argsort(query[open_], kind="stable")]
        # runs of one query, cut where their sets together reach COMPARED hashes
        weight = np.cumsum(self.size[row[open_]]) // COMPARED
        cuts = np.flatnonzero(np.diff(query[open_]) | np.diff(weight)) + 1
        for some in np.split(open_, cuts) if len(open_) else ():
            own = self.flat[self.begin[query[some[0]]] : self.end[query[some[0]]]]
            sizes = self.size[row[some]]
            starts = np.cumsum(sizes) - sizes
            other = self.flat[np.repeat(self.begin[row[some]] - starts, sizes) + np.arange(int(sizes.sum()))]
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            common = np.add.reduceat((own[at] == other).astype(np.int64), starts)
            out[some] = common * (OVER + UNDER) >= OVER * (len(own) + sizes)
        return out


class VerifiedForest(Forest):
    """BK-trees whose components grow by verified links only."""

    def spanning(self, radius: int, sets: Sets) -> np.ndarray:
        """For every row the row that reached it, -1 for the first of a component."""
        via = np.full(len(self.prints), -1, np.int64)
        step = max(16, 500_000 // int((self.end - self.begin).max()))
        pointer, busy, front = self.begin.copy(), np.zeros(len(self.begin), bool), np.zeros(0, np.int64)
        while True:
            idle = np.flatnonzero(~busy & (pointer < self.end))
            while len(idle):
                stale = ~self.alive[pointer[idle]]
                pointer[idle[stale]] += 1
                if not stale.any():
                    break
                idle = idle[pointer[idle] < self.end[idle]]
            seeds = pointer[idle]
            self.take(seeds)
            asking = np.concatenate((front, seeds))
            if not len(asking):
                return via
            reached = []
            for i in range(0, len(asking), step):
                query, row = self.near(asking[i : i + step], radius)
                similar = sets.linked(query, row)
                row, where = np.unique(row[similar], return_index=True)
                via[row] = query[similar][where]
                self.take(row)
                reached.append(row)
            front = np.concatenate(reached)
            busy[:] = False
            busy[self.number[front]] = True


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (doc_id, k1, k2, node, size, keys) of every row; ``node`` numbers the set of shingles."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_row_keys(id_col, text_col), mark_columns(text_bytes(text_col)).alias("s"))
    return stored(rows.select("doc_id", "k1", "k2", "s.*"), "shingles")


def shards(nodes: DataFrame) -> DataFrame:
    """(kind, shard, i, j, node): nodes that must meet, in shards of at most two pieces of ``SHARD_HASHES``."""
    keyed = nodes.select("node", "size", F.explode(F.array_distinct("keys")).alias("key"))
    centres = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").select("key", "centre")
    members = stored(keyed.join(centres, "key"), "members")
    blobs = component_roots(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    wanted = members.groupBy("node").agg(F.any_value("size").alias("size"))
    named = with_roots(wanted, blobs).withColumnRenamed("root", "blob")
    weights = named.groupBy("blob").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    fits = (F.col("w") <= SHARD_HASHES) & (F.col("n") <= MAX_TREE)
    named = stored(named.join(weights.select("blob", fits.alias("fits")), "blob"), "blobs")
    whole = named.where("fits").select(F.lit(0).alias("kind"), F.col("blob").alias("shard"), F.lit(0).alias("i"), F.lit(0).alias("j"), "node")
    wide = members.join(named.where("NOT fits").select("node"), "node", "left_semi")
    heavy = wide.groupBy("key").agg(F.greatest(F.ceil(F.sum("size") / SHARD_HASHES), F.ceil(F.count(F.lit(1)) / MAX_TREE)).cast("int").alias("pieces"))
    wide = wide.join(heavy, "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    wide = wide.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("pieces = 1 OR p <> q")
    return whole.union(wide.select(F.lit(1), "key", F.least("p", "q"), F.greatest("p", "q"), "node"))


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


_SHARD = ["kind", "shard", "i", "j"]


def verified_links(sharded: DataFrame) -> DataFrame:
    """(a, b) links that connect every two similar sets of a shard; ``sharded`` has its columns, node and hashes."""

    def search(frames):
        held: list[pd.DataFrame] = []
        weight = 0
        for frame in frames:
            held.append(frame)
            weight += sum(map(len, frame["hashes"]))
            if weight >= SHARD_HASHES:
                both = pd.concat(held)
                last = (both[_SHARD] == both[_SHARD].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield links(both[~last])
                held = [both[last]]
                weight = sum(map(len, held[0]["hashes"]))
        if held and sum(map(len, held)):
            yield links(pd.concat(held))

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        parts = frame[_SHARD].to_numpy()
        changes = np.concatenate(([0], (parts[1:] != parts[:-1]).any(axis=1).cumsum()))
        sets = [np.asarray(h, np.int64).view(np.uint64) for h in frame["hashes"]]
        via = VerifiedForest(changes, np.array([set_print(s) for s in sets], np.uint64)).spanning(RADIUS, Sets(sets))
        node, row = frame["node"].to_numpy(np.int64), np.flatnonzero(via >= 0)
        return pd.DataFrame({"a": node[row], "b": node[via[row]]})

    ordered = sharded.select(*_SHARD, "node", "hashes").repartition(*_SHARD).sortWithinPartitions(*_SHARD)
    return ordered.mapInPandas(search, "a bigint, b bigint")


def classes(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(v, root) for every node linked with another, but the root itself."""
    nodes = prints.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("pick"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"))
    dealt = stored(shards(nodes), "shards")
    wanted = dealt.select("node").distinct().join(nodes.select("node", "pick.k1", "pick.k2"), "node")
    texts = docs.select(*_row_keys(id_col, text_col), text_bytes(text_col).alias("text")).join(wanted, ["k1", "k2"])
    sets = texts.groupBy("node").agg(F.any_value("text").alias("text")).select("node", set_column("text").alias("hashes"))
    return component_roots(verified_links(dealt.join(sets, "node")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class: that of the smallest id, and of equal ids the one with the smallest key."""
    prints = marked(docs, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("best")
    named = with_roots(prints.select("doc_id", "k1", "k2", "node"), classes(docs, prints, id_col, text_col))
    picked = named.groupBy("root").agg(best).select("best.k1", "best.k2").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *_row_keys(id_col, text_col)).join(picked, ["k1", "k2"], "left_semi")
    # equal rows are reduced in every task before they meet
    return rows.groupBy("k1", "k2").agg(F.min_by("whole", F.xxhash64("whole")).alias("whole")).select("whole.*")
