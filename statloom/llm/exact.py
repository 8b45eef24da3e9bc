"""Exact deduplication with a cuckoo-filter index over text digests.

The index is a table with one row per shard of the digest space.  A shard holds
a cuckoo filter (buckets of four 16-bit fingerprints, two candidate buckets per
digest) and, in the same slots, the stored content: the whole 256-bit digest,
the largest document id and the number of live rows.  A filter hit therefore
verifies against the content of that slot, deletion removes one row (and the
fingerprint with the last), and when an insertion finds no free slot the filter
doubles its buckets and is rebuilt from the stored digests.

A hot text is pre-aggregated before it is shuffled: rows of a digest are first
summed under ``SALTS`` salts, so one shard gets at most that many rows of it.
Shards hold about ``SHARD_ROWS`` rows, so their number follows the input.

Nulls and edge cases: a null text counts as empty; a null id never wins over
another id, and a group of null ids only keeps its first row; rows that repeat
an id and text are one row kept and the others dropped; an empty table gives no
rows; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import stored, text_bytes

SALTS = 64
SHARD_ROWS = 20_000
LEAST_SHARDS = 64
SLOTS = 4
MAX_KICKS = 200
#: Stands for a missing id inside the index; below every other id.
NO_ID = -(2**63)
STATE = "shard int, buckets int, fingerprints binary, digests binary, ids binary, counts binary"


class CuckooShard:
    """Filter and bucketed content of one shard."""

    def __init__(self, buckets: int = 64):
        self.clear(buckets)

    def clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = [0] * (buckets * SLOTS)
        self.digests: list[bytes | None] = [None] * (buckets * SLOTS)
        self.ids = [NO_ID] * (buckets * SLOTS)
        self.counts = [0] * (buckets * SLOTS)

    @classmethod
    def load(cls, row) -> "CuckooShard":
        shard = cls(int(row.buckets))
        shard.prints = np.frombuffer(row.fingerprints, np.uint16).tolist()
        raw = bytes(row.digests)
        shard.ids = np.frombuffer(row.ids, np.int64).tolist()
        shard.counts = np.frombuffer(row.counts, np.int64).tolist()
        shard.digests = [raw[32 * i : 32 * i + 32] if p else None for i, p in enumerate(shard.prints)]
        return shard

    def dump(self, number: int) -> dict:
        return {
            "shard": number,
            "buckets": self.buckets,
            "fingerprints": np.array(self.prints, np.uint16).tobytes(),
            "digests": b"".join(d or bytes(32) for d in self.digests),
            "ids": np.array(self.ids, np.int64).tobytes(),
            "counts": np.array(self.counts, np.int64).tobytes(),
        }

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and the two buckets; each follows from the other and the fingerprint."""
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[8:16], "little") % self.buckets
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (mark * 0x5BD1E995 - bucket) % self.buckets

    def find(self, digest: bytes) -> int:
        """Slot of a live digest, or -1: fingerprints first, then the stored digest."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.digests[slot] == digest:
                    return slot
        return -1

    def insert(self, digest: bytes, doc_id: int, count: int) -> None:
        slot = self.find(digest)
        if slot >= 0:
            self.ids[slot] = max(self.ids[slot], doc_id)
            self.counts[slot] += count
            return
        left = self._place((digest, doc_id, count))
        if left is not None:
            self._grow(left)

    def _place(self, entry):
        """Puts an entry, moving others to their second bucket; the entry left without a slot is returned."""
        digest, doc_id, count = entry
        mark, one, two = self._places(digest)
        for candidate in (one, two):
            for slot in range(candidate * SLOTS, candidate * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self._set(slot, mark, digest, doc_id, count)
                    return None
        bucket = one
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            out = (self.prints[slot], self.digests[slot], self.ids[slot], self.counts[slot])
            self._set(slot, mark, digest, doc_id, count)
            mark, digest, doc_id, count = out
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self._set(slot, mark, digest, doc_id, count)
                    return None
        return digest, doc_id, count

    def _set(self, slot, mark, digest, doc_id, count) -> None:
        self.prints[slot], self.digests[slot], self.ids[slot], self.counts[slot] = mark, digest, doc_id, count

    def _grow(self, left) -> None:
        """Twice the buckets, filled again from the stored digests."""
        entries = [*self.live(), left]
        size = self.buckets
        while True:
            size *= 2
            self.clear(size)
            if all(self._place(e) is None for e in entries):
                return

    def live(self):
        return [(d, i, c) for d, i, c in zip(self.digests, self.ids, self.counts) if d is not None]

    def delete(self, digest: bytes, count: int) -> bool:
        """Takes ``count`` rows of a digest away; with its last row the digest leaves the filter."""
        slot = self.find(digest)
        if slot < 0:
            return False
        self.counts[slot] -= count
        if self.counts[slot] <= 0:
            self._set(slot, 0, None, NO_ID, 0)
        return True


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (32 bytes), salt and a number of its own for every row; store it before use."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text_bytes(text_col), 256)).alias("digest"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int").alias("salt"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """Rows of a digest summed per salt, in the map tasks first: largest id, the first row that has it, and the count."""
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
    groups = rows.groupBy("digest", "salt").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    return groups.select("digest", "salt", F.coalesce("best.doc_id", F.lit(NO_ID)).alias("doc_id"), (-F.col("best.row")).alias("first_row"), "n")


def _sharded(reps: DataFrame, shards: int) -> DataFrame:
    return reps.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def _entries(frame: pd.DataFrame):
    return zip(map(bytes, frame["digest"]), frame["doc_id"].tolist(), frame["n"].tolist())


def shard_count(rows: DataFrame) -> int:
    return max(LEAST_SHARDS, -(-rows.count() // SHARD_ROWS))


def build_index(reps: DataFrame, shards: int) -> DataFrame:
    """A new index over (digest, doc_id, n) rows."""

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        shard = CuckooShard()
        for digest, doc_id, n in _entries(frame):
            shard.insert(digest, doc_id, n)
        return pd.DataFrame([shard.dump(int(key[0]))])

    return _sharded(reps, shards).select("shard", "digest", "doc_id", "n").groupBy("shard").applyInPandas(build, STATE)


def _with_index(index: DataFrame, reps: DataFrame, shards: int, fn, schema: str) -> DataFrame:
    left = _sharded(reps, shards).groupBy("shard")
    return left.cogroup(index.groupBy("shard")).applyInPandas(fn, schema)


def update_index(index: DataFrame, reps: DataFrame, shards: int, delete: bool = False) -> DataFrame:
    """The index after inserting, or deleting, (digest, doc_id, n) rows; unknown digests to delete are passed over.

    Deleting rows leaves the largest id of the others unknown to a summary, so
    a digest keeps its id until its last row goes.
    """

    def update(key, frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        shard = CuckooShard.load(state.iloc[0]) if len(state) else CuckooShard()
        for digest, doc_id, n in _entries(frame):
            if delete:
                shard.delete(digest, n)
            else:
                shard.insert(digest, doc_id, n)
        return pd.DataFrame([shard.dump(int(key[0]))])

    return _with_index(index, reps.select("digest", "doc_id", "n"), shards, update, STATE)


def probe_index(index: DataFrame, reps: DataFrame, shards: int) -> DataFrame:
    """digest, salt, first_row, keep_id and group_size of every (digest, salt) whose digest is live."""

    def probe(_, frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(state) and len(frame):
            shard = CuckooShard.load(state.iloc[0])
            for digest, salt, row in zip(map(bytes, frame["digest"]), frame["salt"].tolist(), frame["first_row"].tolist()):
                if (slot := shard.find(digest)) >= 0:
                    out.append((digest, salt, row, shard.ids[slot], shard.counts[slot]))
        return pd.DataFrame(out, columns=["digest", "salt", "first_row", "keep_id", "group_size"])

    schema = "digest binary, salt int, first_row bigint, keep_id bigint, group_size bigint"
    found = _with_index(index, reps.select("digest", "salt", "first_row"), shards, probe, schema)
    return found.withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: of equal texts the largest id stays."""
    rows = stored(digest_rows(docs, id_col, text_col), "digests")
    reps = stored(representatives(rows), "digest-groups")
    shards = shard_count(rows)
    index = stored(build_index(reps, shards), "cuckoo")
    found = probe_index(index, reps, shards)
    joined = rows.join(found, ["digest", "salt"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("first_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
