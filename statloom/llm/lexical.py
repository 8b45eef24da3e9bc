"""Ranked lexical search: summed accumulators of short lists beside document-at-a-time skipping over long lists.

Documents are inverted where they are read: every task turns the texts of its
split into segments of at most ``SEGMENT_DOCS`` documents, one stored row each,
with the postings of the query terms.  Texts are never shuffled, and a term that
a third of all documents hold is cut at the segment.  Collection counts (N, L,
document frequencies) are sums over segments.

In a segment the postings of an item's short lists are summed into accumulators
first, term at a time.  The summed accumulators are then one more iterator with a
bound, beside the long lists: documents are visited in blocks, in order; a block
whose summed bounds cannot reach the item's k-th score is skipped, only iterators
that could lift a document that far propose candidates, and the other lists are
probed by binary search while a candidate's bound still reaches.  Nothing that
could enter the result is left out: pruning is on bounds strictly below the k-th
score, so ties are always weighed.  A task keeps k rows an item; k rows an item
and task meet in the last window.

Queries are taken in blocks of at most ``BLOCK_BYTES`` of terms (and one item
more), which is what a task holds of them; every block reads the documents once.

Nulls and edge cases: a null or empty text has no terms, such a document is in no
result and such an item has none; rows repeating an item id are one item with the
terms of all of them; rows repeating a document id are documents of their own; a
null document id comes after all others of its score; an empty table gives no
rows; only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import in_range_order, stored, text_bytes, text_or_empty

SEGMENT_DOCS = 16_384
SEGMENT_POSTINGS = 8_000_000
BLOCK_BYTES = 32 << 20
#: A list of at most one document in this many is short.
SHORT_SHARE = 32
#: Documents weighed at once.
BLOCK_DOCS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes.maketrans(UPPER.encode() + bytes(_SEPARATORS), LOWER.encode() + b" " * len(_SEPARATORS))
_NO_ID = np.iinfo(np.int64).max
SEGMENT = pa.schema(
    [
        ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("docs", pa.binary()),
        ("tfs", pa.binary()), ("ids", pa.binary()), ("no_ids", pa.binary()), ("lengths", pa.binary()),
    ]
)
SEGMENT_DDL = "n_docs bigint, n_terms bigint, codes array<int>, counts array<int>, docs binary, tfs binary, ids binary, no_ids binary, lengths binary"
FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def item_terms(text: str) -> Column:
    """Distinct terms of a text column."""
    folded = F.translate(text_or_empty(text), UPPER, LOWER)
    return F.filter(F.array_distinct(F.split(folded, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), lambda t: t != "")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class SegmentWriter:
    """Postings of query terms for documents as they come, cut into segments."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = text.translate(_FOLD).split()
        find = self.vocabulary.get
        codes = [c for c in map(find, words) if c is not None]
        if codes:
            distinct, tf = np.unique(np.array(codes, np.int64), return_counts=True)
            self.keys.append((distinct << 32) | len(self.ids))
            self.tfs.append(tf)
            self.postings += len(distinct)
        self.ids.append(doc_id)
        self.lengths.append(len(words))

    @property
    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def segment(self) -> pa.RecordBatch:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        tfs = np.concatenate(self.tfs) if self.tfs else np.zeros(0, np.int64)
        order = np.argsort(keys)
        codes, counts = np.unique(keys >> 32, return_counts=True)
        lengths = np.array(self.lengths, np.int64)
        row = {
            "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "codes": codes, "counts": counts,
            "docs": (keys[order] & 0xFFFFFFFF).astype("<i4").tobytes(), "tfs": tfs[order].astype("<i8").tobytes(),
            "ids": np.array([_NO_ID if i is None else i for i in self.ids], "<i8").tobytes(), "no_ids": np.array([i is None for i in self.ids], bool).tobytes(),
            "lengths": lengths.astype("<i8").tobytes(),
        }
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in SEGMENT], schema=SEGMENT)


def inverted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored segments: one row for at most ``SEGMENT_DOCS`` documents with their postings of ``vocabulary``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = SegmentWriter(vocabulary)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, text.as_py())
                if writer.full:
                    yield writer.segment()
        if writer.ids:
            yield writer.segment()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return stored(rows.mapInArrow(build, SEGMENT_DDL), "segments")


class Segment:
    """One stored segment with the impact of every posting under the collection's counts."""

    def __init__(self, row: dict, documents: int, terms: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.no_ids = np.frombuffer(row["no_ids"], bool)
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.docs = np.frombuffer(row["docs"], "<i4").astype(np.int64)
        tf = np.frombuffer(row["tfs"], "<i8")
        m = 100 - 50 + (50 * lengths * documents) // max(terms, 1)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs])
        starts = np.concatenate(([0], np.cumsum(row["counts"]))).astype(np.int64)
        self.spans = {int(c): (int(a), int(b)) for c, a, b in zip(row["codes"], starts, starts[1:])}
        self.size = len(self.ids)
        self.edges = np.arange(0, self.size + BLOCK_DOCS, BLOCK_DOCS)
        self.sums = np.zeros(self.size, np.int64)
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def blocks(self, docs: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where every block of documents begins in a list, and the list's largest impact in it."""
        cuts = np.searchsorted(docs, self.edges)
        most = np.zeros(len(self.edges) - 1, np.int64)
        held = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(held):
            most[held] = np.maximum.reduceat(impact, cuts[held])
        return cuts, most

    def long_blocks(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        if code not in self.long:
            a, b = self.spans[code]
            self.long[code] = self.blocks(self.docs[a:b], self.impact[a:b])
        return self.long[code]


class Best:
    """The k best rows of an item so far; ties by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.ids = np.zeros(0, np.int64)
        self.no_ids = np.zeros(0, bool)
        self.least = 1  # the smallest score that can still enter

    def offer(self, score: np.ndarray, ids: np.ndarray, no_ids: np.ndarray) -> None:
        score, ids, no_ids = np.concatenate((self.score, score)), np.concatenate((self.ids, ids)), np.concatenate((self.no_ids, no_ids))
        keep = np.lexsort((ids, no_ids, -score))[: self.k]
        self.score, self.ids, self.no_ids = score[keep], ids[keep], no_ids[keep]
        if len(keep) == self.k:
            self.least = max(1, int(self.score[-1]))


def search_segment(segment: Segment, codes: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Offers to ``best`` every document of the segment that could be among its k for the given terms."""
    short, long_ = [], []
    for code, weight in zip(codes.tolist(), weights.tolist()):
        if weight > 0 and code in segment.spans:
            a, b = segment.spans[code]
            (short if (b - a) * SHORT_SHARE <= segment.size else long_).append((code, weight, a, b))
    sums = segment.sums
    for _, weight, a, b in short:
        sums[segment.docs[a:b]] += weight * segment.impact[a:b]
    touched = np.flatnonzero(sums) if short else np.zeros(0, np.int64)
    # (docs, scores, block cuts, block bounds, list bound); the accumulators are one of them
    cuts, most = segment.blocks(touched, sums[touched])
    lists = [(touched, None, cuts, most, 1)] if len(touched) else []
    for code, weight, a, b in long_:
        cuts, most = segment.long_blocks(code)
        lists.append((segment.docs[a:b], segment.impact[a:b], cuts, most * weight, weight))
    if lists:
        bounds = np.array([most for _, _, _, most, _ in lists])
        whole = bounds.sum(axis=0)
        for block in np.flatnonzero(whole >= best.least).tolist():
            if whole[block] >= best.least:
                _search_block(segment, lists, bounds[:, block], block, best)
    sums[touched] = 0


def _search_block(segment: Segment, lists: list, bound: np.ndarray, block: int, best: Best) -> None:
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))  # the summed bounds from each list on
    essential = order[rest[:-1] >= best.least]
    docs = np.unique(np.concatenate([lists[j][0][lists[j][2][block] : lists[j][2][block + 1]] for j in essential]))
    score = np.zeros(len(docs), np.int64)
    for j, left in zip(order.tolist(), rest.tolist()):
        reach = score + left >= best.least
        docs, score = docs[reach], score[reach]
        if not len(docs):
            return
        own, impact, cuts, _, weight = lists[j]
        a, b = cuts[block], cuts[block + 1]
        if a == b:
            continue
        if impact is None:
            score = score + segment.sums[docs]
            continue
        at = np.minimum(np.searchsorted(own[a:b], docs), b - a - 1)
        score = score + np.where(own[a:b][at] == docs, weight * impact[a:b][at], 0)
    enters = score >= best.least
    if enters.any():
        docs = docs[enters]
        best.offer(score[enters], segment.ids[docs], segment.no_ids[docs])


def _blocks_of_items(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (item_id, terms, block): items in order of their ids, cut where the terms of a block reach ``BLOCK_BYTES``."""
    terms = queries.select(F.col(f"`{id_col}`").cast("bigint").alias("item_id"), F.explode(item_terms(text_col)).alias("term")).distinct()
    items = terms.groupBy("item_id").agg(F.collect_set("term").alias("terms"), F.sum(F.octet_length("term") + 1).alias("bytes"))
    placed = in_range_order(items, [F.col("item_id").asc_nulls_first()], "items")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.sum("bytes").alias("b")).select("part", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("start"))
    before = F.col("start") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    return stored(placed.join(starts, "part").select("item_id", "terms", F.floor(before / BLOCK_BYTES).alias("block")), "item-blocks")


def ranked(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    spark = docs.sparkSession
    items = _blocks_of_items(queries, item_col, query_col)
    found = [spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")]
    for block in sorted(r["block"] for r in items.select("block").distinct().collect()):
        rows = items.where(F.col("block") == block).collect()  # at most BLOCK_BYTES and one item
        vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        segments = inverted(docs, vocabulary, id_col, text_col)
        documents, terms = (x or 0 for x in segments.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        pairs = segments.select(F.explode(F.arrays_zip("codes", "counts")).alias("p")).groupBy("p.codes").agg(F.sum("p.counts").alias("df"))
        holding = {r["codes"]: r["df"] for r in pairs.collect()}  # at most one row for each term of the block
        weights = {c: term_weight(documents, n) for c, n in holding.items()}
        asked = []
        for r in rows:
            codes = [c for c in (vocabulary[t.encode()] for t in sorted(r["terms"])) if c in weights]
            asked.append((r["item_id"], np.array(codes, np.int64), np.array([weights[c] for c in codes], np.int64)))
        found.append(_searched(segments, asked, documents, terms, k))
    every = reduce(DataFrame.union, found)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(segments: DataFrame, asked: list[tuple[int | None, np.ndarray, np.ndarray]], documents: int, terms: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}, documents, terms)
                for (_, codes, weights), own in zip(asked, best):
                    search_segment(segment, codes, weights, own)
        for (item, _, _), own in zip(asked, best):
            if len(own.score):
                ids = pa.array(own.ids, pa.int64(), mask=own.no_ids)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), ids, pa.array(own.score, pa.int64())], schema=FOUND)

    return segments.mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")
