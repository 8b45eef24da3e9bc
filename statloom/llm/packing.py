"""Packing documents into fixed-length sequences in the order of a space-filling curve.

Each document's token ids are counted into a signed hashed vector, projected to
three dimensions and numbered along a Hilbert curve.  Documents are range-sorted
by that number, their tokens are laid end to end in this order and cut every
``length`` tokens, so a sequence holds neighbours and only the last one is padded.
The order is cut by (curve number, row), so a third of all documents at one point
of the curve still spreads over many tasks; only one token total for each range
partition passes through a window.

Distinct words between white space are found in Arrow, tokenized once per worker and
remembered (up to ``REMEMBERED_WORDS``); white space never joins two tokens here, so the ids are
those of the whole text.

Nulls and edge cases: a null or empty text is its end token alone; repeated rows
and ids are packed as often as they occur; a document longer than a sequence is
cut; an empty table gives no pieces; only the id and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import in_range_order, stored, text_bytes
from statloom.llm.hilbert import hilbert_index

HASHED_DIMS = 256
CURVE_DIMS = 3
CURVE_BITS = 10
REMEMBERED_WORDS = 600_000
#: Texts coded at once, and their bytes (one text may have more).
CODED_TEXTS, CODED_BYTES = 10_000, 16 << 20
STOPS = ".,;:!?*#$%&|()-"
#: Letters up to Latin Extended-B whose lower case is one letter.
LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
PIECES = "doc_id bigint, no_id boolean, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, curve bigint, ids binary"


class WordTokenizer:
    """Token ids of texts, word by word; for tokenizers that drop white space and never join across it.

    Texts are split and their distinct words found in Arrow, a batch at a time.  A
    word of letters up to Latin Extended-B, perhaps followed by stops, is its
    lower-cased letters and its stops one after the other: such tokenizers split
    there.  Many words at once are coded in one call and told apart by the tokens
    that end a word.  Words that a batch holds more than once are remembered, in two
    halves: once the younger is full it becomes the older one, which gives its words
    back as they come again.
    """

    _loaded: dict[str, "WordTokenizer"] = {}

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        """One per worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = "<u2" if self.size <= 1 << 16 else "<u4"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.fresh: dict[bytes, bytes] = {}

    def flat(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with ``end_id`` behind it, and where each begins (with the end behind)."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))  # A-Z only, which the tokenizer lower-cases too
        coded = split.flatten().dictionary_encode()
        words = _bytes(coded.dictionary)
        if 2 * len(self.known) > REMEMBERED_WORDS:
            self.known, self.older = {b"": b""}, self.known
        if new := self._unknown(set(words)):
            self._learn(list(new))
        fresh, known = self.fresh, self.known
        values = [fresh[w] if w in new else known[w] for w in words]
        values.append(np.array([end_id], self.type).tobytes())
        ids = np.frombuffer(b"".join(values), self.type)
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // ids.itemsize
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        places = coded.indices.to_numpy()
        if new:  # a word that the batch holds once is seldom worth remembering
            often = np.flatnonzero(np.bincount(places, minlength=len(words)) > 1).tolist()
            known.update([(w, fresh[w]) for w in map(words.__getitem__, often) if w in new])
            self.fresh = {}
        behind = np.diff(split.offsets.to_numpy()).cumsum()
        which = np.insert(places, behind, len(words))
        lengths = sizes[which]
        ends = np.cumsum(lengths, dtype=np.int64)
        edges = np.concatenate(([0], ends[behind + np.arange(len(behind))]))
        shift = (begins[which] - (ends - lengths)).astype(np.int32)
        return ids[np.repeat(shift, lengths) + np.arange(int(edges[-1]), dtype=np.int32)], edges

    def ids(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        ids, edges = self.flat(pa.array(texts, pa.binary()), end_id)
        return np.split(ids, edges[1:-1])

    def _unknown(self, words: set[bytes]) -> set[bytes]:
        """Words neither remembered nor learned in this batch; those of the older half move to the younger."""
        new = words.difference(self.known, self.fresh)
        if kept := new.intersection(self.older):
            self.known.update(zip(kept, map(self.older.__getitem__, kept)))
            new -= kept
        return new

    def _learn(self, words: list[bytes]) -> None:
        cores = pc.ascii_rtrim(pa.array(words, pa.binary()).view(pa.string()), characters=STOPS)
        plain = pc.match_substring_regex(cores, LETTERS)
        chosen = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        cores = cores.filter(plain)
        keys, lengths = _bytes(pc.utf8_lower(cores)), pc.binary_length(cores).to_numpy().tolist()
        self._learn_letters(self._unknown(set(keys)))
        known, fresh, plain_words = self.known, self.fresh, [words[at] for at in chosen.tolist()]
        stops = [word[size:] for word, size in zip(plain_words, lengths)]
        rest = self._unknown(set(stops))
        if len(plain_words) < len(words):
            rest.update(set(words).difference(plain_words))
        rest.update([word for word, key in zip(plain_words, keys) if key not in fresh and key not in known])  # letters that were split after all
        self._learn_whole(list(rest))
        marks = {stop: fresh[stop] if stop in fresh else known[stop] for stop in set(stops)}
        fresh.update([(word, (fresh[key] if key in fresh else known[key]) + marks[stop]) for word, key, stop in zip(plain_words, keys, stops) if word not in rest])

    def _learn_letters(self, cores: set[bytes]) -> None:
        if not cores or not self.ends.any():
            return
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(cores).decode()], add_special_tokens=False)[0].ids)
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) == len(cores):  # else a core was split after all, and all go the long way
            flat, width = ids.astype(self.type).tobytes(), int(self.type[-1])
            cuts = [c * width for c in cuts]
            self.fresh.update(zip(cores, [flat[a:b] for a, b in zip([0, *cuts], cuts)]))

    def _learn_whole(self, words: list[bytes]) -> None:
        if not words:
            return
        coded = self.tokenizer.encode([w.decode("utf-8", "replace") for w in words], is_pretokenized=True, add_special_tokens=False)
        got: dict[int, list[int]] = {}
        for word, token in zip(coded.word_ids, coded.ids):
            got.setdefault(word, []).append(token)
        self.fresh.update((w, np.array(got.get(i, ()), self.type).tobytes()) for i, w in enumerate(words))


def _bytes(strings: pa.Array) -> list[bytes]:
    return strings.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _hash_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of every token id, by a multiplicative hash."""
    mixed = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % HASHED_DIMS).astype(np.int64), 1.0 - 2.0 * ((mixed >> np.uint64(33)) & np.uint64(1)).astype(float)


def _projection() -> np.ndarray:
    """Orthonormal directions, the same in every process."""
    return np.linalg.qr(np.random.default_rng(7).normal(size=(HASHED_DIMS, CURVE_DIMS)))[0].T


def curve_cells(ids: np.ndarray, edges: np.ndarray, dims: np.ndarray, signs: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Cells (document, direction) of documents end to end: signed hashed counts, their roots, projected and quantised."""
    document = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * HASHED_DIMS
    vectors = np.bincount(document + dims[ids], weights=signs[ids], minlength=(len(edges) - 1) * HASHED_DIMS).reshape(-1, HASHED_DIMS)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    places = vectors @ directions.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    return np.clip(((places + 1) / 2 * (1 << CURVE_BITS)).astype(np.int32), 0, (1 << CURVE_BITS) - 1)


def _slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most CODED_TEXTS texts and, but for one text, CODED_BYTES."""
    sizes = np.cumsum(pc.binary_length(batch.column(texts)).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = min(begin + CODED_TEXTS, max(begin + 1, int(np.searchsorted(sizes, before + CODED_BYTES, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, ids (little-endian), doc_tokens and curve of every row; ids are kept in two bytes where the vocabulary allows it."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(tokenizer_path)
        dims, signs = _hash_table(max(words.size, end_id + 1))
        directions = _projection()
        for whole in batches:
            for batch in _slices(whole, 2):
                ids, edges = words.flat(batch.column(2), end_id)
                cells = curve_cells(ids, edges, dims, signs, directions)
                buffers = [None, pa.py_buffer((edges * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers), pa.array(np.diff(edges)), *[pa.array(c) for c in np.ascontiguousarray(cells.T)]],
                    names=["row", "doc_id", "ids", "doc_tokens", "c0", "c1", "c2"],
                )
            pa.default_memory_pool().release_unused()  # the worker lives on beside the next stages

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = rows.mapInArrow(code, f"row bigint, doc_id {kind}, ids binary, doc_tokens bigint, c0 int, c1 int, c2 int")
    return stored(coded.withColumn("curve", hilbert_index(["c0", "c1", "c2"], CURVE_BITS)).drop("c0", "c1", "c2"), "tokens")


def stream_starts(tokens: DataFrame) -> DataFrame:
    """row and the place of its first token when all documents are laid end to end along the curve."""
    placed = in_range_order(tokens.select("row", "doc_tokens", "curve"), ["curve", "row"], "curve-order")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = placed.select("row", "part", F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0)).alias("local"))
    return local.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("local")).alias("at"))  # one row a range partition


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences: where each piece starts in its document and in its sequence, and its ids."""
    tokens = tokenized(docs, tokenizer_path, end_id, id_col, text_col)
    joined = tokens.join(stream_starts(tokens), "row")
    joined = joined.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "ids", "doc_tokens", "curve", "at")

    def cut(frames):
        for frame in frames:
            rows = []
            for doc_id, no_id, raw, n, curve, at in frame.itertuples(index=False):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    size = min(length - offset, n - done)
                    piece = ids[done : done + size].astype("<u4").tobytes()
                    rows.append((doc_id, no_id, done, size, zlib.crc32(piece), n, sequence, offset, curve, piece if with_ids else None))
                    done += size
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    pieces = joined.mapInPandas(cut, PIECES)
    return pieces.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (padded to ``length`` unless their number is a power of two) and the number of real tokens."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("tokens"))
    body = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    missing = F.when(F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0, 0).otherwise(length - F.col("tokens"))
    padding = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), missing.cast("int"))
    return rows.select("sequence_id", F.unhex(F.concat(body, padding)).alias("ids"), "tokens")
