"""Sharding along a Hilbert curve over several metadata dimensions, with built-in functions only.

Every dimension is quantised to ``bits`` bits, the cells are numbered along a
Hilbert curve, rows are sorted by that number and the order is cut into runs.
A run then covers a compact box of all dimensions at once, so that the minimum
and maximum a file keeps of each of them prune it for filters on any of them.

Nulls and edge cases: a null text has size 16 and the checksum of no bytes, a
null category or id falls into the first cell of its dimension, repeated rows
are all kept and get slots of their own, an empty table gives an empty result,
and only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import stored, text_bytes, with_global_rank

ROW_OVERHEAD = 16


def _let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates ``value`` once for ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hilbert_index(cells: list[str], bits: int) -> Column:
    """Place on the curve of integer cell columns, each within ``bits`` bits (Skilling's transform)."""
    n = len(cells)
    axes = "array(" + ", ".join(f"cast(`{c}` AS bigint)" for c in cells) + ")"
    steps = f"flatten(transform(sequence({bits - 1}, 1, -1), q -> transform(sequence(0, {n - 1}), i -> struct(q, i))))"
    low = "(shiftleft(1L, s.q) - 1L)"
    swap = f"((x[0] ^ x[s.i]) & {low})"
    hit = "((x[s.i] & shiftleft(1L, s.q)) <> 0L)"
    undone = (
        f"aggregate({steps}, {axes}, (x, s) -> transform(x, (v, k) -> CASE WHEN k = 0 THEN v ^ if({hit}, {low}, {swap}) "
        f"WHEN k = s.i AND NOT {hit} THEN v ^ {swap} ELSE v END))"
    )
    if bits == 1:
        undone = axes
    gray = f"transform(sequence(0, {n - 1}), i -> aggregate(slice(u, 1, i + 1), 0L, (a, v) -> a ^ v))"
    turn = (
        f"aggregate(sequence({bits - 1}, 1, -1), 0L, (t, q) -> if((g[{n - 1}] & shiftleft(1L, q)) <> 0L, t ^ (shiftleft(1L, q) - 1L), t))"
        if bits > 1
        else "0L"
    )
    woven = f"aggregate(sequence({bits - 1}, 0, -1), 0L, (h, b) -> aggregate(z, h, (w, v) -> w * 2L + (shiftright(v, b) & 1L)))"
    return F.expr(_let(undone, "u", _let(gray, "g", _let(_let(turn, "t", "transform(g, v -> v ^ t)"), "z", woven))))


def category_cuts(df: DataFrame, column: str, bits: int) -> list[tuple[int, object]]:
    """First value of each cell when the distinct values are dealt evenly over 2^bits cells in their order.

    At most 2^bits rows come to the driver, whatever the number of values.
    """
    values = df.select(F.col(f"`{column}`").alias("v")).where(F.col("v").isNotNull()).distinct()
    ranked, n = with_global_rank(values, ["v"], "category")
    if n == 0:
        return []
    cell = F.floor(F.col("rank") * (1 << bits) / F.lit(n)) if n > (1 << bits) else F.col("rank") * ((1 << bits) // n)
    cuts = ranked.select(cell.cast("int").alias("cell"), "v").groupBy("cell").agg(F.min("v").alias("v"))
    return sorted((r["cell"], r["v"]) for r in cuts.collect())


def _category_cell(column: str, cuts: list[tuple[int, object]]) -> Column:
    if not cuts:
        return F.lit(0)
    out = F.lit(0)
    for cell, value in cuts:
        out = F.when(F.col(column) >= F.lit(value), F.lit(cell)).otherwise(out)
    return out


def _size_cell(size: Column, bits: int) -> Column:
    """Four cells for each doubling of the size, up to the last cell."""
    length = F.length(F.bin(size))
    step = (length - 1) * 4 + F.expr(f"shiftright(size, greatest(length(bin(size)) - 3, 0)) & 3")
    return F.least(F.greatest(step - 16, F.lit(0)), F.lit((1 << bits) - 1))


def _id_cell(column: str, low, high, bits: int) -> Column:
    """Equal slices of the range of ids."""
    if low is None:
        return F.lit(0)
    width = (int(high) - int(low)) // (1 << bits) + 1
    offset = F.col(column).cast("decimal(38,0)") - F.lit(str(int(low))).cast("decimal(38,0)")
    return F.coalesce(F.floor(offset / F.lit(str(width)).cast("decimal(38,0)")).cast("int"), F.lit(0))


def hilbert_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), bits: int = 6) -> DataFrame:
    """One narrow row per document: id, size, text_crc32, the categories, its cells and ``hilbert``."""
    if (len(categories) + 2) * bits > 62:
        raise ValueError("the curve index must fit in 62 bits")
    body = text_bytes(text_col)
    narrow = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(body) + ROW_OVERHEAD).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            *[F.col(f"`{c}`").alias(f"dim_{i}") for i, c in enumerate(categories)],
        ),
        "shard-keys",
    )
    low, high = narrow.agg(F.min("doc_id"), F.max("doc_id")).first()
    cells = {f"cell_{i}": _category_cell(f"dim_{i}", category_cuts(narrow, f"dim_{i}", bits)) for i in range(len(categories))}
    cells = {k: F.coalesce(v, F.lit(0)) for k, v in cells.items()}
    cells["cell_size"] = _size_cell(F.col("size"), bits)
    cells["cell_id"] = _id_cell("doc_id", low, high, bits)
    return narrow.withColumns(cells).withColumn("hilbert", hilbert_index(list(cells), bits))


def hilbert_shards(docs: DataFrame, shards: int = 40, **keys) -> DataFrame:
    """Runs of equal row counts (at most one apart) along the curve: shard, slot and the keys of every document."""
    order = ["hilbert", "text_crc32", "size", "doc_id"]
    ranked, n = with_global_rank(hilbert_keys(docs, **keys), order, "shard-order")
    shard = F.expr(f"rank * {shards} DIV {max(n, 1)}")
    first = F.expr(f"(shard * {max(n, 1)} + {shards - 1}) DIV {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first).drop("rank")


def shard_manifest(layout: DataFrame) -> DataFrame:
    """Rows, bytes and the smallest and largest value of every dimension, per shard: what a reader prunes by."""
    dims = [c for c in layout.columns if c.startswith("dim_")] + ["size", "doc_id"]
    bounds = [f(c).alias(f"{name}_{c}") for c in dims for name, f in (("min", F.min), ("max", F.max))]
    return layout.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *bounds)


def write_shards(docs: DataFrame, layout: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Whole documents into one folder per shard, in curve order; ids must be unique here."""
    placed = docs.join(layout.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), F.col(f"`{id_col}`") == F.col("_id"))
    ranged = placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    ranged.drop("_id", "_slot").write.partitionBy("_shard").parquet(path)


def contract_rows(layout: DataFrame) -> DataFrame:
    return layout.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
