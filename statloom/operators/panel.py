"""Item x month panels: pivoting, calendar changes, vintage weights, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, ordinal_month, ordinal_year, pct_change
from statloom.operators.ordered import with_group_totals, with_one_row, written


def item_month_panel(obs: DataFrame, weights: DataFrame) -> DataFrame:
    """obs(item, m, seasonal 'S'/'U', idx) and weights(item, weight_year, w) to one row per (item, m).

    mom and ann3m use the adjusted index, yoy the unadjusted one; a weight dated
    December of year y applies to the months of y + 1.
    """
    wide = obs.groupBy("item", "m").agg(
        F.max(F.when(F.col("seasonal") == "U", F.col("idx"))).alias("idx_nsa"),
        F.max(F.when(F.col("seasonal") == "S", F.col("idx"))).alias("idx_sa"),
    )
    lagged = wide.select(
        "*",
        calendar_lag("idx_sa", "item", "m", 1).alias("_sa1"),
        calendar_lag("idx_sa", "item", "m", 3).alias("_sa3"),
        calendar_lag("idx_nsa", "item", "m", 1).alias("_nsa1"),
        calendar_lag("idx_nsa", "item", "m", 12).alias("_nsa12"),
    )
    changes = lagged.select(
        "item",
        "m",
        "idx_nsa",
        "idx_sa",
        pct_change("idx_sa", "_sa1").alias("mom_sa"),
        pct_change("idx_nsa", "_nsa1").alias("mom_nsa"),
        pct_change("idx_nsa", "_nsa12").alias("yoy"),
        F.when(F.col("_sa3") > 0, (F.pow(F.col("idx_sa") / F.col("_sa3"), 4) - 1) * 100).alias("ann3m"),
        (ordinal_year("m") - 1).alias("weight_year"),
    )
    joined = changes.join(weights.select("item", "weight_year", F.col("w").alias("weight")), ["item", "weight_year"], "left")
    return joined.withColumn("contrib_yoy", F.col("weight") * F.col("yoy") / 100)


def december_weights(cells: DataFrame) -> DataFrame:
    """Spend shares (percent) of each December: item, weight_year, w."""
    december = cells.filter(ordinal_month("m") == 12).select("item", ordinal_year("m").alias("weight_year"), "spend")
    return with_group_totals(december, "weight_year", _total=F.sum("spend")).select(
        "item", "weight_year", (F.col("spend") / F.col("_total") * 100).alias("w")
    )


def latest_weights(cells: DataFrame) -> DataFrame:
    """item, w of the latest December there is."""
    weights = december_weights(cells)
    return with_one_row(weights, weights.agg(F.max("weight_year").alias("_last"))).filter("weight_year = _last").select("item", "w")


def clamped_vintage(df: DataFrame, weights: DataFrame, year: str, key: str) -> DataFrame:
    """Inner join on the previous year's weights, clamped to the years that exist, with an exactness flag."""
    span = weights.agg(F.min("weight_year").alias("_lo"), F.max("weight_year").alias("_hi"))
    wanted = F.col(year) - 1
    keyed = (
        with_one_row(df, span)
        .withColumn("weight_year", F.greatest(F.least(wanted, "_hi"), "_lo"))
        .withColumn("weight_exact", wanted.between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
    return keyed.join(weights, [key, "weight_year"])


def complete_calendar(df: DataFrame, by: str, ordinal: str, value: str) -> DataFrame:
    """Last value per (series, month) laid on every month between the series' ends."""
    last = df.groupBy(by, ordinal).agg(F.max_by(value, "seq").alias(value))
    grid = (
        last.groupBy(by)
        .agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
        .select(by, F.explode(F.sequence("lo", "hi")).alias(ordinal))
    )
    return grid.join(last, [by, ordinal], "left")


def positive_change(df: DataFrame, by: str, ordinal: str, value: str, k: int, name: str) -> DataFrame:
    """k-month percent change, only where the earlier level is positive."""
    return df.withColumn(name, pct_change(value, calendar_lag(value, by, ordinal, k)))


def parents_from_levels(tree: DataFrame, scope: str, item: str, order: str, level: str, max_level: int | None = None) -> DataFrame:
    """Parent of a row = nearest earlier shallower row, if it is exactly one level up.

    Works per ``scope`` (one published table) in sort order; one running value
    per level in use, no row lists.  The deepest level is read from the data
    unless it is given.
    """
    if max_level is None:
        max_level = tree.agg(F.max(level)).first()[0] or 0
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = None
    for depth in range(1, max_level + 1):
        nearest = F.last(F.when(F.col(level) < depth, F.struct(F.col(level).alias("l"), F.col(item).alias("i"))), ignorenulls=True).over(w)
        hit = F.col(level) == depth
        above = F.when(hit, nearest) if above is None else above.when(hit, nearest)
    above = F.lit(None).cast("struct<l:int,i:string>") if above is None else above
    return tree.withColumn("_above", above).withColumn("parent", F.when(F.col("_above.l") == F.col(level) - 1, F.col("_above.i"))).drop("_above")


def ancestors(tree: DataFrame, item: str = "item", parent: str = "parent") -> DataFrame:
    """Every (item, ancestor, depth) of a parent table; depth 1 is the parent.

    One join per level of the tree, each level written before the next one; a
    chain longer than the table is a cycle and an error.
    """
    edges = written(tree.filter(F.col(parent).isNotNull()).select(F.col(item).alias("item"), F.col(parent).alias("ancestor")).distinct())
    up = edges.select(F.col("item").alias("ancestor"), F.col("ancestor").alias("_next"))
    n = edges.count()
    step = edges.withColumn("depth", F.lit(1))
    out, depth = step, 1
    while not step.isEmpty():
        if depth > n:
            raise ValueError("the parent table has a cycle")
        depth += 1
        step = written(step.join(up, "ancestor").select("item", F.col("_next").alias("ancestor"), F.lit(depth).alias("depth")))
        out = out.unionByName(step)
    return out


def complete_partition(tree: DataFrame, weights: DataFrame, min_share: float = 0.99) -> DataFrame:
    """Finest set of nodes that still tiles the whole.

    A node opens when its children carry at least ``min_share`` of its weight; a
    node belongs to the partition when it stays closed and all its ancestors are open.
    """
    weighted = tree.join(weights, "item", "left")
    child = weighted.groupBy(F.col("parent").alias("item")).agg(F.sum("w").alias("_cw"), F.count(F.lit(1)).alias("_n"))
    state = weighted.join(child, "item", "left").withColumn("open", F.coalesce((F.col("w") > 0) & (F.col("_cw") >= F.col("w") * min_share), F.lit(False)))
    closed_above = (
        ancestors(tree)
        .join(state.select(F.col("item").alias("ancestor"), "open"), "ancestor")
        .filter(~F.col("open"))
        .select("item")
        .distinct()
    )
    return state.filter(~F.col("open")).join(closed_above, "item", "left_anti").select("item", "parent", "w")


def side_by_side(frames: dict[str, DataFrame], by: str = "m", value: str = "value") -> DataFrame:
    """Separate series as columns of one table, a row for every month that any of them has; the others are NULL there.

    The series meet in one grouping of their union, however many there are.
    """
    union = None
    for name, frame in frames.items():
        rows = frame.select(by, F.col(value).cast("double").alias("_v"), F.lit(name).alias("_series"))
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy(by).agg(*[F.max(F.when(F.col("_series") == name, F.col("_v"))).alias(name) for name in frames])


def node_universes(tree: DataFrame, nodes: DataFrame, min_share: float = 0.90) -> DataFrame:
    """coarse, fine and hybrid choice of usable nodes of a tree of any depth.

    tree(item, parent); nodes(item, usable, w).  Coarse takes the topmost usable
    node of every path, fine the usable nodes with none below them.  Hybrid opens a
    coarse node, and on downwards, where its usable children carry at least
    ``min_share`` of its weight.  What each node needs to know of those above and
    below it are sums over one closure of the tree.
    """
    state = tree.join(nodes, "item", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
    carried = state.filter("usable").groupBy(F.col("parent").alias("item")).agg(F.sum("w").alias("_cw"))
    opens = F.col("usable") & F.coalesce((F.col("w") > 0) & (F.col("_cw") >= F.col("w") * min_share), F.lit(False))
    state = written(state.join(carried, "item", "left").withColumn("open", opens).select("item", "parent", "w", "usable", "open"))
    ends = state.select(F.col("item").alias("ancestor"), F.col("usable").alias("_au"), F.col("open").alias("_ao"))
    pairs = ancestors(tree).join(ends, "ancestor").join(state.select("item", "usable"), "item")
    both = F.array(
        F.struct(F.col("item").alias("node"), F.when(F.col("_au"), F.col("depth")).alias("top"), F.when(F.col("_ao"), 1).alias("opened"), F.lit(None).cast("int").alias("below")),
        F.struct(F.col("ancestor").alias("node"), F.lit(None).cast("int").alias("top"), F.lit(None).cast("int").alias("opened"), F.when(F.col("usable"), 1).alias("below")),
    )
    known = pairs.select(F.inline(both)).groupBy(F.col("node").alias("item")).agg(F.max("top").alias("top"), F.count("opened").alias("opened"), F.count("below").alias("below"))
    rows = state.filter("usable").join(known, "item", "left")
    # all nodes from the topmost usable one down to the parent must be open
    reached = F.col("top").isNull() | (F.col("opened") == F.col("top"))
    return rows.select("item", "parent", "w", F.col("top").isNull().alias("coarse"), (F.coalesce("below", F.lit(0)) == 0).alias("fine"), (~F.col("open") & reached).alias("hybrid"))


def nearest_ancestor(tree: DataFrame, targets: DataFrame, name: str = "grp") -> DataFrame:
    """Closest listed ancestor (or the item itself) of every item: targets(item)."""
    selves = tree.select("item", F.col("item").alias("ancestor"), F.lit(0).alias("depth"))
    chain = ancestors(tree).unionByName(selves).join(targets.select(F.col("item").alias("ancestor")), "ancestor", "left_semi")
    nearest = chain.groupBy("item").agg(F.min_by("ancestor", "depth").alias(name))
    return tree.join(nearest, "item", "left")


def leaves(tree: DataFrame, item: str = "item", parent: str = "parent") -> DataFrame:
    """Rows that are nobody's parent."""
    parents = tree.filter(F.col(parent).isNotNull()).select(F.col(parent).alias(item)).distinct()
    return tree.join(parents, item, "left_anti")
