"""Chained price indexes under many weight schemes, survey weights, import content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.calendar import calendar_lag, ordinal_month, ordinal_year, pct_change
from statloom.operators.ordered import with_group_totals, with_one_row, with_ranks, written

# Smallest covered weight of a month, weeks per month, replicate count.
MIN_COVERAGE = 0.90
WEEKS_PER_MONTH = 4.345
REPLICATES = 44


def december_relatives(cells: DataFrame, schemes: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """rel(scheme, m) = sum w P_m / P_Dec over items with both, kept when they carry enough of the weight.

    cells(item, m, idx); schemes(scheme, weight_year, item, w).  The items' own
    December price is attached once per (item, year), so every scheme is priced
    in a single aggregation keyed by (scheme, month).
    """
    december = cells.filter(ordinal_month("m") == 12).select("item", ordinal_year("m").alias("weight_year"), F.col("idx").alias("_base"))
    priced = cells.withColumn("weight_year", ordinal_year("m") - 1).join(december, ["item", "weight_year"]).filter(F.col("idx").isNotNull() & F.col("_base").isNotNull())
    total = schemes.groupBy("scheme", "weight_year").agg(F.sum("w").alias("_total")).filter("_total > 0")
    ratio = F.col("idx") / F.col("_base")
    return (
        priced.join(schemes, ["item", "weight_year"])
        .groupBy("scheme", "weight_year", "m")
        .agg(F.sum(F.col("w") * ratio).alias("_num"), F.sum("w").alias("covered"))
        .join(total, ["scheme", "weight_year"])
        .filter(F.col("covered") >= F.col("_total") * min_coverage)
        .select("scheme", "weight_year", "m", (F.col("_num") / F.col("covered")).alias("rel"), (F.col("covered") / F.col("_total")).alias("coverage"))
    )


def chain(cells: DataFrame, schemes: DataFrame, published: DataFrame, anchored: bool = False, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """December-chained level and yoy per scheme: published(m, level) supplies the start.

    The year's base is the scheme's own December level, or the published one
    where there is none (always the published one when ``anchored``).  Only the
    yearly links are sequential: a window over years multiplies them.
    """
    rel = written(december_relatives(cells, schemes, min_coverage))
    pub = published.filter(ordinal_month("m") == 12).select(ordinal_year("m").alias("weight_year"), F.col("level").alias("_pub"))
    years = rel.select("scheme", "weight_year").distinct().join(pub, "weight_year", "left")
    if anchored:
        base = years.withColumn("base", F.col("_pub"))
    else:
        link = rel.filter(ordinal_month("m") == 12).select("scheme", (F.col("weight_year") + 1).alias("weight_year"), F.col("rel").alias("_link"))
        by_year = Window.partitionBy("scheme").orderBy("weight_year")
        run = by_year.rowsBetween(Window.unboundedPreceding, 0)
        linked = years.join(link, ["scheme", "weight_year"], "left").withColumn("_run", F.sum(F.when(F.col("_link").isNull(), 1).otherwise(0)).over(run))
        inside = Window.partitionBy("scheme", "_run").orderBy("weight_year").rowsBetween(Window.unboundedPreceding, 0)
        base = linked.withColumn("base", F.first("_pub").over(inside) * F.exp(F.sum(F.coalesce(F.log("_link"), F.lit(0.0))).over(inside)))
    out = rel.join(base.select("scheme", "weight_year", "base"), ["scheme", "weight_year"]).withColumn("level", F.col("base") * F.col("rel"))
    return out.withColumn("yoy", pct_change("level", calendar_lag("level", "scheme", "m", 12))).select("scheme", "m", "coverage", "rel", "level", "yoy")


def survey_frequencies(lines: DataFrame, weights: DataFrame, weight_columns: list[str], measures=("freq", "spend", "share")) -> DataFrame:
    """Purchase frequency, spend and buying share per code, for every weight column at once.

    lines(unit, code, cost); weights(unit, <weight columns>).  Lines are first
    reduced to one row per (unit, code); replicates stay columns of one
    aggregation, so 45 weights cost one pass and no row is multiplied.  Returns
    (code, weight, <measures>).
    """
    per_row = {"freq": "coalesce({c}, 0D) * n", "spend": "coalesce({c}, 0D) * cost", "share": "coalesce({c}, 0D)"}
    per_unit = lines.groupBy("unit", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    sums = [F.expr(f"sum({per_row[m].format(c=c)}) AS {c}_{m}") for c in weight_columns for m in measures]
    by_code = per_unit.join(weights, "unit").groupBy("code").agg(*sums)
    cells = ", ".join("named_struct('weight', '{0}', {1})".format(c, ", ".join(f"'{m}', {c}_{m}" for m in measures)) for c in weight_columns)
    long = by_code.select("code", F.expr(f"inline(array({cells}))"))
    totals = weights.agg(*[F.expr(f"sum(coalesce({c}, 0D)) AS {c}") for c in weight_columns])
    totals = totals.unpivot([], weight_columns, "weight", "_all")
    return long.join(totals, "weight").select("code", "weight", *[(F.col(m) / F.col("_all")).alias(m) for m in measures])


def map_codes(concordance: DataFrame, leaf: DataFrame, split: str = "exp") -> DataFrame:
    """Share of each code assigned to leaf items: concordance(code, target), leaf(item, w).

    A target walks up to its 4, 3 or 2 character class until a published leaf is
    found; a code with several targets is split by expenditure weight (or
    equally), equally also where the weights are all zero.
    """
    walked = concordance.select("code", "target")
    for k in (4, 3, 2):
        known = leaf.select(F.col("item").alias(f"_i{k}"), F.col("w").alias(f"_w{k}"))
        walked = walked.withColumn(f"_i{k}", F.concat(F.lit("SE"), F.substring("target", 1, k))).join(known, f"_i{k}", "left")
    item = F.coalesce(*[F.when(F.col(f"_w{k}").isNotNull(), F.col(f"_i{k}")) for k in (4, 3, 2)])
    weight = F.coalesce(*[F.col(f"_w{k}") for k in (4, 3, 2)])
    rows = walked.withColumn("item", item).withColumn("_w", F.coalesce(weight, F.lit(0.0)) if split == "exp" else F.col("item").isNotNull().cast("double"))
    rows = with_group_totals(rows, "code", _sum=F.sum("_w"), _n=F.count(F.lit(1)))
    share = F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(F.lit(1.0) / F.col("_n"))
    return rows.withColumn("share", share).filter(F.col("item").isNotNull()).groupBy("code", "item").agg(F.sum("share").alias("share"))


def spread_in_class(df: DataFrame, leaf: DataFrame, value: str, keys=(), prefix: int = 4) -> DataFrame:
    """Sum values to the class (code prefix) and hand them back in proportion to leaf weight, equally if the class weighs nothing."""
    keys = list(keys)
    cls = F.substring("item", 1, prefix)
    shares = with_group_totals(leaf.withColumn("_cls", cls), "_cls", _cw=F.sum("w"), _cn=F.count(F.lit(1)))
    shares = shares.select("item", "_cls", F.when(F.col("_cw") > 0, F.col("w") / F.col("_cw")).otherwise(F.lit(1.0) / F.col("_cn")).alias("_s"))
    sums = df.groupBy(*keys, cls.alias("_cls")).agg(F.sum(value).alias("_v"))
    return sums.join(shares, "_cls").select(*keys, "item", (F.col("_v") * F.col("_s")).alias(value))


def scheme_table(weights: DataFrame, frequencies: DataFrame) -> DataFrame:
    """official, frequency, blend and billfloor schemes, each normalised to 100 per year.

    weights(weight_year, item, w); frequencies(weight_year, item, freq).
    """
    both = weights.join(frequencies, ["weight_year", "item"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))
    floored = F.greatest(F.col("freq"), F.lit(1 / WEEKS_PER_MONTH))
    both = both.withColumn("_floor", floored)
    both = with_group_totals(both, "weight_year", _tw=F.sum("w"), _tf=F.sum("freq"), _tb=F.sum("_floor"))
    official, frequency, bill = (F.col(v) / F.col(t) * 100 for v, t in (("w", "_tw"), ("freq", "_tf"), ("_floor", "_tb")))
    packed = F.array(
        F.struct(F.lit("official").alias("scheme"), official.alias("w")),
        F.struct(F.lit("frequency").alias("scheme"), frequency.alias("w")),
        F.struct(F.lit("blend").alias("scheme"), ((official + frequency) / 2).alias("w")),
        F.struct(F.lit("billfloor").alias("scheme"), bill.alias("w")),
    )
    return both.select("weight_year", "item", F.inline(packed)).select("scheme", "weight_year", "item", "w")


def frequency_variants(frequencies: DataFrame, concordance: DataFrame, leaf: DataFrame) -> DataFrame:
    """Item schemes from code frequencies under every choice: split by spend or equally, leaf or class level, each year or all years.

    frequencies(weight_year, code, freq); concordance(code, target); leaf(item, w).
    Schemes are named split/level/years and normalised to 100 per year.
    """
    years = frequencies.select("weight_year").distinct()
    n_years = years.agg(F.count(F.lit(1)).alias("_years"))
    out = None
    for split in ("exp", "equal"):
        mapped = frequencies.join(map_codes(concordance, leaf, split), "code")
        items = mapped.groupBy("weight_year", "item").agg(F.sum(F.col("freq") * F.col("share")).alias("f"))
        for level, rows in (("leaf", items), ("class", spread_in_class(items, leaf, "f", ["weight_year"]))):
            pooled = with_one_row(rows.groupBy("item").agg(F.sum("f").alias("_f")), n_years).select("item", (F.col("_f") / F.col("_years")).alias("f"))
            pooled = pooled.withColumn("_all", F.lit(0)).join(years.withColumn("_all", F.lit(0)), "_all").select("weight_year", "item", "f")  # a row a year and item
            for span, freq in (("yearly", rows), ("pooled", pooled)):
                total = with_group_totals(freq, "weight_year", _t=F.sum("f"))
                scheme = total.select(F.lit(f"{split}/{level}/{span}").alias("scheme"), "weight_year", "item", (F.col("f") / F.col("_t") * 100).alias("w"))
                out = scheme if out is None else out.unionByName(scheme)
    return out


def gap_to(chains: DataFrame, reference: str = "official") -> DataFrame:
    """yoy of every scheme minus the reference scheme's, by month."""
    ref = chains.filter(F.col("scheme") == reference).select("m", F.col("yoy").alias("_ref"))
    return chains.filter(F.col("scheme") != reference).join(ref, "m").select("scheme", "m", (F.col("yoy") - F.col("_ref")).alias("gap"))


def gap_range(gaps: DataFrame) -> DataFrame:
    """Smallest and largest gap over the variants of each month."""
    return gaps.filter(F.col("gap").isNotNull()).groupBy("m").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("variants"))


def replicate_error(gaps: DataFrame, full: str, replicates: int = REPLICATES) -> DataFrame:
    """sqrt(sum (gap_r - gap)^2 / replicates) per month, over the replicates that have a value."""
    centre = gaps.filter(F.col("scheme") == full).select("m", F.col("gap").alias("_gap"))
    rep = gaps.filter((F.col("scheme") != full) & F.col("gap").isNotNull()).join(centre.filter(F.col("_gap").isNotNull()), "m")
    return rep.groupBy("m").agg(
        F.max("_gap").alias("gap"), F.sqrt(F.sum(F.pow(F.col("gap") - F.col("_gap"), F.lit(2))) / replicates).alias("se"), F.count(F.lit(1)).alias("n_replicates")
    )


def gap_drivers(schemes: DataFrame, changes: DataFrame, a: str, b: str) -> DataFrame:
    """Contribution of each item under two schemes and the difference: changes(item, m, weight_year, yoy)."""
    wide = schemes.filter(F.col("scheme").isin(a, b)).groupBy("weight_year", "item").agg(
        F.max(F.when(F.col("scheme") == a, F.col("w"))).alias("_a"), F.max(F.when(F.col("scheme") == b, F.col("w"))).alias("_b")
    )
    return changes.join(wide, ["weight_year", "item"]).select(
        "item", "m", (F.col("_a") * F.col("yoy") / 100).alias("contrib_a"), (F.col("_b") * F.col("yoy") / 100).alias("contrib_b"), ((F.col("_a") - F.col("_b")) * F.col("yoy") / 100).alias("diff")
    )


def tier(share) -> Column:
    """high from .25, mid from .10, low below."""
    s = F.col(share) if isinstance(share, str) else share
    return F.when(s >= 0.25, "high").when(s >= 0.10, "mid").otherwise("low")


def formula_gap(a: DataFrame, b: DataFrame, base_m: int) -> DataFrame:
    """yoy(A) - yoy(B), both rebased to a month = 100, and the cumulative gap: a, b(item, m, idx)."""
    both = a.select("item", "m", F.col("idx").alias("a")).join(b.select("item", "m", F.col("idx").alias("b")), ["item", "m"])
    yoys = both.withColumn("yoy_a", pct_change("a", calendar_lag("a", "item", "m", 12))).withColumn("yoy_b", pct_change("b", calendar_lag("b", "item", "m", 12)))
    base = both.filter(F.col("m") == base_m).select("item", F.col("a").alias("_a0"), F.col("b").alias("_b0"))
    rel = yoys.join(base, "item", "left").withColumn("rel_a", F.col("a") / F.col("_a0") * 100).withColumn("rel_b", F.col("b") / F.col("_b0") * 100)
    return rel.select("item", "m", "yoy_a", "yoy_b", (F.col("yoy_a") - F.col("yoy_b")).alias("gap_yoy"), "rel_a", "rel_b", ((F.col("rel_a") / F.col("rel_b") - 1) * 100).alias("gap_cum"))


def gap_decomposition(parts: DataFrame, total: DataFrame) -> DataFrame:
    """Weighted component gap per month against the total's gap: parts(m, w, gap), total(m, gap)."""
    rows = parts.filter(F.col("w").isNotNull() & F.col("gap").isNotNull())
    comp = rows.groupBy("m").agg((F.sum(F.col("w") * F.col("gap")) / F.sum("w")).alias("component_gap"), F.sum("w").alias("weight_covered"))
    return comp.join(total.withColumnRenamed("gap", "total_gap"), "m").withColumn("residual", F.col("total_gap") - F.col("component_gap"))


def gap_heatmap(gaps: DataFrame, months: int = 120) -> DataFrame:
    """Cumulative gap of every item in the last ``months`` months, with the item's place by its latest gap, largest first."""
    last = gaps.agg(F.max("m").alias("_last"))
    recent = with_one_row(gaps.select("item", "m", "gap_cum"), last)
    latest = recent.filter("m = _last AND gap_cum IS NOT NULL").select("item", F.lit(0).alias("_all"), (-F.round("gap_cum", 9)).alias("_key"))
    places = with_ranks(latest, "_all", "_key").select("item", F.col("rank_low").alias("place"))
    return recent.filter(F.col("m") > F.col("_last") - months).join(places, "item").select("item", "m", "gap_cum", "place")


def clip01(c) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def import_content(use: DataFrame, make: DataFrame, imports: DataFrame, requirements: DataFrame, consumer: str) -> DataFrame:
    """Direct and total import content per commodity from coordinate matrices.

    use(commodity, col, value), make(industry, commodity, value),
    imports(commodity, col, value), requirements(row, commodity, value).  Every
    matrix product is a join and a sum.
    """
    is_consumer = F.col("col") == consumer
    u = use.groupBy("commodity").agg(F.sum(F.when(is_consumer, F.col("value")).otherwise(0.0)).alias("up"), F.sum("value").alias("ua"))
    i = imports.groupBy("commodity").agg(F.sum(F.when(is_consumer, F.col("value")).otherwise(0.0)).alias("ip"), F.sum("value").alias("ia"))
    ui = u.join(i, "commodity", "left").fillna(0.0, ["ip", "ia"])
    direct = ui.select("commodity", clip01(F.when(F.col("up") > 1, F.col("ip") / F.col("up")).when(F.col("ua") > 1, F.col("ia") / F.col("ua")).otherwise(0.0)).alias("direct"))
    output = make.groupBy("industry").agg(F.sum("value").alias("_x"))
    bought = imports.filter(~is_consumer).groupBy(F.col("col").alias("industry")).agg(F.sum("value").alias("_imp"))
    intensity = output.join(bought, "industry", "left").select("industry", F.coalesce(F.col("_imp") / F.nullif("_x", F.lit(0.0)), F.lit(0.0)).alias("_mi"))
    produced = make.groupBy("commodity").agg(F.sum("value").alias("output"))
    mix = (
        make.join(intensity, "industry").groupBy("commodity").agg(F.sum(F.col("_mi") * F.col("value")).alias("_s")).join(produced, "commodity")
        .select("commodity", "output", F.coalesce(F.col("_s") / F.nullif("output", F.lit(0.0)), F.lit(0.0)).alias("_mc"))
    )
    embodied = requirements.join(mix.select(F.col("commodity").alias("row"), "_mc"), "row").groupBy("commodity").agg(clip01(F.sum(F.col("_mc") * F.col("value"))).alias("embodied"))
    joined = direct.join(mix.select("commodity", "output"), "commodity").join(embodied, "commodity")
    return joined.select("commodity", "direct", "embodied", clip01(F.col("direct") + (1 - F.col("direct")) * F.col("embodied")).alias("total"), "output")


def margin_rate(content: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Output-weighted embodied rate per name pattern; the plain mean of all where a pattern matches nothing."""
    aggs = []
    for g, pattern in groups.items():
        hit = F.col("commodity").rlike(pattern)
        weighted = F.sum(F.when(hit, F.col("embodied") * F.col("output"))) / F.nullif(F.sum(F.when(hit, F.col("output"))), F.lit(0.0))
        aggs.append(F.struct(F.lit(g).alias("margin"), F.coalesce(weighted, F.avg(F.when(hit, F.col("embodied"))), F.avg("embodied")).alias("rate"), F.count_if(hit).alias("n")))
    return content.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))


def bridge_to_purchasers(bridge: DataFrame, content: DataFrame, margins: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Import content of a purchaser's dollar per category.

    bridge(category, commodity, producers, transport, wholesale, retail, purchasers);
    an override(category, rate) replaces the direct content and floors the total.
    """
    rates = margins.agg(*[F.max(F.when(F.col("margin") == g, F.col("rate"))).alias(f"_{g}") for g in ("transport", "wholesale", "retail")])
    joined = bridge.join(content.select("commodity", "direct", "total"), "commodity", "left").fillna(0.0, ["direct", "total"])
    sums = joined.groupBy("category").agg(
        *[F.sum(c).alias(c) for c in ("producers", "transport", "wholesale", "retail", "purchasers")],
        F.sum(F.col("producers") * F.col("direct")).alias("_d"),
        F.sum(F.col("producers") * F.col("total")).alias("_t"),
    ).filter(F.abs("purchasers") > 1e-9)
    if overrides is not None:
        sums = sums.join(overrides, "category", "left")
        forced = F.col("producers") * F.col("rate")
        sums = sums.withColumn("_d", F.coalesce(forced, "_d")).withColumn("_t", F.greatest("_t", forced))
    embodied = F.col("wholesale") * F.col("_wholesale") + F.col("retail") * F.col("_retail") + F.col("transport") * F.col("_transport")
    out = sums.join(F.broadcast(rates.limit(1)), F.lit(True))
    return out.select(
        "category",
        "purchasers",
        (F.col("producers") / F.col("purchasers")).alias("producer_share"),
        clip01(F.col("_d") / F.col("purchasers")).alias("share_direct"),
        clip01((F.col("_t") + embodied) / F.col("purchasers")).alias("share_total"),
    )


def concordance_mean(mapping: DataFrame, shares: DataFrame, compared: int = 28) -> tuple[DataFrame, DataFrame]:
    """Item shares through a multi-target map, and the rows left out.

    mapping(item, category, description, share); shares(category, description, share_total).
    A target is left out when its category is missing or its description drifted
    in the first ``compared`` characters: map files cut descriptions there.
    """
    tidy = lambda c: F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r"\s+", " ")), 1, compared)
    joined = mapping.withColumnRenamed("description", "expected").join(shares, "category", "left")
    problem = F.when(F.col("share_total").isNull(), "missing").when(tidy(F.col("description")) != tidy(F.col("expected")), "drift")
    tagged = joined.withColumn("problem", problem)
    good = tagged.filter(F.col("problem").isNull()).groupBy("item").agg((F.sum(F.col("share") * F.col("share_total")) / F.sum("share")).alias("share_total"))
    return good, tagged.filter(F.col("problem").isNotNull()).select("item", "category", "problem")


def haircut_shares(items: DataFrame, content: DataFrame, haircuts: list[tuple[str, float]], goods: list[str], default: float) -> DataFrame:
    """Fallback item shares: economy mean of positive content for goods prefixes, cut by the prefix's margin haircut."""
    mean = content.filter("total > 0").agg(F.coalesce(F.avg("total"), F.lit(0.0)).alias("_avg"))
    p = F.substring("item", 1, 3)
    cut = F.coalesce(*[F.when(p == k, F.lit(v)) for k, v in haircuts], F.lit(default))
    base = F.when(p.isin(*goods), F.col("_avg")).otherwise(0.0)
    out = items.join(F.broadcast(mean.limit(1)), F.lit(True))
    return out.select("item", (base * cut * 0.7).alias("share_direct"), (base * cut).alias("share_total"))


def import_share_checks(basket: DataFrame, purchased: DataFrame, low: float, high: float, goods_below: float = 0.98) -> DataFrame:
    """Weighted means of import shares held against what they should be: check, ours, expected_low, expected_high, ok.

    basket(item, w), purchased(item, purchasers, producer_share, share_total).  A good
    is an item whose producers' part of the purchase price is below ``goods_below``:
    it is carried and sold with margins.  By purchase value the mean must lie between
    the two bounds; goods must carry more than the basket as a whole.  An item without
    a share counts as nothing in the whole basket and is no good.
    """
    joined = basket.join(purchased, "item", "full_outer")
    good = F.coalesce(F.col("producer_share") < goods_below, F.lit(False))

    def mean(weight: Column, share: Column) -> Column:
        return F.sum(weight * share) / F.nullif(F.sum(weight), F.lit(0.0))

    share, w = F.coalesce("share_total", F.lit(0.0)), F.coalesce(F.col("w"), F.lit(0.0)).cast("double")
    bought = F.when(F.col("purchasers") > 0, F.col("purchasers").cast("double"))
    found = joined.agg(mean(bought, F.col("share_total")).alias("p"), mean(w, share).alias("b"), mean(F.when(good, w), share).alias("g"))
    rows = F.array(
        F.struct(F.lit("by purchase value").alias("check"), F.col("p").alias("ours"), F.lit(low).alias("expected_low"), F.lit(high).alias("expected_high")),
        F.struct(F.lit("goods of the basket").alias("check"), F.col("g").alias("ours"), F.col("b").alias("expected_low"), F.lit(1.0).alias("expected_high")),
        F.struct(F.lit("whole basket").alias("check"), F.col("b").alias("ours"), F.lit(0.0).alias("expected_low"), F.lit(1.0).alias("expected_high")),
    )
    out = found.select(F.inline(rows))
    return out.withColumn("ok", F.coalesce(F.col("ours").between(F.col("expected_low"), F.col("expected_high")), F.lit(False)))
