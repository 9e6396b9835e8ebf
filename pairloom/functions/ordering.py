"""Exact ranks, running sums and quantiles inside groups of any size.

A window over one group is one task.  Where the largest group, counted first, is small that is the best plan, so it is used; where a
group is large (one posting holding a third of all rows), the rows are range-partitioned on (group, order) instead, so
that the group spreads over many tasks, and ranks are put together from the position inside each slice and the sizes
of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.joins import join_small
from pairloom.session import cut_lineage

HOT_ROWS_CONF = "pairloom.hotGroupRows"
HOT_ROWS = 1_000_000


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, counted on the rows themselves: a partial count, one number to the driver."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, Column] | None = None,
                  rank: str = "rank", at_most: int | None = None) -> DataFrame:
    """Add the 1-based position of every row in its group, and inclusive running sums.

    The order must be total inside a group, or equal rows get their ranks in no particular order.  at_most is a bound on a group's rows that
    the caller knows already; without one the groups are counted, which computes df once more.
    """
    totals = totals or {}
    for name, value in totals.items():
        df = df.withColumn(name, value)
    if (largest_group(df, keys) if at_most is None else at_most) <= hot_rows(df):
        window = Window.partitionBy(*keys).orderBy(*order)
        running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({rank: F.row_number().over(window).cast("long")} | {t: F.sum(t).over(running) for t in totals})
    return _rank_over_slices(df, list(keys), list(order), list(totals), rank)


def _rank_over_slices(df: DataFrame, keys: list[str], order: list[Column], totals: list[str], rank: str) -> DataFrame:
    by_key = [F.col(k) for k in keys]
    sliced = df.repartitionByRange(*by_key, *order).sortWithinPartitions(*by_key, *order)
    # The slice of a row must not change between the two uses below, so it is written down first.
    sliced = cut_lineage(sliced.withColumn("_at", F.monotonically_increasing_id()))
    sliced = sliced.withColumn("_slice", F.shiftright("_at", 33))

    inside = Window.partitionBy("_slice", *keys).orderBy("_at")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumns({rank: F.row_number().over(inside).cast("long")} | {t: F.sum(t).over(running) for t in totals})

    sizes = sliced.groupBy("_slice", *keys).agg(F.count("*").alias("_n"), *[F.sum(t).alias(f"_n_{t}") for t in totals])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_slice").alias("_o_slice"), *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_n_{t}").over(before), F.lit(0)).alias(f"_before_{t}") for t in totals])
    on = F.col("_slice") == F.col("_o_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = local.join(offsets, on)
    out = joined.withColumns({rank: (F.col(rank) + F.col("_before"))}
                             | {t: F.col(t) + F.col(f"_before_{t}") for t in totals})
    return out.select(*df.columns, rank)


def group_counts(df: DataFrame, keys: Sequence[str], name: str = "group_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles per group: (keys, q_index from 1, quantile).  NULLs are skipped.

    Small groups are ranked by a window.  Where a group is large no row moves: approximate quantiles bound each wanted position from both
    sides, and only the values between the bounds are counted by value, the rest by cell.  df is read two or three times.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, value)
    named = list(keys)
    if not keys:
        keys = ["_all"]
        present = present.withColumn("_all", F.lit(1))
    counts = group_counts(present, keys, "_n")
    at_most = largest_group(present, keys)
    if at_most > hot_rows(present):
        found = _values_between_bounds(present, keys, value, fractions)
        if found is not None:
            return _interpolated(found, keys, value, named)
    ranked = rank_in_group(present, keys, [F.col(value).asc()], rank="_rank", at_most=at_most)
    spots = _spots(counts, keys, fractions)
    # A row can serve several fractions; the few spots per group are the small side of the join.
    return _interpolated(join_small(ranked, spots, [*keys, "_rank"]), keys, value, named)


def _spots(counts: DataFrame, keys: list[str], fractions: Sequence[float]) -> DataFrame:
    """(keys, q_index, _spot, _rank): the one or two positions each quantile of each group (keys, _n) is read from."""
    wanted = F.array(*[F.struct(F.lit(i + 1).alias("q_index"), F.lit(float(q)).alias("fraction"))
                       for i, q in enumerate(fractions)])
    spots = counts.select(*keys, "_n", F.explode(wanted).alias("w")).select(
        *keys, "w.q_index", ((F.col("_n") - 1) * F.col("w.fraction")).alias("_spot"), "_n")
    spots = spots.withColumn("_low", F.floor("_spot").cast("long") + 1)
    spots = spots.withColumn("_high", F.least(F.col("_low") + 1, F.col("_n"))).drop("_n")
    return spots.withColumn("_rank", F.explode(F.array_distinct(F.array("_low", "_high"))))


def _interpolated(hits: DataFrame, keys: list[str], value: str, named: list[str]) -> DataFrame:
    edge = hits.groupBy(*keys, "q_index").agg(
        F.min(value).alias("_a"), F.max(value).alias("_b"), F.first(F.col("_spot") - F.floor("_spot")).alias("_t"))
    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    out = F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)
    return edge.select(*named, "q_index", out.alias("quantile"))


def count_at_most(df: DataFrame, points: str, value: str, name: str, n: int) -> DataFrame:
    """Add how many of the row's sorted points (at most n) are <= value, by halving; 0 where the value is NULL."""
    df = df.withColumn(name, F.lit(0))
    for step in [1 << k for k in reversed(range(n.bit_length()))]:
        reached = F.get(F.col(points), F.col(name) + (step - 1)) <= F.col(value)
        df = df.withColumn(name, F.when(reached, F.col(name) + step).otherwise(F.col(name)))
    return df


#: Approximate quantiles are off by at most 1 / ACCURACY of a group; the bounds lie twice as far out.
ACCURACY = 20_000
#: Groups of no more rows are counted by value as a whole: the bounds would lie too close.
FEW_ROWS = 50_000


def _values_between_bounds(present: DataFrame, keys: list[str], value: str, fractions: Sequence[float]) -> DataFrame | None:
    """(keys, q_index, _spot, _rank, value) at the wanted positions, or None if a position lies outside its bounds or a group key is NULL."""
    gap = 2 / ACCURACY
    shares = [min(max(q + d, 0.0), 1.0) for q in fractions for d in (-gap, gap)]
    near = present.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, shares, ACCURACY).alias("_p"))
    bounds = cut_lineage(near.withColumn("_points", F.array_sort(F.array_distinct("_p"))))
    # Cell 2j is the j-th point itself, 2j + 1 lies between it and the next; the cells of a quantile run from its lower to its upper point.
    place = lambda i: 2 * F.array_position("_points", F.get("_p", F.lit(i)))
    between = F.array_distinct(F.flatten(F.array(*[F.sequence(place(2 * i), place(2 * i + 1)) for i in range(len(fractions))])))
    every = F.sequence(F.lit(1).cast("long"), 2 * F.size("_points").cast("long") + 1)
    needed = F.when(F.col("_n") <= FEW_ROWS, every).otherwise(between)
    cells = bounds.select(*keys, "_points", F.map_from_arrays(needed, F.transform(needed, lambda c: F.lit(True))).alias("_needed"))
    placed = count_at_most(join_small(present, cells, keys), "_points", value, "_at", len(shares))
    cell = (2 * F.col("_at") + (F.coalesce(F.get("_points", F.col("_at") - 1) != F.col(value), F.lit(True))).cast("int")).cast("long")
    placed = placed.withColumn("_cell", F.when(F.col("_at") == 0, F.lit(1).cast("long")).otherwise(cell))
    kept = F.when(F.try_element_at("_needed", F.col("_cell")), F.col(value))
    counted = placed.select(*keys, "_cell", kept.alias(value)).groupBy(*keys, "_cell", value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_cell", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumn("_upto", F.sum("_c").over(upto))
    spots = cut_lineage(_spots(bounds.select(*keys, "_n"), keys, fractions))
    ranks = spots.groupBy(*keys).agg(F.collect_set("_rank").alias("_ranks"))
    here = F.filter("_ranks", lambda r: (r > F.col("_upto") - F.col("_c")) & (r <= F.col("_upto")))
    read = join_small(running, ranks, keys).select(*keys, value, F.explode(here).alias("_rank"))
    hits = cut_lineage(spots.join(read, [*keys, "_rank"]))
    missed = hits.agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missed")).first()
    return hits if missed["missed"] == 0 and missed["n"] == spots.count() else None
