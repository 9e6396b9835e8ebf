"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

Every source wants its share of the budget by weight; a source may be repeated ``max_epochs`` times at most, and what is above that is
shared again by weight among the others until none is above.  Sorted by cap over weight the capped sources come first, so the fixed
point is found from running sums over one row per source.  A source's target is then met by taking every document the whole number of
times that fits and, for the rest, documents in a seeded order until the words are reached; the document at the border gives its first
words only, so that the words taken equal the rounded target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources without words and a budget of 0 get
target 0; ties in the seeded order fall to doc_id; repeated rows share one place in the order, by row number; an empty table gives an
empty table; extra columns stay untouched where documents are returned (n_chars follows a text that is cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.joins import is_small
from pairloom.llm.common import checkpointed, table

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17
WORD = r"[^\x20\x09-\x0D]+"
#: A word with what stands before it.
PIECE = r"[\x20\x09-\x0D]*" + WORD
#: The seeded order; rows that are equal in all of these repeat each other.
KEY = ("draw", "doc_id", "size", "copy")
#: Hex digits of the seeded order that name a slice: a source is dealt over 16 ** SLICE_DIGITS tasks at most.
SLICE_DIGITS = 3


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def seeded_draw(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, draw, copy): words of the whole text, the document's place in the seeded order, and a hash of its text."""
    return docs.select("doc_id", "source", word_count().alias("size"), seeded_draw(seed).alias("draw"), F.xxhash64("text").alias("copy"))


def cycled_weight(place: Column, weights: tuple = WEIGHTS) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))


def water_filled(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size, weight); the budget is a multiple of all sizes."""
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rows = sources.select(
        "source", "source_size", "weight", (F.col("source_size") * F.lit(max_epochs)).alias("cap"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("filled"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
        F.sum("source_size").over(all_).alias("total"), F.sum("weight").over(all_).alias("weights"))
    # The level at which this source and all after it would stand if those before it are full.
    level = (F.col("total") * F.lit(budget) - F.col("filled") * F.lit(max_epochs)) / (F.col("weights") - F.col("gone"))
    marked = rows.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    known = marked.withColumn("free_level", F.when(F.col("free"), F.struct("gone", "level"))).withColumn(
        "water", F.min("free_level").over(all_)["level"])
    return known.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * F.col("water"))).cast("double").alias("target"))


def _of_source(rows: DataFrame, sources: DataFrame, also: tuple = (), how: str = "inner") -> DataFrame:
    """rows with the columns of their source (and of the other columns in also); null is a source."""
    other = sources.select(*[F.col(c).alias(f"_of_{c}" if c in ("source", *also) else c) for c in sources.columns])
    on = F.col("source").eqNullSafe(F.col("_of_source"))
    for c in also:
        on &= F.col(c) == F.col(f"_of_{c}")
    return rows.join(other, on, how).drop(*[f"_of_{c}" for c in ("source", *also)])


def planned(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
            seed: int = SEED) -> DataFrame:
    """(source, source_size, target, whole, border, left, tied), one row per source, from sizes alone.

    Every document is taken ``whole`` times; those before the border in the seeded order once more, those at the border ``left`` words in
    all, and ``tied`` rows stand at the border (several only if they repeat each other).  A source without words has no border.  The
    running sum has two levels (slices of a source, then the documents of the slice in which the border lies).
    """
    rows = checkpointed(sized(docs, seed)).withColumn("slice", F.substring("draw", 1, SLICE_DIGITS))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = sources.withColumn("weight", cycled_weight(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, weights))
    targets = water_filled(placed, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = checkpointed(targets.withColumn("whole", whole).withColumn(
        "rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))

    def holding(sums: DataFrame, words: Column, window) -> DataFrame:
        """The row in which the running sum passes the rest; rest becomes what is left for it."""
        before = sums.withColumn("before", F.coalesce(F.sum(words).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        return before.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + words)).withColumn(
            "rest", F.col("rest") - F.col("before")).drop("before")

    of_source = W.partitionBy("source")
    slices = _of_source(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), targets.select("source", "rest"))
    at = holding(slices, F.col("words"), of_source.orderBy("slice")).select("source", "slice", "rest")
    groups = _of_source(rows, at, ("slice",)).groupBy("source", "rest", *KEY).agg(F.count("*").alias("tied"))
    border = holding(groups, F.col("size") * F.col("tied"), of_source.orderBy(*KEY)).select(
        "source", F.struct(*KEY).alias("border"), F.col("rest").alias("left"), "tied")
    return _of_source(targets.drop("rest"), border, how="left")


def portions(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
             seed: int = SEED) -> DataFrame:
    """Every row of docs, with all its columns and _mix (size, source_size, target, whole, part): it is taken ``whole`` times and then its
    first ``part`` words.  Texts aren't shuffled while the sources can be broadcast."""
    plan = checkpointed(planned(docs, weights, budget, max_epochs, seed)).select("source", F.struct("*").alias("_plan"))
    keyed = docs.withColumn("_key", F.struct(seeded_draw(seed).alias("draw"), "doc_id", word_count().alias("size"), F.xxhash64("text").alias("copy")))
    rows = _of_source(keyed, F.broadcast(plan) if is_small(plan) else plan)
    size, border, left = F.col("_key.size"), F.col("_plan.border"), F.col("_plan.left")
    here = F.coalesce(F.col("_key") == border, F.lit(False))
    repeated = here & (F.col("_plan.tied") > 1)
    once = rows.where(~repeated).withColumn("_part", F.when(here, left).when(F.col("_key") < border, size).otherwise(F.lit(0)))
    place = F.row_number().over(W.partitionBy("_plan.source").orderBy("_key")) - 1
    ties = rows.where(repeated).withColumn("_place", place).withColumn(
        "_part", F.least(F.greatest(left - F.col("_place") * size, F.lit(0)), size)).drop("_place")
    return once.unionByName(ties).withColumn("_mix", F.struct(
        size.alias("size"), F.col("_plan.source_size"), F.col("_plan.target"), F.col("_plan.whole"), F.col("_part").cast("long").alias("part"))).select(
        *docs.columns, "_mix")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
          seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words of each document the mix takes, repeats counted."""
    m = lambda name: F.col(f"_mix.{name}")
    return portions(docs, weights, budget, max_epochs, seed).select(
        "doc_id", m("size"), m("source_size"), m("target"), (m("whole") * m("size") + m("part")).alias("taken"))


def _copies(rows: DataFrame, none: bool = False) -> DataFrame:
    """The rows of portions once for each repetition, as in mixed_documents; none: rows that aren't taken stay, without repetition and text."""
    size, whole, part = (F.col(f"_mix.{c}") for c in ("size", "whole", "part"))
    n = F.when(size > 0, whole + F.when(part > 0, 1).otherwise(0)).otherwise(F.lit(0))
    each = (F.explode_outer if none else F.explode)(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))
    spread = rows.withColumn("repetition", each).withColumn(
        "taken", F.when(F.col("repetition").isNull(), F.lit(0)).when(F.col("repetition") <= whole, size).otherwise(part).cast("long"))
    cut = F.col("taken") < size
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), F.lit(1), F.col("taken").cast("int")), "")
    out = spread.withColumn("text", F.when(F.col("repetition").isNull(), F.lit(None)).when(cut, first).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(rows.schema["n_chars"].dataType)) \
        if "n_chars" in rows.columns else out


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
                    seed: int = SEED) -> DataFrame:
    """The mix itself: the documents with all their columns, once for each repetition (1, 2, ...), and the words taken.

    The last repetition of a border document holds its first words, up to the end of the last; n_chars follows the text.  Documents of
    which no words are taken are left out; columns of docs named repetition or taken are replaced.
    """
    return _copies(portions(docs, weights, budget, max_epochs, seed)).drop("_mix")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all texts that the mix holds of each document, counted in these texts."""
    copies = _copies(portions(table(spark, folder, "documents")).withColumn("_row", F.monotonically_increasing_id()), none=True)
    return copies.groupBy("_row", "doc_id", *[F.col(f"_mix.{c}").alias(c) for c in ("size", "source_size", "target")]).agg(
        F.sum(word_count()).alias("taken")).drop("_row")


def mix_sql(documents: str = "documents") -> str:
    return rf"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5('{SEED}:' || coalesce(doc_id::varchar, '')) as draw from {documents}),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
    select *, [5, 2, 1][(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as weight from sources),
running as (
    select *, 2 * source_size as cap,
           coalesce(sum(source_size) over (order by source_size / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
           coalesce(sum(weight) over (order by source_size / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as gone,
           sum(source_size) over () as total, sum(weight) over () as weights from weighted),
levels as (select *, (total * 1.5::double - filled * 2) / (weights - gone)::double as level from running),
water as (select min_by(level, gone) as water from levels where level * weight <= cap),
targets as (
    select source, source_size, case when water is null then cap else least(cap, weight * water) end::double as target
    from levels cross join water),
amounts as (
    select *, case when source_size > 0 then floor(round(target) / source_size) else 0 end::bigint as whole from targets),
placed as (
    select *, coalesce(sum(size) over (partition by source order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
    from sized)
select doc_id, size, source_size, target,
       (whole * size + least(greatest(round(target)::bigint - whole * source_size - ahead, 0), size))::bigint as taken
from placed join amounts on placed.source is not distinct from amounts.source"""


OP6_SQL = mix_sql()
