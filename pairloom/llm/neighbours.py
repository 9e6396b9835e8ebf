"""Nearest vectors by collision counting over single projections.

Every vector is made a point at one distance from the origin by one more coordinate (the largest norm of its shard less its own), so that the
largest inner products are the smallest distances.  A shard of rows is indexed by ``PROJECTIONS`` random directions, the points sorted along
each.  A query widens a window around its own projection in all sorted arrays, radius by radius (virtual rehashing: one index serves every
radius), and counts into how many of its windows each point falls.  Points that collide in at least ``THRESHOLD`` of the arrays are verified by
exact inner products; widening ends when there are enough of them (``LEAST`` times 20 and ``SHARE``
of the shard).  All points that pass are verified.

Shards are bands of norms (a factor of the fourth root of two), dealt by hash into parts of about ``SHARD_ROWS``, so vectors of very
different lengths don't spoil each other's index and a shard's memory is bounded; copies of one vector with other ids spread over all parts.
The work is a grid: blocks of queries, of a size a task can hold, by groups of shards.  A task holds its block, and the rows of its group
stream through shard by shard; it returns the best of its group, and those of all groups are merged.  Only the size of the grid depends on
the number of cores; the shards, and so the results, don't.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another length than a
query's are no candidates of it; equal scores rank by vec_id (null last); rows that repeat a query's id and vector are one query, and all but
one of them are its candidates, as are rows of its id with another vector; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import table

NEAREST = 20
PROJECTIONS, THRESHOLD, LEAST, SHARE = 128, 0.75, 8, 0.1
#: Points and queries lie on the unit sphere.  The first radius, the factor from one to the next, and the window's width in radii.
FIRST, WIDER, WINDOW = 0.8, 1.1, 2.72
#: Rows of a shard, queries that a task holds, queries that are searched at a time.
SHARD_ROWS, HELD_QUERIES, QUERY_ROWS = 1 << 12, 1 << 16, 256
_NO_ID = np.iinfo(np.int64).max


def usable(vector: str = "embedding") -> Column:
    """No component is null, infinite or not a number, and one isn't zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def norm_band(vector: str = "embedding") -> Column:
    """The band of norms; computed from the largest component on, so that no square over- or underflows."""
    v = F.transform(F.col(vector), lambda x: F.abs(x.cast("double")))
    return F.get(F.transform(F.array(F.array_max(v)), lambda top: F.floor(4 * (F.log2(top) + F.log2(F.aggregate(
        v, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))) / 2) + 0.5)), 0).cast("int")


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms, measured in the largest component, so that no square over- or underflows."""
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(np.square(vectors / top[:, None]).sum(axis=1))


class Shard:
    """The sorted arrays of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, times: np.ndarray, seed: int = 7):
        self.ids, self.vectors, self.times = ids, vectors, times
        n, norms = len(ids), lengths(vectors)
        scale = norms.max()
        rest = np.sqrt(np.maximum(1 - np.square(norms / scale), 0))
        directions = np.random.default_rng(seed).standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        self.across = directions[:, :-1]
        values = self.across @ (vectors / scale).T + directions[:, -1:] * rest
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=1)
        # Of every point its place in each sorted array: a window is a range of places, and a short integer tells who is inside.
        self.place = np.empty((PROJECTIONS, n), np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[None, :], axis=1)

    def near(self, queries: np.ndarray, most: int) -> list[np.ndarray]:
        """For each query (a row, any length) the rows that collided often enough."""
        n, needed = len(self.ids), int(np.ceil(THRESHOLD * PROJECTIONS))
        enough = min(n, LEAST * most + int(SHARE * n))
        values = ((queries / lengths(queries)[:, None]) @ self.across.T).T
        out: list = [None] * len(queries)
        radius, open_ = FIRST, np.arange(len(queries))
        offset, inside = np.empty_like(self.place), np.empty(self.place.shape, bool)
        while len(open_):
            half = radius * WINDOW / 2
            first = np.stack([np.searchsorted(s, v - half) for s, v in zip(self.sorted, values[:, open_], strict=True)])
            last = np.stack([np.searchsorted(s, v + half, "right") for s, v in zip(self.sorted, values[:, open_], strict=True)])
            first, wide = first.T.astype(self.place.dtype), (last - first).T.astype(self.place.dtype)
            for query, a, w in zip(open_, first, wide, strict=True):
                np.subtract(self.place, a[:, None], out=offset)  # places before the window wrap around
                np.less(offset, w[:, None], out=inside)
                passed = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= needed)
                if len(passed) >= enough:
                    out[query] = passed
            open_ = np.array([q for q in open_ if out[q] is None], np.int64)
            radius *= WIDER
        return out

    def best(self, query_id: int, query: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the most similar of these rows, without one row that is the query itself."""
        # One sum per row, in the order of the components: equal vectors have equal scores.
        scores = (self.vectors[rows] * query).sum(axis=1)
        order = np.lexsort((self.ids[rows], -scores))[:most + 1]
        rows, scores = rows[order], scores[order]
        times = self.times[rows] - ((self.ids[rows] == query_id) & (self.vectors[rows] == query).all(axis=1))
        copies = np.repeat(np.arange(len(rows)), np.minimum(times, most))[:most]
        return self.ids[rows][copies], scores[copies]


def nearest(vectors: DataFrame, queries: DataFrame, most: int = NEAREST, shard_rows: int = SHARD_ROWS,
            held_queries: int = HELD_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors`` nearest to each row of ``queries``, both (vec_id, embedding).

    One count of rows by band and one of the queries come first; they alone reach the driver.
    """
    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable())

    spark = vectors.sparkSession
    # Rows that repeat an id and its vector are one point with a count.
    points = clean(vectors).groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).withColumn("band", norm_band()).withColumn("size", F.size("embedding"))
    asked = clean(queries).distinct()
    counted, blocks = points.groupBy("size", "band").count().collect(), -(-asked.count() // held_queries)
    if not counted or not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan, shards = [], 0
    for size, band, n in sorted(map(tuple, counted)):
        plan.append((size, band, shards, -(-n // shard_rows)))
        shards += plan[-1][-1]
    groups = min(shards, -(-3 * spark.sparkContext.defaultParallelism // blocks))
    bands = F.broadcast(spark.createDataFrame(plan, "size int, band int, first int, parts int"))
    sizes = F.broadcast(spark.createDataFrame([(size, min(p[2] for p in plan if p[0] == size) * groups // shards, max(
        p[2] + p[3] - 1 for p in plan if p[0] == size) * groups // shards) for size in {p[0] for p in plan}], "size int, low int, high int"))
    hashed = F.xxhash64("vec_id", "embedding")
    shard = (F.col("first") + F.pmod(hashed, F.col("parts"))).cast("int")
    dealt = points.join(bands, ["size", "band"]).select(shard.alias("shard"), "vec_id", "embedding", "times").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.floor(F.col("shard") * groups / shards).cast("int").alias("group"),
        "shard", "vec_id", "embedding", "times")
    spread = asked.withColumn("size", F.size("embedding")).join(sizes, "size").select(
        F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence("low", "high")).alias("group"), F.lit(-1).alias("shard"),
        "vec_id", "embedding", F.lit(1).cast("long").alias("times"))
    cell = (F.col("block") * groups + F.col("group")).cast("int")
    placed = dealt.unionAll(spread).withColumn("cell", cell).repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", "shard")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def answers(ids: np.ndarray, rows: np.ndarray, times: np.ndarray, block: dict) -> Iterator:
            """What one shard gives to the block's queries of its length."""
            parts = block.get(rows.shape[1])
            if not parts:
                return
            index, asked_ids = Shard(ids, rows, times), np.concatenate([p[0] for p in parts])
            asked_rows = np.concatenate([p[1] for p in parts])
            for at in range(0, len(asked_ids), QUERY_ROWS):
                some, spots = asked_rows[at:at + QUERY_ROWS], asked_ids[at:at + QUERY_ROWS]
                for i, q, near in zip(spots, some, index.near(some, most + 1), strict=True):
                    yield i, q, index.best(i, q, near, most)

        def merged(block: dict, best: dict) -> Iterator:
            found = list(best.items())
            for at in range(0, len(found), 1024):
                some = found[at:at + 1024]
                n = [len(v[0]) for _, v in some]
                ids, scores = (np.concatenate([v[k] for _, v in some]) for k in (0, 1))
                keys = [k for (k, _), times in zip(some, n, strict=True) for _ in range(times)]
                asked_id = np.array([k[0] for k in keys], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(asked_id, mask=asked_id == _NO_ID), "query": pa.array([k[1] for k in keys], pa.binary()),
                    "vec_id": pa.array(ids, pa.int64(), mask=ids == _NO_ID), "score": pa.array(scores, pa.float64())})

        def close(rows: list, block: dict, best: dict) -> None:
            for i, q, (ids, scores) in answers(*(np.concatenate([r[k] for r in rows]) for k in range(3)), block):
                key = (i, q.tobytes())
                if key in best:
                    ids, scores = np.concatenate((best[key][0], ids)), np.concatenate((best[key][1], scores))
                    order = np.lexsort((ids, -scores))[:most]
                    ids, scores = ids[order], scores[order]
                best[key] = (ids, scores)

        rows, block, best, at = [], {}, {}, (None, None)
        for batch in batches:
            cells, shard = batch.column("cell").to_numpy(), batch.column("shard").to_numpy()
            ids, times = batch.column("vec_id").fill_null(_NO_ID).to_numpy(), batch.column("times").to_numpy()
            flat, size = batch.column("embedding").flatten().to_numpy(), np.diff(batch.column("embedding").offsets.to_numpy())
            begin = np.concatenate(([0], np.cumsum(size)))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(shard) != 0) | (np.diff(size) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if a == b:
                    continue
                here = (cells[a], shard[a])
                if here != at and rows:
                    close(rows, block, best)
                    rows = []
                if here[0] != at[0]:
                    yield from merged(block, best)
                    block, best = {}, {}
                at = here
                piece = (ids[a:b], flat[begin[a]:begin[b]].reshape(b - a, -1), times[a:b])
                if shard[a] < 0:
                    block.setdefault(piece[1].shape[1], []).append(piece)
                else:
                    rows.append(piece)
        if rows:
            close(rows, block, best)
        yield from merged(block, best)

    found = placed.select("cell", "shard", "vec_id", "embedding", "times").mapInArrow(run, "query_id long, query binary, vec_id long, score double")
    order = F.struct((-F.col("score")).alias("far"), F.coalesce("vec_id", F.lit(_NO_ID)).alias("last"), "vec_id", "score")
    # At most `most` rows a group and query arrive here.
    merged = found.groupBy("query_id", "query").agg(F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")


def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
