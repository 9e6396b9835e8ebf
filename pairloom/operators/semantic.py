"""Embeddings: chunking, pooling, encode-once cache, pair cosine and duty alignment.

Vectors are arrays of floats of length 1.  Where they come from is the caller's choice: an encoder is any function from a
(text_id, chunk, n_tokens, text) table to a (text_id, chunk, n_tokens, vec) table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import text as tx
from pairloom.functions.binding import let
from pairloom.functions.numbers import dot, norm
from pairloom.functions.ordering import rank_in_group
from pairloom.operators.ranking import first_per_group
from pairloom.session import arrow_rows, cut_lineage

Encoder = Callable[[DataFrame], DataFrame]
#: Coordinates of a vector that are summed in one row, and vectors of a document that lie in one row.
SLICE, BLOCK = 16, 64
#: Two blocks of doubles a row, and so many bytes of rows go to Python at a time.
BATCH_BYTES = 1 << 25


def text_key(text: Column) -> Column:
    return F.sha1(tx.normalize(text))


def distinct_texts(requests: DataFrame, text: str = "text") -> DataFrame:
    """(text_id, text): one row per distinct normalised text."""
    normal = requests.select(tx.normalize(F.col(text)).alias("text"))
    return normal.groupBy(F.sha1("text").alias("text_id")).agg(F.any_value("text").alias("text"))


def chunk_windows(texts: DataFrame, max_tokens: int, strategy: str = "chunk_mean", id: str = "text_id",
                  text: str = "text") -> DataFrame:
    """(id, chunk, n_tokens, text): consecutive token windows; truncate keeps the first, chunk_mean all of them."""
    if strategy not in ("truncate", "chunk_mean"):
        raise ValueError("strategy must be truncate or chunk_mean")
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    last = lambda w: F.lit(0) if strategy == "truncate" else F.greatest(F.ceil(F.size(w) / F.lit(max_tokens)), F.lit(1)).cast("int") - 1
    windows = let(words, lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.slice(w, i * max_tokens + 1, max_tokens)))
    return texts.select(id, F.posexplode(windows).alias("chunk", "_part")).select(
        id, "chunk", F.greatest(F.size("_part"), F.lit(1)).alias("n_tokens"), F.array_join("_part", " ").alias("text"))


def hashed_bag_encoder(dim: int = 256) -> Encoder:
    """Deterministic stand-in encoder: words hashed by MD5 modulo dim (at most 256), counted, length 1."""
    if dim > 256:
        raise ValueError("dim must be at most 256")

    def encode(chunks: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 31, 2), 16, 10).cast("int"), F.lit(dim)))
        hashed = chunks.select("text_id", "chunk", "n_tokens", slots.alias("_slots"))
        # One chunk's words are bounded by the window, so the counting stays inside the row.
        # Every slot is added once and the list sorted: where a slot's run starts tells how often the slots before it occur.
        every = F.sequence(F.lit(0), F.lit(dim - 1))
        ordered = F.array_sort(F.concat("_slots", every))
        starts = lambda s: F.concat(F.transform(every, lambda d: F.array_position(s, d)), F.array((F.size(s) + 1).cast("long")))
        counts = lambda s, at: F.transform(every, lambda d: (F.get(at, d + 1) - F.get(at, d) - 1).cast("double"))
        length = lambda s, at, c: F.greatest(norm(c), F.lit(1e-300))
        vec = let(ordered, starts, counts, length, lambda s, at, c, n: F.transform(c, lambda x: (x / n).cast("float")))
        return hashed.select("text_id", "chunk", "n_tokens", vec.alias("vec"))

    return encode


def pool_chunks(chunks: DataFrame, id: str = "text_id") -> DataFrame:
    """(id, vec): mean of a text's chunk vectors weighted by chunk length, back to length 1, single precision.

    A mean of length 0, as that of a text without words, stays 0.  Vectors are added slice by slice in partial sums that tasks merge, so a text's chunks never meet in one row, however many there are.
    """
    count = F.greatest(F.ceil(F.size("vec") / F.lit(SLICE)), F.lit(1)).cast("int")
    slices = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("slice"), F.slice("vec", i * SLICE + 1, SLICE).alias("part")))
    rows = chunks.select(id, "n_tokens", F.size("vec").alias("dim"), F.inline(slices))
    sums = rows.groupBy(id, "slice").agg(F.max("dim").alias("dim"), *[
        F.sum(F.get("part", F.lit(i)).cast("double") * F.col("n_tokens")).alias(f"_{i}") for i in range(SLICE)])
    # One row a slice: together as long as the vector.
    whole = sums.groupBy(id).agg(F.max("dim").alias("dim"), F.array_sort(F.collect_list(F.struct(
        "slice", F.array(*[f"_{i}" for i in range(SLICE)]).alias("part")))).alias("_s"))
    summed = F.slice(F.flatten(F.transform("_s", lambda x: x["part"])), F.lit(1), F.col("dim"))
    return whole.select(id, let(summed, lambda s: F.greatest(norm(s), F.lit(1e-300)), lambda s, n: F.transform(s, lambda x: (x / n).cast("float"))).alias("vec"))


def encode_texts(requests: DataFrame, encoder: Encoder, max_tokens: int = 510, strategy: str = "chunk_mean",
                 text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(text_id, vec) of every distinct text that is not in known (text_id, vec)."""
    todo = distinct_texts(requests, text)
    if known is not None:
        todo = todo.join(known.select("text_id"), "text_id", "left_anti")
    return pool_chunks(encoder(chunk_windows(todo, max_tokens, strategy)))


def encoding_stats(requests: DataFrame, known: DataFrame, max_tokens: int = 510, strategy: str = "chunk_mean",
                   text: str = "text") -> DataFrame:
    """Texts requested, distinct new texts to encode, their chunks, requests served by known vectors."""
    normal = requests.select(tx.normalize(F.col(text)).alias("_t"))
    windows = F.greatest(F.ceil(tx.word_count(F.col("_t")) / F.lit(max_tokens)), F.lit(1)).cast("long")
    chunks = F.lit(1).cast("long") if strategy == "truncate" else windows
    per = normal.groupBy(F.sha1("_t").alias("text_id")).agg(F.count("*").alias("n"), F.first(chunks).alias("chunks"))
    marked = per.join(known.select("text_id").distinct().withColumn("_known", F.lit(True)), "text_id", "left")
    new = F.col("_known").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return marked.agg(F.sum("n").alias("texts_requested"), F.count_if(new).alias("texts_encoded"),
                      zero(F.sum(F.when(new, F.col("chunks")))).alias("chunks_encoded"),
                      zero(F.sum(F.when(~new, F.col("n")))).alias("reused_cached"))


def vector_pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str = "candidate_id",
                       right_id: str = "posting_id", score: str = "score", how: str = "inner") -> DataFrame:
    """Cosine of two unit vectors per pair; how="left" keeps pairs without a vector, with NULL."""
    l = left.select(left_id, F.col("vec").alias("_l"))
    r = right.select(right_id, F.col("vec").alias("_r"))
    return vector_scores(pairs.join(l, left_id, how).join(r, right_id, how), "_l", "_r", score)


def vector_scores(joined: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """Cosine of pairs that carry both unit vectors, which are dropped; NULL where one is missing."""
    return joined.withColumn(score, dot(F.col(left), F.col(right))).drop(left, right)


MATCHES = T.ArrayType(T.StructType([T.StructField("duty", T.IntegerType()), T.StructField("evidence", T.IntegerType()),
                                    T.StructField("similarity", T.DoubleType())]))


@F.pandas_udf(MATCHES)
def _block_matches(duties: pd.Series, evidence: pd.Series, first_duty: pd.Series, first_evidence: pd.Series, dims: pd.Series) -> pd.Series:
    """The best evidence of one block for each duty of one block: at most BLOCK vectors a side."""
    out = []
    for d, e, i, j, dim in zip(duties, evidence, first_duty, first_evidence, dims):
        sims = np.asarray(d, dtype=np.float64).reshape(-1, dim) @ np.asarray(e, dtype=np.float64).reshape(-1, dim).T
        best = sims.argmax(axis=1)
        out.append([{"duty": int(i + k), "evidence": int(j + b), "similarity": float(sims[k, b])} for k, b in enumerate(best)])
    return pd.Series(out)


def vector_blocks(sentences: DataFrame, id: str, position: str) -> DataFrame:
    """(id, first, flat): a document's sentence vectors by their place from 0, end to end, at most BLOCK of them a row."""
    placed = rank_in_group(sentences.select(id, position, "vec"), [id], [F.col(position)], rank="_rank")
    blocks = placed.groupBy(id, F.floor((F.col("_rank") - 1) / BLOCK).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "vec"))).alias("_v"))
    return blocks.select(id, (F.col("_block") * BLOCK).cast("int").alias("first"), F.flatten(F.transform("_v", lambda x: x["vec"])).alias("flat"))


def best_evidence(pairs: DataFrame, duties: DataFrame, evidence: DataFrame, dim: int, left_id: str = "candidate_id",
                  right_id: str = "posting_id") -> DataFrame:
    """(pair, duty, evidence, similarity): each duty's most similar sentence, the first on ties.

    duties (posting, first, flat) and evidence (candidate, first, flat) come from vector_blocks.  Blocks are compared in rows of bounded size and
    each duty's maxima are merged by a partial aggregate, so long documents spread over tasks.  Written once, in batches of bounded bytes.
    """
    d = duties.select(right_id, F.col("first").alias("_i"), F.col("flat").alias("_d"))
    e = evidence.select(left_id, F.col("first").alias("_j"), F.col("flat").alias("_e"))
    blocks = pairs.select(left_id, right_id).distinct().join(d, right_id).join(e, left_id)
    found = blocks.select(left_id, right_id, F.inline(_block_matches("_d", "_e", "_i", "_j", F.lit(dim))))
    # Rounded so that equal vectors in blocks of other shapes tie.
    order = F.struct(F.round("similarity", 12).alias("s"), (-F.col("evidence")).alias("e"))
    best = found.groupBy(left_id, right_id, "duty").agg(F.max_by(F.struct("evidence", "similarity"), order).alias("_b"))
    with arrow_rows(pairs.sparkSession, max(16, BATCH_BYTES // (16 * BLOCK * dim))):
        return cut_lineage(best.select(left_id, right_id, "duty", "_b.*"))


def alignment(pairs: DataFrame, duties: DataFrame, evidence: DataFrame, dim: int, left_id: str = "candidate_id",
              right_id: str = "posting_id", top: int = 3) -> DataFrame:
    """Mean over a posting's duties of the best cosine with any of the candidate's sentences, and the best duties.

    duties and evidence come from vector_blocks; NULL and no duties where either side has no sentences.
    """
    both = [left_id, right_id]
    matched = best_evidence(pairs, duties, evidence, dim, left_id, right_id)
    mean = matched.groupBy(*both).agg(F.avg("similarity").alias("responsibility_similarity"))
    first = first_per_group(matched, both, [F.desc("similarity"), F.asc("duty")], top).groupBy(*both).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "duty", "evidence", "similarity"))),
        lambda x: F.struct(x["duty"].alias("duty"), x["evidence"].alias("evidence"), x["similarity"].alias("similarity"))).alias("best"))
    out = pairs.join(mean, both, "left").join(first, both, "left")
    return out.withColumn("best", F.coalesce("best", F.array().cast(MATCHES)))
