"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words, weighted by their count in the text times an inverse document frequency (counted over all documents in
2**18 hashed features, 1 for ordinary shingles and less for those that very many documents share).  Each text draws SAMPLES consistent
weighted samples; texts that agree in a whole band of them meet in a bucket, and pairs are verified by the exact weighted Jaccard
similarity of the whole texts.  Classes are connected components of the verified links.

A bucket is never expanded into all pairs.  Its PIVOTS most central members are compared with all others; where it still holds several
classes after that, its members meet in blocks of BLOCK rows, two blocks a task, where only pairs of different classes are compared, the
most alike by their samples first, and only links that join two classes are returned.  Pairs whose samples agree too rarely to be similar
(ESTIMATE) are not compared.

Defined results: null counts as the empty text; texts without words are near copies of equal texts only; rows that share a doc_id are
one document; a null doc_id takes part under a negative id made from its text; an empty table gives an empty table; extra columns stay
untouched where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.common import U64, checkpointed, mix, row_id, shingle_hashes, table, text_bytes, text_key
from pairloom.operators.near_duplicates import connected_components

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 12
SAMPLES = ROWS * BANDS
#: Share of agreeing samples below which a pair is not verified: three standard errors under SIMILARITY.
ESTIMATE = 0.62
FEATURES = 1 << 18
#: An idf is at least so much of an ordinary shingle's, so that a large group of copies doesn't lose its own shingles.
LEAST_IDF = 0.7
#: Members of each bucket that are compared with all others at first.
PIVOTS = 4
#: Rows of a bucket that one task holds, twice.
BLOCK = 512


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the sample functions; quantile tables of Gamma(2, 1) and of the logarithm of it."""
    place = (np.arange(1 << 16) + 0.5) / (1 << 16)
    grid = np.concatenate(([0.0], np.geomspace(1e-4, 40, 20_000)))
    gamma = np.interp(place, 1 - np.exp(-grid) * (1 + grid), grid)
    factors = mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return factors, gamma.astype(np.float32), (1 / gamma).astype(np.float32), np.log(gamma).astype(np.float32)


def weighted_shingles(data: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, sorted, and their weights."""
    hashes, counts = np.unique(shingle_hashes(data, WORDS), return_counts=True)
    return hashes, counts * idf[(hashes & U64(FEATURES - 1)).astype(np.int64)]


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 64-bit sample for each sample function; two texts agree in one with the probability of their weighted Jaccard similarity."""
    factors, gamma, inverse, logarithm = _draws()
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, U64)
    every = np.arange(SAMPLES)
    for start in range(0, len(hashes), 2048):
        part = hashes[start : start + 2048]
        bits = part[None, :] * factors[:, None]
        bits ^= bits >> U64(29)
        bits *= U64(0xBF58476D1CE4E5B9)
        ri = (bits >> U64(48)).astype(np.uint16)
        r = gamma[ri]
        beta = ((bits >> U64(32)).astype(np.uint16)).astype(np.float32) * np.float32(1 / 65536)
        level = np.floor(np.log(weights[start : start + 2048]).astype(np.float32)[None, :] * inverse[ri] + beta)
        value = logarithm[(bits >> U64(16)).astype(np.uint16)] - r * (level + np.float32(1) - beta)
        at = value.argmin(axis=1)
        found = value[every, at]
        better = found < best
        best[better] = found[better]
        out[better] = mix(part[at] + level[every, at].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))[better]
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 if either text has no words."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """One idf for each hashed feature; counted over all documents, added up in two steps, 2**18 sums at most reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for text in batch["text"]:
                features = np.unique(shingle_hashes(text_bytes(text), WORDS)) & U64(FEATURES - 1)
                total += np.bincount(features.astype(np.int64), minlength=FEATURES) if len(features) > 20_000 else 0
                if 0 < len(features) <= 20_000:
                    np.add.at(total, features.astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"feature": used, "df": total[used]})

    sums = docs.select("text").mapInPandas(count, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    n = max(1, docs.count())
    df = np.zeros(FEATURES)
    df[sums["feature"].to_numpy(np.int64)] = sums["df"].to_numpy(np.float64)
    usual = max(1.0, df.mean())
    return np.clip(np.log1p(n / np.maximum(df, 1)) / np.log1p(n / usual), LEAST_IDF, 1.0)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, id, text_key, bands) for every row: 16 bits of each of a band's ROWS samples, packed; empty for texts without words."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bands = []
            for text in batch["text"]:
                hashes, weights = weighted_shingles(text_bytes(text), idf.value)
                drawn = (samples(hashes, weights) & U64(0xFFFF)).astype(np.uint16) if len(hashes) else np.zeros(0, np.uint16)
                bands.append(drawn.view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "id": batch["id"], "text_key": batch["text_key"], "bands": bands})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("id"), text_key().alias("text_key"), "text")
    return source.mapInPandas(sign, "doc_id long, id long, text_key string, bands array<long>")


def verified(docs: DataFrame, pairs: DataFrame, idf) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that are similar enough.  Only texts that stand in a pair are fetched."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = checkpointed(docs.select(row_id().alias("id"), "text").join(ends, "id", "left_semi"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            found = []
            for a, b, first, second in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b != last:
                    last, held = b, weighted_shingles(text_bytes(second), idf.value)
                found.append((a, b, weighted_jaccard(weighted_shingles(text_bytes(first), idf.value), held)))
            yield pd.DataFrame([f for f in found if f[2] >= SIMILARITY], columns=["a", "b", "similarity"])

    one = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(
        compare, "a long, b long, similarity double")


def _agreement(first: str, second: str) -> Column:
    """Share of samples on which two texts agree."""
    lane = lambda x, k: F.when(F.shiftrightunsigned(x, 16 * k).bitwiseAND(0xFFFF) == 0, 1).otherwise(0)
    same = F.zip_with(first, second, lambda x, y: sum(lane(x.bitwiseXOR(y), k) for k in range(ROWS)))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x) / F.lit(SAMPLES)


def _compared(members: DataFrame, chosen: DataFrame, among: Column) -> DataFrame:
    """(a, b): members of the buckets with the chosen ones, each pair once, in the first band on which it agrees."""
    agree = F.array_position(F.zip_with("bands", "p_bands", lambda x, y: x == y), True) == F.col("band") + 1
    met = members.join(chosen, ["band", "value"]).where(among & agree & (_agreement("bands", "p_bands") >= ESTIMATE))
    return checkpointed(met.select(F.col("id").alias("a"), F.col("p_id").alias("b")).distinct())


def near_copy_links(docs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, similarity): verified links among the distinct texts (id, bands), enough of them to connect every class."""
    rows = texts.select("id", F.posexplode("bands").alias("band", "value"))
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("members")).where("members > 1")
    shared = rows.join(sizes, ["band", "value"]).groupBy("id").agg(
        F.sum("members").alias("weight"), F.collect_list(F.struct("band", "value")).alias("buckets"))
    members = checkpointed(shared.join(texts, "id").select("id", "weight", "bands", F.explode("buckets").alias("b")).select(
        "id", "weight", "bands", "b.band", "b.value"))
    order = W.partitionBy("band", "value").orderBy(F.col("weight").desc(), "id")
    first = checkpointed(members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select(
        "band", "value", F.col("id").alias("p_id"), F.col("bands").alias("p_bands"), "place"))
    # A pair of two pivots is compared once.
    pairs = _compared(members, first, F.col("id") != F.col("p_id"))
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = checkpointed(verified(docs, once, idf))
    # What is known of the classes so far: the smallest id two links away.  Texts with one label are connected for certain.
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ways.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    label = checkpointed(near.join(near.select(F.col("a").alias("m"), F.col("m").alias("further")), "m", "left").select(
        F.col("a").alias("id"), F.coalesce("further", "m").alias("label")))
    labelled = checkpointed(members.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    counted = labelled.groupBy("band", "value", "label").agg(F.count("*").alias("n"))
    open_ = counted.groupBy("band", "value").agg(F.sum("n").alias("rows"), F.count("*").alias("labels")).where("labels > 1")
    held = checkpointed(labelled.join(open_.drop("labels"), ["band", "value"]).select("id", "label", "bands", "band", "value", "rows"))
    return checkpointed(links.unionByName(_links_in_blocks(docs, held, idf)))


def _links_in_blocks(docs: DataFrame, held: DataFrame, idf) -> DataFrame:
    """(a, b, similarity): links that join labels inside the buckets (band, value) of (id, label, bands, rows)."""
    texts = docs.select(row_id().alias("id"), "text").join(held.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = held.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("id", "label", "bands", "band", "value", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        ids, own = rows["id"].to_numpy(np.int64), rows["own"].to_numpy()
        inside, band = rows["low"].iat[0] == rows["high"].iat[0], int(rows["band"].iat[0])
        root = {x: x for x in rows["label"]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        labels, bands = rows["label"].to_numpy(np.int64), np.stack(rows["bands"].to_numpy())
        marks = bands.view(np.uint16)
        pairs = []
        for i in range(len(ids) - 1):
            later = np.arange(i + 1, len(ids))
            later = later[(labels[later] != labels[i]) & (inside | (own[later] != own[i]))]
            share = (marks[later] == marks[i]).mean(axis=1)
            later, share = later[share >= ESTIMATE], share[share >= ESTIMATE]
            # A pair is judged in the first band on which it agrees.
            first = (bands[later] == bands[i]).argmax(axis=1) == band
            pairs += [(-s, i, j) for s, j in zip(share[first], later[first], strict=True)]
        texts, found = rows["text"].to_list(), []
        of = lru_cache(None)(lambda k: weighted_shingles(text_bytes(texts[k]), idf.value))
        for _, i, j in sorted(pairs):
            if find(labels[i]) != find(labels[j]):
                similarity = weighted_jaccard(of(i), of(j))
                if similarity >= SIMILARITY:
                    root[find(labels[i])] = find(labels[j])
                    found.append((ids[i], ids[j], similarity))
        return pd.DataFrame(found, columns=["a", "b", "similarity"])

    return dealt.join(texts, "id").groupBy("band", "value", "low", "high").applyInPandas(link, "a long, b long, similarity double")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, id, class_id, n_links) for every row of (doc_id, text).

    class_id is the smallest id of the class; n_links counts the links to other texts that were verified to
    connect the class.
    """
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs))
    signed = checkpointed(signatures(docs, idf))
    texts = checkpointed(signed.groupBy("text_key").agg(
        F.min("id").alias("owner"), F.any_value("bands").alias("bands")))
    links = near_copy_links(docs, texts.select(F.col("owner").alias("id"), "bands").where(F.size("bands") > 0), idf)
    degree = links.select(F.col("a").alias("owner")).unionByName(links.select(F.col("b").alias("owner"))).groupBy("owner").agg(
        F.count("*").alias("n_links"))
    # Rows that share an id are one document: their texts are tied together.
    held = signed.select("id", "text_key").distinct().join(texts.select("text_key", "owner"), "text_key")
    ties = held.join(held.groupBy("id").agg(F.min("owner").alias("a")), "id").where(F.col("a") != F.col("owner")).select(
        "a", F.col("owner").alias("b"))
    tied = links.select("a", "b").unionByName(ties)
    ends = tied.select(F.col("a").alias("doc_id")).unionByName(tied.select(F.col("b").alias("doc_id"))).distinct()
    parts = connected_components(ends, tied).select(F.col("doc_id").alias("id"), "component")
    owned = texts.select("text_key", "owner").join(parts.select(F.col("id").alias("owner"), "component"), "owner", "left").join(
        degree, "owner", "left").select("text_key", F.coalesce("component", "owner").alias("class_id"),
                                        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("doc_id", "id", "text_key").join(owned, "text_key").select("doc_id", "id", "class_id", "n_links")


def first_of_each_class(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which no near copy has a smaller id; one row per id."""
    kept = near_copies(docs).where(F.col("id") == F.col("class_id")).select(F.col("id").alias("_kept_id")).distinct()
    marked = docs.withColumn("_kept_id", row_id())
    return marked.join(kept, "_kept_id", "left_semi").dropDuplicates(["_kept_id"]).select(*docs.columns)


def op7_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")
