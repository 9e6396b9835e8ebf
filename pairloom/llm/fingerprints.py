"""Document fingerprints by a threshold-scaled sketch.

Every shingle hash below ``fraction * 2**64`` stays, whatever the length of the document, so that sketches of very unequal documents
are comparable, two sketches merge by union, and the share of one sketch found in another estimates containment without bias.  A text
all of whose hashes lie above the threshold keeps its smallest one (the smallest of a union is still known after a merge).

Defined results: null counts as the empty text; a text without words has the empty fingerprint, whose likeness is 1 to another empty one
and 0 to any other; repeated rows give repeated results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import range_part, shingle_hashes, table, text_bytes

FRACTION, WORDS = 1 / 8, 5
_LEAST = -(2**63)


def sketch(data: bytes, fraction: float = FRACTION, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes below the threshold; the smallest one if there are none."""
    hashes = np.unique(shingle_hashes(data, words))
    kept = hashes[: np.searchsorted(hashes, np.uint64(min(int(fraction * 2**64), 2**64 - 1)))]
    return kept if len(kept) else hashes[:1]


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two documents taken together."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64(min(int(fraction * 2**64), 2**64 - 1))]
    return kept if len(kept) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first document's shingles that the second has."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def text_of(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex(" ", 8)


def fingerprints(docs: DataFrame, fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every row of (doc_id, text); no shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "n_chars": [len(t) if isinstance(t, str) else 0 for t in batch.text],
                                "fingerprint": [text_of(sketch(text_bytes(t), fraction, words)) for t in batch.text]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def with_followers(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, tail, doc_id, text) dealt by ranges of doc_id and sorted within each part: a document's follower is the next row.

    Each part also gets, with tail = 1, the first row of the next part (the last part: the first row of all).  Only cut points and one
    id per part reach the driver; the texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = keyed.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(found)) if parts > 1 else []
    placed = keyed.withColumn("part", range_part(F.col("key"), cuts))
    firsts = dict(placed.groupBy("part").agg(F.min("key").alias("first")).collect())
    used = sorted(firsts)
    first = [firsts.get(p) for p in range(len(cuts) + 1)]
    before = [used[used.index(p) - 1] if p in firsts else None for p in range(len(cuts) + 1)]
    at = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("part") + 1)
    here = F.struct(F.col("part"), F.lit(0).alias("tail"))
    there = F.struct(at(before, "int").alias("part"), F.lit(1).alias("tail"))
    copies = F.when(F.col("key") == at(first, "long"), F.array(here, there)).otherwise(F.array(here))
    dealt = placed.select(F.explode(copies).alias("place"), "key", "text").select("place.*", "key", "text")
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "tail", "key", "text")


def followed_fingerprints(docs: DataFrame, fraction: float = FRACTION, words: int = WORDS, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last floor(n/2) code points are the follower's first ones.

    ``near_edited`` and ``near_next`` are the containments of the document's sketch in the edited text's and in the follower's.
    """
    def row(key: int, text: str, mine: np.ndarray, follower: str, theirs: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = (text[: len(text) - half] + follower[:half]).encode("utf-8", "surrogatepass")
        other = sketch(edited, fraction, words)
        return (None if key == _LEAST else key, len(text), hashlib.sha256(edited).hexdigest(), text_of(mine), text_of(other),
                containment(mine, other), containment(mine, theirs), len(mine))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, columns = None, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes"]
        for batch in batches:
            rows = []
            for tail, key, text in zip(batch["tail"], batch["key"], batch["text"], strict=True):
                mine = sketch(text_bytes(text), fraction, words)
                if held:
                    rows.append(row(*held, text, mine))
                held = None if tail else (key, text, mine)
                if tail:
                    break
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"doc_id": "Int64"})

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double, n_hashes long")
    return with_followers(docs, parts).mapInPandas(run, schema)


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return followed_fingerprints(table(spark, folder, "documents"))
