"""Quality by an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Documents are dealt into blocks of about BLOCK_BYTES.  A block sends each of its distinct n-grams once, with its count in trusted text;
counts are added up per n-gram, probabilities are computed in shards (an n-gram, its suffixes and their contexts share their two bytes
before the last, so that a shard has all it needs but the bigrams, of which there are 65,536 at most), and joined back to the blocks
that asked.  Each block then scores its documents whole.  A language's threshold is a quantile of the perplexities of its trusted
documents that the model hasn't seen: of all trusted documents one in CALIBRATION, by hash, is kept out of the counts for that.

The symbols are bytes, so nothing is out of vocabulary, and one more that stands for a whole word equal to the word before it: five bytes
can't tell that a text repeats an ordinary word, but REPEATED after the word's last bytes is as improbable as trusted text seldom repeats
such words.  All other trusted text is counted, so the model grows with the input.

A language's quantile is drawn towards that over all languages, in the proportion of BORROWED documents to its own, where that one is
larger; the rule is the same for any number of documents.

Defined results: null and empty texts have no perplexity and are not kept; a language without calibrating documents takes the quantile over
all of them (null is a language like others); without calibrating documents everything but empty texts is kept; a null doc_id is never
trusted; rows that share a doc_id are judged each by its own text (filtering documents keeps all rows of an id of which one is kept); extra
columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import checkpointed, row_id, table, text_bytes, word_spans

ORDER = 5
BLOCK_BYTES = 32 << 20
#: Of the trusted documents of a language, so many have a perplexity below its threshold; the threshold has some head-room above that.
QUANTILE, HEADROOM, PRIOR_SYMBOLS, CALIBRATION = 0.995, 1.1, 32, 5
#: A language's threshold is drawn towards a larger one of all languages as if so many documents had that one.
BORROWED = 30
#: The symbol of a repeated word; no UTF-8 text has this byte.
REPEATED = 0xFF
_START, _END = b"\x02" * (ORDER - 1), b"\x03"
_CHUNK = 4 << 20


def gram_codes(data: bytes) -> np.ndarray:
    """The code of the n-gram that ends at each symbol of a text and at its end; the context is always the bytes before.

    A word that equals the word before it, one byte apart, is one symbol together with that byte: REPEATED.
    """
    raw = np.frombuffer(_START + data + _END, np.uint8).astype(np.int64)
    n = len(data) + 1
    codes = raw[:n].copy()
    for i in range(1, ORDER):
        codes <<= 8
        codes |= raw[i : n + i]
    starts, ends, hashes = word_spans(data)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (starts[1:] == ends[:-1] + 1)) + 1
    if not len(again):
        return codes
    codes[starts[again] - 1] |= REPEATED
    inside = np.zeros(n, np.int64)
    inside[starts[again]] += 1  # each of these places belongs to one word
    inside[ends[again]] -= 1
    return codes[np.cumsum(inside) == 0]


def _texts(group: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
    unpack = zstandard.ZstdDecompressor()
    for i, packed in enumerate(group["packed"]):
        yield i, unpack.decompress(packed) if packed else b""


def blocks(docs: DataFrame, n: int) -> DataFrame:
    """(block, id, doc_id, lang, n_bytes, packed): texts compressed, dealt by id into n blocks and kept for the passes that follow."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [text_bytes(t) for t in batch["text"]]
            yield pd.DataFrame({"block": batch["block"], "id": batch["id"], "doc_id": batch["doc_id"].astype("Int64"), "lang": batch["lang"],
                                "n_bytes": [len(r) for r in raw], "packed": [press.compress(r) if r else None for r in raw]})

    dealt = docs.select(F.pmod(F.xxhash64(row_id()), F.lit(n)).cast("int").alias("block"), row_id().alias("id"),
                        F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    packed = dealt.mapInPandas(pack, "block int, id long, doc_id long, lang string, n_bytes long, packed binary")
    return packed.repartition(min(n, 1 << 20), "block").persist(StorageLevel.MEMORY_AND_DISK)


def block_grams(held: DataFrame, trusted: DataFrame) -> DataFrame:
    """(block, gram, n): every n-gram of each block once, with its count in the block's trusted documents."""
    def count(docs: pd.DataFrame, good: pd.DataFrame) -> pd.DataFrame:
        good_ids = set(good["id"])
        sums: dict[bool, list] = {True: [], False: []}
        waiting: dict[bool, list] = {True: [], False: []}

        def settle(side: bool) -> None:
            if waiting[side]:
                sums[side].append(np.unique(np.concatenate(waiting[side]), return_counts=True))
                waiting[side].clear()

        size = {True: 0, False: 0}
        for i, data in _texts(docs):
            side = docs["id"].iat[i] in good_ids
            if data:
                waiting[side].append(gram_codes(data))
                size[side] += len(data)
                if size[side] > _CHUNK:
                    settle(side)
                    size[side] = 0
        settle(True)
        settle(False)
        grams = np.unique(np.concatenate([*[s[0] for s in sums[True] + sums[False]], np.zeros(0, np.int64)]))
        n = np.zeros(len(grams), np.int64)
        for found, counts in sums[True]:
            n[np.searchsorted(grams, found)] += counts
        return pd.DataFrame({"block": np.full(len(grams), docs["block"].iat[0] if len(docs) else 0, np.int32), "gram": grams, "n": n})

    return held.groupBy("block").cogroup(trusted.groupBy("block")).applyInPandas(count, "block int, gram long, n long")


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (counts_of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *[min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]])


def interpolated(counts: np.ndarray, context: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of n-grams with these counts and contexts, given those of the next lower order (one value per n-gram)."""
    _, place = np.unique(context, return_inverse=True)
    total = np.bincount(place, counts)
    held = np.bincount(place, discount[np.minimum(counts, 3)])
    seen = total[place] > 0
    safe = np.maximum(total[place], 1)
    return np.where(seen, (counts - discount[np.minimum(counts, 3)] + held[place] * lower) / safe, lower)


def low_orders(bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of all bigrams, their discounts) from the number of distinct bytes seen before each bigram."""
    of = lambda counts: discounts(dict(zip(*np.unique(counts[counts > 0], return_counts=True), strict=True)))
    before = (bigrams.reshape(256, 256) > 0).sum(axis=0)
    single = interpolated(before, np.zeros(256, int), of(before), np.full(256, 1 / 256))
    every = np.arange(1 << 16)
    return interpolated(bigrams, every >> 8, of(bigrams), single[every & 255]), of(bigrams)


def gram_probabilities(grams: DataFrame) -> DataFrame:
    """(gram, logp) for every distinct n-gram (gram, n): n is its count in trusted text, 0 if unseen there."""
    seen = grams.where("n > 0")
    suffix = lambda k: F.col("gram").bitwiseAND((1 << 8 * k) - 1)
    levels, tables = {}, {ORDER: seen.select("gram", F.col("n"))}
    for k in range(ORDER - 1, 1, -1):
        tables[k] = tables[k + 1].select(suffix(k).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    for k in range(3, ORDER + 1):
        found = tables[k].where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()
        levels[k] = discounts({r.n: r.m for r in found})
    bigrams = np.zeros(1 << 16, np.int64)
    for row in tables[2].collect():  # 65,536 rows at most
        bigrams[row.gram] = row.n
    shared = grams.sparkSession.sparkContext.broadcast((low_orders(bigrams)[0], levels))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        base, discount = shared.value
        gram, n = rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        types, counts = {ORDER: gram}, {ORDER: n}
        places = {}
        for k in range(ORDER - 1, 2, -1):
            types[k], places[k + 1] = np.unique(types[k + 1] & ((1 << 8 * k) - 1), return_inverse=True)
            counts[k] = np.bincount(places[k + 1], counts[k + 1] > 0, len(types[k])).astype(np.int64)
        p = base[types[3] & 0xFFFF]
        for k in range(3, ORDER + 1):
            p = interpolated(counts[k], types[k] >> 8, discount[k], p if k == 3 else p[places[k]])
        return pd.DataFrame({"gram": gram, "logp": np.log(p).astype(np.float32)})

    shards = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    middle = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    return grams.groupBy(F.pmod(F.xxhash64(middle), F.lit(shards)).alias("shard")).applyInPandas(shard, "gram long, logp float")


def perplexities(docs: DataFrame, trusted: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, doc_id, lang, n_bytes, n_symbols, trusted, perplexity) for every row; trusted has the doc_id of the documents to learn from."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    held = blocks(docs, n)
    good = trusted.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct().select(
        F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id")
    asked = block_grams(held, good)
    grams = checkpointed(asked.groupBy("gram").agg(F.sum("n").alias("n")))
    answers = asked.select("block", "gram").join(gram_probabilities(grams), "gram").select("block", "gram", "logp")

    def score(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        index, logp = pd.Index(found["gram"].to_numpy()), found["logp"].to_numpy(np.float64)
        out, n = np.full(len(docs), np.nan), np.zeros(len(docs), np.int64)
        for i, data in _texts(docs):
            if data:
                codes = gram_codes(data)
                n[i] = len(codes)
                out[i] = math.exp(min(700.0, -logp[index.get_indexer(codes)].mean()))
        return pd.DataFrame({"id": docs["id"], "doc_id": docs["doc_id"].astype("Int64"), "lang": docs["lang"], "n_bytes": docs["n_bytes"],
                             "n_symbols": n, "perplexity": out})

    scored = held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        score, "id long, doc_id long, lang string, n_bytes long, n_symbols long, perplexity double")
    scored = scored.withColumn("perplexity", F.when(~F.isnan("perplexity"), F.col("perplexity")))
    out = checkpointed(scored)
    held.unpersist()
    return out.join(good.select("id", F.lit(True).alias("trusted")), "id", "left").withColumn(
        "trusted", F.coalesce("trusted", F.lit(False)))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, headroom: float = HEADROOM) -> DataFrame:
    """(id, doc_id, lang, n_bytes, perplexity, smoothed, threshold, keep) for every row of (doc_id, text, lang); trusted: labels.quality = 1.

    A text of a few symbols says little: ``smoothed``, which is held against the threshold, is its perplexity together with PRIOR_SYMBOLS
    symbols at the median of the language's trusted documents.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn(
        "unseen", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0)
    scored = perplexities(docs, good.where(~F.col("unseen")))
    rows = checkpointed(scored.join(good.where("unseen").select(F.col("doc_id").alias("id"), "unseen"), "id", "left").withColumn(
        "unseen", F.coalesce("unseen", F.lit(False))))

    def limits(value: str, name: str, rows: DataFrame, at: float) -> DataFrame:
        """The rows with the quantile of the calibrating documents of their language, drawn towards that of all."""
        known = rows.where(F.col("unseen") & F.col(value).isNotNull())
        found = F.percentile_approx(value, at, 10_000)
        by_lang, overall = known.groupBy("lang").agg(found.alias("_own"), F.count("*").alias("_n")), known.agg(found.alias("_all"))
        joined = rows.join(by_lang, rows["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"]).crossJoin(F.broadcast(overall))
        own, n = F.ln(F.coalesce("_own", "_all")), F.coalesce("_n", F.lit(0))
        drawn = F.exp((n * own + BORROWED * F.greatest(own, F.ln("_all"))) / (n + BORROWED))
        return joined.withColumn(name, drawn).drop("_own", "_n", "_all")

    usual = limits("perplexity", "usual", rows, 0.5)
    n = F.col("n_symbols")
    smoothed = F.exp((n * F.ln("perplexity") + PRIOR_SYMBOLS * F.ln(F.coalesce("usual", "perplexity"))) / (n + PRIOR_SYMBOLS))
    known = limits("smoothed", "threshold", usual.withColumn("smoothed", smoothed), quantile).withColumn("threshold", F.col("threshold") * headroom)
    return known.select("id", "doc_id", "lang", "n_bytes", "perplexity", "smoothed", "threshold", (
        F.col("smoothed").isNotNull() & (F.col("threshold").isNull() | (F.col("smoothed") <= F.col("threshold")))).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose perplexity is within their language's threshold."""
    kept = judged(docs, labels).where("keep").select(F.col("id").alias("_kept_id")).distinct()
    return docs.withColumn("_kept_id", row_id()).join(kept, "_kept_id", "left_semi").select(*docs.columns)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("id")
