"""Near-duplicate groups: documents whose unigram TF-IDF cosine reaches a threshold, closed under connection.

The pairs are found without comparing all pairs.  With a document's terms in one global order, rarest first, two vectors
whose dot product reaches t must share a term among each one's prefix: the terms kept while the norm of the term and all
that follow it is at least t.  Documents meet in the bucket of a shared prefix term.  In the bucket of the first term they share, the
dot product is at most the product of the two weights and the product of the two norms that follow; pairs that stay below t are left out.

Prefix terms are rare, so nearly all buckets are small, and their pairs are made as they are.  Similar pairs (similar_edges) are all found: a
bucket of more than DIRECT_ROWS is split by a second shared term.  Two vectors that reach t and whose weights of the
bucket's term multiply to less than t - s also share a term among each one's longer prefix, kept while the norm that remains is at least
s.  The few members with a large weight of the bucket's term are compared with the whole bucket.

Groups (near_duplicate_groups) need fewer pairs: equal texts, and texts with the same bag of words, are one vector and are linked without
being compared, and in each bucket of more than PIVOT_ROWS a pivot is compared with every member.  Members within the threshold of the pivot
are linked through it and are not compared with each other; angles add up, so a member and an outsider can reach the threshold only if their
angles to the pivot differ by at most the threshold angle, which leaves few to verify.  The outsiders form the bucket of the next round where
the pivot linked at least half of the bucket (a logarithmic number of rounds), and are split by a second term elsewhere.  The bounds on a
bucket only choose between exact ways.

A vector is one row.  Texts are dealt in blocks and written once, so that no later step shuffles them; each block asks for the frequency of a term once; a pair's two vectors meet in the cell of a
bucket the pair was found in, and vectors are sent to a cell once, however many pairs they have there.

Connected components are found by alternating large-star and small-star steps, a logarithmic number of rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from math import acos, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import text as tx
from pairloom.session import bucketed, cut_lineage, written

FAIR_SHARE = 0.5  # a pivot round must link this share of a bucket, or the bucket is split by a second term
SECOND_NORM = 0.5  # s above
MARGIN = 1e-9  # keeps rounding from losing a pair that sits exactly on a bound; every pair is verified afterwards
DIRECT_ROWS, PIVOT_ROWS = 4_096, 512  # larger buckets are split, or get a pivot
BLOCK_CHARS = 1 << 24  # text of a block
SHARDS = 8  # a large bucket's pairs are verified in so many times so many cells


@dataclass(frozen=True)
class Vectors:
    """rows (doc_id, dfs, ids, tfs): a document's terms, rarest first, each with its number of documents, its id and its count; n documents in all."""

    rows: DataFrame
    n: int
    blocks: int


@dataclass(frozen=True)
class Texts:
    """rows (_block, doc_id, text) in hash buckets of the block: n texts in so many blocks, which are read without a shuffle."""

    rows: DataFrame
    n: int
    blocks: int


@contextmanager
def _dealt_stays(spark: SparkSession) -> Iterator[None]:
    """While an action runs inside, rows that are dealt by one of a join's keys are not dealt again by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_chars(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.length(text))).first()[0] or 0


def dealt_texts(texts: DataFrame, chars: int | None = None, doc: str = "doc_id", text: str = "text") -> Texts:
    """The texts written once in blocks.  chars may give their length or a bound on it; without it texts are computed once more."""
    chars = text_chars(texts, text) if chars is None else chars
    blocks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BLOCK_CHARS))
    placed = texts.select(F.pmod(F.hash(doc), F.lit(blocks)).alias("_block"), F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    rows = bucketed(placed.repartition(blocks, "_block"), blocks, "_block")
    return Texts(rows, rows.count(), blocks)


def unigram_vectors(texts: DataFrame | Texts, doc: str = "doc_id", text: str = "text") -> Vectors:
    """Term and document counts of every text; weights are sublinear TF-IDF, length 1, every term kept."""
    texts = texts if isinstance(texts, Texts) else dealt_texts(texts, None, doc, text)
    dealt = texts.rows
    terms = dealt.select("_block", "doc_id", F.explode(tx.tokens(F.lower("text"), tx.WORD_TOKEN)).alias("term"))
    counts = terms.groupBy("_block", "doc_id", "term").agg(F.count("*").alias("tf"))
    asked = written(counts.groupBy("_block", "term").agg(F.count("*").alias("n")))
    vocabulary = written(asked.groupBy("term").agg(F.sum("n").alias("df")).withColumn("id", F.monotonically_increasing_id()))
    known = asked.select("_block", "term").join(vocabulary, "term")
    whole = counts.join(known.hint("shuffle_hash"), ["_block", "term"]).groupBy("_block", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("df", "id", "tf"))).alias("_v"))
    of = lambda c, kind: F.transform("_v", lambda x: x[c].cast(kind))
    with _dealt_stays(dealt.sparkSession):
        # A block is the bucket of its documents' ids, so the vectors are written where they lie and joins by doc_id read them in place.
        rows = bucketed(whole.select("doc_id", of("df", "int").alias("dfs"), of("id", "long").alias("ids"), of("tf", "int").alias("tfs")),
                        texts.blocks, "doc_id")
    return Vectors(rows, texts.n, texts.blocks)


def _prefix(n: int, threshold: float) -> Callable:
    """A vector's prefix.  The function carries all it needs, so that workers don't import this package."""
    bound = threshold - MARGIN

    def rows(dfs: pd.Series, ids: pd.Series, tfs: pd.Series) -> pd.Series:
        out = []
        for df, id, tf in zip(dfs, ids, tfs):
            w = (1 + np.log(tf)) * (np.log((1 + n) / (1 + np.asarray(df, dtype=np.float64))) + 1)
            w /= np.sqrt((w * w).sum())
            remaining = np.append(np.sqrt(np.cumsum((w * w)[::-1])[::-1]), 0.0)
            out.append([{"term": id[i], "weight": w[i], "rest": remaining[i + 1]} for i in range((remaining[:-1] >= bound).sum()) if df[i] > 1])
        return pd.Series(out)

    return F.pandas_udf(rows, "array<struct<term:long,weight:double,rest:double>>")


def prefixes(vectors: Vectors, threshold: float) -> DataFrame:
    """(doc_id, term, weight, rest): the terms of each vector that can be needed to find a partner, with the norm after each; terms of one
    document only are left out."""
    return vectors.rows.select("doc_id", F.inline(_prefix(vectors.n, threshold)("dfs", "ids", "tfs")))


def _cosines(n: int) -> Callable:
    """A cell's pairs, from the vectors that were sent there."""

    def compute(pairs: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if pairs.empty or sent.empty:
            return pd.DataFrame({"a": pairs["a"][:0], "b": pairs["b"][:0], "cosine": np.zeros(0)})
        ends = np.cumsum([len(x) for x in sent["ids"]])
        starts = np.append(0, ends[:-1])
        join = lambda c: np.concatenate(list(sent[c]))
        terms, at = np.unique(join("ids"), return_inverse=True)
        w = (1 + np.log(join("tfs"))) * (np.log((1 + n) / (1 + join("dfs").astype(np.float64))) + 1)
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), ends - starts)
        place = {d: i for i, d in enumerate(sent["doc_id"])}
        dense, found, last = np.zeros(len(terms)), np.empty(len(pairs)), -1
        pairs = pairs.sort_values("a")
        for k, (a, b) in enumerate(zip(pairs["a"].map(place), pairs["b"].map(place))):
            if a != last:
                if last >= 0:
                    dense[at[starts[last]:ends[last]]] = 0.0
                dense[at[starts[a]:ends[a]]] = w[starts[a]:ends[a]]
                last = a
            found[k] = dense[at[starts[b]:ends[b]]] @ w[starts[b]:ends[b]]
        return pd.DataFrame({"a": pairs["a"], "b": pairs["b"], "cosine": found})

    return compute


def cosines(candidates: DataFrame, vectors: Vectors) -> DataFrame:
    """(a, b, cosine) of the distinct candidate pairs (a, b, cell), whose vectors meet in one of the cells the pair is named with."""
    kind = dict(vectors.rows.dtypes)["doc_id"]
    groups = max(int(vectors.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * vectors.blocks)
    pairs = written(candidates.groupBy("a", "b").agg(F.min("cell").alias("cell")).select(F.pmod("cell", F.lit(groups)).cast("int").alias("g"), "a", "b"))
    sent = pairs.select(F.col("g").alias("cell"), F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(vectors.rows, "doc_id")
    return pairs.groupBy("g").cogroup(sent.groupBy("cell")).applyInPandas(_cosines(vectors.n), f"a {kind}, b {kind}, cosine double")


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _in_shards(pairs: DataFrame) -> DataFrame:
    """(a, b, cell) of pairs (term, a, b) of large buckets."""
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARDS))
    return pairs.select("a", "b", F.xxhash64("term", shard("a"), shard("b")).alias("cell"))


def _sized(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold two or more, with the bucket's size."""
    sizes = members.groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    return written(members.join(sizes, "term"))


def _bucket_pairs(members: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs (keys, a, b) of each bucket that can reach the threshold, if the bucket's last key is the first term they share."""
    side = lambda id: members.select(*keys, F.col("doc_id").alias(id), F.col("weight").alias(f"_w{id}"), F.col("rest").alias(f"_r{id}"),
                                     *[F.col("base").alias(f"_b{id}") for c in members.columns if c == "base"])
    most = F.col("_wa") * F.col("_wb") + F.col("_ra") * F.col("_rb")
    if "base" in members.columns:
        most = most + F.col("_ba") * F.col("_bb")
    return side("a").join(side("b"), keys).where((F.col("a") < F.col("b")) & (most >= threshold - MARGIN)).select(*keys, "a", "b")


def direct_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cell) of the buckets (term, doc_id, weight, rest), which are their own cells."""
    return _bucket_pairs(members, ["term"], threshold).select("a", "b", F.xxhash64("term").alias("cell"))


def pairs_by_second_term(members: DataFrame, vectors: Vectors, threshold: float) -> DataFrame:
    """(a, b, cell) of the buckets (term, doc_id, weight, rest) that also share a term of the longer prefix."""
    large = F.col("weight") >= sqrt(max(threshold - SECOND_NORM, 0.0)) - MARGIN
    longer = prefixes(vectors, SECOND_NORM).withColumnsRenamed({"term": "second"})
    split = members.where(~large).select("term", "doc_id", F.col("weight").alias("base")).join(longer, "doc_id").where(F.col("term") != F.col("second"))
    heavy = members.where(large).select("term", F.col("doc_id").alias("h"))
    against = heavy.join(members, "term").where(F.col("h") != F.col("doc_id")).select("term", *_ordered(F.col("h"), F.col("doc_id")))
    return _in_shards(_bucket_pairs(split, ["term", "second"], threshold).select("term", "a", "b").unionByName(against))


def similar_pairs(vectors: Vectors, threshold: float, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(a, b, cell): every pair that can reach the threshold, some of them more than once."""
    members = _sized(prefixes(vectors, threshold))
    pairs, crowded = direct_pairs(members.where(F.col("n") <= direct_rows), threshold), members.where(F.col("n") > direct_rows)
    return pairs if crowded.isEmpty() else pairs.unionByName(pairs_by_second_term(crowded, vectors, threshold))


def linking_pairs(vectors: Vectors, members: DataFrame, threshold: float, pivot_rows: int = PIVOT_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs to verify, pairs already verified by a pivot, with their cosine): enough to connect every group."""
    angle = acos(threshold)
    members = _sized(members)
    links, pairs = [], [direct_pairs(members.where(F.col("n") <= pivot_rows), threshold)]
    current = members.where(F.col("n") > pivot_rows).drop("n")
    while not current.isEmpty():
        pivot = current.groupBy("term").agg(F.min_by("doc_id", F.xxhash64("doc_id", "term")).alias("pivot"))
        toward = current.join(pivot, "term").where(F.col("doc_id") != F.col("pivot"))
        pivots = toward.select("term", *_ordered(F.col("doc_id"), F.col("pivot")))
        seen = cut_lineage(cosines(_in_shards(pivots), vectors))
        placed = cut_lineage(toward.withColumns(dict(zip(["a", "b"], _ordered(F.col("doc_id"), F.col("pivot"))))).join(
            seen, ["a", "b"], "left").select(
            "term", "pivot", "doc_id", "weight", "rest",
            F.acos(F.least(F.coalesce("cosine", F.lit(0.0)), F.lit(1.0))).alias("angle"),
            (F.coalesce("cosine", F.lit(0.0)) >= threshold).alias("linked")))
        links.append(seen)
        inside, outside = placed.where("linked"), placed.where(~F.col("linked"))
        # Band join: an outsider needs only members whose angle to the pivot is within one threshold angle of its own.
        band = lambda a: F.floor(a / F.lit(angle)).cast("int")
        near = outside.where(F.col("angle") <= 2 * angle + MARGIN).select(
            "term", F.col("doc_id").alias("o"), F.col("angle").alias("oa"),
            F.explode(F.array(band(F.col("angle")) - 1, band(F.col("angle")))).alias("band"))
        across = near.join(inside.select("term", F.col("doc_id").alias("m"), F.col("angle").alias("ma"),
                                         band(F.col("angle")).alias("band")), ["term", "band"])
        pairs.append(_in_shards(across.where(F.col("oa") - F.col("ma") <= angle + MARGIN).select("term", *_ordered(F.col("o"), F.col("m")))))
        state = placed.groupBy("term").agg(F.count_if(~F.col("linked")).alias("n"), (F.count_if("linked") >= FAIR_SHARE * F.count("*")).alias("goes_on"))
        rest = cut_lineage(outside.select("term", "doc_id", "weight", "rest").join(state.where("n > 1"), "term"))
        pairs.append(direct_pairs(rest.where(F.col("n") <= pivot_rows), threshold))
        crowded = rest.where(F.col("n") > pivot_rows)
        pairs.append(pairs_by_second_term(crowded.where(~F.col("goes_on")), vectors, threshold))
        current = cut_lineage(crowded.where("goes_on").select("term", "doc_id", "weight", "rest"))
    return reduce(DataFrame.unionByName, pairs), links


def similar_edges(texts: DataFrame | Texts, threshold: float = fv.NEAR_DUP_COSINE, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(a, b, cosine): every pair of distinct texts (doc_id, text) with cosine >= threshold."""
    vectors = unigram_vectors(texts)
    return cosines(similar_pairs(vectors, threshold, direct_rows), vectors).where(F.col("cosine") >= threshold)


def linking_edges(texts: DataFrame | Texts, threshold: float = fv.NEAR_DUP_COSINE, skip: DataFrame | None = None, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(a, b, cosine) with cosine >= threshold, enough of them to connect every group of similar texts.

    Documents in skip (doc_id) count for the document frequencies but are not compared.
    """
    vectors = unigram_vectors(texts)
    members = prefixes(vectors, threshold)
    if skip is not None:
        members = members.join(skip, "doc_id", "left_anti")
    pairs, links = linking_pairs(vectors, members, threshold, pivot_rows)
    return reduce(DataFrame.unionByName, links, cosines(pairs, vectors)).where(F.col("cosine") >= threshold)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, component): component is the smallest id that can be reached."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    mark = _fingerprint(current)
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest node around it.
        ways = both(current)
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where(
            F.col("a") != F.col("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        current = cut_lineage(small)
        now = _fingerprint(current)
        if now == mark:
            break
        mark = now
    roots = current.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "doc_id")
    return nodes.select("doc_id").join(roots, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def same_bags(texts: DataFrame) -> DataFrame:
    """(doc_id, a): the smallest id of the texts with the same bag of words, for every text that has words.

    The sorted tokens of a text name its bag, so copies are linked without a comparison.
    """
    words = F.array_sort(tx.tokens(F.lower("text"), tx.WORD_TOKEN))
    bags = written(texts.select("doc_id", words.alias("_words")).where(F.size("_words") > 0).select(
        "doc_id", F.sha2(F.array_join("_words", " "), 256).alias("bag")))  # read for its groups and for its rows
    return bags.join(bags.groupBy("bag").agg(F.min("doc_id").alias("a")), "bag").select("doc_id", "a")


def similar_classes(docs: DataFrame, threshold: float = fv.NEAR_DUP_COSINE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, class_id, n_links) for every document, (a, b, cosine) of similar classes): the similarity join without expanded copies.

    A class is the documents with one bag of words, named by its smallest doc_id; two documents are linked if they are of one class or of
    similar ones, and n_links counts a document's partners.  N copies make N rows of the first table and no pair, and what is compared and
    counted is classes only.  Texts without words are a class if they are equal; null counts as the empty text; rows are kept as they are.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.sha2("text", 256))
    dealt = dealt_texts(keyed.groupBy("_text").agg(F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text")), text_chars(docs))
    owners = keyed.groupBy("_text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    placed = cut_lineage(owners.join(same_bags(dealt.rows), "doc_id", "left").select(
        "_text", "doc_id", F.coalesce("a", "doc_id").alias("class_id"), "copies"))
    sizes = placed.groupBy("class_id").agg(F.sum("copies").alias("size"))
    followers = placed.where(F.col("class_id") != F.col("doc_id")).select("doc_id")
    vectors = unigram_vectors(dealt)
    firsts = Vectors(vectors.rows.join(followers, "doc_id", "left_anti"), vectors.n, vectors.blocks)
    edges = cut_lineage(cosines(similar_pairs(firsts, threshold), firsts).where(F.col("cosine") >= threshold))
    ends = edges.select(F.col("a").alias("class_id"), F.col("b").alias("_other")).unionByName(
        edges.select(F.col("b").alias("class_id"), F.col("a").alias("_other")))
    partners = ends.join(sizes.select(F.col("class_id").alias("_other"), "size"), "_other").groupBy("class_id").agg(F.sum("size").alias("_linked"))
    links = sizes.join(partners, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("_linked", F.lit(0))).alias("n_links"))
    rows = keyed.select("doc_id", "_text").join(placed.select("_text", "class_id").join(links, "class_id"), "_text")
    return rows.select("doc_id", "class_id", "n_links"), edges


def near_duplicate_groups(docs: DataFrame, threshold: float = fv.NEAR_DUP_COSINE) -> DataFrame:
    """(doc_id, group_id) for every document (doc_id, text); group_id is the smallest doc_id of the group."""
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("_text"), "text")
    owners = keyed.groupBy("_text").agg(F.min("doc_id").alias("owner"), F.any_value("text").alias("text"))
    texts = dealt_texts(owners.select(F.col("owner").alias("doc_id"), "text"), text_chars(docs))
    same = cut_lineage(same_bags(texts.rows).where(F.col("a") != F.col("doc_id")).select("a", F.col("doc_id").alias("b")))
    edges = linking_edges(texts, threshold, same.select(F.col("b").alias("doc_id")))
    components = connected_components(texts.rows, edges.select("a", "b").unionByName(same))
    owned = keyed.select("doc_id", "_text").join(owners.select("_text", "owner"), "_text")
    return owned.join(components.withColumnRenamed("doc_id", "owner"), "owner").select(
        "doc_id", F.col("component").alias("group_id"))
