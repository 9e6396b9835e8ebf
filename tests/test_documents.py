import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import lexical as lx
from pairloom.operators import near_duplicates as nd
from pairloom.operators import prepare as pp
from pairloom.operators import semantic as se
from pairloom.operators import split as sp
from pairloom.sources import store

RAW = "resume_text string, job_description_text string, label string"
SPELLINGS = ["No Fit", "potential fit", " Good Fit "]


def raw_rows():
    return [(f"Ferry pilot number {r} crosses the sound {3 * r} times", f"Harbour {j} wants a calm hand at the wheel", SPELLINGS[(r + j) % 3])
            for r in range(5) for j in range(2)]


def prepared(spark, rows):
    clean = pp.clean_pairs(pp.select_renamed(spark.createDataFrame(rows, RAW))).withColumn("at", F.monotonically_increasing_id())
    settled = pp.settle_pairs(clean.where(~F.col("is_empty")), ["candidate_id", "posting_id"], "label_id", [F.col("at")])
    return clean, settled



def test_pairs_are_settled_in_one_shuffle(spark):
    rows = [(1, 1, 0, 5), (1, 1, 0, 3), (1, 1, 2, 4), (1, 2, None, 1), (1, 2, 1, 0), (None, 3, 1, 2), (None, 3, 1, 2)]
    settled = pp.settle_pairs(spark.createDataFrame(rows, "posting_id int, candidate_id int, label_id int, at int"),
                              ["posting_id", "candidate_id"], "label_id", [F.col("at")])
    assert settled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in settled.collect()} == {(1, 1, 0, 3, 3, 2), (1, 2, 1, 0, 2, 2), (None, 3, 1, 2, 2, 1)}

def test_drops_by_cause(spark):
    rows = raw_rows()
    rows += [rows[0], (rows[1][0], rows[1][1], "Good Fit" if rows[1][2].strip() != "Good Fit" else "No Fit"), ("  ", rows[2][1], "No Fit")]
    clean, settled = prepared(spark, rows)
    report = {r["metric"]: r["value"] for r in pp.drop_report(clean, settled).collect()}
    assert report == {"raw_rows": 13, "dropped_empty": 1, "dropped_exact_duplicates": 1, "dropped_conflicting_pairs": 2, "rows": 9}
    kept = pp.without_conflicts(settled).withColumn("candidate_group", F.col("candidate_id"))
    assert pp.validate(kept).count() == 9
    with pytest.raises(ValueError, match="duplicate_pair"):
        pp.validate(kept.unionByName(kept))


def test_original_split_leakage(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "train"), ("a", "test"), ("d", "test")], "candidate_id string, original_split string")
    assert tuple(pp.original_split_leakage(df).first()) == (2, 1, 0.5)


def test_near_copies_share_a_group(spark):
    texts = ["Harbour pilot with night crossings, fog signals and two winters of ice", "Harbour pilot; with night crossings, fog signals and two winters of ICE!",
             "Keeps bees on the roof of a school"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r["doc_id"]: r["group_id"] for r in nd.near_duplicate_groups(df).collect()}
    assert groups == {0: 0, 1: 0, 2: 2}


def vectors(texts):
    docs = [Counter(re.findall(r"\w\w+", t.lower())) for t in texts]
    df = Counter(w for d in docs for w in d)
    out = []
    for d in docs:
        v = {w: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, c in d.items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        out.append({w: x / n for w, x in v.items()})
    return out


def brute_groups(texts, threshold=0.9):
    vs = vectors(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(vs)):
        for j in range(i):
            if sum(x * vs[j].get(w, 0) for w, x in vs[i].items()) >= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


def test_groups_match_brute_force(spark):
    """Many near copies of two texts, chains of edits and unrelated texts."""
    rng = random.Random(11)
    words = [f"w{i:03d}" for i in range(400)]
    bases = [rng.sample(words, 40) for _ in range(12)]
    texts = []
    for i in range(90):
        base = list(bases[0 if i < 40 else rng.randrange(12)])
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            base[rng.randrange(40)] = rng.choice(words)
        texts.append(" ".join(base))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in nd.near_duplicate_groups(df).collect()}
    assert got == brute_groups(texts)


def test_unlike_texts_in_one_crowded_bucket(spark):
    """Texts that share two rare terms and little else: no pivot links a fair share, so the bucket is split again."""
    rng = random.Random(7)
    texts = []
    for i in range(60):
        own = [f"u{i}x{k}" for k in range(rng.choice([0, 1, 6]))] + rng.sample([f"c{k}" for k in range(30)], 6)
        texts.append(" ".join(["rare", "odd", *own]))
    texts += [texts[0] + " zz", texts[5] + " yy c1", "rare", "rare rare odd"]
    texts += [f"filler{i} plain{i % 9} words{i % 4}" for i in range(80)]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in nd.near_duplicate_groups(df, threshold=0.7).collect()} == brute_groups(texts, 0.7)


def test_all_edges_of_a_large_bucket(spark):
    """Hundreds of near copies of one text: every similar pair is found, and the groups are those of all pairs."""
    rng = random.Random(23)
    base = [f"m{i:03d}" for i in range(400)]
    texts = [" ".join([*base, *rng.sample([f"e{k:04d}" for k in range(5000)], 1)]) for _ in range(260)]
    texts = list(dict.fromkeys(texts)) + [f"other{i} thing{i % 7} word{i % 3}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vs = vectors(texts)
    want = {(j, i) for i in range(len(vs)) for j in range(i) if sum(x * vs[j].get(w, 0) for w, x in vs[i].items()) >= 0.9}
    assert {(r["a"], r["b"]) for r in nd.similar_edges(df).collect()} == want and len(want) > 5_000
    assert {r["doc_id"]: r["group_id"] for r in nd.near_duplicate_groups(df).collect()} == brute_groups(texts)


def crowded_texts():
    """Near copies of three texts, and short texts that share a term and little else."""
    rng = random.Random(5)
    bases = [[f"b{k}w{i:02d}" for i in range(40)] for k in range(3)]
    texts = []
    for i in range(75):
        base = list(bases[i % 3])
        for _ in range(rng.choice([0, 1, 2, 3])):
            base[rng.randrange(40)] = f"x{rng.randrange(60)}"
        texts.append(" ".join(base))
    texts += [" ".join(["rare", "odd", *rng.sample([f"c{k}" for k in range(12)], 3)]) for _ in range(60)]
    return list(dict.fromkeys(texts))


def all_pairs(texts):
    vs = vectors(texts)
    return {(j, i) for i in range(len(vs)) for j in range(i) if sum(x * vs[j].get(w, 0) for w, x in vs[i].items()) >= 0.9}


def test_edges_of_split_buckets_are_those_of_all_pairs(spark):
    texts = crowded_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = all_pairs(texts)
    got = [(r["a"], r["b"]) for r in nd.similar_edges(df, direct_rows=4).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_small_buckets_are_not_multiplied_by_second_terms(spark):
    """A long text's few partners are found from its rare terms alone: as many rows as pairs of the buckets, and each vector is one row."""
    common = [f"c{i:03d}" for i in range(150)]
    texts = [" ".join([*common[i % 7:], *[f"r{i // 2}x{k}" for k in range(30)]]) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = nd.unigram_vectors(df)
    assert found.rows.count() == 120 and found.n == 120
    assert nd.similar_pairs(found, 0.9).count() <= 60 * 30
    assert {(r["a"], r["b"]) for r in nd.similar_edges(df).collect()} == all_pairs(texts)


def test_groups_through_pivots_are_those_of_all_pairs(spark):
    texts = crowded_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edges = nd.linking_edges(df, pivot_rows=4)
    assert {r["doc_id"]: r["component"] for r in nd.connected_components(df, edges).collect()} == brute_groups(texts)


def test_a_vector_is_sent_once_to_a_cell_and_meets_all_its_partners_there(spark):
    """One row a distinct pair, whatever number of buckets it was found in, with the exact cosine."""
    texts = crowded_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = nd.unigram_vectors(df)
    pairs = spark.createDataFrame([(a, b, cell) for a in range(20) for b in range(a + 1, 20) for cell in (a, b, 7 - a)], "a long, b long, cell long")
    got = {(r["a"], r["b"]): r["cosine"] for r in nd.cosines(pairs, found).collect()}
    vs = vectors(texts)
    assert len(got) == 190
    assert all(abs(c - sum(x * vs[b].get(w, 0) for w, x in vs[a].items())) < 1e-9 for (a, b), c in got.items())


def test_similar_classes_equal_all_pairs(spark):
    """Thousands of copies, the same words in another order, near copies, texts without words, nulls and repeated rows."""
    rng = random.Random(29)
    base = [f"m{i:03d}" for i in range(60)]
    near = [" ".join([*base, *rng.sample([f"e{k:02d}" for k in range(40)], 2)]) for _ in range(12)]
    texts = near + [" ".join(reversed(near[0].split())), near[1].upper()] + [" ".join(base)] * 3000 + ["", None, "!", "a", "! "] + ["one two", "one  two"]
    texts += [f"other{i} thing{i % 7} word{i % 3}" for i in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows] + [(rows[0][0], rows[0][1], 5, "x")], "doc_id long, text string, class_id int, _text string")
    got, pairs = nd.similar_classes(df)
    plain = ["" if t is None else t for t in [*texts, texts[0]]]
    kinds = list(dict.fromkeys(plain))
    vs, n = vectors(kinds), Counter(plain)
    links = {k: n[k] - 1 + sum(n[o] for j, o in enumerate(kinds) if j != i and sum(x * vs[j].get(w, 0) for w, x in vs[i].items()) >= 0.9)
             for i, k in enumerate(kinds)}
    bag = lambda t: tuple(sorted(re.findall(r"\w\w+", t.lower()))) or t
    first = {}
    for i, t in enumerate(plain[:-1]):
        first.setdefault(bag(t), i)
    rows_got = got.collect()
    assert len(rows_got) == len(plain)
    assert all((r.class_id, r.n_links) == (first[bag(plain[r.doc_id])], links[plain[r.doc_id]]) for r in rows_got)
    assert pairs.count() <= 13 * 12 // 2  # classes only
    assert nd.similar_classes(df.limit(0))[0].count() == 0


def test_texts_are_written_once_and_not_dealt_again(spark, monkeypatch):
    rows = [(i, f"rope sail mast deck hull{i % 7} keel{i % 5}") for i in range(60)] + [(99, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, plans = [], []
    cut, write = nd.cut_lineage, nd.written
    monkeypatch.setattr(nd, "cut_lineage", lambda x: kept.append(x.columns) or cut(x))
    monkeypatch.setattr(nd, "written", lambda x: plans.append(x) or write(x))
    groups = {r["doc_id"]: r["group_id"] for r in nd.near_duplicate_groups(df).collect()}
    assert groups[99] == 99 and len(groups) == 61 and groups[35] == 0
    assert not any("text" in c for c in kept) and not any("text" in x.columns for x in plans)
    texts = nd.dealt_texts(df)
    counts = texts.rows.select("_block", "doc_id", F.explode(F.split("text", " ")).alias("term")).groupBy("_block", "doc_id", "term").count()
    assert texts.n == 61 and "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_long_chain_of_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 39)] + [(50, 55), (55, 52)], "a long, b long")
    got = {r["doc_id"]: r["component"] for r in nd.connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(40)} == {0} and got[45] == 45 and got[52] == got[55] == 50


CORPUS = ["Tide tables and fog.js with the night ferry", "Night ferry crew with knots, tide tables and rope", "Orchard hands with ladders",
          "Beekeeper with smoke and rope", "G++ and A# charts with fog.js"]


def test_lexical_scores(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(CORPUS)], "doc_id string, text string")
    vocabulary = lx.fit_vocabulary(docs.unionByName(docs), min_df=1, max_df=1.0)
    terms = {r["term"] for r in vocabulary.collect()}
    assert {"g++", "a#", "fog.js", "rope", "tide tables", "night ferry"} <= terms
    weights = lx.transform(lx.term_counts(docs), vocabulary)
    left, right = weights.withColumnRenamed("doc_id", "candidate_id"), weights.withColumnRenamed("doc_id", "posting_id")
    pairs = spark.createDataFrame([("1", "1"), ("1", "3"), ("1", "7")], "candidate_id string, posting_id string")
    score = {(r["candidate_id"], r["posting_id"]): r["score"] for r in lx.pair_scores(pairs, left, right).collect()}
    assert score[("1", "1")] == pytest.approx(1) and 0 < score[("1", "3")] < 1 and score[("1", "7")] == 0
    kept = {r["term"] for r in lx.fit_vocabulary(docs).collect()}
    assert "rope" in kept and "with" not in kept and "orchard" not in kept


def test_bag_cosine_defaults(spark):
    df = spark.createDataFrame([(1, "spark jobs spark", "spark jobs"), (2, "", "spark"), (3, "alpha", "omega")], "k int, a string, b string")
    got = {r["k"]: r["similarity"] for r in lx.bag_cosine(df, ["k"], "a", "b").collect()}
    assert got[1] == pytest.approx(3 / math.sqrt(10)) and got[2] == 0.5 and got[3] == 0.0


def grouped(spark):
    rng = random.Random(4)
    rows = [(f"g{g}", f"r{g}", f"j{rng.randrange(30)}", rng.randrange(3)) for g in range(200) for _ in range(4)]
    return spark.createDataFrame(rows, "candidate_group string, candidate_id string, posting_id string, label_id int")


def test_splits(spark):
    pairs = sp.grouped_split(grouped(spark))
    counts = {r["split"]: r["unique_groups"] for r in sp.split_summary(pairs).collect()}
    assert counts == {"train": 140, "validation": 30, "test": 30}
    report = sp.leakage_report(pairs)
    assert report.where("leaks").count() == 0
    sp.require_no_leakage(report)
    train = pairs.where("split = 'train'")
    leaky = train.unionByName(train.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="shared"):
        sp.require_no_leakage(sp.leakage_report(leaky))


def test_repetitions(spark):
    pairs = grouped(spark)
    folds = sp.stratified_group_folds(pairs)
    assert sorted(folds.collect()) == sorted(sp.stratified_group_folds(grouped(spark)).collect())
    rows = pairs.join(sp.rotate_repetitions(folds), "candidate_group")
    assert rows.groupBy("candidate_group", "repetition").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {(r["repetition"], r["split"]): r["n"] / 800 for r in rows.groupBy("repetition", "split").agg(F.count("*").alias("n")).collect()}
    assert len({r for r, _ in share}) == 5 and all(abs(v - 0.15) <= 0.04 for (_, s), v in share.items() if s != "train")
    tests = rows.where("split = 'test'").select("candidate_group", "repetition").distinct()
    assert tests.groupBy("candidate_group").count().where("count > 1").count() == 0


def test_chunks_and_pooling(spark):
    docs = spark.createDataFrame([("t", " ".join(f"w{i}" for i in range(20))), ("e", "")], "text_id string, text string")
    sizes = [r["n_tokens"] for r in se.chunk_windows(docs.where("text_id = 't'"), 6).orderBy("chunk").collect()]
    assert sizes == [6, 6, 6, 2] and se.chunk_windows(docs, 6, "truncate").count() == 2
    rows = [("t", 0, 3, [1.0, 0.0]), ("t", 1, 1, [0.0, 1.0])]
    vec = se.pool_chunks(spark.createDataFrame(rows, "text_id string, chunk int, n_tokens int, vec array<float>")).first()["vec"]
    assert vec == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])


def test_cache_encodes_only_new_texts(spark, tmp_path):
    calls = []

    def encoder(chunks):
        calls.append(chunks.count())
        return se.hashed_bag_encoder(256)(chunks)

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    path = str(tmp_path / "cache")
    store.extend_embedding_cache(spark, path, texts("spark jobs", "spark  jobs", "bread"), encoder)
    table = store.extend_embedding_cache(spark, path, texts("bread", "cake"), encoder)
    assert calls == [2, 1] and table.count() == 3
    # Other settings have vectors of their own.
    assert store.extend_embedding_cache(spark, path, texts("bread"), encoder, strategy="truncate").count() == 1
    assert store.extend_embedding_cache(spark, path, texts("bread"), encoder, encoder_name="other").count() == 1 and calls == [2, 1, 1, 1]
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-5 for r in table.collect())


def test_texts_without_words_have_no_direction(spark, tmp_path):
    from pairloom.catalog import documents
    texts = spark.createDataFrame([(1, "rope and sails"), (2, "  "), (3, "")], "doc_id long, text string")
    got = {r["text_id"]: r["vec"] for r in se.encode_texts(texts, se.hashed_bag_encoder(16), 128).collect()}
    assert len(got) == 2 and sorted(round(sum(x * x for x in v), 5) for v in got.values()) == [0.0, 1.0]
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    assert documents.hashed_embeddings(spark, str(tmp_path)).count() == 1  # as in SQL


def test_alignment(spark):
    pairs = spark.createDataFrame([("c", "p"), ("c", "q")], "candidate_id string, posting_id string")
    duties = spark.createDataFrame([("p", 5, [1.0, 0.0]), ("p", 9, [0.0, 1.0])], "posting_id string, at int, vec array<float>")
    held = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("c", 0, [0.6, 0.8])], "candidate_id string, at int, vec array<float>")
    got = {r["posting_id"]: r for r in se.alignment(
        pairs, se.vector_blocks(duties, "posting_id", "at"), se.vector_blocks(held, "candidate_id", "at"), 2).collect()}
    assert got["p"]["responsibility_similarity"] == pytest.approx(0.9, abs=1e-6)
    assert tuple(got["p"]["best"][0]) == (0, 1, 1.0) and tuple(got["p"]["best"][1])[:2] == (1, 0) and got["q"]["responsibility_similarity"] is None and got["q"]["best"] == []


def test_alignment_of_long_documents_is_that_of_the_whole_matrix(spark):
    rng = np.random.default_rng(7)
    vectors = {name: rng.normal(size=(n, 6)).astype(np.float32) for name, n in (("p", 150), ("q", 64), ("c", 300), ("d", 1))}
    vectors["c"][200] = vectors["c"][10] = vectors["p"][3]  # equal sentences in blocks of different shapes: the first one wins
    rows = lambda names: [(n, i, [float(x) for x in v]) for n in names for i, v in enumerate(vectors[n])]
    blocks = lambda names, id: se.vector_blocks(spark.createDataFrame(rows(names), f"{id} string, at int, vec array<float>"), id, "at")
    duties, held = blocks("pq", "posting_id"), blocks("cd", "candidate_id")
    assert duties.agg(F.max(F.size("flat"))).first()[0] == 64 * 6
    pairs = spark.createDataFrame([(c, p) for c in "cd" for p in "pq"], "candidate_id string, posting_id string")
    for r in se.alignment(pairs, duties, held, 6).collect():
        whole = vectors[r["posting_id"]].astype(float) @ vectors[r["candidate_id"]].astype(float).T
        best = whole.max(axis=1)
        assert r["responsibility_similarity"] == pytest.approx(best.mean())
        assert [b["duty"] for b in r["best"]] == np.argsort(-best, kind="stable")[:3].tolist()
        assert all(b["evidence"] == whole[b["duty"]].round(12).argmax() for b in r["best"])
    three = {r["duty"]: r["evidence"] for r in se.best_evidence(pairs.where("candidate_id = 'c' and posting_id = 'p'"), duties, held, 6).collect()}
    assert len(three) == 150 and three[3] == (vectors["p"][3].astype(float) @ vectors["c"].astype(float).T).round(12).argmax()


def test_pooling_many_chunks(spark):
    rng = np.random.default_rng(2)
    for dim in (1, 15, 16, 40):
        parts, sizes = rng.normal(size=(500, dim)).astype(np.float32), rng.integers(1, 9, 500)
        rows = [("t", i, int(n), [float(x) for x in v]) for i, (v, n) in enumerate(zip(parts, sizes, strict=True))] + [("e", 0, 1, [])]
        df = spark.createDataFrame(rows, "text_id string, chunk int, n_tokens int, vec array<float>").repartition(5)
        got = {r["text_id"]: r["vec"] for r in se.pool_chunks(df).collect()}
        want = (parts.astype(float) * sizes[:, None]).sum(axis=0)
        assert got["t"] == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-6) and got["e"] == []
