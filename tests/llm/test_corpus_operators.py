"""Mixing, near copies, quality, toxicity, licences and the pipeline against plain versions and hand-made cases."""

import collections
import importlib.util
import math
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import licenses, mixing, near_copies, quality, toxicity
from pairloom.llm.boosting import BoostedTrees
from pairloom.llm.common import text_bytes

RNG = np.random.default_rng(11)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 8))) for _ in range(3000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


# Mixing

def plain_targets(sizes, weights, budget, epochs):
    """Round by round: clamp what is above its cap, share the rest again."""
    left, free, out = budget * sum(sizes.values()), set(sizes), {}
    while free:
        shares = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        above = {s for s in free if shares[s] > epochs * sizes[s]}
        if not above:
            return out | shares
        for s in above:
            out[s] = epochs * sizes[s]
            left -= out[s]
        free -= above
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_its_targets(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(int(rng.integers(1, 9))):
        for _ in range(int(rng.integers(1, 60))):
            rows.append((len(rows), None if s == 3 else f"s{s}", " ".join("w" * int(rng.integers(0, 400 if s % 2 else 30)))))
    rows += [(10_000, "empty", None), (10_001, "empty", " \t"), (None, "s0", "a b"), (None, "s0", "a b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = plain_targets(sizes, weights, 1.5, 2)
    source_of = {r[0]: r[1] for r in rows}
    taken = collections.Counter()
    for r in got:
        source = source_of[r.doc_id] if r.doc_id is not None else "s0"
        assert r.source_size == sizes[source] and math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert key(got[0])


def test_mix_of_nothing(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_mix_holds_the_texts(spark):
    rows = [(i, f"s{i % 3}", f" w{i}a\tw{i}b  " * (1 + i % 7 + 40 * (i % 3 == 2)), i) for i in range(60)]
    rows += [(None, "s2", "x y\n z", 7)] * 3 + [(70, "one", "p q r", 1)] * 4 + [(71, "one", "p q s", 2)] * 3 + [(80, None, None, 5), (81, None, "u", 5)]
    table = spark.createDataFrame([(*r, len(r[2] or "")) for r in rows], "doc_id long, source string, text string, size int, n_chars int")
    got = mixing.mixed_documents(table).collect()
    assert mixing.mixed_documents(table).columns == [*table.columns, "repetition", "taken"]
    want = collections.Counter()
    for r in mixing.mixed(table).collect():
        want[r.doc_id] += r.taken
    words, originals, cut = collections.Counter(), {(r[0], r[1], r[3], r[2]) for r in rows}, collections.Counter()
    for r in got:
        assert len(r.text.split()) == r.taken > 0 and r.repetition >= 1
        words[r.doc_id] += r.taken
        if (r.doc_id, r.source, r["size"], r.text) not in originals:
            cut[r.source] += 1
            assert any(o[:3] == (r.doc_id, r.source, r["size"]) and o[3].startswith(r.text) for o in originals) and r.n_chars == len(r.text)
    assert words == +want and cut and max(cut.values()) == 1 and max(r.repetition for r in got) > 1


def test_border_among_repeated_rows(spark):
    table = spark.createDataFrame([(1, "a", "p q r s t")] * 5 + [(2, "b", "w " * 9)] * 30, "doc_id long, source string, text string")
    got = mixing.mixed_documents(table, weights=(3, 7), budget=0.5, max_epochs=1).collect()
    sums = collections.Counter()
    for r in got:
        assert len(r.text.split()) == r.taken
        sums[r.source] += r.taken
    assert sums == {"a": 25, "b": 123} and sorted(r.taken for r in got if r.doc_id == 2) == [6] + [9] * 13


# Near copies

def edited(text, n, rng):
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = "zz" + words[i]
    return " ".join(words)


def plain_classes(rows, idf):
    shingles = {k: near_copies.weighted_shingles(text_bytes(t), idf) for k, t in rows}
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    texts = dict(rows)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (texts[a] or "") == (texts[b] or "") or near_copies.weighted_jaccard(shingles[a], shingles[b]) >= near_copies.SIMILARITY:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: root(k) for k in keys}


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    base = prose(150, rng)
    rows += [(len(rows) + i, edited(base, int(rng.integers(0, 9)), rng)) for i in range(160)]  # one large group, most links over 0.7
    chain = prose(120, rng)
    for _ in range(12):  # every link is near, the ends are far apart
        chain = edited(chain, 2, rng)
        rows.append((1000 + len(rows), chain))
    shared = prose(60, rng)
    rows += [(2000 + i, shared + " " + prose(60, rng)) for i in range(60)]  # half of each text is the same
    rows += [(3000 + i, prose(int(rng.integers(1, 80)), rng)) for i in range(60)]
    rows += [(4000, None), (4001, ""), (4002, "?!"), (4003, "one two"), (4004, "One, two"), (4005, rows[170][1])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in near_copies.near_copies(docs.repartition(6)).collect()}
    want = plain_classes(rows, near_copies.inverse_frequencies(docs))
    wrong = [k for k in want if got[k] != want[k]]
    assert len(got) == len(rows) and not wrong
    kept = near_copies.first_of_each_class(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_near_copies_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_copies.near_copies(spark.createDataFrame([], schema)).count() == 0
    text = prose(40)
    docs = spark.createDataFrame([(None, text), (None, "x y z"), (5, text), (5, text), (6, "other words here"), (5, "quite different now")], schema)
    got = near_copies.near_copies(docs).collect()
    assert len(got) == 6 and {r.class_id for r in got if r.doc_id == 5} == {next(r.class_id for r in got if r.doc_id is None and r.class_id == min(
        x.class_id for x in got if x.doc_id == 5))}
    kept = near_copies.first_of_each_class(docs).collect()
    assert len(kept) == 3


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(4)
    idf = np.ones(near_copies.FEATURES)
    near, agree = [], []
    for _ in range(60):
        a = prose(200, rng)
        b = edited(a, int(rng.integers(1, 14)), rng)
        x, y = (near_copies.weighted_shingles(t.encode(), idf) for t in (a, b))
        near.append(near_copies.weighted_jaccard(x, y))
        agree.append((near_copies.samples(*x) == near_copies.samples(*y)).mean())
    assert abs(np.mean(near) - np.mean(agree)) < 0.03
    x = near_copies.weighted_shingles((prose(50, rng) + " a b c d e" * 5).encode(), idf)
    heavier = (x[0], x[1] * np.where(np.arange(len(x[0])) % 2, 3, 1))
    exact = near_copies.weighted_jaccard(x, heavier)
    assert abs((near_copies.samples(*x) == near_copies.samples(*heavier)).mean() - exact) < 0.25


# Quality

quality_words = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def plain_grams(text, order=quality.ORDER):
    """Symbol by symbol: a word equal to the one before it, one byte apart, is one symbol with that byte."""
    data, words, grams, at = b"\x02" * (order - 1) + text + b"\x03", {}, [], 0
    for m in quality_words.finditer(text):
        words[m.start()] = m
    last = None
    while at <= len(text):
        if at in words:
            last = words[at]
        after = words.get(at + 1)
        if last and after and last.end() == at and after[0].lower() == last[0].lower():
            grams.append(data[at : at + order - 1] + b"\xff")
            last, at = after, after.end()
        else:
            grams.append(data[at : at + order])
            at += 1
    return grams


def plain_kneser_ney(texts, order=quality.ORDER):
    """The textbook recursion over dictionaries."""
    counts = {order: collections.Counter()}
    for t in texts:
        counts[order].update(plain_grams(t))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount = {k: quality.discounts(collections.Counter(c.values())) for k, c in counts.items()}
    followers = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            followers[k][g[:-1]].append(n)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        held = followers[k].get(gram[:-1])
        if not held:
            return p(gram[1:])
        d, n = discount[k], counts[k].get(gram, 0)
        return (n - d[min(n, 3)] + sum(d[min(m, 3)] for m in held) * p(gram[1:])) / sum(held)

    return p


def test_probabilities_equal_the_recursion(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(int(rng.integers(1, 40)), rng) if i % 3 else prose(5, rng).upper() + "é!", "xy"[i % 2]) for i in range(60)] + [(90, None, "x"), (91, "", None)]
    for i, tail in enumerate([" no no No.", "la la  la la", "go-go go", "so", "é é é\né"]):
        rows[i] = (i, tail if i % 2 else rows[i][1] + tail, rows[i][2])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i,) for i in range(60) if i % 3] + [(None,), (1,)], "doc_id long")
    p = plain_kneser_ney([rows[i][1].encode() for i in range(60) if i % 3])
    assert math.isclose(sum(p(b"abcd" + bytes([c])) for c in range(256)), 1, rel_tol=1e-9)
    for size in (1 << 20, 700):
        got = {r.doc_id: r for r in quality.perplexities(docs, good, size).collect()}
        assert len(got) == 62 and got[90].perplexity is None and got[91].perplexity is None
        for i in range(60):
            grams = plain_grams(rows[i][1].encode())
            want = math.exp(-np.mean([math.log(p(g)) for g in grams]))
            assert got[i].n_symbols == len(grams)
            assert math.isclose(got[i].perplexity, want, rel_tol=1e-4) and got[i].trusted == bool(i % 3)


def test_judgement(spark):
    rng = np.random.default_rng(9)
    rows = [(i, prose(40, rng), "a" if i % 2 else None, 1) for i in range(80)] + [(100, "%%% ### $$$ " * 30, "a", 1), (101, None, "b", 1), (102, prose(30, rng), "new", 1)]
    rows += [(None, prose(30, rng), "a", 1), (100, "%%% ### $$$ " * 30, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs, labels).collect()
    kept = {r.doc_id for r in out if r.keep}
    assert len(out) == len(rows) and 100 not in kept and 101 not in kept and {102, None} <= kept and len(kept & set(range(80))) >= 79
    accepted = quality.accepted(docs, labels)
    assert accepted.columns == docs.columns and {r.doc_id for r in accepted.collect()} == kept
    assert quality.judged(docs, labels.limit(0)).where("keep").count() == len(rows) - 1
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_texts_that_repeat_ordinary_words_go(spark):
    rng = np.random.default_rng(19)
    rows = [(i, prose(80, rng), "a") for i in range(300)]
    junk = [(1000 + i, " ".join(w for w in prose(6, rng).split() for _ in range(25)), "a") for i in range(20)]
    junk.append((1100, "word " * 200_000, "a"))
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judged(docs, labels).where("keep").collect()}
    assert not kept & {r[0] for r in junk} and len(kept) >= 295


def test_thresholds_of_small_languages_are_drawn_smoothly(spark):
    rng = np.random.default_rng(20)
    rows = [(i, prose(60, rng), "a") for i in range(400)] + [(1000 + i, prose(8, rng) + " " + prose(8, rng), "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    limits = []
    for n in (20, 60, 110, 200):
        labels = spark.createDataFrame([(i, 1, 0) for i in range(400)] + [(1000 + i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
        limits.append(quality.judged(docs, labels).where("lang = 'b'").agg({"threshold": "max"}).first()[0])
    assert max(limits) / min(limits) < 1.3


# Toxicity

def test_toxicity_from_positives_alone(spark):
    rng = np.random.default_rng(6)
    bad = ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(1800):
        toxic = i % 6 == 0
        words = prose(int(rng.integers(5, 60)), rng).split()
        if toxic:
            for w in rng.choice(bad, 2):
                words.insert(int(rng.integers(0, len(words))), w)
        rows.append((i, " ".join(words)))
        if i // 6 % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (None, ""), (0, rows[0][1])], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, toxicity.trained(docs, table)).collect()
    assert len(got) == 1803 and all(0 <= r.score <= 1 for r in got)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    tested = [(r.score >= 0.5, r.doc_id % 6 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1800]
    assert np.mean([a == b for a, b in tested]) > 0.97
    # Negative labels teach nothing: without them but for the prior the same texts are found.
    assert toxicity.trained(docs, table.limit(0)) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), None).count() == 0


# Boosted trees

def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97


# Licences

def test_licences_and_inheritance(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [(1, "repo/a/one.py", f"# {mit}.\ncode here"), (2, "repo/a/two.py", "nothing"), (3, "repo/LICENSE", gpl + "\n" + prose(200)),
            (4, "repo/b/c/deep.py", None), (5, "repo/b/NOTICE.txt", f"intro\n{licenses.TEMPLATES['Apache-2.0']}\n"), (6, "other/x.py", ""),
            (7, None, "text"), (8, "repo/b/c/deep.py", None), (9, "/repo//a/three.py", "the work is public"), (10, "other/y/COPYING", mit)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.origin, r.distance) for r in licenses.scanned(docs).collect()}
    assert got == {1: ("MIT", "own", 0), 2: ("GPL-3.0", "inherited", 1), 3: ("GPL-3.0", "own", 0), 4: ("Apache-2.0", "inherited", 1),
                   5: ("Apache-2.0", "own", 0), 6: (None, "none", None), 7: (None, "none", None), 8: ("Apache-2.0", "inherited", 1),
                   9: ("GPL-3.0", "inherited", 1), 10: ("MIT", "own", 0)}
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_cosines_equal_a_plain_version(spark):
    lines = [*licenses.TEMPLATES.values(), "Released under the MIT License and some more words", "the license", "GNU Public version 3 work",
             "Licensed under the Apache License"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(i + 100, prose(30)) for i in range(40)], "doc_id long, text string")
    idf, other, weights, _ = licenses.template_weights(docs, licenses.TEMPLATES, licenses.SIMILARITY)
    got = {r.id: (r.license, r.score) for r in licenses.matched_units(docs).where("unit = 1").collect()}
    for i, line in enumerate(lines):
        tf = collections.Counter(t for t in licenses.re.split(r"[^a-z0-9]+", line.lower()) if t)
        length = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in tf.items()))
        scores = {name: sum(n * idf[t] * w[t] for t, n in tf.items() if t in w) / length for name, w in weights.items()}
        best = min(scores, key=lambda s: (-round(scores[s], 6), s))
        if scores[best] >= licenses.SIMILARITY:
            assert got[i][0] == best and abs(got[i][1] - scores[best]) < 1e-6
        else:
            assert i not in got


# Pipeline

def test_pipeline_stages(spark, tmp_path):
    root = Path(__file__).resolve().parents[2]
    sys.path.insert(0, str(root))
    spec = importlib.util.find_spec("corpus_pipeline")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    rng = np.random.default_rng(12)
    rows = [(i, prose(60, rng), "en", f"s{i % 3}", 0, "k") for i in range(120)]
    item = prose(14, rng)
    rows += [(200, edited(rows[5][1], 1, rng), "en", "s0", 0, "k"), (201, prose(20, rng) + " " + item, "en", "s1", 0, "k"),
             (202, "%%% ### " * 60, "en", "s1", 0, "k"), (203, prose(300, rng) + " joe@mail.example.org", "en", "s2", 0, "k"), (204, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    ids = {}
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "mix" or docs.columns == columns
    everything = {r[0] for r in rows}
    assert everything - ids["quality"] == {202, 204}
    assert ids["quality"] - ids["near_copies"] == {200}
    assert ids["near_copies"] - ids["benchmark"] == {201}
    assert ids["benchmark"] == ids["personal_data"]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    assert text[203].endswith("<EMAIL>") and text[7] == rows[7][1]
    assert docs.count() == len(pipeline.run(spark, str(tmp_path)).collect())
    assert docs.agg(F.min("taken")).first()[0] > 0


def test_pipeline_ends_in_texts(spark):
    import corpus_pipeline
    table = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d e", "en", "s")], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.mix(spark, table, "").collect()
    assert sum(len(r.text.split()) for r in got) == 8 and {r.lang for r in got} == {"en"}
