"""Periodic runs, nearest vectors and turn repair against brute force, and their defined results on odd tables."""

import hashlib
import heapq
import random
import zlib

import duckdb
import numpy as np
import pytest

from pairloom.llm import neighbours, periodic_runs, turn_repair


# Periodic runs

def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_those_of_all_pairs(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 12)):
        letters, n = "abcdefgh"[: rng.choice([1, 2, 3, 8])], rng.choice([0, 1, 23, 24, 60, 300])
        words = [rng.choice(letters) for _ in range(n)]
        if n and rng.random() < 0.8:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            words = words[:a] + [words[a + (i - a) % min(p, n - a)] for i in range(a, n)] + [rng.choice(letters) for _ in range(rng.choice([0, 30]))]
        texts.append(words)
    texts += texts[:2]
    assert periodic_runs.runs_of(texts) == [plain_runs(w) for w in texts]


def test_agreement_is_that_of_the_sequence():
    rng = np.random.default_rng(5)
    body = np.concatenate([np.tile([1, 2, 3, 3], 40), rng.integers(1, 3, 200), np.tile([1], 90), np.tile([1, 2, 3, 3], 40)])
    symbols = np.concatenate([[0], body, [9]]).astype(np.int64)
    levels = periodic_runs.grammar(symbols)
    pairs = np.sort(rng.integers(1, len(symbols) - 1, (3000, 2)), axis=1)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    for step in (1, -1):
        got = periodic_runs.agreement(levels, pairs[:, 0], pairs[:, 1], step)
        for (i, j), n in zip(pairs.tolist(), got.tolist(), strict=True):
            k = 0
            while symbols[i + step * k] == symbols[j + step * k]:
                k += 1
            assert k == n


def test_runs_of_odd_tables(spark):
    line = "one two three four"
    long = " ".join(f"w{i}" for i in range(60_000)) + " end" * 40
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, " \n".join([line] * 9)), (4, " ".join([line] * 9)), (None, "x " * 30), (5, long),
            (6, "a a " * 24), (7, "x " * 23)]
    table = spark.createDataFrame([(*r, 0, "n") for r in rows], "doc_id long, text string, runs int, n_words string")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(table).collect()}
    assert len(got) == 8  # the two equal rows fall together here
    assert got[4, line] == [(0, 36, 4)] and got[None, "x"] == [(0, 30, 1)] and got[6, "a a"] == [(0, 24, 1)]
    assert got[7, " ".join(["x"] * 23)] == [] and got[1, ""] == got[2, ""] == got[3, ""] == []
    assert got[5, long.removesuffix(" end" * 39)] == [(60_000, 40, 1)]
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


def test_runs_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))) for i in range(120)] + [(7, None), (None, "a " * 50), (-12, "b c " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).where("doc_id <> 7 or doc_id is null").collect()}
    for doc_id, text in rows:
        if doc_id == 7:
            continue
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        want = (len(runs), *best, best[1] and best[1] * 1000 // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(got[doc_id])[1:] == want


# Nearest vectors

@pytest.mark.parametrize("kind", ["unit", "lengths", "groups"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((9000, 32))
    if kind == "groups":
        v = v * 0.4 + rng.standard_normal((30, 32))[rng.integers(0, 30, 9000)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= 2.0 ** rng.integers(-3, 8, (9000, 1))
    v = v.astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, table.where("vec_id % 100 = 0")).collect()
    queries = np.arange(0, 9000, 100)
    scores = v[queries] @ v.T
    scores[np.arange(len(queries)), queries] = -np.inf
    true = {int(q): set(np.argsort(-s)[:20].tolist()) for q, s in zip(queries, scores, strict=True)}
    assert len(got) == 20 * len(queries)
    found = [r for r in got if r.vec_id in true[r.query_id]]
    assert len(found) / len(got) >= 0.93
    for r in got:
        assert abs(r.score - float(v[r.query_id] @ v[r.vec_id])) < 1e-9 * max(1, abs(r.score)) and r.vec_id != r.query_id
    ranked = sorted(got, key=lambda r: (r.query_id, r["rank"]))
    assert all(a.score >= b.score for a, b in zip(ranked, ranked[1:], strict=False) if a.query_id == b.query_id)


def test_vectors_of_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
            (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (20, [1.0, 2.0, 3.0]), (40, [2.0, 0.0]), (60, [1e300, 1e300]),
            (80, [1e-300, 0.0])]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in neighbours.nearest(table, table.where("vec_id in (0, 2, 20, 3, 7)")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == {0, 2}  # nothing but itself has the length of 20
    # The one other copy of the query's own row stays; equal scores by id, null last.
    assert [got[0][k] for k in sorted(got[0])] == [(60, 1e300), (40, 2.0), (0, 1.0), (1, 1.0), (None, 1.0), (80, 1e-300), (2, 0.0)]
    assert [got[2][k][0] for k in sorted(got[2])] == [60, 0, 0, 1, 40, 80, None]
    none = table.limit(0)
    assert neighbours.nearest(none, table).count() == neighbours.nearest(table, none).count() == 0


def test_copies_and_grid_do_not_change_results(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((600, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[::3] = v[0]  # one vector holds a third of all rows
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0")
    key = lambda df: sorted(map(tuple, df.collect()))
    few = key(neighbours.nearest(table, queries, shard_rows=100, held_queries=7))
    assert few == key(neighbours.nearest(table.repartition(5), queries, shard_rows=100))
    assert [r[2] for r in few if r[0] == 0] == list(range(3, 63, 3))
    small = table.where("vec_id < 15")
    assert neighbours.nearest(small, queries).where("query_id = 0").count() == 14


# Turn repair

def plain_repair(codes):
    """Least (cost, edits) by a shortest-path search over (rows read, pattern place)."""
    follow, ends, roles = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3), "uuau"
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(codes) and s in ends:
            # Another end state of equal cost may have smaller edits.
            rest = [(c, a) for c, a, j, t in heap if j == len(codes) and t in ends and c == cost]
            return min([(cost, audit), *rest])
        heapq.heappush(heap, (cost + 2, audit + "I", i, follow[s][roles[s]]))
        if i < len(codes):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            if codes[i] != "-":
                own, extra = codes[i].lower(), int(codes[i].isupper())
                if own in follow[s]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, follow[s][own]))
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, follow[s][roles[s]]))


@pytest.mark.parametrize("seed", range(40))
def test_repair_is_the_cheapest_and_first(seed):
    rng = random.Random(seed)
    for _ in range(60):
        codes = "".join(rng.choice("uuuuaaaasUAx-" if rng.random() < 0.7 else "ua") for _ in range(rng.randint(0, 14)))
        cost, audit = turn_repair.repair(codes)
        assert (cost, audit) == plain_repair(codes), codes
        assert sum(e != "I" for e in audit) == len(codes)
        roles = "".join((codes[r].lower() if x is None else x[0]) for r, x in turn_repair.repaired_turns(codes, audit))
        assert roles.removeprefix("s").replace("ua", "") == "" and (roles != "s")


def test_repair_of_a_long_conversation():
    rng = random.Random(8)
    codes = "s" + "".join(rng.choice("uUuuuu-") + rng.choice("aAaaaau-") for _ in range(2500))
    cost, audit = turn_repair.repair(codes)
    assert cost > 0 and sum(e != "I" for e in audit) == len(codes)


def test_repair_query(spark, tmp_path):
    rng = random.Random(2)
    said = ["Hello.", "What?", "no end", "", " \t", "Yes!\n", "Hello."]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]),
             rng.choice([*said, None])) for c in [*range(60), None, -5] for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += rows[:40] + [(77, None, "user", "All null turns."), (77, None, "assistant", "Yes.")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    table.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    got = sorted(map(tuple, turn_repair.op13_turn_repair(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(turn_repair.OP13_SQL).fetchall(), key=str)
    assert got == want and len(got) == len({r[0] for r in rows})
    assert turn_repair.op13_turn_repair(spark, str(tmp_path / "none")).count() == 0


def test_conversation_whose_rows_are_all_dropped(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    (row,) = turn_repair.op13_turn_repair(spark, str(tmp_path)).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
