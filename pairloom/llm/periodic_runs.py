"""Periodic runs of words by recompression.

The words of many texts stand in one sequence, with a symbol of its own before each text.  It is compressed to a run-length grammar: by
turns, blocks of equal symbols and pairs of a left and a right symbol (a seeded coin per symbol and round) become one symbol.  Equal
stretches are compressed alike but for their edges, so how far the sequence agrees from two places on (or backwards) is read off the
grammar by climbing while the places agree and descending to the first difference, a bounded number of steps a level.

A run of period q and at least three periods covers three neighbours of the grid q, 2q, 3q, ... with equal words; these triples are the
candidates (n/q a period: harmonic, n log n in all), and two grammar queries give a candidate's exact extent.

Defined results: null, empty and blank texts have no words and no runs; repeated rows repeat their results; a text of any length is one
row and is compressed as a whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import U64, crc32_sql, mix, table, text_bytes

#: A run has at least so many words and so many periods.  Three grid places per run need three periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts are taken together up to so many words; a longer one is taken alone.  Bounds memory only, not results.
TOGETHER = 250_000
RUNS = "array<struct<start:long,length:long,period:long>>"


class Level(NamedTuple):
    symbols: np.ndarray
    #: For each symbol the place of the one it went into; for each of those its first place here, and the end.
    up: np.ndarray
    first: np.ndarray
    block: bool


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels of the run-length grammar; the last one has no two equal symbols (and no ``up``)."""
    levels, free, rounds = [], int(symbols.max(initial=0)) + 1, 0
    while True:
        n = len(symbols)
        seen = np.zeros(free, bool)
        seen[symbols] = True
        if np.count_nonzero(seen) == n:
            return [*levels, Level(symbols, np.zeros(0, np.int64), np.zeros(0, np.int64), False)]
        same = symbols[1:] == symbols[:-1]
        block = bool(same.any())
        if block:
            joined = same
        else:
            rounds += 1
            left = mix(symbols.astype(U64) + U64(rounds * 0x9E3779B97F4A7C15 % 2**64)) & U64(1) == 0
            joined = left[:-1] & ~left[1:]
            if not joined.any():
                continue
        starts = np.concatenate(([True], ~joined))
        first = np.append(np.flatnonzero(starts), n)
        lengths = np.diff(first)
        taken = np.flatnonzero(lengths > 1)
        at = first[taken]
        # Each (symbol, count) or (left, right) gets a number of its own; all others keep theirs.
        key = symbols[at] * np.int64(free + n) + (lengths[taken] if block else symbols[at + 1])
        names, number = np.unique(key, return_inverse=True)
        above = symbols[first[:-1]]
        above[taken] = free + number
        free += len(names)
        levels.append(Level(symbols, np.cumsum(starts) - 1, first, block))
        symbols = above


def _rest(level: Level, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many children of its parent remain from a place on, in the direction of step, and whether that is all of them."""
    parent = level.up[at]
    low, high = level.first[parent], level.first[parent + 1]
    return (high - at, at == low) if step > 0 else (at - low + 1, at == high - 1)


def agreement(levels: list[Level], i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
    """For places i < j of the sequence: how many symbols agree from them on (step 1) or from them backwards (step -1).

    A symbol that occurs once must stand at each end of the sequence, so that every comparison ends inside.
    """
    begun, i, j = i, i.copy(), j.copy()
    height = np.full(len(i), len(levels) - 1)
    live = np.arange(len(i))
    for k, level in enumerate(levels[:-1]):
        equal = level.symbols[i[live]] == level.symbols[j[live]]
        height[live[~equal]] = k
        live = live[equal]
        if not len(live):
            break
        (a, all_a), (b, all_b) = _rest(level, i[live], step), _rest(level, j[live], step)
        moved = np.where(all_a & all_b, 0, np.minimum(a, b)) * step
        i[live] += moved
        j[live] += moved
        ended = (moved != 0) & (a != b)
        height[live[ended]] = k
        live = live[~ended]
        # Where symbols were stepped over, the place reached is the next parent's edge.
        over = moved[~ended] != 0
        for place in (i, j):
            here = place[live]
            place[live] = np.where(over, level.up[np.where(over, here - step, here)] + step, level.up[here])
    for k in range(int(height.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(height > k)
        level = levels[k]
        for place in (i, j):
            place[live] = level.first[place[live]] if step > 0 else level.first[place[live] + 1] - 1
        equal = live[level.symbols[i[live]] == level.symbols[j[live]]]
        by = np.minimum(_rest(level, i[equal], step)[0], _rest(level, j[equal], step)[0]) if level.block else 1
        i[equal] += by * step
        j[equal] += by * step
    return np.abs(i - begun)


def candidates(symbols: np.ndarray, text_of: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid places whose word stands again one and two periods further on in the same text."""
    places, periods = [], []
    for q in range(1, longest // LEAST_PERIODS + 1):
        grid = symbols[::q]
        equal = grid[1:] == grid[:-1]
        hits = np.flatnonzero(equal[1:] & equal[:-1]) * q
        if len(hits):
            hits = hits[text_of[hits] == text_of[hits + 2 * q]]
            places.append(hits)
            periods.append(np.full(len(hits), q))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), in that order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or sizes.max(initial=0) < LEAST_WORDS:
        return out
    number = collections.defaultdict(itertools.count(len(texts) + 1).__next__)
    # A symbol of its own stands before each text and at the end.
    parts = [p for k, t in enumerate(texts) for p in ((k,), map(number.__getitem__, t))]
    symbols = np.fromiter(itertools.chain(*parts, (len(texts),)), np.int64, int(sizes.sum()) + len(texts) + 1)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) + 1
    text_of = np.append(np.repeat(np.arange(len(texts)), sizes + 1), len(texts))
    place, q = candidates(symbols, text_of, int(sizes.max()))
    levels = grammar(symbols)
    ahead, back = agreement(levels, place, place + q), agreement(levels, place - 1, place + q - 1, -1)
    length = back + q + ahead
    kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, length, q = (place - back)[kept], length[kept], q[kept]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    # Multiples of a run's period give the same stretch again.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner = text_of[start[new]]
    for k, s, n, p in zip(owner.tolist(), (start[new] - begin[owner]).tolist(), length[new].tolist(), q[new].tolist(), strict=True):
        out[k].append((s, n, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return list(itertools.compress(words, np.cumsum(marks[:-1]) == 0))


def together(texts: list[list], most: int = TOGETHER) -> Iterator[list[list]]:
    """Neighbouring texts in lists of a bounded number of words."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def periodic_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns to keep (doc_id if not given), n_words, runs, collapsed (its text without repeats).

    Words are what white space of ASCII separates.  Map only.
    """
    keep = keep or ["doc_id"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            words = [text_bytes(t).split() for t in batch.column("_run_text").to_pylist()]
            for some in together(words):
                found = runs_of(some)
                texts = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(some, found, strict=True)]
                rows = batch.slice(at, len(some))
                at += len(some)
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in keep} | {
                    "n_words": pa.array([len(w) for w in some], pa.int64()),
                    "runs": pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                    "collapsed": pa.array(texts, pa.string())})

    return docs.select(*keep, F.col("text").alias("_run_text")).mapInArrow(
        run, ", ".join([*fields, "n_words long", f"runs {RUNS}", "collapsed string"]))


def replanted(docs: DataFrame) -> DataFrame:
    """The documents of which one in ten, by the checksum of its id, is made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.array_join(F.concat(F.slice(words, 1, a), tail), " ")

    chosen = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    text = F.when(chosen, F.get(F.transform(F.array(words), planted), 0)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(replanted(table(spark, folder, "documents")))
    exponent = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    first = F.get("runs", 0)
    # Runs are sorted by start and period, so only a greater exponent takes the place of an earlier run.
    best = F.aggregate("runs", first, lambda held, r: F.when(exponent(r, held) > 0, r).otherwise(held))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                                r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The runs from all pairs of equal words of a document: stretches of neighbouring pairs of one distance.
OP11_SQL = rf"""
with split as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
           {crc32_sql("doc_id::varchar")} as h from documents),
planted as (select *, len(w) as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from split),
edited as (
    select r, doc_id, n, case when a is null then w else
        [w[case when i < a then i + 1 else a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1 end] for i in range(n)] end as w from planted),
words as (select r, n, unnest(range(n)) as i, unnest(w) as word from edited),
pairs as (select x.r, x.i, y.i - x.i as q from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
stretches as (
    select r, q, min(i) as start, count(*) + q as length
    from (select *, i - row_number() over (partition by r, q order by i) as island from pairs) group by r, q, island),
runs as (select r, start, length, min(q) as period from stretches where length >= greatest(24, 3 * q) group by r, start, length),
counted as (
    select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
           arg_min(struct_pack(start := start, length := length, period := period), row(-length::double / period, start, period)) as best
    from runs group by r),
dropped as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(word, ' ' order by i) as line from words anti join dropped using (r, i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
       (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
       sha256(coalesce(line, '')) as collapsed_sha256
from edited left join counted using (r) left join kept using (r)"""
