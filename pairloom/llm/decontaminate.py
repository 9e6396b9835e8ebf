"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test questions and answers.

Normalised means: A-Z in lower case, everything but words dropped, one space between words.  The automaton reads each text once; hits
are mapped to word numbers and, on demand, to code points of the original text.

Defined results: null and empty texts have no words and no hits; repeated rows repeat their results; windows that several items share
count for each item; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import WORD_BYTES, table, text_bytes

WINDOW = 10
#: Code points of benchmark text in one automaton.  A larger benchmark is scanned in so many more passes.
AUTOMATON_CHARS = 20_000_000
_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c in WORD_BYTES or 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text) -> list[str]:
    """The words of a text in order."""
    return [w.decode("utf-8", "surrogatepass") for w in text_bytes(text).translate(_TO_WORDS).split(b" ") if w]


def windows(words: list[str], size: int = WINDOW) -> list[str]:
    """All runs of so many words, each between spaces; a shorter text is one window."""
    return [f" {' '.join(words[i:i + size])} " for i in range(max(1, len(words) - size + 1))] if words else []


def automaton(items: list[tuple], size: int = WINDOW) -> ahocorasick.Automaton:
    """From window to (its number of words, the ids of the items that have it)."""
    owners: dict[str, set] = {}
    for item, text in items:
        for window in windows(normalised(text), size):
            owners.setdefault(window, set()).add(item)
    built = ahocorasick.Automaton()
    for window, ids in owners.items():
        built.add_word(window, (window.count(" ") - 1, tuple(ids)))
    built.make_automaton()
    return built


def scan(text, built: ahocorasick.Automaton) -> tuple[int, np.ndarray, set]:
    """Number of words, marks of the hit words, ids of the items hit."""
    words = [w for w in text_bytes(text).translate(_TO_WORDS).split(b" ") if w]
    marks, ids = np.zeros(len(words) + 1, np.int64), set()
    if words and len(built):
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        found = list(built.iter(line))
        if found:
            # The window ends with the space before word number `last`.
            spaces = np.fromiter((i for i, c in enumerate(line) if c == " "), np.int64)
            for end, (n, items) in found:
                last = int(np.searchsorted(spaces, end))
                marks[last - n] += 1
                marks[last] -= 1
                ids.update(items)
    return len(words), np.cumsum(marks[:-1]) > 0, ids


def hit_spans(text: str, marks: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the runs of hit words in the original text."""
    spans, open_ = [], None
    for match, hit in zip(_WORD.finditer(text), marks, strict=True):
        if hit and open_ is None:
            open_ = [match.start(), match.end()]
        elif hit:
            open_[1] = match.end()
        elif open_ is not None:
            spans.append(tuple(open_))
            open_ = None
    return spans + ([tuple(open_)] if open_ is not None else [])


def benchmark_parts(benchmark: DataFrame, chars: int = AUTOMATON_CHARS) -> list[list[tuple]]:
    """The items as the driver hands them to the tasks, in parts of a proven size; the sizes are known before any text is fetched."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars) or 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [[(r.item_id, r.text) for r in dealt.where(F.col("part") == i).collect()] for i in range(n)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, chars: int = AUTOMATON_CHARS,
                   keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per document with n_words, n_hit, item_ids (sorted as text), spans of the hits in the original text; no shuffle.

    ``keep`` names the columns that stay (doc_id alone if not given); ``prefix`` keeps the new names apart from them.
    """
    keep = keep or ["doc_id"]
    parts = benchmark_parts(benchmark, chars)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields] + [
        f"`{prefix}n_words` long", f"`{prefix}n_hit` long", f"`{prefix}item_ids` array<string>",
        f"`{prefix}spans` array<struct<start:long,end:long>>"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [automaton(p, size) for p in shared.value] if len(shared.value) == 1 else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, marks, ids = [0] * len(texts), [None] * len(texts), [set() for _ in texts]
            for k, part in enumerate(shared.value):
                built = held[k] if held else automaton(part, size)
                for i, text in enumerate(texts):
                    n_words[i], mine, found = scan(text, built)
                    marks[i] = mine if marks[i] is None else marks[i] | mine
                    ids[i] |= found
            spans = [[{"start": a, "end": b} for a, b in hit_spans(t, m)] if t and m.any() else [] for t, m in zip(texts, marks, strict=True)]
            columns = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {
                f"{prefix}n_words": pa.array(n_words, pa.int64()), f"{prefix}n_hit": pa.array([int(m.sum()) for m in marks], pa.int64()),
                f"{prefix}item_ids": pa.array([sorted(map(str, i)) for i in ids], pa.list_(pa.string())),
                f"{prefix}spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return source.mapInArrow(run, schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    hits = benchmark_hits(docs, benchmark, size, keep=docs.columns, prefix="_benchmark_")
    return hits.where(F.col("_benchmark_n_hit") == 0).select(*docs.columns)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
with words as (
    select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    union all
    select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
items as (select id as item_id, w, least(len(w), 10) as n from words where side = 'i' and len(w) > 0),
item_windows as (
    select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win
    from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from items)),
lengths as (select distinct n from items),
doc_windows as (
    select id as doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
    from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from words cross join lengths where side = 'd' and len(w) >= n)),
hits as (select doc_id, i, n, item_id from doc_windows join item_windows using (n, win)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join places on words.id = places.doc_id left join named on words.id = named.doc_id where side = 'd'"""
