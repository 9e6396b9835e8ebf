"""Character spans inside one text, as array expressions: extraction stays a map-only job, whatever the text's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.binding import let

SPAN = "array<struct<start:int,end:int,text:string>>"


_CHUNK = 128


def running_starts(lengths: Column) -> Column:
    """Sum of the lengths before each place.

    Appending to an array copies it, so sums are taken inside chunks and over the chunks' totals: a long array costs about _CHUNK steps an
    element instead of one for every element before it.
    """
    def sums(values: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(
            acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, n: (acc + n).cast("int"))
    chunks = lambda lengths: F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / F.lit(_CHUNK)).cast("int") - 1), lambda i: F.slice(
        lengths, i * _CHUNK + 1, _CHUNK))
    joined = lambda lengths, chunks: F.flatten(F.zip_with(chunks, sums(F.transform(chunks, total)), lambda chunk, before: F.transform(
        sums(chunk), lambda at: at + before)))
    none = F.array().cast("array<int>")
    return let(lengths, lambda lengths: F.when(F.size(lengths) > 0, let(F.transform(lengths, lambda n: n.cast("int")), chunks, joined)).otherwise(none))


def match_spans(text: Column, pattern: str) -> Column:
    """[(start, end, text)] of every match; zero-based, end exclusive.

    Spark returns matches without offsets, so they are summed from the pieces between the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    hits = F.filter(pairs, lambda x: x["hit"].isNotNull())

    def span(x, at):
        start = at + x["gap"]
        return F.struct(start.cast("int").alias("start"), (start + F.length(x["hit"])).cast("int").alias("end"), x["hit"].alias("text"))

    spans = let(hits, lambda hits: F.zip_with(hits, running_starts(F.transform(hits, lambda x: x["gap"] + F.length(x["hit"]))), span))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))  # most texts have no match: one look is enough


def part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def trimmed_span(piece: Column, at: Column) -> Column:
    """A piece of text that starts at a position, without surrounding whitespace, as (start, end, text)."""
    lead = lambda raw: F.length(F.regexp_extract(raw, r"(?U)^\s*", 0))
    body = lambda raw: F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return let(piece, lambda raw: at + lead(raw), lambda raw, at: body(raw), lambda raw, at, kept: F.struct(
        at.cast("int").alias("start"), (at + F.length(kept)).cast("int").alias("end"), kept.alias("text")))


def last_started(spans: Column, at: Column) -> Column:
    """The last span that starts at or before a position; the first span if none does.  Spans are in order: one in _CHUNK is looked at first."""
    firsts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(spans) - 1, F.lit(0)), F.lit(_CHUNK)), lambda i: F.get(spans, i)["start"])
    chunk = F.greatest(F.size(F.filter(firsts, lambda start: start <= at)), F.lit(1))
    before = F.filter(F.slice(spans, (chunk - 1) * _CHUNK + 1, _CHUNK), lambda s: s["start"] <= at)
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(spans, F.lit(1)))
