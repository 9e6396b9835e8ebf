"""Sentences, sections and requirement wording of flattened texts, as array expressions on one text column.

A segment is a sentence or a glued bullet.  Headings are searched anywhere in the text.  Nothing is exploded or shuffled:
each function returns a column, so a whole text is processed inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.binding import let
from pairloom.functions.spans import last_started, match_spans, part, running_starts, trimmed_span

# Where segments end, where a heading may stand, what bounds a word in glued text.
# What follows is looked at before what precedes: most places are left after one character.
BOUNDARY = r"(?U)(?=\s)(?<=[.!?;:])\s+|(?=[A-Z][a-z])(?<=[a-z0-9)])"
BEFORE_HEADING = r"(?=[A-Z])(?:(?<![A-Za-z])|(?<=[a-z]))"
AFTER_HEADING = r"(?=\s*(?:$|[:\-A-Z0-9(]))"
GLUE_BEFORE = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
GLUE_AFTER = r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
HEAD = "array<struct<start:int,end:int,section:string>>"


def segments(text: Column) -> Column:
    """[(start, end, text)] of the non-empty segments, blanks trimmed, offsets exact."""
    return let(text, _segments)


def _segments(text: Column) -> Column:
    gaps = F.regexp_extract_all(text, F.lit(BOUNDARY), F.lit(0))
    pieces = F.split(text, BOUNDARY, -1)
    pairs = F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("p"), F.coalesce(F.length(g), F.lit(0)).alias("g")))

    lengths = lambda pairs: running_starts(F.transform(pairs, lambda x: F.length(x["p"]) + x["g"]))
    placed = let(pairs, lambda pairs: F.zip_with(pairs, lengths(pairs), lambda x, at: trimmed_span(x["p"], at)))
    return F.filter(placed, lambda s: s["end"] > s["start"])


def heading_pattern(phrases: list[str]) -> str:
    return rf"(?U){BEFORE_HEADING}(?i:{'|'.join(phrases)}){AFTER_HEADING}"


def headings(text: Column, rules: dict[str, list[str]]) -> Column:
    """[(start, end, section)] of the headings kept: by start, longer first, earlier rule first, without overlap."""
    def of_rule(rank, kind, phrases):
        return F.transform(match_spans(text, heading_pattern(phrases)), lambda m: F.struct(
            m["start"].alias("start"), (-m["end"]).alias("neg_end"), F.lit(rank).alias("rule"), F.lit(kind).alias("section")))

    found = F.flatten(F.array(*[of_rule(i, kind, phrases) for i, (kind, phrases) in enumerate(rules.items())]))

    def step(acc, h):
        head = F.struct(h["start"].alias("start"), (-h["neg_end"]).cast("int").alias("end"), h["section"].alias("section"))
        return F.when(h["start"] >= acc["end"], F.struct((-h["neg_end"]).cast("int").alias("end"),
                                                         F.concat(acc["out"], F.array(head)).alias("out"))).otherwise(acc)

    zero = F.struct(F.lit(0).alias("end"), F.array().cast(HEAD).alias("out"))
    return F.aggregate(F.array_sort(found), zero, step, lambda acc: acc["out"])


def label_pieces(spans: Column, heads: Column) -> Column:
    """[(start, end, text, section)]: segments cut at both ends of every heading; the last heading names the section."""
    bounds = lambda heads: F.array_sort(F.array_distinct(F.flatten(F.transform(heads, lambda h: F.array(h["start"], h["end"])))))
    return let(heads, bounds, lambda heads, bounds: _label_pieces(spans, heads, bounds))


def _label_pieces(spans: Column, heads: Column, bounds: Column) -> Column:
    def cut(s):
        inner = F.filter(bounds, lambda p: (p > s["start"]) & (p < s["end"]))
        starts, ends = F.concat(F.array(s["start"]), inner), F.concat(inner, F.array(s["end"]))
        return F.zip_with(starts, ends, lambda a, b: trimmed_span(part(s["text"], a - s["start"], b - s["start"]), a))

    pieces = F.filter(F.flatten(F.transform(spans, cut)), lambda p: p["end"] > p["start"])

    def name(p):
        before = F.filter(heads, lambda h: h["start"] <= p["start"])  # names the section; headings are few
        section = F.coalesce(F.try_element_at(before, F.lit(-1))["section"], F.lit("intro"))
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"), section.alias("section"))

    return F.transform(pieces, name)


def section_blocks(text: Column, pieces: Column) -> Column:
    """[(start, end, text, section)]: neighbouring pieces of one section merged."""
    opens = lambda pieces: F.filter(F.transform(pieces, lambda p, i: F.struct(
        i.alias("at"), p["start"].alias("start"), p["section"].alias("section"), F.coalesce(
            F.get(pieces, i - 1)["section"] != p["section"], F.lit(True)).alias("opens"))), lambda p: p["opens"])
    ended = lambda pieces, opens: F.transform(opens, lambda o, k: F.struct(
        o["start"].alias("start"), F.get(pieces, F.coalesce(F.get(opens, k + 1)["at"], F.size(pieces)) - 1)["end"].alias("end"), o["section"].alias("section")))
    blocks = let(pieces, opens, ended)
    return let(text, lambda t: F.transform(blocks, lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), part(t, b["start"], b["end"]).alias("text"), b["section"].alias("section"))))


def cue_patterns(glued: bool) -> dict[str, str]:
    before, after = (GLUE_BEFORE, GLUE_AFTER) if glued else (r"\b", r"\b")
    return {"preferred": f"(?U){before}(?i:{'|'.join(fv.PREFERRED_CUES)}){after}",
            "required": f"(?U){before}(?i:{'|'.join(fv.REQUIRED_CUES)}){after}"}


def cues(sentence: Column, glued: bool = False) -> Column:
    """[(start, status)] of the requirement words in a sentence."""
    def of_status(status, pattern):
        return F.transform(match_spans(sentence, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(status).alias("status")))

    return F.concat(*[of_status(status, pattern) for status, pattern in cue_patterns(glued).items()])


def nearest_cue(found: Column, position: Column) -> Column:
    """Status of the cue nearest to a position (start to start); at equal distance "preferred"; NULL without cues."""
    ranked = F.transform(found, lambda c: F.struct(F.abs(c["start"] - position).alias("distance"), c["status"].alias("status")))
    return F.array_min(ranked)["status"]


def sentence_at(spans: Column, position: Column) -> Column:
    return last_started(spans, position)
