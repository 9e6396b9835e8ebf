"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees score them from their format and context; spans above a calibrated
threshold are added to those that the base rules find.  The trees learn from the base rules' own decisions: a candidate that is a base
span is a positive; a failed checksum, a part out of range, a number inside a longer token and a bare number without a cue word before it
are negatives.  Everything else is left out of training, since the base rules can't tell: what overlaps a base span or lies in a longer
dropped match, and the forms that only the generators know ('[at]' addresses, 13 to 15 digit cards, phones without '+').  For these the
trees see the base spans rewritten to each form, in their own context and alone.

Training rows: at most TRAINING_ROWS per class, dealt evenly to the kinds, by hash order, from half of the candidates.  All others are
scored in Spark and counted by (kind, score, label); each kind's threshold is read from these counts and PRIOR pooled ones of all kinds.

Defined results: null counts as the empty text; repeated rows repeat their results; with too few candidates to learn from, the base
spans alone are returned; an empty table gives an empty table; extra columns stay untouched where documents are returned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.boosting import BoostedTrees
from pairloom.llm.common import checkpointed, table

KINDS = ("email", "ip", "card", "phone")
TRAINING_ROWS = 8_000
#: Share of the candidates above the threshold that must be positives on the held-out half; the pooled counts weigh as so many candidates.
PRECISION, PRIOR, SCORE_BINS = 0.98, 20, 1000
#: Words before a span that announce its kind, and such as announce other numbers.
CUES = {"email": {"mail", "email", "contact", "write"}, "ip": {"ip", "host", "server", "address"}, "card": {"card", "visa", "mastercard", "amex"},
        "phone": {"tel", "telephone", "phone", "call", "fax", "mobile", "cell", "dial"}}
OTHER_CUES = {"token", "id", "key", "order", "ticket", "ref"}

# The base rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTERS_LAST = re.compile(r"[A-Za-z]{2,}\Z")

# Generators: overlapping candidates by look-ahead.
_PROPOSE = {
    "email": [re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}(?: ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]+(?:(?:\.| ?\[dot\] ?)[A-Za-z0-9-]+)+)")],
    "ip": [re.compile(r"(?=((?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])))")],
    "card": [re.compile(r"(?=((?<![0-9])[0-9]{13,19}(?![0-9])))"), re.compile(r"(?=((?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])))")],
    "phone": [re.compile(r"(?=(\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])))"),
              re.compile(r"(?=((?<![0-9+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])))"),
              re.compile(r"(?=(\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])))"),
              re.compile(r"(?=((?<![0-9])[0-9]{7,12}(?![0-9])))")],
}


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @; linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) by kind and start; and the matches that a rule dropped."""
    spans, dropped = [("email", a, b) for a, b in emails(text)], []
    if not _DIGIT.search(text):
        return spans, dropped
    rules = (("ip", _IP, lambda s: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
             ("card", _CARD, lambda s: 16 <= len(d := only_digits(s)) <= 19 and luhn(d)),
             ("phone", _PHONE, lambda s: 8 <= len(only_digits(s)) <= 15))
    for kind, pattern, holds in rules:
        for m in pattern.finditer(text):
            if holds(m.group()):
                spans.append((kind, *m.span()))
            elif m.end() - m.start() > 12:
                dropped.append(m.span())
    return spans, dropped


def cue(text: str, start: int) -> str:
    """The last word in the 24 characters before a span."""
    return (re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].lower())[-1:] or [""])[0]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the candidate and of what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = only_digits(span)
    parts = span.split(".")
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3
    word = cue(text, start)
    return [KINDS.index(kind), len(span), len(digits), len(span) - len(digits), span.count("("), span.count("."), span.count(" ") + span.count("-"),
            float(span[:1] == "+"), float(bool(digits) and luhn(digits)), max((int(p) for p in parts if p.isdigit() and len(p) < 5), default=0),
            len(set(digits)), side(before[-1:]), side(after[:1]), len(only_digits(before)), len(only_digits(after)),
            float(word in CUES[kind]), float(word in OTHER_CUES), float('"' in before[-3:] or '"' in after[:3]), float(bool(_LETTERS_LAST.search(span)))]


def touching(spans: list[tuple[int, int]]):
    """A test whether any of the spans overlaps (start, end), in logarithmic time."""
    spans = sorted(spans)
    starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def test(start: int, end: int) -> bool:
        n = bisect_left(starts, end)
        return n > 0 and ends[n - 1] > start

    return test


def outside_label(text: str, kind: str, start: int, end: int) -> int:
    """0 for a candidate that no base rule and no dropped match covers if it can't be personal data, -1 if the base rules can't tell."""
    span = text[start:end]
    inside = any(c.isalnum() or c == "_" for c in text[max(0, start - 1) : start] + text[end : end + 1])
    if kind == "email":
        good = _LETTERS_LAST.search(span)
    elif kind == "ip":
        good = all(int(p) <= 255 for p in span.split("."))
    elif kind == "card":
        good = luhn(only_digits(span)) and not inside
    elif span[0] in "+(":
        good = 8 <= len(only_digits(span)) <= 15
    else:
        good = cue(text, start) in CUES["phone"] and not inside
    return -1 if good else 0


def candidates(text: str) -> list[tuple[str, int, int, int, list[float]]]:
    """(kind, start, end, label, features): label 1 for a base span, 0 for what can't be personal data, -1 for what the base rules can't tell."""
    digit = _DIGIT.search(text)
    if not digit and "@" not in text and "[at]" not in text and "(at)" not in text:
        return []
    spans, dropped = base_spans(text)
    known, out = set(spans), [(*s, 1, features(text, *s)) for s in spans]
    on_base, on_dropped, whole = touching([s[1:] for s in spans]), touching(dropped), set(dropped)
    for kind, patterns in _PROPOSE.items():
        for pattern in patterns if digit or kind == "email" else ():
            if kind == "email" and "at" not in text:
                continue
            for m in pattern.finditer(text):
                span = (kind, *m.span(1))
                if span not in known:
                    known.add(span)
                    unknown = on_base(*span[1:]) or on_dropped(*span[1:]) and span[1:] not in whole
                    out.append((*span, -1 if unknown else outside_label(text, *span), features(text, *span)))
    return out


def rewritten(text: str, kind: str, start: int, end: int) -> list[tuple[str, int, list[float]]]:
    """(what is rewritten and its context, label, features): a base span in the forms that only the generators know, and
    broken ones, each in the span's own context and alone."""
    span, digits, forms = text[start:end], only_digits(text[start:end]), []
    if kind == "email":
        local, _, domain = span.partition("@")
        forms = [(1, "", f"{local}{at}{domain.replace('.', dot)}") for at, dot in ((" [at] ", "."), ("[at]", "."), ("(at)", "[dot]"), (" (at) ", " [dot] "))]
    elif kind == "card":
        for n in (13, 14, 15):
            check = [c for c in "0123456789" if luhn(digits[: n - 1] + c)][0]
            forms += [(1, "", digits[: n - 1] + check), (0, "", digits[: n - 1] + str((int(check) + 1 + digits.count("1") % 9) % 10))]
    elif kind == "phone":
        forms = [(1, "tel ", digits[-n:]) for n in (7, 10, 12) if len(digits) >= n]
        if len(digits) >= 10:
            forms += [(1, "", f"({digits[-10:-7]}){gap}{digits[-7:-4]}{sep}{digits[-4:]}") for gap, sep in ((" ", "-"), ("", "-"), (" ", "."))]
    out = []
    for label, word, form in forms:
        for before, after in ((text[max(0, start - 24) : start] + word, text[end : end + 12]), (" " + word, " ")):
            made = before + form + after
            out.append((made, label, features(made, kind, len(before), len(before) + len(form))))
    return out


def thresholds_from(counts: np.ndarray) -> dict[str, float]:
    """The lowest score of each kind above which the share of positives is PRECISION, from counts by (kind, label, score bin)."""
    counts = counts.astype(float)
    if not counts[:, 1].sum():
        return dict.fromkeys(KINDS, float("inf"))
    pooled = counts.sum(axis=0)
    out = {}
    for i, kind in enumerate(KINDS):
        above = np.cumsum((counts[i] + PRIOR * pooled / pooled.sum())[:, ::-1], axis=1)[:, ::-1]
        good = np.flatnonzero((above[1] > 0) & (above[1] >= PRECISION * above.sum(axis=0)))
        out[kind] = max(0.5, good[0] / SCORE_BINS) if len(good) else float("inf")
    return out


def trained(docs: DataFrame, rows: int = TRAINING_ROWS) -> tuple[BoostedTrees | None, dict[str, float]]:
    """Trees and one threshold per kind.  At most 3 * rows candidates, and the counts by score, reach the driver."""
    none = None, dict.fromkeys(KINDS, float("inf"))

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda kind, t: hashlib.md5(f"{kind} {t}".encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            found = []
            for t in batch["text"]:
                for kind, a, b, label, values in candidates(t) if isinstance(t, str) else ():
                    if label >= 0:
                        draw = digest(kind, t[max(0, a - 24) : b + 12])
                        found.append((KINDS.index(kind), label, False, values, draw))
                        if label and draw[-1] in "02468ace":
                            found += [(KINDS.index(kind), y, True, x, digest(kind, made)[:-1] + "0") for made, y, x in rewritten(t, kind, a, b)]
            yield pd.DataFrame(found, columns=["kind", "label", "made", "x", "draw"])

    # Copies of one text give one example.  Even draws are for fitting, odd ones for the thresholds.
    seen = checkpointed(docs.select("text").mapInPandas(propose, "kind int, label int, made boolean, x array<double>, draw string").groupBy(
        "kind", "label", "made", "draw").agg(F.min("x").alias("x")))
    even = F.substring("draw", 32, 1).isin(*"02468ace")
    parts = [seen.where(even & (F.col("kind") == i) & (F.col("label") == k) & (F.col("made") == made)).select("label", "draw", "x").orderBy("draw").limit(
        max(1, rows // len(KINDS) // (1 + made))) for i in range(len(KINDS)) for k in (0, 1) for made in (False, True)]
    sample = reduce(DataFrame.unionByName, parts).toPandas()
    if sample["label"].nunique() < 2:
        return none
    sample = sample.sort_values(["draw", "label"], kind="stable")
    trees = BoostedTrees().fit(np.array(sample["x"].tolist(), float), sample["label"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = np.floor(shared.value.predict(np.array(batch["x"].tolist(), float)) * SCORE_BINS).astype(int)
                yield pd.DataFrame({"kind": batch["kind"], "label": batch["label"], "at": np.minimum(at, SCORE_BINS - 1)})

    counts = np.zeros((len(KINDS), 2, SCORE_BINS))
    held = seen.where(~even & ~F.col("made")).select("kind", "label", "x").mapInPandas(score, "kind int, label int, at int")
    for r in held.groupBy("kind", "label", "at").agg(F.count("*").alias("n")).collect():
        counts[r.kind, r.label, r["at"]] = r.n
    return trees, thresholds_from(counts)


def chosen_spans(text: str, trees: BoostedTrees | None, thresholds: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans), both by kind and start: the base spans, and candidates that the trees accept and that overlap none taken."""
    place = {k: i for i, k in enumerate(KINDS)}
    found = candidates(text)
    base = sorted((c[:3] for c in found if c[3] == 1), key=lambda s: (place[s[0]], s[1]))
    rest = [c for c in found if c[3] != 1]
    taken = list(base)
    if rest and trees is not None:
        scores = trees.predict(np.array([c[4] for c in rest], float))
        for score, c in sorted(zip(scores, rest, strict=True), key=lambda r: (-r[0], r[1][1], r[1][2], r[1][0])):
            if score >= thresholds[c[0]] and not any(a < c[2] and c[1] < b for _, a, b in taken):
                taken.append(c[:3])
    return base, sorted(taken, key=lambda s: (place[s[0]], s[1]))


def spans_of(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (kind, start, end) in code points; no shuffle after training."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained(docs))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [chosen_spans(t, *shared.value) if isinstance(t, str) else ([], []) for t in batch["text"]]
            rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in side] for side in both] for both in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": [r[0] for r in rows], "spans": [r[1] for r in rows]})

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(find, f"doc_id long, base {kind}, spans {kind}")


def redacted(docs: DataFrame, model=None) -> DataFrame:
    """The documents, with all their columns; every span is replaced by its kind in angle brackets, and n_chars follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained(docs))

    def cover(text):
        if not isinstance(text, str):
            return text
        out, last = [], 0
        for kind, a, b in sorted(chosen_spans(text, *shared.value)[1], key=lambda s: (s[1], -s[2])):
            if b > last:
                out += [text[last : max(a, last)], f"<{kind.upper()}>"] if a >= last else []
                last = b
        return "".join(out) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cover(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans_of(table(spark, folder, "documents")).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
