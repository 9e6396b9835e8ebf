"""String and token expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import fixed_values as fv
from pairloom.functions.binding import let

# Letters, digits and underscore of any script, written out so that every engine reads it the same way.
WORD = r"\p{L}\p{N}_"
WORD_TOKEN = rf"[{WORD}]{{2,}}"
TECH_TOKEN = rf"[{WORD}][{WORD}+#.]*[{WORD}+#]|[{WORD}]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def nfkc(text: Column) -> Column:
    """Compatibility normal form.  No built-in does it; ASCII text is its own normal form and stays in the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def clean_text(text: Column) -> Column:
    """NULL becomes empty, NFKC, whitespace runs become one space, ends trimmed."""
    return collapse_spaces(nfkc(F.coalesce(text, F.lit(""))))


def label_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z]", "")


def canonical_label(label: Column, labels: list[str] = fv.LABELS) -> Column:
    """Spelling variants of a label become its canonical name; an unknown label stops the job."""
    known = F.create_map(*[F.lit(x) for name in labels for x in ("".join(c for c in name.lower() if c.isalpha()), name)])
    found = F.try_element_at(known, label_key(label))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL")))).cast("string"))


def label_id(label: Column, labels: list[str] = fv.LABELS) -> Column:
    return (F.array_position(F.array(*map(F.lit, labels)), label) - 1).cast("int")


def label_name(ordinal: Column, labels: list[str] = fv.LABELS) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), ordinal.cast("int") + 1)


def content_id(text: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the lower-cased text."""
    return F.substring(F.sha1(F.lower(text)), 1, 12)


def normalize(text: Column) -> Column:
    """Noise characters to spaces, known headings cut off the word glued to them, spaces collapsed."""
    headings = "|".join(fv.GLUED_HEADINGS)
    quiet = F.regexp_replace(text, fv.NOISE_CHARS, " ")
    return collapse_spaces(F.regexp_replace(quiet, rf"(?U)\b({headings})(?=[A-Z])", "$1 "))


def lexical_text(text: Column) -> Column:
    """Normalised, lower-cased, sentence-final dots dropped; dots inside words stay."""
    return collapse_spaces(F.regexp_replace(F.lower(normalize(text)), rf"\.(?![{WORD}])", " "))


def tokens(text: Column, pattern: str = TECH_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n neighbours; empty when there are fewer than n words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def unigrams_and_bigrams(words: Column) -> Column:
    return let(words, lambda w: F.concat(w, ngrams(w, 2)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def lines(text: Column) -> Column:
    """Trimmed, non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda l: l != "")


def unbulleted(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^[•\-*·]\s*", ""))


def content_words(text: Column) -> Column:
    """Lower-case tokens longer than two characters that are not stop words."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9+#.\s]", " ")
    stop = F.array(*map(F.lit, fv.STOP_WORDS))
    return F.filter(F.split(plain, r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def tidy_extract(text: Column) -> Column:
    """Line ends to LF, runs of blanks to one, three or more line ends to two, trimmed."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def printable_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E\t\r\n]", " ")
