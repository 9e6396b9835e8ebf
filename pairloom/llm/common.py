"""Helpers the training-data operators share: hashed word shingles, row keys, range parts, shared-folder checkpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import cut_lineage

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_STEP = U64(0xD6E8FEB86659FD93 | 1)
#: A byte is part of a word if it is an ASCII letter or digit, or belongs to a character beyond ASCII.
WORD_BYTES = bytes(c for c in range(256) if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IS_WORD = np.isin(np.arange(256), np.frombuffer(WORD_BYTES, np.uint8))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Written once to the folder in spark.checkpoint.dir, so that several readers don't compute it again."""
    return cut_lineage(df)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the words of a UTF-8 text, in order; ASCII case doesn't count.  Linear in the text, no Python loop."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    inside = np.concatenate(([False], _IS_WORD[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], dtype=U64, out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order."""
    return word_spans(data)[2]


def shingle_hashes(data: bytes, words: int = 5) -> np.ndarray:
    """A 64-bit hash of every run of so many words (a shorter text: of all its words), in order, repeats included."""
    hashes = word_hashes(data)
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, words)
    total = np.full(n - k + 1, U64(k), U64)
    for i in range(k):
        total = total * _STEP + hashes[i : n - k + 1 + i]
    return mix(total)


def text_key(text: str = "text") -> Column:
    """128 bits of a text's SHA-256: equal texts have equal keys; null counts as the empty text."""
    return F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32)


def row_id() -> Column:
    """The id under which a row of (doc_id, text) takes part: doc_id, or a negative id made from the text if that is null."""
    made = F.lit(-1) - F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), made)


def text_bytes(text) -> bytes:
    return b"" if text is None or text != text else text.encode("utf-8", "surrogatepass")


def range_part(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most the value, in about 2 * sqrt(len(cuts)) steps a row."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    at = lambda values: F.array(*[F.lit(v) for v in values])
    first = F.size(F.filter(at([g[0] for g in groups]), lambda c: c <= value))
    inner = F.element_at(F.array(*[at(g) for g in groups]), F.greatest(first, F.lit(1)))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * width + F.size(F.filter(inner, lambda c: c <= value)))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in SQL: each byte is added, then eight times shifted out."""
    steps = f"flatten([[ascii(c)::bigint{', -1' * 8}] for c in string_split({text}, '')])"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {steps}), lambda c, e: case
               when e >= 0 then xor(c, e) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))"""
