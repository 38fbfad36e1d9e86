"""Repetition coverage of whole texts (operator 5).

Words are hashed, hashes of n neighbouring words are rolled in numpy for several n, and the
characters inside words of any n-gram that occurs again in the text are measured, first occurrence
included; so are the characters of lines that equal an earlier line. A text fails if a share
exceeds its limit. Coverage never grows with n, so longer n-grams are measured only where the
shortest ones repeat at all.

Defined cases: a null text has no words and fails the base rule. Repeated rows are judged each;
other columns pass through, except those that carry an output's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from coursepulse.llm.common import SPACES, WordHashes, append_columns, utf8, windows

#: Largest share of word characters inside repeated n-grams, by n. Fixed values, as published for web text.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of word characters in lines, that equal an earlier line.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
#: The base rule: fewest words, window of words, most percent of words in repeated windows.
MIN_WORDS, WINDOW, MOST_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
#: Bytes that don't begin a character, symbols and white space, for deletion.
INSIDE = bytes(range(0x80, 0xC0))
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = [
    *(T.StructField(c, T.LongType()) for c in COUNTS),
    T.StructField("base_failed", T.BooleanType()),
    *(T.StructField(f"dup_{n}gram_chars", T.DoubleType()) for n in NGRAM_LIMITS),
    T.StructField("dup_line_share", T.DoubleType()),
    T.StructField("dup_line_chars", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def repeated(hashes: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of `size` words that the text holds twice or more."""
    inside = np.zeros(len(hashes) + 1, np.int64)
    rolled = windows(hashes, size)
    if len(rolled):
        order = np.argsort(rolled, kind="stable")
        ranked = rolled[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(rolled), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = np.flatnonzero(twice)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + size, -1)
    return np.cumsum(inside[:-1]) > 0


def _chars(raw: bytes) -> int:
    """Characters that are not white space."""
    return len(raw.translate(None, INSIDE + SPACES.encode()))


def measure(raw: bytes, hashes: WordHashes) -> tuple:
    words = raw.split()
    hashed = hashes.of(words)
    total = _chars(raw)
    symbols = len(raw.translate(None, NOT_SYMBOLS))

    lines = [line for line in raw.split(b"\n") if line.strip()]
    again, again_chars = 0, 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                again += 1
                again_chars += _chars(line)
            seen.add(line)

    inside = repeated(hashed, WINDOW)
    n_repeat = int(inside.sum())
    shares = []
    if n_repeat:
        lengths = np.fromiter(map(_chars, words), np.int64, len(words))
        for n in NGRAM_LIMITS:
            if n != WINDOW and (not shares or shares[-1] > 0):
                inside = repeated(hashed, n)
            shares.append(float(lengths[inside].sum()) / total if not shares or shares[-1] > 0 else 0.0)
    else:
        shares = [0.0] * len(NGRAM_LIMITS)
    line_share = again / len(lines) if lines else 0.0
    line_chars = again_chars / total if total else 0.0
    base_failed = len(words) < MIN_WORDS or 100 * n_repeat > MOST_PERCENT * len(words)
    kept = (
        not base_failed
        and all(share <= limit for share, limit in zip(shares, NGRAM_LIMITS.values()))
        and line_share <= LINE_LIMIT
        and line_chars <= LINE_CHARS_LIMIT
    )
    return (len(words), total, symbols, again, n_repeat, base_failed, *shares, line_share, line_chars, kept)


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts, coverages and verdict of each text."""

    def start():
        hashes = WordHashes()

        def compute(texts):
            rows = [measure(raw or b"", hashes) for raw in utf8(texts)]
            columns = list(zip(*rows)) or [()] * len(FIELDS)
            kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            return [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, FIELDS)]

        return compute

    return append_columns(docs, [text], FIELDS, start)


def report(docs: DataFrame) -> DataFrame:
    return repetition(docs.select("doc_id", "text")).drop("text")
