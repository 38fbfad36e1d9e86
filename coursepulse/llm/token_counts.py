"""Token counts of whole texts by a SentencePiece model (operator 3).

A text up to `chunk` characters is encoded in one go. A longer one is cut into overlapping chunks
that are encoded with offsets; neighbours are spliced at a boundary proven stable: no piece of the
model holds a space after another character, so no merge ever crosses from a non-space to a space,
and what stands on either side is encoded independently. Both encodings must have a token edge
there. If the overlap holds no such place, it is doubled until it does or the text ends.

Defined cases: a null or empty text has no tokens. Repeated rows are counted each; other columns
pass through, except those that carry an output's name.
"""

from __future__ import annotations

import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse.llm.common import append_columns

CHUNK = 16_384
OVERLAP = 256
LIMIT = 4_096
SPACE_MARK = "▁"
EDGE = re.compile(f"(?<=[^ {SPACE_MARK}]) ")
ACROSS = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")


def _size(text: str, start: int, end: int) -> int:
    """Bytes of a part of a text: offsets of tokens are in bytes."""
    return len(text[start:end].encode())


class Counter:
    """Counts tokens; chunks and overlaps are in characters."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        #: Whether a space always begins a piece; if not, texts aren't cut.
        self.splits = not any(ACROSS.search(p) for p in pieces)
        self.chunk, self.overlap = chunk, overlap

    def _chunk(self, text: str, start: int, end: int) -> list:
        return self.model.encode(text[start:end], return_type="proto").pieces

    @staticmethod
    def _after(pieces, place: int) -> int | None:
        """How many tokens begin at or after a byte of the chunk; None if a token covers it."""
        low, high = 0, len(pieces)
        while low < high:
            middle = (low + high) // 2
            if pieces[middle].begin < place:
                low = middle + 1
            else:
                high = middle
        if low and pieces[low - 1].end > place:
            return None
        return len(pieces) - low

    def spans(self, text: str):
        """Chunks as (start, end, place of the splice with the chunk before, tokens)."""
        start, splice = 0, 0
        end = min(self.chunk, len(text))
        left = self._chunk(text, start, end)
        while end < len(text):
            overlap, place = self.overlap, None
            while place is None:
                begin = max(splice, end - overlap)
                reach = min(begin + max(self.chunk, 2 * (end - begin)), len(text))
                right = self._chunk(text, begin, reach)
                place = self._common(text, begin, end, start, left, right)
                if begin == splice:
                    break
                overlap *= 2
            if place is None:
                # No stable place in the left chunk: it grows and is encoded anew.
                end = min(start + 2 * (end - start), len(text))
                left = self._chunk(text, start, end)
                continue
            yield start, end, splice, self._between(text, left, start, splice, place)
            start, end, splice, left = begin, reach, place, right
        yield start, end, splice, self._between(text, left, start, splice, None)

    def _common(self, text, begin, end, start, left, right) -> int | None:
        """The first place in the overlap where both encodings have a proven token edge."""
        for found in EDGE.finditer(text, begin + 1, end):
            place = found.start()
            if self._after(left, _size(text, start, place)) is not None and (
                self._after(right, _size(text, begin, place)) is not None
            ):
                return place
        return None

    def _between(self, text, pieces, start: int, low: int, high: int | None) -> int:
        """Tokens of a chunk from one splice to the next; the first chunk has no lower one."""
        n = self._after(pieces, _size(text, start, low)) if low else len(pieces)
        return n - (self._after(pieces, _size(text, start, high)) if high is not None else 0)

    def count(self, text: str) -> int:
        return sum(n for *_, n in self.spans(text))

    def counts(self, texts: list[str | None]) -> list[int]:
        whole = [t or "" for t in texts]
        short = [i for i, t in enumerate(whole) if len(t) <= self.chunk or not self.splits]
        out = [0] * len(whole)
        for i, ids in zip(short, self.model.encode([whole[i] for i in short], num_threads=1)):
            out[i] = len(ids)
        for i in set(range(len(whole))) - set(short):
            out[i] = self.count(whole[i])
        return out


_LOADED: dict[tuple, Counter] = {}
#: Texts handed to the tokenizer at once.
TOGETHER = 256


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """docs with the number of tokens of each text."""

    def start():
        key = (path, chunk, overlap)
        if key not in _LOADED:
            _LOADED[key] = Counter(*key)
        counter = _LOADED[key]

        def compute(texts):
            counts = []
            for i in range(0, len(texts), TOGETHER):
                counts += counter.counts(texts.slice(i, TOGETHER).to_pylist())
            return [pa.array(counts, pa.int64())]

        return compute

    return append_columns(docs, [text], [T.StructField(name, T.LongType())], start)


def report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed a limit, for every document."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(sized, path).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
