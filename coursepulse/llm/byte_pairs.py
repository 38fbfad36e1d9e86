"""Byte-level pair encoding of whole texts, and decoding (operator 8).

A short word is encoded on a contiguous array: its parts lie side by side with the rank of every
adjacent pair, the smallest rank is looked for again and again, the boundary there is deleted and
the two neighbouring ranks are refreshed. Words beyond SHORT parts take the same merges from a
heap, as the scans of a long array would grow with its square.

Defined cases: a null text counts as empty and has no ids; special strings inside a text become
their own id, as the tokenizer file's library does by default. Repeated rows are encoded each;
other columns pass through, except those that carry an output's name.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse.llm.common import MAX_CACHED, append_columns

#: Parts up to which a word counts as short.
SHORT = 64
NEVER = 1 << 60

# Fixed value: white space as the file's pre-tokenizer has it, and its pattern for words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BytePairs(dict):
    """Tokenizer of one vocabulary file; as a dict, it holds the packed ids of words met."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE file is needed")
        vocab = model["vocab"]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = n
            self.merged.append(vocab[left + right])
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in special.items()}
        self.special = {content: array("I", [i]).tobytes() for content, i in special.items()}
        self.special_in = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.words = regex.compile(WORD).findall

    def __missing__(self, word: str) -> bytes:
        ids = [self.first[b] for b in word.encode()]
        ids = self._long(ids) if len(ids) > SHORT else self._short(ids)
        if len(self) >= MAX_CACHED:
            self.clear()
        packed = array("I", ids).tobytes()
        if len(word) <= SHORT:
            self[word] = packed
        return packed

    def _short(self, parts: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NEVER)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same merges, smallest rank first and leftmost among equals, from a heap."""
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (q := rank(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (q, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special or not self.special_in.search(text):
            return b"".join(map(self.__getitem__, self.words(text)))
        found = []
        for piece in self.special_in.split(text):
            found.append(self.special.get(piece) or b"".join(map(self.__getitem__, self.words(piece))))
        return b"".join(found)

    def decode(self, packed: bytes) -> str:
        ids = array("I", packed)
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _arrow(values: Sequence, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of the text's token ids, little-endian, four bytes each."""

    def start():
        pairs = _tokenizer(path)
        return lambda texts: [_arrow([pairs.encode(t) if t else b"" for t in texts.to_pylist()], pa.binary())]

    return append_columns(docs, [text], [T.StructField(ids, T.BinaryType())], start)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of packed token ids; null ids give the empty text."""

    def start():
        pairs = _tokenizer(path)
        return lambda packed: [_arrow([pairs.decode(p) if p else "" for p in packed.to_pylist()], pa.string())]

    return append_columns(df, [ids], [T.StructField(text, T.StringType())], start)


_LOADED: dict[str, BytePairs] = {}


def _tokenizer(path: str) -> BytePairs:
    """One tokenizer, and so one table of words, for all tasks of a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of ids and decoded text for every document."""
    coded = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
