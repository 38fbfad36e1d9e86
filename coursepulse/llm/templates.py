"""Benchmark decontamination on template windows (operator 9).

Words are lower-cased and stripped of punctuation; numbers, names and units become typed
placeholders, and windows of WINDOW words are hashed in two forms, literal and as a template. A
filter of bits of a fixed size, filled from the benchmark's hashes, thins out the documents'
windows inside the scan; what is left is joined with the benchmark's windows on the hash, so the filter
decides nothing. A capitalised word that begins a sentence is read both ways, as itself and as a
name, so there are two readings of a template window. Windows of a document and an item that lie on one diagonal (the same shift of
positions) under one reading each are an alignment. It is a leak if a literal window matches, or if enough of the item's
template windows match and the values in the slots are consistent: each value of the item stands
for one value of the document. Two values of the item may have got the same new one.
A value of several words, a name ("Mary Ann") or a number in words ("twenty five", "3 million"), is one
placeholder, so windows and shifts of templates count placeholders and words, not words alone. An alignment of
templates needs two words beside the placeholders: kinds alone would match every
table of as many numbers. An item without them is found by its own values.

Defined cases: a null or empty text has no windows. An item of fewer than WINDOW words is one window. An item of
fewer than MIN_WORDS words is found where it stands by itself: between ends of texts, lines or sentences, marks
between words, quotes or brackets; inside a sentence such few words say nothing. Items with equal text count as the one with the
smallest id. Documents are told apart by id and text, so rows without id are judged each, and
repeated rows alike. A very long text is worked on by one task, in memory of some 200 bytes a word. Without
documents or items nothing leaks.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepulse.llm.common import MAX_CACHED, map_arrow, mixed, stored, utf8

WINDOW, MIN_WORDS = 13, 5
#: A leak without a literal window needs this share of the item's windows on one diagonal.
ITEM_SHARE = 0.5
#: Documents that a task works on at once: some 100,000 words.
ROWS = 200
#: Bits of the filter per window of the benchmark, and most bits in all (16 MB).
BITS_PER_WINDOW, MAX_BITS = 32, 1 << 27

# Words for numbers, units and given names.
NUMBER_WORDS = set(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = set(
    "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters mg g kg gram grams kilogram "
    "kilograms ton tons lb lbs oz pound pounds ounce ounces ml l litre litres liter liters gallon gallons ms second "
    "seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro "
    "euros percent degrees volts watts amps kmh mph".split()
)
NAMES = set(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph "
    "jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty mark sandra paul emily peter anna "
    "maria jose juan carlos pedro luis pierre jean marie claire hans klaus petra heidi alice bob tom sam emma olivia "
    "noah liam sophia lucas leo julia natalia".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(st|nd|rd|th)?")
WITH_UNIT = re.compile(rf"[+-]?\d[\d.,]*({'|'.join(sorted(UNITS, key=len, reverse=True))})")
EDGES = string.punctuation.replace("+", "").replace("-", "") + "-+“”‘’«»–—…¿¡"

#: Kinds of words.
LITERAL, NUMBER_SLOT, NAME_SLOT, UNIT_SLOT, MEASURE_SLOT = range(5)
#: Readings of a window: its words, or a template where capitalised words are names inside of sentences or everywhere.
EXACT, INSIDE, EVERYWHERE = range(3)
LINE_BREAK = re.compile(rb"[\r\n]+")
#: Flags beside the kind in the low bits of a word's code: it is capitalised, ends a sentence, has no letter or digit,
#: is a number in words, is followed by a mark, opens or ends something that stands by itself.
KIND, CAPITAL, CLOSES, EMPTY, IN_WORDS, MARKED, OPENS, ENDS, FLAGS = 7, 8, 16, 32, 64, 128, 256, 512, 1023
OPENING, ENDING = "\"'([{<“‘«„¿¡", ".!?:;\"')]}>”’»"


def plain(word: str) -> str:
    return word.strip(EDGES).lower()


def in_words(word: str) -> bool:
    """Whether a plain word is a number: five, twenty-five."""
    return word in NUMBER_WORDS or "-" in word and all(part in NUMBER_WORDS for part in word.split("-"))


def kind_of(word: str) -> int:
    """Kind of a plain word by itself."""
    if word[:1].isdigit() or word[:1] in ("+", "-"):
        if WITH_UNIT.fullmatch(word):
            return MEASURE_SLOT
        if NUMBER.fullmatch(word):
            return NUMBER_SLOT
    if in_words(word):
        return NUMBER_SLOT
    return UNIT_SLOT if word in UNITS else NAME_SLOT if word in NAMES else LITERAL


#: Kinds and flags of the words listed above.
LISTED = {
    w.encode(): kind_of(w) | (IN_WORDS if in_words(w) else 0) for words in (NUMBER_WORDS, UNITS, NAMES) for w in words
}


class WordCodes(dict):
    """Hash of each word's plain form, with its kind and flags in the low bits."""

    def __missing__(self, raw: bytes) -> int:
        if raw.isalpha():  # ASCII letters alone, as most words are
            own = raw.lower()
            flags = LISTED.get(own, LITERAL) | (CAPITAL if raw[:1].isupper() else 0)
        else:
            word = raw.decode("utf-8", "replace")
            bare = word.strip(EDGES)
            lower = bare.lower()
            own, flags = lower.encode(), kind_of(lower) | (IN_WORDS if in_words(lower) else 0)
            flags |= (CAPITAL if bare[:1].isupper() else 0) | (0 if bare else EMPTY)
            if not word[-1].isalnum():
                flags |= MARKED | (ENDS if word[-1] in ENDING else 0)
                flags |= CLOSES if word.rstrip("\"')”’»")[-1:] in (".", "!", "?", ":") else 0
            flags |= OPENS if word[0] in OPENING else 0
        if len(self) >= MAX_CACHED:
            self.clear()
        code = self[raw] = xxhash.xxh3_64_intdigest(own) & ~FLAGS | flags
        return code


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0xD6E8FEB86659FD93) + right)


def _rolled(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` values, put together from runs of powers of two."""
    out, done, run, width = None, 0, x, 1
    while True:
        if size & width:
            n = len(x) - done - width + 1
            part = run[done : done + max(n, 0)]
            out = part.copy() if out is None else _joined(out[: len(part)], part)
            done += width
        width *= 2
        if width > size:
            return out + np.uint64(size)
        run = _joined(run[: max(len(run) - width // 2, 0)], run[width // 2 :])


class Windows:
    """The windows of some texts in each reading: literal ones over words, templates over words and placeholders."""

    def __init__(self, raws: list[bytes | None], codes: WordCodes):
        self.words, counts, breaks = [], [], []
        for raw in raws:
            before = len(self.words)
            for line in LINE_BREAK.split(raw or b""):
                breaks.append(len(self.words))
                self.words += line.split()
            counts.append(len(self.words) - before)
        code = np.fromiter(map(codes.__getitem__, self.words), np.uint64, len(self.words))
        text = np.repeat(np.arange(len(raws)), counts)
        flags = (code & np.uint64(FLAGS)).astype(np.int64)
        # Places before each word and after the last one: where a line or text begins, what ends there, what can't go on.
        begins = np.zeros(len(code) + 1, bool)
        begins[[0, len(code), *breaks]] = True
        closes, apart = begins.copy(), begins.copy()
        closes[1:-1] |= flags[:-1] & CLOSES > 0
        apart[1:-1] |= (flags[:-1] & (ENDS | EMPTY) > 0) | (flags[1:] & (OPENS | EMPTY) > 0)
        goes_on = ~apart[:-1]
        goes_on[1:] &= flags[:-1] & MARKED == 0
        self.at = np.flatnonzero(flags & EMPTY == 0)
        self.begins, self.ends = apart[:-1][self.at], apart[1:][self.at]
        literal = code[self.at] & ~np.uint64(FLAGS)
        own, goes_on = flags[self.at], goes_on[self.at]
        self.n, self.n_words = len(raws), {}
        self.token, self.text, self.first, self.hash, self.kind, self.slots_before = {}, {}, {}, {}, {}, {}
        self._add(EXACT, text, np.arange(len(self.at)), np.zeros(len(self.at), np.int64), literal)
        named = (own & KIND == LITERAL) & (own & CAPITAL > 0)
        for reading, names in ((INSIDE, named & ~closes[:-1][self.at]), (EVERYWHERE, named)):
            kind = np.where(names, NAME_SLOT, own & KIND)
            more = np.zeros(len(kind), bool)
            one_value = (kind[1:] == NAME_SLOT) | (kind[1:] == NUMBER_SLOT) & (own[1:] & IN_WORDS > 0)
            more[1:] = goes_on[1:] & one_value & (kind[1:] == kind[:-1])
            token = np.flatnonzero(~more)
            kind = kind[token]
            self._add(reading, text, token, kind, np.where(kind == LITERAL, literal[token], kind.astype(np.uint64)))

    def _add(self, reading: int, text: np.ndarray, token: np.ndarray, kind: np.ndarray, hashed: np.ndarray) -> None:
        """A reading: the first word of each token, and tokens' kinds and hashes."""
        self.token[reading], self.kind[reading], self.hash[reading] = token, kind, hashed
        self.text[reading] = text[self.at[token]]
        self.slots_before[reading] = np.append(0, np.cumsum(kind != LITERAL))
        self.n_words[reading] = np.bincount(self.text[reading], minlength=self.n)
        self.first[reading] = np.cumsum(self.n_words[reading]) - self.n_words[reading]

    def of(self, size: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of all windows of a size. A window without placeholders has only its literal form."""
        text = self.text[reading]
        n = len(text) - size + 1
        if n < 1 or reading != EXACT and size < MIN_WORDS:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        there = text[:n] == text[size - 1 :]
        before = self.slots_before[reading]
        if reading != EXACT:
            there &= before[size:] > before[:n]
        at = np.flatnonzero(there)
        hashes = _rolled(self.hash[reading], size)[at]
        return at, hashes if reading == EXACT else mixed(hashes + np.uint64(1))

    def by_itself(self, at: np.ndarray, size: int) -> np.ndarray:
        """Whether literal windows stand by themselves."""
        return self.begins[at] & self.ends[at + size - 1]

    def slots(self, start: int, size: int, reading: int) -> list[tuple[int, int, str]]:
        """Placeholders of a window: offset, kind and value."""
        kind, token = self.kind[reading], self.token[reading]
        return [
            (i, int(kind[start + i]), self._value(token, start + i)) for i in range(size) if kind[start + i] != LITERAL
        ]

    def _value(self, token: np.ndarray, i: int) -> str:
        end = token[i + 1] if i + 1 < len(token) else len(self.at)
        return " ".join(plain(self.words[w].decode("utf-8", "replace")) for w in self.at[token[i] : end])


SLOTS = "slots array<struct<offset:int,kind:int,value:string>>"
KEYED = f"hash long, exact boolean, reading int, size int, place int, word int, {SLOTS}"


def _emit(rows: list[tuple], lead: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    slot = pa.struct([("offset", pa.int32()), ("kind", pa.int32()), ("value", pa.string())])
    fields = [
        *lead, ("hash", pa.int64()), ("exact", pa.bool_()), ("reading", pa.int32()), ("size", pa.int32()), ("place", pa.int32()),
        ("word", pa.int32()), ("slots", pa.list_(slot)),
    ]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _rows(found: Windows, lead: tuple, start: int, size: int, hashed: int, reading: int) -> tuple:
    """A window with its place among the text's tokens, and its first word."""
    text = found.text[reading][start]
    place = start - found.first[reading][text]
    word = found.token[reading][start] - found.first[EXACT][text]
    exact = reading == EXACT
    slots = [] if exact else [{"offset": o, "kind": k, "value": v} for o, k, v in found.slots(start, size, reading)]
    return (*lead, int(np.int64(np.uint64(hashed))), exact, reading, size, int(place), int(word), slots)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_windows of the reading) and keyed windows of all items, equal texts once."""
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))

    def run(batches):
        codes = WordCodes()
        for batch in batches:
            raws, ids = utf8(batch.column(0)), batch.column(1).to_pylist()
            found, rows = Windows(raws, codes), []
            for reading, n_words in found.n_words.items():
                for size in range(1, WINDOW + 1):
                    at, hashes = found.of(size, reading)
                    text = found.text[reading][at]
                    for i in np.flatnonzero(np.minimum(n_words[text], WINDOW) == size):
                        lead = ids[text[i]], int(n_words[text[i]] - size + 1)
                        rows.append(_rows(found, lead, at[i], size, hashes[i], reading))
            yield _emit(rows, [("item_id", pa.int64()), ("n_windows", pa.int32())])

    return map_arrow(items.select("text", F.col("item_id").cast("long")), run, f"item_id long, n_windows int, {KEYED}")


def bits_of(windows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Filter with a bit for each hash; its size follows the number of windows up to MAX_BITS."""
    bits = min(MAX_BITS, 1 << max(10, (BITS_PER_WINDOW * n).bit_length()))
    bit = F.col("hash").bitwiseAND(bits - 1)
    words = windows.select(F.shiftright(bit, 5).cast("int").alias("w"), (bit % 32).alias("b")).groupBy("w")
    filled = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("v")).toPandas()
    filter_ = np.zeros(bits // 32, np.uint32)
    filter_[filled["w"].to_numpy(np.int64)] = filled["v"].to_numpy(np.int64).astype(np.uint32)
    return filter_, bits


def document_windows(docs: DataFrame, shared: Broadcast, n_bits: int, sizes: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, text_hash) and keyed windows of documents, of these sizes and readings, that pass the broadcast filter."""

    def passes(bits, hashes):
        bit = hashes & np.uint64(n_bits - 1)
        return (bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & 1 > 0

    def run(batches):
        codes, bits = WordCodes(), shared.value
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                lead = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                found, rows = Windows(utf8(batch.column(2)), codes), []
                for size, reading in sizes:
                    at, hashes = found.of(size, reading)
                    near = passes(bits, hashes)
                    if size < MIN_WORDS:
                        near &= found.by_itself(at, size)
                    for i in np.flatnonzero(near):
                        rows.append(_rows(found, lead[found.text[reading][at[i]]], at[i], size, hashes[i], reading))
                yield _emit(rows, [("doc_id", pa.int64()), ("text_hash", pa.int64())])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(keyed, run, f"doc_id long, text_hash long, {KEYED}")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold an item, one row for each pair.

    doc_id, text_hash, item_id, exact_windows, template_windows, n_windows (of the item) and
    first_word (where in the document the longest alignment begins).
    """
    spark = docs.sparkSession
    items = stored(item_windows(benchmark), "items")
    # At most WINDOW sizes of literal windows and of templates; a template is looked for in both readings.
    known = {(r["size"], r["exact"]): r["n"] for r in items.groupBy("size", "exact").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [(size, r) for size, exact in sorted(known) for r in ((EXACT,) if exact else (INSIDE, EVERYWHERE))]
    bits, n_bits = bits_of(items, sum(known.values()))
    shared = spark.sparkContext.broadcast(bits)
    found = stored(document_windows(docs, shared, n_bits, sizes), "windows")

    literals = F.array_except(F.sequence(F.lit(0), F.col("size") - 1), F.col("slots.offset"))
    right = items.select(
        "item_id", "n_windows", "hash", "exact", "size", F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"), F.col("reading").alias("item_reading"),
        (F.col("place") + F.array_min(literals)).alias("first_literal"),
        (F.col("place") + F.array_max(literals)).alias("last_literal"),
    )
    matched = found.join(right, ["hash", "exact", "size"]).withColumn("shift", F.col("place") - F.col("item_place"))
    matched = stored(matched, "matched")
    aligned = ["doc_id", "text_hash", "item_id", "n_windows", "shift", "reading", "item_reading"]
    counted = matched.groupBy(*aligned).agg(
        F.count_distinct(F.when(F.col("exact"), F.col("item_place"))).alias("exact_windows"),
        F.count_distinct(F.when(~F.col("exact"), F.col("item_place"))).alias("template_windows"),
        F.count_distinct("item_place").alias("windows"),
        F.min("word").alias("first_word"),
        # From the item's first word beside placeholders to its last: more than 0 for two words.
        (F.max("last_literal") - F.min("first_literal")).alias("reach"),
    )
    values = matched.where(~F.col("exact")).select(*aligned, F.explode(F.arrays_zip("slots", "item_slots")).alias("s"))
    values = values.select(
        *aligned, F.col("s.slots.kind").alias("kind"), F.col("s.slots.value").alias("own"),
        F.col("s.item_slots.value").alias("theirs"), F.col("s.item_slots.kind").alias("their_kind"),
    ).distinct()
    forth = values.groupBy(*aligned, "their_kind", "theirs").agg(F.count_distinct("kind", "own").alias("n"))
    broken = forth.where("n > 1").select(*aligned).distinct()
    broken = broken.select(*(F.col(c).alias(f"_{c}") for c in aligned), F.lit(True).alias("broken"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in aligned]
    judged = counted.join(broken, same, "left")
    leaking = judged.where(
        (F.col("exact_windows") > 0)
        | F.col("broken").isNull()
        & (F.col("reach") > 0)
        & (F.col("windows") >= F.ceil(F.col("n_windows") * ITEM_SHARE))
    )
    return leaking.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(
        F.max("exact_windows").alias("exact_windows"),
        F.max("template_windows").alias("template_windows"),
        F.min_by("first_word", F.struct(-F.col("windows"), F.col("first_word"))).alias("first_word"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item; columns as they were, whatever their names."""
    names = docs.columns
    doc, text = (f"_col{[c.lower() for c in names].index(c)}" for c in ("doc_id", "text"))
    own = docs.toDF(*(f"_col{i}" for i in range(len(names))))
    found = leaks(docs.select("doc_id", "text"), benchmark)
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col(doc).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    return own.join(found, same, "left_anti").toDF(*names)
