"""Near-duplicate documents by a multi-index Hamming join of minhash signatures (operator 10).

A document is the set of its distinct 5-word shingles. Equal sets form a class, told apart by 64
bits of hash. A class's signature has VALUES minhashes of 32 bits; signatures that differ in at most DISTANCE
values are candidates, and a link is confirmed on the full sets. At a similarity of 0.75 the
distance has mean 16 and deviation 3.5, so 33 is passed about once in a million pairs.

The join: a signature is split into chunks of two values with one error allowed in a chunk. Chunks
with two errors number DISTANCE // 2 at most, so by pigeonhole the others, half of all chunks, have
one error or none. Enumerating the errors of a chunk gives two keys, each one value with its place.
Two candidates share VALUES - DISTANCE keys or more, hence each needs to be looked up under its
DISTANCE + 1 rarest keys only, in an order by frequency that is the same for all. Keys that only
one class has come first and need no lookup.

Keys of many classes (long shared passages, large families of copies) aren't expanded to pairs.
Their members take an exact way on full sets. Sets of x and y shingles with a similarity of 0.75
share 3/7 (x + y) or more, so the rarest shingle they share stands early enough in either order
to leave room for the rest. Where such a shingle is itself common, members are compared with its
centres; then members outside the component of the majority are compared with those others of
that shingle for which there is room, since a link within a component adds nothing to it.

Defined cases: a document without words or text has no shingles and is linked with nothing. Rows
that share doc_id are one document. A row without doc_id takes no part: its component is null and it
is kept. Repeated rows fall into one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coursepulse.llm.common import WordHashes, append_columns, mixed, stored, utf8, windows
from coursepulse.llm.components import components

SHINGLE = 5
#: A link needs an intersection of this many hundredths of the union.
SIMILARITY = 75
VALUES, DISTANCE = 64, 33
#: Classes under one key up to which all their pairs are taken.
SMALL = 24

_RNG = np.random.default_rng(10)
_XOR = _RNG.integers(0, 1 << 32, VALUES, np.uint64).astype(np.uint32)
_ODD = _RNG.integers(0, 1 << 32, VALUES, np.uint64).astype(np.uint32) | np.uint32(1)
_BLOCK = 4_096


def shingles(raw: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; with fewer words, of the whole sequence."""
    words = (raw or b"").lower().split()
    return np.unique(windows(hashes.of(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """VALUES minhashes of a set."""
    narrow = (mixed(own.copy()) >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(narrow), _BLOCK):
        x = (narrow[i : i + _BLOCK, None] ^ _XOR) * _ODD
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class and signature of every document; the last two null without shingles."""

    def start():
        hashes = WordHashes()

        def compute(texts):
            sizes, classes, signatures = [], [], []
            for raw in utf8(texts):
                own = shingles(raw, hashes)
                sizes.append(len(own))
                classes.append(_signed(xxhash.xxh3_64_intdigest(own.tobytes())) if len(own) else None)
                signatures.append(signature(own).view(np.int32) if len(own) else None)
            return [
                pa.array(sizes, pa.int64()),
                pa.array(classes, pa.int64()),
                pa.array(signatures, pa.list_(pa.int32())),
            ]

        return compute

    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("cid", T.LongType()),
        T.StructField("signature", T.ArrayType(T.IntegerType())),
    ]
    return append_columns(docs.select("doc_id", "text"), ["text"], fields, start).drop("text")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the classes in wanted (cid, doc_id), computed again from their texts."""

    def start():
        hashes = WordHashes()

        def compute(texts):
            own = [shingles(raw, hashes).view(np.int64) for raw in utf8(texts)]
            return [
                pa.array([_signed(xxhash.xxh3_64_intdigest(s.tobytes())) for s in own], pa.int64()),
                pa.array(own, pa.list_(pa.int64())),
            ]

        return compute

    fields = [T.StructField("cid", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = append_columns(texts, ["text"], fields, start).select("cid", "shingles")
    # Rows that share an id may bring in a set nobody asked for, and repeated rows the same one twice.
    return found.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def _rarest(keys: DataFrame) -> DataFrame:
    """The keys under which a class must be looked up: keys (key, cid, total, reach) with size and place.

    total: keys the class has; reach: how many of its rarest ones matter; place: where the key
    stands in the class's order by frequency. Keys of one class only fall away, but count as the rarest.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keys.join(sizes, "key")
    own = W.partitionBy("cid")
    return (
        shared.withColumn("alone", F.col("total") - F.count(F.lit(1)).over(own))
        .withColumn("place", F.row_number().over(own.orderBy("size", "key")) + F.col("alone"))
        .where(F.col("place") <= F.col("reach"))
        .select("key", "cid", "size", "total", "place")
    )


def _pairs(small: DataFrame) -> DataFrame:
    """All pairs (a < b) of classes under keys of few classes. Equal member lists are expanded once."""
    lists = small.groupBy("key").agg(F.array_sort(F.collect_set("cid")).alias("members")).where(F.size("members") > 1)
    first = lists.select("members").distinct().select("members", F.posexplode("members").alias("i", "a"))
    rest = F.slice("members", F.col("i") + 2, F.lit(SMALL))
    return first.select("a", F.explode(rest).alias("b")).distinct()


def _room(total_a: Column, place_a: Column, total_b: Column, place_b: Column) -> Column:
    """Whether sets can be similar whose rarest common shingle stands at these places, or further on."""
    needed = F.ceil((total_a + total_b) * SIMILARITY / (100 + SIMILARITY))
    sizes = 100 * F.least(total_a, total_b) >= SIMILARITY * F.greatest(total_a, total_b)
    return sizes & (total_a - place_a + 1 >= needed) & (total_b - place_b + 1 >= needed)


def _with_centres(large: DataFrame) -> DataFrame:
    """Pairs of each class under a common key with the key's centres.

    One centre is the class for which the key stands first, hence with the fewest rarer shingles;
    the other is any.
    """
    row = F.struct("cid", "total", "place")
    chosen = large.groupBy("key").agg(
        F.min_by(row, F.struct("place", "cid")).alias("c0"), F.min_by(row, F.xxhash64("cid", "key")).alias("c1")
    )
    near = large.join(chosen, "key")
    other = [
        F.when(_room(F.col("total"), F.col("place"), F.col(f"{c}.total"), F.col(f"{c}.place")), F.col(f"{c}.cid"))
        for c in ("c0", "c1")
    ]
    near = near.groupBy("cid").agg(*(F.collect_set(o).alias(f"o{i}") for i, o in enumerate(other)))
    pairs = near.select("cid", F.explode(F.array_union("o0", "o1")).alias("other")).where("cid != other")
    return pairs.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.distinct().join(left, "a").join(right, "b")
    union = F.size("sa") + F.size("sb") - F.col("common")
    return (
        joined.where(100 * F.least(F.size("sa"), F.size("sb")) >= SIMILARITY * F.greatest(F.size("sa"), F.size("sb")))
        .withColumn("common", F.size(F.array_intersect("sa", "sb")))
        .where(100 * F.col("common") >= SIMILARITY * union)
        .select("a", "b")
    )


def _stragglers(large: DataFrame, labels: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs under common keys that lie in different components, of which one isn't the key's largest."""
    marked = large.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        "key", "cid", "total", "place", F.coalesce("label", "cid").alias("label")
    )
    sized = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    split = (
        sized.groupBy("key")
        .agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .drop("parts")
    )
    marked = marked.join(split, "key")
    outside = marked.where("label != main").select(*(F.col(c).alias(f"x_{c}") for c in marked.columns))
    fits = _room(F.col("x_total"), F.col("x_place"), F.col("total"), F.col("place"))
    apart = (F.col("x_key") == F.col("key")) & (F.col("x_label") != F.col("label")) & fits
    pairs = outside.join(marked, apart).select(
        F.least("x_cid", "cid").alias("a"), F.greatest("x_cid", "cid").alias("b")
    )
    return pairs.distinct().join(compared, ["a", "b"], "left_anti")


def link(docs: DataFrame, described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (cid, doc_id: the smallest) and confirmed links (a, b) that join all similar classes."""
    classes = stored(
        described.where(F.col("cid").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("cid")
        .agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")),
        "classes",
    )
    value = F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)
    keys = classes.select("cid", F.posexplode("signature").alias("at", "value")).select(
        F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(value).alias("key"),
        "cid",
        F.lit(VALUES).alias("total"),
        F.lit(DISTANCE + 1).alias("reach"),
    )
    lookups = stored(_rarest(keys), "lookups")
    few = stored(_pairs(lookups.where(F.col("size") <= SMALL)), "pairs")
    crowded = lookups.where(F.col("size") > SMALL).select("cid").distinct()

    members = few.select(F.col("a").alias("cid")).unionAll(few.select(F.col("b").alias("cid"))).unionAll(crowded)
    wanted = members.distinct().join(classes.select("cid", "doc_id"), "cid")
    sets = stored(full_sets(docs, wanted), "sets")

    n = F.size("shingles")
    exact = (
        sets.join(crowded, "cid", "left_semi")
        .withColumn("reach", n - F.ceil(n * SIMILARITY / 100) + 1)
        .select(F.explode("shingles").alias("key"), "cid", n.alias("total"), "reach")
    )
    exact = stored(_rarest(exact), "crowded")
    common = exact.where(F.col("size") > SMALL)
    pairs = few.unionAll(_pairs(exact.where(F.col("size") <= SMALL))).unionAll(_with_centres(common))
    pairs = stored(pairs.distinct(), "candidates")
    links = stored(_confirmed(pairs, sets), "confirmed")
    if common.limit(1).count():
        rest = stored(_stragglers(common, components(links), pairs), "stragglers")
        links = links.unionAll(_confirmed(rest, sets))
    return classes, links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every document."""
    described = stored(describe(docs), "described")
    classes, links = link(docs, described)
    labels = components(links)
    linked = labels.join(classes.select(F.col("cid").alias("node"), "doc_id"), "node")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component"))
    of_class = (
        classes.select("cid", "doc_id")
        .join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        .join(least, "label", "left")
        .select("cid", F.coalesce("component", "doc_id").alias("component"))
    )
    rows = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cid")).alias("cid"))
    return rows.join(of_class, "cid", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of every group of near-duplicates, and all rows without doc_id; columns as they were, whatever their names."""
    names = docs.columns
    doc = f"_col{[c.lower() for c in names].index('doc_id')}"
    own = docs.toDF(*(f"_col{i}" for i in range(len(names))))
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    known = own.where(F.col(doc).isNotNull()).join(kept, F.col(doc) == F.col("_kept"), "left_semi")
    return known.dropDuplicates([doc]).unionAll(own.where(F.col(doc).isNull())).toDF(*names)
