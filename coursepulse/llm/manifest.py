"""Merkle manifest of a table: a root digest for all rows, and a proof for each of them.

Method (checkpoint and recompute): the leaves of a tree stand in order and every FANOUT
consecutive nodes hash into one until one is left. Only the leaves and every second level above
them are stored. A proof needs the siblings on all levels: extraction reads a stored level in
aligned subtrees of SPAN nodes under one node of the next stored level, computes the level between
from them, hands every node its siblings on both levels and forgets the level between again. A
subtree gives its part of the path to all rows below it, from the top down, so a level's rows
are joined to the one above it by one key for SPAN rows.

Trees are numbered in parallel: rows are dealt out by ranges of (tree, order), every range counts
its rows for each tree, and the counts before it give the ranks. A tree with a third of all rows lies in
as many ranges as its size asks for. Groups hold at most SPAN rows. The driver sees one number, the size
of the largest tree.

Defined cases. Null field: marked as such in the leaf, so null and empty text differ. Null order
value: first. Null name of a tree: a tree of its own, before all others. Rows of equal order
value stand by leaf digest, and equal rows side by side, each with a proof for its own place. A tree
of one row: its leaf is the subroot. A table of one row: the leaf is the root, the proof is empty.
Empty table: no rows. Very long texts are hashed once, in the first pass. Columns beyond the fields asked
for take no part and can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursepulse.llm.common import stored
from coursepulse.llm.spans import let

#: Nodes that hash into one; levels from one stored level to the next; nodes under a stored node.
FANOUT = 16
LEVELS = 2
SPAN = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests left and right of a node among those that hash into its parent, joined.
STEP = "struct<left:string,right:string>"


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its length in bytes and itself, or '-' where null."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(digests: Column) -> Column:
    """Digests of the level above, of an aligned run of nodes."""
    last = F.floor((F.size(digests) - 1) / FANOUT).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda j: F.sha2(_joined(F.slice(digests, j * FANOUT + 1, FANOUT)), 256)
    )


def _step(digests: Column, at: Column) -> Column:
    """Siblings of the node at a place (from 0) of an aligned run."""
    within = F.pmod(at, F.lit(FANOUT))
    return F.struct(
        _joined(F.slice(digests, at - within + 1, within)).alias("left"),
        _joined(F.slice(digests, at + 2, F.lit(FANOUT - 1) - within)).alias("right"),
    )


def ranked(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """items (tree, ...) with idx, the place in the tree from 0, and m, the tree's number of rows."""
    keys = ["tree", *order]
    # Finding the ranges reads the rows once more: the stored ones, not what they were made from.
    items = stored(items, "items")
    placed = items.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    # The number of the range is in the upper bits of the id.
    placed = placed.withColumn("range", F.shiftright("at", 33))
    counted = placed.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = W.partitionBy("tree")
    shifts = counted.select(
        "tree",
        "range",
        (F.sum("n").over(tree.orderBy("range")) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(tree).alias("m"),
    )
    joined = placed.join(stored(shifts, "shifts"), ["tree", "range"])
    return joined.select(*items.columns, (F.col("at") + F.col("shift")).alias("idx"), "m")


def _subtrees(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Nodes (tree, idx, digest, m) that have a parent, gathered in order under the next stored level."""
    above = F.floor(F.col("idx") / SPAN).cast("long")
    return (
        nodes.where("m > 1")
        .groupBy("tree", above.alias("above"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", "digest", *payload))).alias("nodes"), F.first("m").alias("m"))
    )


def _above(nodes: DataFrame) -> DataFrame:
    """The next stored level. A subtree of one run ends a level earlier: its parent is the top."""
    parents = F.transform("nodes", lambda x: x["digest"])
    top = let(
        _parents(parents),
        lambda p: F.when(F.col("m") > FANOUT, F.sha2(_joined(p), 256)).otherwise(F.element_at(p, 1)),
    )
    return _subtrees(nodes).select(
        "tree", F.col("above").alias("idx"), top.alias("digest"), F.ceil(F.col("m") / SPAN).cast("long").alias("m")
    )


@dataclass(frozen=True)
class Forest:
    """Stored levels of trees, the leaves first, and the leaves' further columns."""

    levels: tuple[DataFrame, ...]
    payload: tuple[str, ...]

    @property
    def tops(self) -> DataFrame:
        """(tree, digest): what remains of every tree."""
        found = [level.where("m = 1").select("tree", "digest") for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out

    def proofs(self, tops: DataFrame) -> DataFrame:
        """All leaves with their paths, from the leaf up.

        tops: tree, the path of its top, and columns that all its leaves get.
        """
        carried = [c for c in tops.columns if c not in ("tree", "path")]
        rows = None
        for level, nodes in reversed(list(enumerate(self.levels))):
            payload = [] if level else list(self.payload)
            alone = nodes.where("m = 1").join(tops, "tree")
            columns = ["tree", "idx", "digest", *payload, "path", *carried]
            found = alone.select(*columns)
            if rows is not None:
                found = found.unionAll(self._below(nodes, payload, rows, carried).select(*columns))
            rows = found
        return rows

    @staticmethod
    def _below(nodes: DataFrame, payload: list[str], rows: DataFrame, carried: list[str]) -> DataFrame:
        """Nodes with their paths, from the rows of the stored level above."""
        upper = rows.select("tree", F.col("idx").alias("above"), "path", *carried)
        groups = _subtrees(nodes, payload).join(upper, ["tree", "above"])
        digests = F.transform("nodes", lambda x: x["digest"])

        def steps(own: Column, parents: Column, at: Column) -> Column:
            first = F.array(_step(own, at))
            parent = F.floor(at / FANOUT).cast("int")
            return F.when(F.col("m") > FANOUT, F.concat(first, F.array(_step(parents, parent)))).otherwise(first)

        def each(own: Column, parents: Column) -> Column:
            return F.transform(
                "nodes",
                lambda x, at: F.struct(
                    *(x[c].alias(c) for c in ("idx", "digest", *payload)),
                    F.concat(steps(own, parents, at), F.col("path")).alias("path"),
                ),
            )

        members = let(digests, lambda own: let(_parents(own), lambda parents: each(own, parents)))
        return groups.select("tree", *carried, F.inline(members))


def grow(items: DataFrame, order: Sequence[str]) -> Forest:
    """Store the levels of the trees over items (tree, digest, ...), which stand in the order asked for."""
    payload = tuple(c for c in items.columns if c not in ("tree", "digest"))
    levels = [stored(ranked(items, order), "level")]
    size = levels[0].agg(F.max("m")).first()[0] or 0
    while size > 1:
        levels.append(stored(_above(levels[-1]), "level"))
        size = -(-size // SPAN)
    return Forest(tuple(levels), payload)


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, own, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proofs(rows: DataFrame, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """rows (name, digest, ...) with subroot, root and path.

    name: the tree that a row belongs to. Within a tree rows stand by order, then by digest; the trees'
    tops stand by name, null first, and form a tree of their own.
    """
    # A key that is never null and sorts as the name does.
    key = F.coalesce(F.concat(F.lit("="), F.col("name").cast("string")), F.lit(""))
    items = rows.withColumn("tree", key).drop("name")
    trees = grow(items, [*order, "digest"])
    subroots = trees.tops.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("key"))
    whole = grow(subroots, ["key"])
    root = whole.tops.select("tree", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))
    tops = whole.proofs(root).select(F.col("key").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return trees.proofs(stored(tops, "tops"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, name of the tree (the source) and digest of every row; tampered: the digest after tampering.

    Where 5 divides the checksum of doc_id, tampering lower-cases A-Z in the text; else it is null.
    """
    values = {c: F.col(c) for c in FIELDS}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = values | {"text": F.translate("text", upper, upper.lower())}
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(
        "doc_id",
        F.col("source").alias("name"),
        leaf(list(values.values())).alias("digest"),
        F.when(hit, leaf(list(lowered.values()))).alias("tampered"),
    )


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, digest of the proof, and what folding the row as it is now gives."""
    found = proofs(leaves(docs))
    now = F.coalesce("tampered", "digest")
    checked = found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(now, F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_levels(name: str, keys: str, levels: int) -> str:
    """CTEs <name>1, ... of the levels above <name>0 (keys, idx, m, h) and <name>s0, ... of their siblings."""
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    parts = []
    for k in range(levels):
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (
    SELECT {keys}, idx // {FANOUT} AS idx, any_value((m + {FANOUT - 1}) // {FANOUT}) AS m,
           sha256(string_agg(h, '' ORDER BY idx)) AS h
    FROM {name}{k} WHERE m > 1 GROUP BY {keys}, idx // {FANOUT}
), {name}s{k} AS MATERIALIZED (
    SELECT {own}, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM {name}{k} a JOIN {name}{k} b ON {same} AND a.idx // {FANOUT} = b.idx // {FANOUT}
    WHERE a.m > 1 GROUP BY {own}, a.idx
)""")
    return ", ".join(parts)


def _sql_walk(name: str, steps: str, levels: int, on: str) -> str:
    """CTEs <name>1, ... that take proof and fold of <name>0 up the levels."""
    return ", ".join(
        f"""{name}{k + 1} AS (
    SELECT w.* REPLACE (w.proof || coalesce(s.l || s.r, '') AS proof,
                        CASE WHEN s.l IS NULL THEN w.fold ELSE sha256(s.l || w.fold || s.r) END AS fold)
    FROM {name}{k} w LEFT JOIN {steps}{k} s ON {on} AND w.pos // {FANOUT**k} = s.idx
)"""
        for k in range(levels)
    )


def _sql_tops(name: str, columns: str, levels: int) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM {name}{k} WHERE m = 1" for k in range(levels + 1))


def sql(levels: int = 6, top_levels: int = 3) -> str:
    """DuckDB SQL for audit, unrolled for sources of up to FANOUT ** levels rows."""

    def text_leaf(text: str) -> str:
        values = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(
            f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in values
        ) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH bytes AS (
    SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM (SELECT unnest(range(0, 256)) AS b)
), leaves AS (
    SELECT doc_id, source, {text_leaf("text")} AS h, {text_leaf(lowered)} AS lowered,
           xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x:
               ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 5 = 0 AS hit
    FROM documents, bytes
), n0 AS MATERIALIZED (
    SELECT doc_id, source, h, CASE WHEN hit THEN lowered ELSE h END AS now,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS m
    FROM leaves
), {_sql_levels("n", "source", levels)}, u0 AS MATERIALIZED (
    SELECT 1 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS m
    FROM ({_sql_tops("n", "source, h", levels)})
), {_sql_levels("u", "one", top_levels)}, roots AS ({_sql_tops("u", "h AS root", top_levels)}),
w0 AS (SELECT doc_id, source, h AS leaf, idx AS pos, '' AS proof, now AS fold FROM n0),
{_sql_walk("w", "ns", levels, "w.source IS NOT DISTINCT FROM s.source")},
v0 AS (
    SELECT w.* REPLACE (u.idx AS pos), u.h AS subroot FROM w{levels} w JOIN u0 u ON w.source IS NOT DISTINCT FROM u.source
), {_sql_walk("v", "us", top_levels, "true")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM v{top_levels}, roots
"""
