"""Lines that many documents share stay in one document only. DataFrame functions only.

Method: every line gets a key (white space stripped at both ends, A-Z lower-cased). Keys of some
length are exploded as hashes with the line's position, distinct documents are counted for each
hash, and a hash found in enough documents loses its lines everywhere but in the largest doc_id
that holds it. The lines left are put together again by position. Texts are shuffled at most once,
beside the positions to drop; the counting shuffles hashes alone.

Hot lines: a line's documents are counted as distinct (line, document) pairs, dealt out by both and
combined before each shuffle, so a line of a third of all documents sends one row per map task. The
join back reads two stored tables, whose hot keys Spark splits.

Defined cases. Null and empty text: one empty line. Null doc_id: all such rows count as one
document, smaller than all others. Rows of one doc_id are one document for counting, whatever their
texts; each row keeps its own lines, and equal rows come out equal. A line repeated within a document
counts once and is dropped at all its places. Very long texts: any number of lines; a row holds its
own lines and nothing of other rows. A document may lose all lines and then has the empty text.
Empty table: empty result. Columns named like a result are replaced, others are kept whatever
their names. Hashes have 128 bits and are taken for the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepulse.llm.common import SPACES, stored
from coursepulse.llm.spans import let

#: Code points from which a key counts, and documents from which its lines go.
MIN_CHARS = 20
MIN_DOCS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _hashed(text: Column, min_chars: int) -> Column:
    """(position, hash) of the lines whose keys are long enough."""
    keys = F.transform(lines_of(text), lambda line, i: F.struct(i.alias("pos"), key_of(line).alias("key")))
    counted = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    return F.transform(counted, lambda x: F.struct(x["pos"].alias("pos"), F.unhex(F.md5(x["key"])).alias("line")))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, keeper) of the lines (doc, line) found in enough documents."""
    n = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    found = lines.groupBy("line").agg(n.alias("n_docs"), F.max("doc").alias("keeper"))
    return found.where(F.col("n_docs") >= min_docs).select("line", "keeper")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the shared lines taken out of text, n_lines (before) and n_dropped."""
    names = docs.columns
    lower = [c.lower() for c in names]
    own = docs.select(*(F.col(f"`{c}`").alias(f"_col{i}") for i, c in enumerate(names)))
    doc, text = (F.col(f"_col{lower.index(c)}") for c in ("doc_id", "text"))
    # Rows of one doc_id are told apart by their texts.
    row = F.xxhash64(text)
    lines = stored(
        own.select(doc.alias("doc"), row.alias("row"), F.inline(_hashed(text, min_chars))), "lines"
    )
    shared = stored(shared_lines(lines, min_docs), "shared")
    dropped = stored(
        lines.join(shared, "line")
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "row")
        .agg(F.collect_set("pos").alias("drop")),
        "dropped",
    )
    found = own.join(dropped, doc.eqNullSafe(F.col("doc")) & (row == F.col("row")), "left")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
        return F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")

    kept = F.when(F.col("drop").isNull(), text).otherwise(let(lines_of(text), rest))
    keep = [i for i, c in enumerate(lower) if c not in ("n_lines", "n_dropped")]
    return found.select(
        *((kept if lower[i] == "text" else F.col(f"_col{i}")).alias(names[i]) for i in keep),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text left."""
    out = drop_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Lines by window-free joins on the keys themselves; doc_id is unique in the tables.
SQL = r"""
WITH texts AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
    SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM texts
), keyed AS (
    SELECT doc_id, pos, line, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
    ) AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS dropped
    FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
