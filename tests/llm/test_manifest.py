import hashlib
import random
import string
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from coursepulse.llm import manifest as m

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[1], row[2], row[3], text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Top and, for each node, its siblings left and right on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // 16 * 16
            paths[i].append((nodes[first:place], nodes[place + 1 : first + 16]))
            at[i] = place // 16
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    by_name = {}
    for row in rows:
        by_name.setdefault(row[1], []).append(row)
    names = sorted(by_name, key=lambda n: (n is not None, (n or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))
    groups = [sorted(by_name[n], key=order) for n in names]
    found = [tree([leaf(r, r[4]) for r in own]) for own in groups]
    root, upper = tree([top for top, _ in found])
    out = []
    for own, (top, paths), above in zip(groups, found, upper):
        for row, path in zip(own, paths):
            path = path + above
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = text.translate(LOWER)
            now = leaf(row, text)
            for left, right in path:
                now = digest(*left, now, *right)
            proof = digest(*(x for left, right in path for x in left + right))
            out.append((row[0], leaf(row, row[4]), top, root, proof, now, now == root))
    return out


def rows_of(sizes, seed=1):
    rnd = random.Random(seed)
    rows, doc = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            doc += rnd.randint(1, 3)
            rows.append((doc, name, rnd.choice(["en", None]), rnd.choice([5, None]), rnd.choice(["Aé b", "a", "", None])))
    rnd.shuffle(rows)
    return rows


def same(spark, rows):
    found = m.audit(spark.createDataFrame(rows, COLUMNS).repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(plain(rows), key=key)
    return found


def test_against_a_plain_version(spark):
    """Trees of one row, one run, two and three levels, and one of more rows than two levels hold."""
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "c": 256, "d": 257, "é": 40, "Z": 4200, "z z": 1}
    rows = rows_of(sizes)
    found = same(spark, rows)
    assert {r.verified for r in found} == {True, False}


def test_many_trees(spark):
    same(spark, rows_of({f"s{i}": 1 + i % 3 for i in range(300)}))


@pytest.mark.parametrize("n", [1, 16, 273])
def test_one_tree(spark, n):
    same(spark, rows_of({"only": n}))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(None, "s", "en", 1, "X")] * 20
    rows += [(5, "s", "en", 1, t) for t in ("b", "a", None, "")] + [(5, "s", "en", 1, "b")] * 30
    found = same(spark, rows)
    assert all(r.verified for r in found if r.doc_id is None)


def test_hot_tree_over_many_ranges(spark):
    """Ranks stay gapless where a tree lies in many ranges of rows."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, "other").otherwise("hot").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id"
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = m.ranked(df.repartition(9), ["id"])
        rows = ranked.groupBy("tree").agg(
            F.count_distinct("idx").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.max("m").alias("m")
        ).collect()
        assert {(r.tree, r.n, r.lo, r.hi, r.m) for r in rows} == {("hot", 19_600, 0, 19_599, 19_600), ("other", 400, 0, 399, 400)}
        up = ranked.where("tree = 'hot'").orderBy("id").select("idx").collect()
        assert [r.idx for r in up] == list(range(19_600))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_only_every_second_level_is_stored(spark):
    rows = spark.range(5_000).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    forest = m.grow(rows, ["id"])
    assert [level.count() for level in forest.levels] == [5_000, 20, 1]


def test_sql_agrees(spark):
    rows = rows_of({None: 2, "a": 300, "b": 1})
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    expected = con.execute(m.sql())
    names = [c[0] for c in expected.description]
    ours = m.audit(spark.createDataFrame(rows, COLUMNS)).select(names)
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in ours.collect())


def test_other_columns_long_text_and_empty_table(documents):
    docs = documents([(1, "A" * 3_000_000), (2, "b")], extra="path").select(
        "*", *(F.lit("own").alias(c) for c in ("tree", "digest", "idx", "m", "name", "root", "at"))
    )
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert sorted(map(tuple, m.audit(docs).collect())) == sorted(plain(rows))
    assert m.audit(docs.where("doc_id > 5")).count() == 0
