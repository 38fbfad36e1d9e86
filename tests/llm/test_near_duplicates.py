import random

import pytest
from pyspark.sql import functions as F

from check_oracle import compare
from coursepulse.llm import near_duplicates as nd
from coursepulse.llm.components import components


def shingle_set(text):
    words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    """component of every row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = rows[i][0] == rows[j][0] or sets[i] and sets[j] and (
                100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
            )
            if rows[i][0] is not None and rows[j][0] is not None and alike:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), doc)
        least[find(i)] = min(x for x in (least[find(i)], doc) if x is not None) if doc is not None else None
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def corpus(seed, families, copies, shared=0):
    """Families of texts edited more and more, some around a long shared passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rnd.randint(12, 80))]
        if rnd.random() < shared:
            base = base[: rnd.randint(3, 40)] + passage
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 20))):
                own[rnd.randrange(len(own))] = word()
            rows.append(" ".join(w.upper() if rnd.random() < 0.1 else w for w in own))
            if rnd.random() < 0.4:
                base = own
    rnd.shuffle(rows)
    return list(enumerate(rows))


CASES = [
    (7, None), (8, ""), (9, "\n \t"), (1, "Two words"), (2, "two\x0bWORDS"), (3, "two words more"),
    (4, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (6, "a b c d e f g"), (10, "a b c d e f g h"),
    (None, "a b c d e"), (None, None), (11, "É b c d e f"), (12, "é b c d e f"),
]


@pytest.mark.parametrize("small, seed, shared", [(24, 1, 0.3), (2, 2, 0.9), (3, 3, 0.5)])
def test_against_all_pairs(documents, monkeypatch, small, seed, shared):
    monkeypatch.setattr(nd, "SMALL", small)
    rows = CASES + [(i + 100, t) for i, t in corpus(seed, 40, 9, shared)]
    found = nd.near_duplicates(documents(rows)).collect()
    ours = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert ours == sorted(brute(rows), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_keep_one_returns_the_columns(documents):
    docs = documents(CASES)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert kept.where("doc_id is null").count() == 2


def test_keep_one_with_clashing_columns(documents):
    docs = documents([(1, "a b c"), (2, "a b c"), (3, "d"), (None, "a b c")], extra="_kept")
    names = ["cid", "label", "component", "component_id", "kept", "n_shingles", "node", "_col0", "key", "size"]
    docs = docs.select("*", *(F.lit("own").alias(c) for c in names))
    out = nd.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept, r._kept) for r in out.collect()) == [(0, "own", "own"), (1, "own", "own"), (3, "own", "own")]


def test_empty_table(documents):
    docs = documents([(1, "x")]).where("doc_id > 1")
    assert nd.near_duplicates(docs).count() == 0
    assert nd.keep_one(docs).count() == 0


def test_very_long_text(documents):
    text = " ".join(str(i) for i in range(60_000))
    rows = nd.near_duplicates(documents([(1, text), (2, text + " end"), (3, text[:1000])])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.001", "op10_near_duplicates") is None
