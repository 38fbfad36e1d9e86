import hashlib
import random
import string
from collections import defaultdict

from pyspark.sql import functions as F

from coursepulse.llm import line_dedup as d

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    """(n_lines, n_dropped, text left) of every row (doc_id, text)."""
    split = [((text or "").split("\n"), doc) for doc, text in rows]
    holders = defaultdict(set)
    for lines, doc in split:
        for line in lines:
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= 20:
                holders[key].add((doc is not None, doc or 0))
    out = []
    for (lines, doc), (_, text) in zip(split, rows):
        own = (doc is not None, doc or 0)
        kept = []
        for line in lines:
            found = holders.get(line.strip(SPACE).translate(LOWER), ())
            if len(found) < 3 or max(found) == own:
                kept.append(line)
        dropped = len(lines) - len(kept)
        out.append((doc, len(lines), dropped, "\n".join(kept) if dropped else text))
    return out


def texts():
    rnd = random.Random(3)
    common = [
        "all rights reserved by the owner",
        "  ALL rights Reserved by the owner\t\r",
        "exactly twenty chars",
        "only nineteen chars",
        "Ünïcode Ängström lines count öfter",
        "\x1cnot white space here, kept as part",
        " em space is no white space either",
        "seen in one document alone, twice over",
    ]
    rows = [(0, None), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "\r\n".join(common[:3]))]
    for i in range(5, 160):
        lines = [rnd.choice([*common[:7], "", " ", f"own line of document number {i}", "short"]) for _ in range(rnd.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(200, f"{common[7]}\n{common[7]}"), (7, "another text under one id\n" + common[0]), rows[9], rows[9]]
    rows += [(None, common[0]), (None, common[2] + "\nmore"), (900, f"{common[0]}\nlast\n{common[0].upper()}")]
    # Two documents share it: it stays. With rows of one id counted once, so does this one.
    return rows + [(901, "shared by two documents only"), (902, "shared by two documents only"), (902, "shared by two documents only\n!")]


def test_against_a_plain_version(documents):
    rows = texts()
    found = d.drop_lines(documents(rows)).collect()
    ours = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found), key=str)
    assert ours == sorted(plain(rows), key=str)
    assert sum(r.n_dropped for r in found) > 100
    hashes = sorted(((r.doc_id, r.kept_sha256) for r in d.digest(documents(rows)).collect()), key=str)
    expected = [(x[0], hashlib.sha256((x[3] or "").encode()).hexdigest()) for x in plain(rows)]
    assert hashes == sorted(expected, key=str)


def test_the_largest_document_keeps_its_lines(documents):
    line = "the same words in every document"
    rows = [(i, f"{line}\nown {i}\n {line.title()} ") for i in range(500)]
    kept = {r.doc_id: r.text for r in d.drop_lines(documents(rows)).collect()}
    assert kept.pop(499) == rows[499][1]
    assert kept == {i: f"own {i}" for i in range(499)}


def test_limits_are_parameters(documents):
    docs = documents([(1, "abc\nx"), (2, "ABC"), (3, "y")])
    assert {r.text for r in d.drop_lines(docs, min_chars=3, min_docs=2).collect()} == {"x", "ABC", "y"}
    assert {r.text for r in d.drop_lines(docs, min_chars=3).collect()} == {"abc\nx", "ABC", "y"}


def test_other_columns_and_empty_table(documents):
    names = ["line", "row", "doc", "keeper", "drop", "pos", "n_dropped", "_col0"]
    docs = documents([(i, "a line of more than twenty") for i in range(4)], extra="kept").select(
        "*", *(F.lit("own").alias(c) for c in names)
    )
    out = d.drop_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_dropped"] + ["n_lines", "n_dropped"]
    assert {r.text for r in out.collect()} == {"", "a line of more than twenty"}
    assert out.where("line = 'own' AND _col0 = 'own' AND kept = 'own'").count() == 4
    assert d.drop_lines(docs.where("doc_id < 0")).count() == 0


def test_very_long_text(documents):
    long = "\n".join(f"line number {i % 60_000} of a very long text" for i in range(120_000))
    rows = [(1, long), (2, long[: len(long) // 2]), (3, "x\n" + long), (4, "y" * 2_000_000)]
    found = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in d.drop_lines(documents(rows)).collect())
    assert found == sorted(plain(rows))


def test_no_python_in_the_plan(documents):
    plan = d.drop_lines(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
