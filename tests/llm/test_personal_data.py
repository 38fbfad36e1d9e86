import hashlib
import random
import re

from coursepulse.llm import personal_data as p


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def base(text):
    return sorted(
        (m.start(), k, m.end(), name)
        for k, (name, pattern, holds) in enumerate(BASE)
        for m in re.finditer(pattern, text or "")
        if holds(m)
    )


def text_of(found):
    return ",".join(f"{name}:{start}:{end}" for start, _, end, name in found)


def check(docs, texts):
    rows = {r.doc_id: r for r in p.report(docs).collect()}
    for i, text in enumerate(texts):
        found, r = base(text), rows[i]
        counts = (r.n_email, r.n_ip, r.n_card, r.n_phone)
        assert counts == tuple(sum(f[3] == k for f in found) for k, *_ in BASE), text
        assert r.base_sha256 == hashlib.sha256(text_of(found).encode()).hexdigest(), text
        assert {x for x in text_of(found).split(",") if x} <= set(r.spans.split(",")), text
    return rows


def test_base_spans_against_a_plain_search(documents):
    rnd = random.Random(8)
    bits = ["a", "b.c", "@", "a@b.c", "_x@d.e", ".", "-", "+", "%", " ", "é", "😀", "1", "12", "255", "256", "0004", "4111111111111111",
            "4111 1111-1111 1111", "+1 (555) 010-9999", "(", ")", "\n", "1.2.3.4", "000000000000"]
    texts = [None, "", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "+1 2", "٣٣٣٣"] + [
        "".join(rnd.choices(bits, k=rnd.randint(1, 25))) for _ in range(600)
    ]
    check(documents(list(enumerate(texts))), texts)


def test_labelers_and_classifier_add_what_looks_personal(documents):
    rnd = random.Random(9)
    n = lambda k: "".join(rnd.choices("0123456789", k=k))
    texts = [f"call {n(3)}-{n(3)}-{n(4)} for help or write to a{i}@b.org" for i in range(80)]
    texts += [f"see page {n(2)}/{n(2)}/20{n(2)} of the report" for _ in range(80)]
    texts += ["ring 555-123-4567 then", "as of 12/11/2019 it was"]
    rows = check(documents(list(enumerate(texts))), texts)
    assert all(f"number:5:17" in rows[i].spans for i in range(80))
    assert not any(rows[i].spans for i in range(80, 160))
    assert rows[160].spans == "number:5:17" and rows[161].spans == ""


def test_estimated_reliabilities():
    """Votes drawn from known labelers: the better one gets the sharper table."""
    rnd = random.Random(2)
    patterns, truth = {}, {}
    for _ in range(4000):
        yes = rnd.random() < 0.4
        vote = tuple((1 if (rnd.random() < good) == yes else -1) for good in (0.95, 0.7, 0.6, 0.85))
        patterns[vote] = patterns.get(vote, 0) + 1
        truth.setdefault(vote, []).append(yes)
    prior, tables, prob = p.estimate(patterns)
    assert abs(prior - 0.4) < 0.05
    assert tables[0][1][1] > tables[3][1][1] > tables[1][1][1] > tables[2][1][1]
    right = sum((prob[v] > 0.5) == y for v, ys in truth.items() for y in ys)
    assert right / 4000 > 0.93


def test_very_long_runs_cost_no_more_than_their_length(documents):
    texts = ["a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a@" + "b." * 50_000 + "c"]
    check(documents(list(enumerate(texts))), texts[:0])
    found = {r.doc_id: r for r in p.report(documents(list(enumerate(texts)))).collect()}
    assert found[4].n_email == 1 and found[0].n_email == 0 and found[2].n_ip == 25_000


def test_empty_table(documents):
    assert p.report(documents([(0, "x")]).where("doc_id > 0")).count() == 0
