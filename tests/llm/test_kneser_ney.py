import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from coursepulse.llm import kneser_ney as k


def plain_symbols(text):
    out = [k.START] * (k.ORDER - 1)
    for c in text.lower():
        x = ord(c)
        x = k.DIGIT if 48 <= x <= 57 else k.SPACE if 9 <= x <= 13 else x
        out.append(x if x < k.HALF else k.HALF + ((x * 0x9E3779B1) >> 7) % k.HALF)
    return [*out, k.END]


class Plain:
    """The model by its textbook formulas, on dictionaries of tuples."""

    def __init__(self, texts):
        own = Counter()
        for t in texts:
            s = plain_symbols(t)
            own.update(tuple(s[i : i + k.ORDER]) for i in range(len(s) - k.ORDER + 1))
        self.n = {k.ORDER: own}
        for size in range(k.ORDER - 1, 0, -1):
            self.n[size] = Counter(g[1:] for g in self.n[size + 1])
        self.cut, self.total, self.taken = {}, {}, {}
        for size, own in self.n.items():
            n1, n2, n3, n4 = (sum(v == i for v in own.values()) for i in range(1, 5))
            self.cut[size] = [0.5, 0.75, 0.9]
            if n1 and n2:
                y = n1 / (n1 + 2 * n2)
                found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
                self.cut[size] = [d if 0 < d < i else 0.5 * i for i, d in zip((1, 2, 3), found)]
            self.total[size], self.taken[size] = defaultdict(int), defaultdict(float)
            for g, v in own.items():
                self.total[size][g[:-1]] += v
                self.taken[size][g[:-1]] += self.cut[size][min(v, 3) - 1]

    def p(self, gram):
        size = len(gram)
        context = gram[:-1]
        if not size:
            return 1 / len(self.n[1])
        if size == 1 and gram not in self.n[1]:
            return None
        lower = self.p(gram[1:])
        if context not in self.total[size]:
            return lower
        v = self.n[size].get(gram, 0)
        if lower is None:
            return None
        kept = v - self.cut[size][min(v, 3) - 1] if v else 0
        return (kept + self.taken[size][context] * lower) / self.total[size][context]

    def perplexity(self, text):
        s = plain_symbols(text)
        grams = [tuple(s[i : i + k.ORDER]) for i in range(len(s) - k.ORDER + 1)]
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams))


def corpus(seed, n, letters="abcde ", most=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("shard_rows", [10**6, 300])
def test_perplexities_against_the_formulas(spark, documents, shard_rows):
    train, test = corpus(1, 60), corpus(2, 40) + ["a", "A1 2\t", "abc" * 400]
    train += ["A12\n9", "édé 中"]
    table = k.model(documents(list(enumerate(train))))
    plain = Plain(train)
    rows = k.scored(documents([*enumerate(test), (0, test[0]), (99, None), (98, "")]), table, shard_rows).collect()
    found = {r.doc_id: r.perplexity for r in rows}
    assert found[99] is None and found[98] is None and len(rows) == len(test) + 2
    for i, text in enumerate(test):
        assert found[i] == pytest.approx(plain.perplexity(text), rel=1e-6), text


def test_probabilities_add_up(documents):
    train = corpus(3, 50)
    table = k.model(documents(list(enumerate(train))))
    top = k._rows_of(table)
    shard = k.Shard(top, 0, 1)
    last = np.array(sorted(top["gram"][top["size"] == 1]))
    for text in ("ab", "eeee", "d a"):
        context = k.ngrams([text])[0][-1] & ~np.int64((1 << k.BITS) - 1)
        assert np.exp(shard.scores(context | last)).sum() == pytest.approx(1)


def test_lookup_table():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 60, 5000))
    table = k.Table(keys, np.arange(len(keys)))
    at = table.find(np.concatenate([keys, rnd.integers(0, 1 << 60, 5000)]))
    assert (at[: len(keys)] == np.arange(len(keys))).all() and (at[len(keys) :] == -1).all()


def test_junk_goes_and_clean_text_stays(spark, documents):
    rnd = random.Random(5)
    words = ["the", "house", "river", "stone", "light", "green", "walks", "under"]
    clean = [" ".join(rnd.choices(words, k=30)) for _ in range(700)]
    junk = ["".join(rnd.choices("#$%&!xzq", k=80)) for _ in range(20)]
    docs = documents([(i, t, "en" if i % 2 else None) for i, t in enumerate(clean + junk)] + [(900, None), (901, "")])
    rows = [(i, 1, 0) for i in range(600)] + [(0, None, None), (610, 1, 1), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in k.judge(docs, labels).collect()}
    assert len(found) == 722
    assert sum(found[i].kept for i in range(700)) > 680
    assert not any(found[i].kept for i in range(700, 720)) and not found[900].kept and not found[901].kept
    assert found[0].trusted and not found[610].trusted


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "x"), (2, "y")])
    none = k.judge(docs, labels.where("doc_id > 1")).collect()
    assert [(r.perplexity, r.kept) for r in none] == [(None, False)] * 2
    assert k.judge(docs.where("doc_id > 9"), labels).count() == 0


def test_small_languages_have_thresholds_of_their_own(spark, documents):
    """One trusted text is enough, and each is scored by a model without its fold."""
    texts = {"en": corpus(11, 12), "de": corpus(12, 3, "vwxyz "), None: corpus(13, 1, "fgh ")}
    rows = [(t, lang) for lang, own in texts.items() for t in own] + [("abc", "xx")]
    docs = documents([(i, t, lang) for i, (t, lang) in enumerate(rows)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in k.judge(docs, labels).collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", k._fold().alias("f")).collect()}
    unseen = {}
    for f in range(k.FOLDS):
        table = k.model(docs.where(k._fold() != f).where("doc_id < 16"))
        unseen |= {r.doc_id: r.perplexity for r in k.scored(docs, table).collect() if fold[r.doc_id] == f}
    for lang in texts:
        own = [i for i in range(16) if rows[i][1] == lang]
        assert found[own[0]].threshold == pytest.approx(max(unseen[i] for i in own), rel=1e-9)
    assert found[16].threshold == pytest.approx(max(unseen[i] for i in range(16)), rel=1e-9)


def test_thresholds_are_exact(spark):
    rnd = random.Random(4)
    rows = [(lang, rnd.uniform(2, 3) if lang else 7.0) for lang in ("a", "b", None) for _ in range(rnd.randint(150, 900))]
    found = dict(k.thresholds(spark.createDataFrame(rows, "lang string, perplexity double")).collect())
    for lang in ("a", "b", None):
        own = sorted(p for x, p in rows if x == lang)
        assert found[lang] == own[-(-len(own) * 995 // 1000) - 1]


@pytest.mark.parametrize("shard_rows", [10**6, 300])
def test_whole_code_points(spark, documents, shard_rows):
    """Characters that were hashed together, as no alphabet of 2,048 symbols can hold them apart."""
    han = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 4000))
    train = corpus(21, 60, han[:2500] + "ab \U0001f600’") + ["ab" + han[:2500]]
    test = corpus(22, 20, han[:2500] + "ab ") + ["ab \U0001f600’"]
    table = k.model(documents(list(enumerate(train))))
    plain = Plain(train)
    assert table.where("size = 1").count() == len(plain.n[1])
    rows = k.scored(documents([*enumerate(test), (98, han[2500:2600])]), table, shard_rows).collect()
    found = {r.doc_id: r.perplexity for r in rows}
    for i, text in enumerate(test):
        if all((s,) in plain.n[1] for s in plain_symbols(text)[k.ORDER - 1 :]):
            assert found[i] == pytest.approx(plain.perplexity(text), rel=1e-6), text
    # Unseen characters cost what unknown ones cost.
    assert found[98] > len(plain.n[1])


def test_lookup_table_with_upper_bits():
    rnd = np.random.default_rng(2)
    pairs = np.unique(rnd.integers(0, 60, (3000, 2)), axis=0)
    table = k.Table(pairs[:, 0], high=pairs[:, 1])
    asked = np.stack(np.meshgrid(np.arange(60), np.arange(60)), -1).reshape(-1, 2)
    own = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert table.find(asked[:, 0], asked[:, 1]).tolist() == [own.get(tuple(p), -1) for p in asked.tolist()]
