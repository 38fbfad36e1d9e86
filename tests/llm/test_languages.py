import random
import zlib

import numpy as np
import pytest

from coursepulse.llm import languages as lg

WORDS = {
    "en": "the and of house with river under stone light which there".split(),
    "de": "der und ein haus mit fluss unter stein licht welche schön".split(),
    "es": "el los una casa con río bajo piedra señor donde también".split(),
}


def text(rnd, lang, n=40):
    return " ".join(rnd.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(i, text(rnd, lang), lang) for i, lang in enumerate(rnd.choices(list(WORDS), k=300))]


def test_held_out_accuracy_and_cases(documents, rows):
    more = [(900, None, "en"), (901, "", "en"), (902, "12 .. !", "de"), (903, "schön", None), (903, "schön", None)]
    docs = documents(rows + more, extra="lang_pred")
    found = {r.doc_id: r for r in lg.report(docs).collect()}
    assert lg.report(docs).count() == 305
    for doc, _, lang in rows:
        assert found[doc].held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert found[doc].lang_pred == lang and 0.5 < found[doc].score <= 1
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert found[903].lang_pred == "de"


def test_training_counts_equal_a_plain_count(documents, rows):
    names, logs = lg.train(documents(rows + [(1000, None, "en"), (1001, "x", None)]))
    assert names == sorted(WORDS)
    for i, lang in enumerate(names):
        own = np.full(lg.BUCKETS, lg.SMOOTHING)
        for _, t, of in rows:
            if of == lang:
                np.add.at(own, lg.trigrams([t])[0], 1)
        assert logs[i] == pytest.approx(np.log(own / own.sum()), rel=1e-5)


def test_trigrams_of_several_texts_are_those_of_each():
    texts = ["Ab cd", "", "12", "é\nß x", "a", "İstanbul"]
    buckets, word, of = lg.trigrams(texts)
    for i, t in enumerate(texts):
        assert buckets[of[word] == i].tolist() == lg.trigrams([t])[0].tolist()
    assert len(lg.trigrams(["ab cd"])[0]) == 4 and len(np.unique(lg.trigrams(["ab cd"])[1])) == 2


def test_mixtures(documents, rows):
    rnd = random.Random(5)
    model = lg.train(documents(rows))
    mixed = text(rnd, "en", 60) + " " + text(rnd, "de", 30)
    junk = " ".join("".join(rnd.choices("qxzwvkj", k=9)) for _ in range(60))
    share, lettered = lg.mixture([mixed, text(rnd, "es", 30), junk, ""], model[1])
    en, de, es = (model[0].index(x) for x in ("en", "de", "es"))
    assert share[0][en] == pytest.approx(2 / 3, abs=0.07) and share[0][de] == pytest.approx(1 / 3, abs=0.07)
    assert share[0][es] == 0 and (share[1] > 0).sum() == 1 and share[1][es] == pytest.approx(1)
    assert share[2].argmax() == len(model[0]) and lettered.tolist() == [True, True, True, False]


def test_accept_keeps_clean_rows_and_columns(documents, rows):
    rnd = random.Random(6)
    junk = " ".join("".join(rnd.choices("qxzwvkj", k=9)) for _ in range(60))
    docs = documents(rows + [(900, None), (901, "12"), (902, junk, None), (903, text(rnd, "en"), None)], extra="noise")
    kept = lg.accept(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} | {903}


def test_without_training_rows(documents):
    docs = documents([(0, "words", None), (3, None, "en")])
    assert [(r.lang_pred, r.score) for r in lg.report(docs).collect()] == [("und", 0.0)] * 2
    assert lg.report(docs.where("doc_id > 5")).count() == 0


def test_texts_in_more_than_three_languages(documents):
    rnd = random.Random(8)
    more = WORDS | {
        "fi": "ja talo joki kivi valo joka siellä alla kaunis vihreä".split(),
        "pl": "i dom rzeka kamień światło który tam pod piękny zielony".split(),
    }
    rows = [(i, " ".join(rnd.choices(more[x], k=40)), x) for i, x in enumerate(rnd.choices(list(more), k=300))]
    names, logs = lg.train(documents(rows))
    junk = " ".join("".join(rnd.choices("qxzwvkj", k=9)) for _ in range(60))
    whole = " ".join(" ".join(rnd.choices(more[x], k=60)) for x in names)
    share, _ = lg.mixture([whole, whole + " " + junk], logs)
    assert share[0][:-1] == pytest.approx([0.2] * 5, abs=0.05)
    assert share[1] == pytest.approx([1 / 6] * 6, abs=0.05)


def test_a_text_of_noise_alone_has_its_likeliest_language(documents, rows):
    model = lg.train(documents(rows))
    junk = " ".join("qxzwvkj" * 2 for _ in range(60))
    found = lg.predict(documents([(0, junk + " señor"), (1, junk)]), model).orderBy("doc_id").collect()
    assert all(r.noise > 0.9 and r.score < 0.1 for r in found)
    assert found[0].lang_pred == "es"
