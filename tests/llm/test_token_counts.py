import random

import public_tokenizers
import pytest
import sentencepiece

from coursepulse.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = [*"abcdeé ß\n\t  中　  \U0001f600'sre12٣.,#\x1c\x85\xa0áñ▁", " the", "  ", "<s>", "</s>", "▁▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("chunk, overlap", [(7, 2), (20, 3), (64, 16), (5, 1)])
def test_spliced_counts_equal_the_library(library, chunk, overlap):
    rnd, own = random.Random(chunk), tc.Counter(PATH, chunk, overlap)
    for _ in range(1500):
        text = "".join(rnd.choices(BITS, k=rnd.randint(0, 200)))
        assert own.count(text) == len(library.encode(text)), text


def test_overlaps_widen_where_no_place_is_stable(library):
    own = tc.Counter(PATH, 50, 5)
    for text in ("a" * 1000, "ab " + "x" * 400 + " cd " * 30, "中" * 300, " " * 500, "▁" * 400, "b" * 60 + " c"):
        assert own.count(text) == len(library.encode(text))
        ends = [(start, end, splice) for start, end, splice, _ in own.spans(text)]
        assert ends[-1][1] == len(text) and all(a[2] < b[2] for a, b in zip(ends, ends[1:]))


def test_report(documents, library):
    rnd = random.Random(9)
    long = " ".join("".join(rnd.choices("abcdeéè", k=rnd.randint(1, 9))) for _ in range(30_000))
    texts = [None, "", "é", "two words", "two words", long, "x" * 40_000, "word " * 4096]
    docs = documents(list(enumerate(texts)), extra="n_tokens")
    rows = {r.doc_id: r for r in tc.report(docs, PATH).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens) == (len((text or "").encode()), n)
        assert rows[i].over_limit == (n > 4096)
    assert tc.report(docs.where("doc_id < 0"), PATH).count() == 0
