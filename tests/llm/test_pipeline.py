import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from coursepulse.llm import queries
from llm.test_languages import WORDS
from llm.test_near_duplicates import brute

REPO = Path(__file__).resolve().parents[2]
ITEM = "why does the slow grey heron wait beside the frozen lake until the first warm morning of the year"
SECRET = "0123456789abcdef" * 2


def rows():
    rnd = random.Random(11)
    made = lambda lang, n=60: " ".join(rnd.choice(WORDS[lang]) + rnd.choice("abcdefgh") for _ in range(n))
    out = [(i, made(lang), lang) for i, lang in enumerate(rnd.choices(list(WORDS), k=120))]
    out += [(200 + i, t + " end", lang) for i, t, lang in out[:20]]  # near copies
    out += [(300 + i, t, lang) for i, t, lang in out[:10]]  # copies
    out += [(400, made("en") + " " + ITEM + " " + made("en"), "en"), (401, None, "en"), (402, "", "en"), (403, "12 ..", "en")]
    return out + [(404, f"{made('en')} token = {SECRET} {made('en')}", "en")]


def test_run_against_plain_stages(spark, documents, tmp_path):
    own = rows()
    documents(own, extra="ids").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lettered = [(i, t) for i, t, _ in own if any(c.isalpha() for c in t or "")]
    kept = {i for i, _, component in brute(lettered) if i == component} - {400}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == kept
    texts = {i: t for i, t, _ in own}
    for i, r in found.items():
        text = texts[i].replace(f"token = {SECRET}", "[SECRET]")
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.round_trip


def test_stages_return_the_columns_of_documents(spark, documents, tmp_path):
    documents(rows()[:30]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_text_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(REPO, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)
