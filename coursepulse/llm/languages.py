"""Language mixture of whole texts (operator 4).

Training counts hashed letter trigrams of each language. A text is taken as words drawn from a
mixture of languages and of noise (every trigram alike): a word's likelihood under a language is
the product over its trigrams, and expectation-maximisation estimates the shares. The set of the
strongest languages grows, with and without noise beside it, up to all of them or until the penalised
likelihood stops improving; the best set is kept, or noise alone if that is better. Then the
predicted language is the strongest one of the whole mixture, with score 0.

Defined cases: a text that is null or has no letter is `und` with score 0 and no languages.
Training ignores rows without text or language, and those held out. Without any training row every
text is `und`. Ties go to the language that comes first in the alphabet. Repeated rows are judged
each; other columns pass through, except those that carry an output's name.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse.llm.common import append_columns, map_arrow

#: Trigrams are hashed into this many buckets; a model has so many numbers for each language.
BUCKETS = 1 << 16
SMOOTHING = 0.05
ROUNDS, ROUNDS_NESTED = 8, 5
#: Letters that a task works on at once.
TOGETHER = 1_000_000
UNKNOWN = "und"
#: Share of noise beyond which a text is rejected; short texts around a long key have less.
MOST_NOISE = 0.75
#: Log-likelihoods of one word differ by this much at most, so that one odd word can't decide.
CLIP = 30.0


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of texts, the word of each, and the text of each word.

    A word is a run of letters, with an edge on either side.
    """
    lowered = [t.lower() for t in texts]
    joined = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    letter = _letters()[joined]
    codes = np.where(letter, joined, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    x = codes[at - 1] * np.uint64(0x9E3779B97F4A7C15) + codes[at]
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9) + codes[at + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    buckets = (x >> np.uint64(48)).astype(np.int64)
    first = ~letter[at - 1]
    word = np.cumsum(first) - 1
    text_of_word = np.searchsorted(ends, at[first], side="right")
    return buckets, word, text_of_word


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training must not see; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (language, bucket), from every row with text and language.

    Tasks add up their own counts, so what is shuffled has one row for each task, language and
    bucket at most, and the model has BUCKETS numbers for each language.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part in _parts(batch.column(1).to_pylist()):
                texts = [t for _, t in part]
                buckets, word, text = trigrams(texts)
                if not len(buckets):
                    continue
                lang_of = np.array([langs[i] for i, _ in part], dtype=object)[text][word]
                for lang in set(lang_of):
                    own = np.bincount(buckets[lang_of == lang], minlength=BUCKETS)
                    counts[lang] = counts[lang] + own if lang in counts else own
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    found = (
        map_arrow(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toPandas()
    languages = sorted(set(found["lang"]))
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    table[np.searchsorted(languages, found["lang"].to_numpy(str)) if languages else [], found["bucket"]] += found["n"]
    return languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _parts(texts: list[str | None]):
    """Runs of (position, text) with about TOGETHER letters; null counts as empty."""
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append((i, t or ""))
        size += len(t or "")
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _mix(likely: np.ndarray, text: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int):
    """Shares after some rounds of expectation-maximisation, and each text's log-likelihood."""
    words = np.diff(np.append(starts, len(text)))[:, None]
    for _ in range(rounds):
        weight = likely * share[text]
        weight /= weight.sum(1, keepdims=True)
        share = np.add.reduceat(weight, starts) / words
    return share, np.add.reduceat(np.log((likely * share[text]).sum(1)), starts)


def mixture(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (text, language and noise last), zero outside the chosen set, and whether there is a letter."""
    return _mixture(texts, logs)[:2]


def _mixture(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As mixture, and each text's strongest language in the mixture of all."""
    known = len(logs)
    out = np.zeros((len(texts), known + 1), np.float32)
    lettered, strongest = np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    buckets, word, text = trigrams(texts)
    if not len(buckets) or not known:
        return out, lettered, strongest
    first = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(np.append(first, len(buckets)))
    log = np.empty((len(first), known + 1), np.float32)
    for i, own in enumerate(logs):
        log[:, i] = np.add.reduceat(own[buckets], first)
    log[:, known] = -np.log(BUCKETS) * size
    log -= log.max(1, keepdims=True)
    likely = np.exp(np.maximum(log, -CLIP))

    present, starts = np.unique(text, return_index=True)
    lettered[present] = True
    dense = np.searchsorted(present, text)
    words = np.diff(np.append(starts, len(dense)))
    n = len(present)
    full, _ = _mix(likely, dense, starts, np.full((n, known + 1), 1 / (known + 1), np.float32), ROUNDS)
    # Shares can fall to exactly zero beside noise; then the languages' likelihoods of the text decide.
    likeliest = np.add.reduceat(log[:, :known], starts, dtype=np.float64).argmax(1)
    strongest[present] = np.where(full[:, :known].max(1) > 0, full[:, :known].argmax(1), likeliest)
    order = np.argsort(-full[:, :known], axis=1, kind="stable")
    best, cost = np.zeros_like(full), np.full(n, np.inf)
    growing, own_likely, own_text, own_starts = np.arange(n), likely, dense, starts
    for k in range(1, known + 1):
        improved = np.zeros(len(growing), bool)
        for noise in (False, True):
            chosen = np.zeros((len(growing), known + 1), np.float32)
            top = order[growing, :k]
            np.put_along_axis(chosen, top, np.take_along_axis(full[growing], top, 1) + 1e-6, 1)
            if noise:
                chosen[:, known] = full[growing, known] + 1e-6
            chosen /= chosen.sum(1, keepdims=True)
            members = k + noise
            share, fit = _mix(own_likely, own_text, own_starts, chosen, ROUNDS_NESTED if members > 1 else 0)
            own = -fit + (members - 1) / 2 * np.log(words[growing] + 1)
            better = own < cost[growing] - 1e-6
            best[growing[better]], cost[growing[better]] = share[better], own[better]
            improved |= better
        if not improved.any():
            break
        if not improved.all():
            inside = improved[own_text]
            own_likely, own_text = own_likely[inside], (np.cumsum(improved) - 1)[own_text[inside]]
            growing = growing[improved]
            own_starts = np.searchsorted(own_text, np.arange(len(growing)))
    alone = -np.add.reduceat(np.log(likely[:, known]), starts) < cost - 1e-6
    best[alone] = np.eye(known + 1, dtype=np.float32)[known]
    out[present] = best
    return out, lettered, strongest


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("noise", T.DoubleType()),
    T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType())),
]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with the strongest language, its share among languages and noise, and all shares."""
    languages, logs = model

    def start():
        def compute(texts):
            pred, score, noise, shares = [], [], [], []
            for part in _parts(texts.to_pylist()):
                share, lettered, strongest = _mixture([t for _, t in part], logs)
                for own, known, first in zip(share.astype(float), lettered, strongest):
                    if not known:
                        pred.append(UNKNOWN), score.append(0.0), noise.append(0.0), shares.append([])
                        continue
                    i = int(np.argmax(own[:-1])) if own[:-1].any() else int(first)
                    pred.append(languages[i]), score.append(min(own[i], 1.0)), noise.append(min(own[-1], 1.0))
                    shares.append([(languages[j], own[j]) for j in np.flatnonzero(own[:-1])])
            return [
                pa.array(pred, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(noise, pa.float64()),
                pa.array(shares, pa.map_(pa.string(), pa.float64())),
            ]

        return compute

    return append_columns(docs, [text], FIELDS, start)


def report(docs: DataFrame) -> DataFrame:
    """Prediction for every document, by a model of those not held out."""
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "noise"
    )


def accept(docs: DataFrame) -> DataFrame:
    """docs without those that have no letter or are mostly noise; columns as they were."""
    model = train(docs.where(~held_out()))
    names = docs.columns
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))
    text = f"_{[c.lower() for c in names].index('text')}"
    judged = predict(renamed, model, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("noise") <= MOST_NOISE))
    return judged.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
