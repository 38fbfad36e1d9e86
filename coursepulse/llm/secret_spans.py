"""Secrets in whole texts, by patterns and by character Markov models (operator 6).

Patterns give the base spans. Further candidates are long runs of the characters that keys are made
of. Two Markov models of neighbouring characters are trained from labelled samples: values of the
base spans are random strings, candidates of letters alone, apart from base spans, are ordinary
identifiers. A candidate is a secret if its log-likelihood ratio per character exceeds zero, and
the ratio that one in a thousand ordinary identifiers exceeds. Only DataFrame functions are used.

Defined cases: a null text counts as empty. Without samples of either class no span is added to the base. A text of
any length is read whole. Repeated rows are scanned each; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepulse.llm import spans as S
from coursepulse.llm.common import stored

# The base patterns. Lengths are checked here only where a match can't hide a longer one.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"^[A-Za-z]+$"
#: Codes of characters; a model has CODES squared numbers.
CODES = 128
SMOOTHING = 0.5
#: Share of ordinary identifiers that the threshold lets pass for random.
MISTAKES = 0.001
#: Parts of a range that the search for a quantile counts at a time.
SUB_RANGES = 4_096


def base_spans(text: Column) -> Column:
    lowered = F.lower(text)
    cue = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        cue = cue | lowered.contains(word)
    assign = F.filter(S.matches(text, ASSIGN, "assign", 0, 2, cue), lambda s: F.length(s["value"]) >= MIN_VALUE)
    access = S.matches(text, ACCESS, "access", 1, needs=text.contains("AKIA"))
    return S.merged(assign, access, S.matches(text, HEX, "hex", 2))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base spans and, apart from them, candidates."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("base", base_spans(whole))
    candidates = S.matches(whole, CANDIDATE, "random", 3)
    return found.withColumn("candidates", S.apart(candidates, F.col("base")))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of characters, by code; None if a class had no sample."""

    ratios: tuple[float, ...] | None
    threshold: float = 0.0


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))


def _pairs(value: Column) -> Column:
    """Codes of the neighbouring characters of a string of two or more."""
    codes = _codes(value)
    last = F.size(codes) - 1
    return F.zip_with(F.slice(codes, 1, last), F.slice(codes, 2, last), lambda a, b: a * CODES + b)


def _ratio(value: Column, ratios: tuple[float, ...]) -> Column:
    """Log-likelihood ratio per character."""
    known = F.split(F.lit(" ".join(f"{r:.6g}" for r in ratios)), " ").cast("array<double>")
    total = F.aggregate(_pairs(value), F.lit(0.0), lambda done, p: done + F.element_at(known, p + 1))
    return total / F.length(value)


def samples(found: DataFrame) -> DataFrame:
    """Labelled samples (random, value): all of the corpus."""
    random = found.select(F.lit(True).alias("random"), F.explode("base.value").alias("value"))
    plain = found.select(F.lit(False).alias("random"), F.explode("candidates.value").alias("value"))
    return random.unionAll(plain.where(F.col("value").rlike(ORDINARY))).where(F.length("value") > 1)


def train(found: DataFrame) -> Model:
    """Models of both classes from scanned documents; what is collected has CODES squared rows for each class."""
    labelled = samples(found)
    counted = labelled.select("random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("random", "pair")
    counts = {True: {}, False: {}}
    for r in counted.agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["random"]][r["pair"]] = r["n"]
    if not counts[True] or not counts[False]:
        return Model(None)
    from_code = {label: [0.0] * CODES for label in counts}
    for label, own in counts.items():
        for pair, n in own.items():
            from_code[label][pair // CODES] += n
    ratios = tuple(_log_ratio(counts, from_code, pair) for pair in range(CODES * CODES))
    score = labelled.where("not random").select(_ratio(F.col("value"), ratios).alias("ratio"))
    return Model(ratios, max(0.0, quantile(stored(score, "ratios"), 1 - MISTAKES)))


def quantile(values: DataFrame, share: float) -> float:
    """Exact interpolated quantile of a table of one column of numbers, with at least one row.

    The range that holds the rank is cut into SUB_RANGES parts, and the part that holds it is cut again, until
    all its values are the same. Counting is combined before the shuffle; the driver sees a row for each part.
    """
    x = F.col(values.columns[0])
    whole = values.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most")).first()
    place = (whole["n"] - 1) * share
    rank, least, most = math.floor(place), whole["least"], whole["most"]
    below = 0
    while least < most:
        part = F.least(F.floor((x - least) / (most - least) * SUB_RANGES), F.lit(SUB_RANGES - 1))
        inside = values.where(x.between(least, most)).groupBy(part.alias("part"))
        counted = inside.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"))
        for r in sorted(counted.collect(), key=lambda r: r["part"]):
            if rank < below + r["n"]:
                least, most = r["least"], r["most"]
                break
            below += r["n"]
    if place == rank:
        return least
    over = F.when(x > least, x)
    after = values.agg((F.count(x) - F.count(over)).alias("n"), F.min(over).alias("next")).first()
    upper = least if rank + 1 < after["n"] else after["next"]
    return (rank + 1 - place) * least + (place - rank) * upper


def _log_ratio(counts: dict, from_code: dict, pair: int) -> float:
    value = {
        label: (counts[label].get(pair, 0) + SMOOTHING) / (from_code[label][pair // CODES] + SMOOTHING * 64)
        for label in counts
    }
    return math.log(value[True] / value[False])


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """Scanned documents with all spans: base ones and random candidates."""
    if model.ratios is None:
        return found.withColumn("spans", F.col("base"))
    added = F.filter("candidates", lambda s: _ratio(s["value"], model.ratios) > model.threshold)
    return found.withColumn("spans", S.merged(F.col("base"), added))


def report(docs: DataFrame) -> DataFrame:
    """Base counts and all spans of every document."""
    found = stored(scanned(docs.select("doc_id", "text")).drop("text"), "secrets")
    spans = with_spans(found, train(found))
    return spans.select(
        "doc_id",
        *(S.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )


def mask(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text masked, and n_chars, where there is one, brought in line."""
    length = [i for i, c in enumerate(docs.columns) if c.lower() == "n_chars"]

    def apply(renamed: DataFrame, text: str) -> DataFrame:
        found = stored(scanned(renamed, text), "secrets")
        found = with_spans(found, train(found)).withColumn(text, S.masked(F.col(text), F.col("spans"), by))
        hit = F.size("spans") > 0
        for i in length:
            own = F.length(text).cast(renamed.schema[f"_col{i}"].dataType)
            found = found.withColumn(f"_col{i}", F.when(hit, own).otherwise(F.col(f"_col{i}")))
        return found

    return S.sheltered(docs, apply)
