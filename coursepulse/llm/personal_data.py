"""Personal data in whole texts, by weak supervision (operator 2).

Patterns give the base spans, which always stand. Candidates beside them (numbers in groups,
account numbers, capitalised pairs of words, handles) and the base spans themselves are voted on by
labelers: forms, a gazetteer of given names, words before and after the span. Expectation-maximisation over the table of vote
patterns estimates each labeler's reliability and so a probability for every pattern; with these a
naive Bayes classifier of the span's own features is trained on all candidates of the corpus, and it decides which
candidates become spans. Only DataFrame functions are used; the driver sees the vote patterns (at
most 3 to the number of labelers) and the classifier's counts (at most FEATURE_BUCKETS for each feature).

Defined cases: a null text counts as empty. A text of any length is read whole. Without candidates
only base spans are given. Repeated rows are scanned each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepulse.llm import spans as S
from coursepulse.llm.common import stored

# The base patterns, written so that no text costs more than its length. A match may
# begin where the one before ended, or where its first run of characters begins.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

# Patterns of candidates.
CANDIDATES = {
    "number": r"(?<![0-9A-Za-z.+-])[0-9(][0-9()./\x20-]{5,18}[0-9](?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<![\p{L}0-9])[A-Z][a-z]{1,20}\x20[A-Z][a-z]{1,20}(?![\p{L}0-9])",
    "handle": r"(?<![A-Za-z0-9_@.])@[A-Za-z][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@])",
}
KINDS = (*BASE_KINDS, *CANDIDATES)

# Gazetteer of given names, and words that speak for and against a span near them.
GIVEN_NAMES = (
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph "
    "jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty mark sandra paul emily peter anna "
    "maria jose juan carlos pedro luis pierre jean marie claire hans klaus petra heidi alice emma olivia noah liam"
).split()
CUES_FOR = (
    "phone tel telephone mobile cell fax call contact email mail ssn iban account passport born birth name mr mrs ms "
    "dr herr frau monsieur madame telefon konto nombre nom"
).split()
CUES_AGAINST = "isbn version page figure table chapter order invoice section volume line item street avenue road".split()
NATIONAL_PHONE = r"^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"
SOCIAL = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
DATE = r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$"

#: Code points on either side of a span that the context labelers see.
CONTEXT = 24
FEATURE_BUCKETS = 512
ROUNDS = 30
VOTERS = ("form", "gazetteer", "cue", "counter_cue", "digits", "base")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(
            c.cast("int")
        ),
    )
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    email = S.matches(text, EMAIL, "email", 0, needs=text.contains("@"))
    ip = F.filter(
        S.matches(text, IP, "ip", 1),
        lambda s: F.forall(
            F.split(s["value"], r"\."),
            lambda part: S.let(
                F.regexp_replace(part, "^0+", ""),
                lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255"),
            ),
        ),
    )
    card = F.filter(S.matches(text, CARD, "card", 2), lambda s: _luhn(_digits(s["value"])))
    phone = F.filter(
        S.matches(text, PHONE, "phone", 3, needs=text.contains("+")),
        lambda s: F.length(_digits(s["value"])).between(9, 15),
    )
    return S.merged(email, ip, card, phone)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base spans and the spans to vote on, each with the text before and after it."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("base", base_spans(whole))
    others = [S.matches(whole, p, kind, len(BASE_KINDS) + i) for i, (kind, p) in enumerate(CANDIDATES.items())]

    def in_context(parts: Column) -> Column:
        return F.transform(
            F.concat("base", "candidates"),
            lambda s: F.struct(
                s.alias("span"),
                F.lower(S.cut(parts, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])).alias("before"),
                F.lower(S.cut(parts, s["end"], s["end"] + CONTEXT)).alias("after"),
            ),
        )

    found = found.withColumn("candidates", S.apart(F.concat(*others), F.col("base")))
    some = F.size("base") + F.size("candidates") > 0
    parts = F.when(some, S.pieces(whole)).otherwise(F.array().cast("array<string>"))
    return found.withColumn("voted", S.let(parts, in_context))


def _any_word(words: list[str]) -> str:
    return r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"


def votes(v: Column) -> list[Column]:
    """A vote of each labeler on a voted struct: 1 for personal data, -1 against, 0 none."""
    kind, value = v["span"]["kind"], v["span"]["value"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    digits = F.length(_digits(value))
    known = F.lower(F.split(value, " ")[0]).isin(GIVEN_NAMES)
    numeric = kind.isin("number", "card", "phone")
    return [
        vote(value.rlike(NATIONAL_PHONE) | value.rlike(SOCIAL) | (kind == "account"), value.rlike(DATE)),
        vote((kind == "name") & known, (kind == "name") & ~known),
        vote(v["before"].rlike(_any_word(CUES_FOR)), never),
        vote(never, v["before"].rlike(_any_word(CUES_AGAINST)) | v["after"].rlike("^ ?" + _any_word(CUES_AGAINST))),
        vote(numeric & digits.between(9, 16), numeric & (digits < 8)),
        vote(kind.isin(*BASE_KINDS), never),
    ]


def features(v: Column) -> list[Column]:
    """Features of a span by itself, each as a bucket below FEATURE_BUCKETS."""
    value = v["span"]["value"]
    shape = F.translate(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[a-z]", "a"), "012345678", "9" * 9)
    before = F.element_at(F.regexp_extract_all(F.concat(F.lit("^ "), v["before"]), F.lit(r"[^\s]+"), F.lit(0)), -1)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FEATURE_BUCKETS)).cast("int")
    return [
        v["span"]["rank"],
        F.least(F.length(value), F.lit(FEATURE_BUCKETS - 1)),
        bucket(F.regexp_replace(shape, r"(.)\1+", "$1")),
        F.floor(F.length(_digits(value)) * 10 / F.length(value)).cast("int"),
        bucket(before),
    ]


N_FEATURES = 5


@dataclass(frozen=True)
class Model:
    """What the corpus taught: labelers' tables, and the classifier's log ratios by feature and bucket."""

    prior: float
    voters: dict[str, dict[int, tuple[float, float]]]
    log_odds: float
    ratios: tuple[tuple[float, ...], ...] | None


def estimate(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, list[float]]], dict]:
    """Expectation-maximisation over vote patterns and their counts.

    The prior, each labeler's (P(vote | no), P(vote | yes)), and each pattern's probability of yes.
    """
    voters = len(next(iter(patterns)))
    prior = 0.5
    tables = [{-1: [0.3, 0.1], 0: [0.5, 0.5], 1: [0.2, 0.4]} for _ in range(voters)]
    prob: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        for pattern in patterns:
            no, yes = math.log(1 - prior), math.log(prior)
            for vote, table in zip(pattern, tables):
                no, yes = no + math.log(table[vote][0]), yes + math.log(table[vote][1])
            prob[pattern] = 1 / (1 + math.exp(min(700.0, no - yes)))
        total = sum(patterns.values())
        sure = sum(n * prob[p] for p, n in patterns.items())
        prior = (sure + 1) / (total + 2)
        for j, table in enumerate(tables):
            for vote in table:
                of_vote = [(n, prob[p]) for p, n in patterns.items() if p[j] == vote]
                yes = sum(n * q for n, q in of_vote)
                no = sum(n for n, _ in of_vote) - yes
                table[vote] = [(no + 1) / (total - sure + 3), (yes + 1) / (sure + 3)]
    return prior, tables, prob


def train(found: DataFrame) -> Model:
    """Labeler reliabilities and classifier from scanned documents."""
    voted = found.select(F.explode("voted").alias("v"))
    cast = voted.select(F.array(*votes(F.col("v"))).alias("votes"), F.array(*features(F.col("v"))).alias("features"))
    cast = stored(cast, "votes")
    patterns = {tuple(r["votes"]): r["n"] for r in cast.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return Model(0.5, {}, 0.0, None)
    prior, tables, prob = estimate(patterns)
    chances = found.sparkSession.createDataFrame(
        [(list(p), float(q)) for p, q in prob.items()], "votes array<int>, yes double"
    )
    soft = cast.join(F.broadcast(chances), "votes").select("yes", F.posexplode("features").alias("feature", "bucket"))
    sums = soft.groupBy("feature", "bucket").agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no"))
    yes = [[0.5] * FEATURE_BUCKETS for _ in range(N_FEATURES)]
    no = [[0.5] * FEATURE_BUCKETS for _ in range(N_FEATURES)]
    for r in sums.collect():
        yes[r["feature"]][r["bucket"]] += r["yes"]
        no[r["feature"]][r["bucket"]] += r["no"]
    ratios = tuple(
        tuple(math.log(y / sum(ys)) - math.log(n / sum(ns)) for y, n in zip(ys, ns)) for ys, ns in zip(yes, no)
    )
    voters = {v: {k: (t[0], t[1]) for k, t in table.items()} for v, table in zip(VOTERS, tables)}
    return Model(prior, voters, math.log(prior / (1 - prior)), ratios)


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """Scanned documents with all spans: base ones, and candidates that the classifier takes."""
    if model.ratios is None:
        return found.withColumn("spans", F.col("base"))

    def score(v: Column) -> Column:
        total = F.lit(model.log_odds)
        for own, feature in zip(model.ratios, features(v)):
            known = F.split(F.lit(" ".join(f"{r:.6g}" for r in own)), " ").cast("array<double>")
            total = total + F.element_at(known, feature + 1)
        return total

    added = F.filter("voted", lambda v: ~v["span"]["kind"].isin(*BASE_KINDS) & (score(v) > 0))
    return found.withColumn("spans", S.merged(F.col("base"), F.transform(added, lambda v: v["span"])))


def report(docs: DataFrame) -> DataFrame:
    """Base counts and all spans of every document."""
    found = stored(scanned(docs.select("doc_id", "text")).drop("text"), "personal")
    spans = with_spans(found, train(found))
    return spans.select(
        "doc_id",
        *(S.count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
