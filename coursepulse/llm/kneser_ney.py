"""Perplexity of whole texts under an interpolated modified Kneser-Ney model (operator 7).

The model is over characters, of order ORDER. Counts come from all trusted text: tasks count their own n-grams,
Spark adds them up, and discounts, contexts and lower orders (by continuation counts) follow from
joins on the n-grams, sharded by hash like any join. The finished table is cut into shards by the
last two characters of the context, so that a shard answers alone for its places in a text; short
n-grams go to every shard. Documents are scored shard by shard, with one shard, at most
SHARD_ROWS rows and their short n-grams, broadcast at a time; the sums are stored, the shard is dropped, and
in the end the sums are added up. (A join of every document's own n-grams would shuffle some 20 times the text.)

A text is kept if its perplexity is at most the threshold of its language: the QUANTILE of its trusted texts, each
scored by a model that didn't see it. For that, trusted texts are dealt to FOLDS folds by id, and there is a model
without each of them; documents are scored by the one without fold 0. All models share one table and its joins, with
columns of their own. However few trusted texts a language has, the threshold is its own; only a language
without any takes the threshold of all.

Defined cases: a null or empty text has no perplexity and isn't kept. Without trusted text nothing
has a perplexity or is kept. A null language is a language of its own. Rows that are alike in id, text and
language are one document. The labels of a document are taken together: it is trusted if one says
good quality and none says otherwise or toxic.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursepulse.llm.common import ROWS, map_arrow, stored

ORDER = 5
#: A symbol is a whole code point: its lower bits are packed in the column gram, its upper ones (often none) in high.
BITS, HIGH_BITS = 12, 9
#: Code points below this, which are all, stand for themselves.
HALF = 1 << (BITS + HIGH_BITS)
START, END, SPACE, DIGIT = 1, 2, 32, 48
#: Orders that go to every shard, as their context is too short to tell the shard.
SHORT = 2
SHARD_ROWS = 2_000_000
#: Different n-grams that a task holds before it adds up equal ones.
HELD = 2_000_000
FOLDS = 5
QUANTILE = 0.995
#: Sub-ranges of a doubling, in which perplexities are counted for the thresholds.
RANGES = 1024


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts one after the other, each behind ORDER - 1 starts and before an end; and their lengths."""
    edge = chr(START) * (ORDER - 1)
    own = [t.lower() for t in texts]
    joined = "".join(edge + t + chr(END) for t in own)
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x[(x >= 48) & (x <= 57)] = DIGIT
    x[(x >= 9) & (x <= 13)] = SPACE
    return x, np.array([len(t) + ORDER for t in own], np.int64)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram of highest order at every place of the texts (end included), lower and upper bits, and places of each text."""
    x, lengths = symbols(texts)
    if not len(x):
        return *2 * (np.empty(0, np.int64),), lengths
    packed, high = np.zeros((2, len(x) - ORDER + 1), np.int64)
    upper = x >> BITS
    x &= (1 << BITS) - 1
    for i in range(ORDER):
        packed = packed << BITS | x[i : i + len(packed)]
        high = high << HIGH_BITS | upper[i : i + len(high)]
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(x), bool)
    for i in range(1, ORDER):
        inside[(first - i)[first >= i]] = False
    inside = inside[: len(packed)]
    return packed[inside], high[inside], lengths - ORDER + 1


def _distinct(grams: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams, and the place of each given one among them."""
    wide = high != 0
    one, at = np.unique(grams[~wide], return_inverse=True)
    order = np.lexsort((grams[wide], high[wide]))
    low, up = grams[wide][order], high[wide][order]
    new = np.append(True, (low[1:] != low[:-1]) | (up[1:] != up[:-1]))[: len(low)]
    place = np.empty(len(grams), np.int64)
    place[~wide] = at
    place[np.flatnonzero(wide)[order]] = len(one) + np.cumsum(new) - 1
    return np.append(one, low[new]), np.append(np.zeros(len(one), np.int64), up[new]), place


#: What tells n-grams apart, and the same of their contexts and suffixes.
GRAM, CONTEXT, SUFFIX = ["gram", "high"], ["context", "context_high"], ["suffix", "suffix_high"]


def _suffix(size: int) -> list[Column]:
    """The last symbols of an n-gram."""
    return [F.col("gram").bitwiseAND((1 << BITS * size) - 1), F.col("high").bitwiseAND((1 << HIGH_BITS * size) - 1)]


def _context() -> list[Column]:
    """All symbols of an n-gram but the last."""
    return [F.shiftright("gram", BITS), F.shiftright("high", HIGH_BITS)]


def _named(columns: list, names: list[str]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names)]


def counts(docs: DataFrame, folds: int = 1) -> DataFrame:
    """(gram, high, n0, n1, ...) of highest order over docs (text, fold): n<k> counts all texts but those of fold k.

    With one fold there is one count, of all texts.
    """

    def run(batches):
        grams, high, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, folds), np.int64)]

        def merge():
            together, upper, own = _distinct(np.concatenate(grams), np.concatenate(high))
            every = np.concatenate(n)
            total = [np.bincount(own, every[:, f], len(together)).astype(np.int64) for f in range(folds)]
            grams[:], high[:], n[:] = [together], [upper], [np.stack(total, 1)]

        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                own = [(t, f) for t, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t]
                every, upper, places = ngrams([t for t, _ in own])
                fold = np.repeat(np.array([f for _, f in own], np.int64), places)
                one, upper, at = _distinct(every, upper)
                grams.append(one)
                high.append(upper)
                n.append(np.bincount(at * folds + fold, minlength=len(one) * folds).reshape(-1, folds))
                if sum(map(len, grams)) > HELD:
                    merge()
        merge()
        for first in range(0, len(grams[0]), 100_000):
            part = slice(first, first + 100_000)
            columns = [pa.array(grams[0][part]), pa.array(high[0][part]), *(pa.array(n[0][part, f]) for f in range(folds))]
            yield pa.RecordBatch.from_arrays(columns, [*GRAM, *(f"c{f}" for f in range(folds))])

    fields = "".join(f", c{f} long" for f in range(folds))
    own = map_arrow(docs.select("text", "fold"), run, f"gram long, high long{fields}").groupBy(*GRAM)
    own = own.agg(*(F.sum(f"c{f}").alias(f"c{f}") for f in range(folds)))
    total = reduce(Column.__add__, (F.col(f"c{f}") for f in range(folds)))
    return own.select(*GRAM, *((total - F.col(f"c{f}") if folds > 1 else total).alias(f"n{f}") for f in range(folds)))


def _discounts(level: DataFrame, folds: int) -> list[list[float]]:
    """For each model, discounts of counts 1, 2 and above, from how many n-grams have counts 1 to 4."""
    row = level.agg(
        *(F.count(F.when(F.col(f"n{k}") == i, 1)).alias(f"m{k}_{i}") for k in range(folds) for i in range(1, 5))
    ).first()
    out = []
    for k in range(folds):
        n1, n2, n3, n4 = (float(x) for x in row[4 * k : 4 * k + 4])
        if not n1 or not n2:
            out.append([0.5, 0.75, 0.9])
            continue
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        out.append([d if 0 < d < i else 0.5 * i for i, d in zip((1, 2, 3), found)])
    return out


def models(texts: DataFrame, folds: int) -> DataFrame:
    """(size, gram, high, logp0, back0, logp1, ...) of the models without each fold of texts (text, fold).

    logp<k> is null for n-grams that model k doesn't have. Contexts of nothing but starts are no n-grams; they have
    their size with a minus.
    """
    each = range(folds)
    levels = {ORDER: stored(counts(texts, folds), "ngrams")}
    for size in range(ORDER - 1, 0, -1):
        kinds = [F.count(F.when(F.col(f"n{k}") > 0, 1)).alias(f"n{k}") for k in each]
        levels[size] = stored(levels[size + 1].groupBy(*_named(_suffix(size), GRAM)).agg(*kinds), "ngrams")
    kinds = levels[1].agg(*(F.count(F.when(F.col(f"n{k}") > 0, 1)) for k in each)).first()
    lower, done = None, []
    for size in range(1, ORDER + 1):
        level = levels[size]
        less = []
        for k, cut in enumerate(_discounts(level, folds)):
            n = F.col(f"n{k}")
            less.append(F.when(n == 0, 0.0).when(n == 1, cut[0]).when(n == 2, cut[1]).otherwise(cut[2]))
        contexts = level.groupBy(*_named(_context(), CONTEXT)).agg(
            *(F.sum(f"n{k}").alias(f"total{k}") for k in each), *(F.sum(less[k]).alias(f"taken{k}") for k in each)
        )
        joined = level.select("*", *_named(_context(), CONTEXT)).join(contexts, CONTEXT)
        if lower is None:
            below = joined.select("*", *(F.lit(1.0 / max(kinds[k], 1)).alias(f"p_lower{k}") for k in each))
        else:
            short = lower.select(*_named(GRAM, SUFFIX), *(F.col(f"p{k}").alias(f"p_lower{k}") for k in each))
            below = joined.select("*", *_named(_suffix(size - 1), SUFFIX)).join(short, SUFFIX)
        p = [
            F.when(
                F.col(f"n{k}") > 0,
                (F.col(f"n{k}") - less[k] + F.col(f"taken{k}") * F.col(f"p_lower{k}")) / F.col(f"total{k}"),
            )
            for k in each
        ]
        lower = stored(below.select(*GRAM, *(p[k].alias(f"p{k}") for k in each)), "probabilities")
        backs = [F.when(F.col(f"total{k}") > 0, F.log(F.col(f"taken{k}") / F.col(f"total{k}"))) for k in each]
        weights = contexts.select(*_named(CONTEXT, GRAM), *(backs[k].alias(f"back{k}") for k in each))
        done.append((size, lower, weights))
    rows = []
    for (size, probs, _), (_, _, weights) in zip(done, [*done[1:], (0, None, None)]):
        own = probs.select(*GRAM, *(F.log(f"p{k}").alias(f"logp{k}") for k in each))
        if weights is None:
            own = own.select("*", *(F.lit(None).cast("double").alias(f"back{k}") for k in each))
        else:
            own = own.join(weights, GRAM, "full")
        values = [c for k in each for c in (f"logp{k}", f"back{k}")]
        known = F.coalesce(*(f"logp{k}" for k in each)).isNotNull()
        rows.append(own.select(F.when(known, size).otherwise(-size).alias("size"), *GRAM, *values))
    return stored(reduce(DataFrame.unionAll, rows), "model")


def _without(table: DataFrame, fold: int) -> DataFrame:
    """(size, gram, high, logp, back) of one of the models."""
    own = table.where(F.col(f"logp{fold}").isNotNull() | (F.col("size") < 0))
    return own.select("size", *GRAM, F.col(f"logp{fold}").alias("logp"), F.col(f"back{fold}").alias("back"))


def model(texts: DataFrame) -> DataFrame:
    """(size, gram, high, logp, back): every n-gram's log-probability, and its weight as a context (null if it is none)."""
    return _without(models(texts.select("text", F.lit(0).alias("fold")), 1), 0)


def _shard(context: Column | np.ndarray, high: Column | np.ndarray, shards: int):
    """Shard of the last two symbols of a context."""
    two, upper = (1 << 2 * BITS) - 1, (1 << 2 * HIGH_BITS) - 1
    if isinstance(context, np.ndarray):
        return ((context & two) * 40_503 + (high & upper) * 2_654_435 >> 8) % shards
    return F.shiftright(context.bitwiseAND(two) * 40_503 + high.bitwiseAND(upper) * 2_654_435, 8) % shards


class Table:
    """Values by key, looked up for whole arrays at once (open addressing); high holds the keys' upper bits, if any."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray, high: np.ndarray | None = None):
        bits = max(4, (4 * len(keys)).bit_length())
        self.mask = (1 << bits) - 1
        # The upper bits of the product are those that all bits of a key take part in.
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.at = np.zeros(self.mask + 1, np.int32)
        self.high = high if high is not None and high.any() else None
        place, left = self._place(keys, high), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.at[place[free]] = free
            self.keys[place[free]] = keys[self.at[place[free]]]
            left = left[self.at[place[left]] != left]
            place[left] = place[left] + 1 & self.mask
        self.values = values

    def _place(self, keys: np.ndarray, high: np.ndarray | None) -> np.ndarray:
        mixed = keys.astype(np.uint64)
        if high is not None and self.high is not None:
            mixed = mixed + high.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _same(self, place: np.ndarray, there: np.ndarray, keys: np.ndarray, high: np.ndarray | None) -> np.ndarray:
        same = there == keys
        if self.high is not None:
            same &= self.high[self.at[place]] == (0 if high is None else high)
        elif high is not None:
            same &= high == 0
        return same

    def find(self, keys: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """Positions of the keys' values, -1 where there is none."""
        place = self._place(keys, high)
        there = self.keys[place]
        same = self._same(place, there, keys, high)
        out = np.where(same, self.at[place], -1).astype(np.int64)
        left = np.flatnonzero(~same & (there >= 0))
        while len(left):
            place[left] = place[left] + 1 & self.mask
            there = self.keys[place[left]]
            won = self._same(place[left], there, keys[left], None if high is None else high[left])
            out[left[won]] = self.at[place[left[won]]]
            left = left[~won & (there >= 0)]
        return out


class Shard:
    """One shard of the models, with the n-grams short enough to be in all; a column of values for each model."""

    def __init__(self, rows: dict[str, np.ndarray], number: int, shards: int):
        self.number, self.shards = number, shards
        self.tables = {}
        for size in range(1, ORDER + 1):
            own = rows["size"] == size
            back = np.nan_to_num(rows["back"][own], nan=0.0)
            self.tables[size] = Table(rows["gram"][own], rows["logp"][own], back, high=rows["high"][own])
        #: Back-off weights of contexts of nothing but starts.
        starts = np.flatnonzero(rows["size"] < 0)
        self.starts = {-int(rows["size"][i]): np.nan_to_num(rows["back"][i], nan=0.0) for i in starts}
        #: What a symbol unknown to a model costs.
        kinds = np.sum(~np.isnan(self.tables[1].values[0]), axis=0)
        self.unknown = -np.log(2.0 * np.maximum(kinds, 1))

    def scores(self, grams: np.ndarray, high: np.ndarray | None = None, model: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of the last symbol of each n-gram under a model, the first if none is named; zero for n-grams of other shards."""
        out = np.zeros(len(grams))
        high = np.zeros(len(grams), np.int64) if high is None else high
        model = np.zeros(len(grams), np.int64) if model is None else model
        left = np.arange(len(grams))
        if self.shards > 1:
            left = left[_shard(grams >> BITS, high >> HIGH_BITS, self.shards) == self.number]
        for size in range(ORDER, 0, -1):
            keys, upper = grams[left] & (1 << BITS * size) - 1, high[left] & (1 << HIGH_BITS * size) - 1
            at = self.tables[size].find(keys, upper)
            hit = at >= 0
            found = np.full(len(left), np.nan)
            found[hit] = self.tables[size].values[0][at[hit], model[left[hit]]]
            # The table holds the n-grams of all models; one that a model lacks is none there.
            hit = ~np.isnan(found)
            out[left[hit]] += found[hit]
            left, keys, upper = left[~hit], keys[~hit], upper[~hit]
            if size > 1:
                starts = (keys >> BITS == sum(START << BITS * i for i in range(size - 1))) & (upper >> HIGH_BITS == 0)
                if size - 1 in self.starts:
                    out[left[starts]] += self.starts[size - 1][model[left[starts]]]
                at = self.tables[size - 1].find(keys >> BITS, upper >> HIGH_BITS)
                hit = at >= 0
                out[left[hit]] += self.tables[size - 1].values[1][at[hit], model[left[hit]]]
        out[left] += self.unknown[model[left]]
        return out


def _rows_of(table: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a part of the table; those of the models side by side. The part comes as Arrow batches, not as rows."""
    found = table.toArrow()
    out = {c: found[c].to_numpy().astype(k) for c, k in {"size": np.int8, "gram": np.int64, "high": np.int64}.items()}
    for kind in ("logp", "back"):
        own = [c for c in found.column_names if c.startswith(kind)]
        out[kind] = np.stack([found[c].to_numpy().astype(np.float64) for c in own], 1)
    return out


def scored(docs: DataFrame, table: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (doc_id, lang, text) with places and perplexity, one row for each different document.

    A column fold of docs chooses the model of each document; without it, it is the first. The driver holds
    one shard at a time: its sums are stored before the next one is fetched.
    """
    spark = docs.sparkSession
    shards = max(1, -(-table.where(F.col("size") > SHORT).count() // shard_rows))
    model = F.col("fold") if "fold" in docs.columns else F.lit(0)
    keyed = docs.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), "text", model.cast("int").alias("model"))
    backs = F.coalesce(*(c for c in table.columns if c.startswith("back"))).isNotNull()
    passes = []
    for number in range(shards):
        # A long n-gram's row serves as one with its context's shard, and as a context with its own.
        own = _shard(*_context(), shards) == number
        as_context = backs & (_shard(F.col("gram"), F.col("high"), shards) == number)
        shared = spark.sparkContext.broadcast(_rows_of(table.where((F.col("size") <= SHORT) | own | as_context)))
        passes.append(stored(_pass(keyed, shared, number, shards), "sums"))
        shared.destroy()
    key = ["doc_id", "lang", "text_hash"]
    total = reduce(DataFrame.unionAll, passes).groupBy(*key).agg(
        F.max("places").alias("places"), F.sum(F.col("logp") / F.col("places")).alias("mean"), F.count(F.lit(1)).alias("rows")
    )
    # Rows that are alike add up to as many equal sums.
    mean = F.col("mean") * shards / F.col("rows")
    known = F.lit(bool(table.limit(1).count()))
    return total.select(*key, "places", F.when(known & (F.col("places") > 1), F.exp(-mean)).alias("perplexity"))


def _pass(keyed: DataFrame, shared, number: int, shards: int) -> DataFrame:
    def run(batches):
        shard = Shard(shared.value, number, shards)
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                grams, high, places = ngrams([t or "" for t in batch.column(3).to_pylist()])
                model = np.repeat(batch.column(4).to_numpy(), places)
                starts = np.cumsum(places) - places
                sums = np.add.reduceat(shard.scores(grams, high, model), starts) if len(grams) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), pa.array(places), pa.array(sums)],
                    ["doc_id", "lang", "text_hash", "places", "logp"],
                )

    kinds = dict(keyed.dtypes)
    lead = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "text_hash"))
    return map_arrow(keyed, run, f"{lead}, places long, logp double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_id) of the documents whose labels make them trusted."""
    own = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic")
    )
    return own.where("quality = 1 and toxic = 0").select("_id")


def _fold() -> Column:
    """Fold of a trusted document; the model without it gives the document's part in the thresholds."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")


def thresholds(unseen: DataFrame) -> DataFrame:
    """(lang, threshold): the exact QUANTILE of unseen (lang, perplexity) by language.

    Perplexities are counted by sub-range first, and only those of the sub-range that holds the rank are sorted.
    """
    known = unseen.where(F.col("perplexity").isNotNull()).select(
        "lang", "perplexity", F.floor(F.log2("perplexity") * RANGES).alias("range")
    )
    ranges = known.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    by_lang = Window.partitionBy("lang")
    rank = F.ceil(F.sum("n").over(by_lang) * QUANTILE - 1e-9)
    upto = F.sum("n").over(by_lang.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    chosen = ranges.select("*", rank.alias("rank"), upto.alias("upto")).where("upto >= rank and upto - n < rank")
    chosen = chosen.select(
        F.col("lang").alias("_lang"), F.col("range").alias("_range"), (F.col("rank") - F.col("upto") + F.col("n")).alias("nth")
    )
    inside = known.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("range") == F.col("_range")))
    place = F.row_number().over(by_lang.orderBy("perplexity"))
    return inside.withColumn("place", place).where("place = nth").select("lang", F.col("perplexity").alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, trusted, places, perplexity, threshold and kept of every document."""
    ids = trusted_ids(labels)
    own = docs.select("doc_id", "lang", "text")
    # The labels grow with the corpus, so the join is the same at every size: both sides are shuffled.
    trusted = own.join(ids.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi").withColumn("fold", _fold())
    trusted = stored(trusted, "trusted")
    table = models(trusted, FOLDS)
    marked = scored(own, _without(table, 0), shard_rows).join(ids, F.col("doc_id") == F.col("_id"), "left")
    scores = stored(marked.withColumn("trusted", F.col("_id").isNotNull()).drop("_id"), "perplexities")
    # Every trusted document by the model that didn't see it, all in one pass.
    unseen = stored(scored(trusted, table, shard_rows).select("lang", "perplexity"), "unseen")
    limits = thresholds(unseen).withColumnRenamed("lang", "_lang")
    overall = thresholds(unseen.withColumn("lang", F.lit("all"))).first()
    joined = scores.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("threshold", F.lit(overall and overall["threshold"]).cast("double"))
    return joined.select(
        "doc_id",
        "lang",
        "trusted",
        "places",
        "perplexity",
        limit.alias("threshold"),
        F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"),
    )
