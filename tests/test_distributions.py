"""Histogram, box plot, trend, thresholds, retention and shares against brute force."""

import math
import random

import numpy as np
import pytest

from coursepulse.operators import boxplot, distributions, histogram, trend
from coursepulse.plans import report


@pytest.fixture(scope="module")
def rates(spark):
    def build(rows):
        return spark.createDataFrame(rows, "completed boolean, week1_completion_rate double")

    return build


def test_thresholds_keep_empty_rows(rates):
    rows = distributions.threshold_curve(rates([(False, 5.0), (True, 100.0)])).collect()
    by = {r.threshold: (r.n, r.completion_rate) for r in rows}
    assert by == {0.0: (2, 50.0), **{float(t): (1, 100.0) for t in range(10, 101, 10)}}
    nobody = distributions.threshold_curve(rates([(True, 5.0)]), [0, 50]).collect()
    assert {r.threshold: (r.n, r.completion_rate, r.overall_rate) for r in nobody} == {
        0.0: (1, 100.0, 100.0), 50.0: (0, None, 100.0),
    }


def test_threshold_counts_never_rise(rates):
    rng = random.Random(1)
    data = [(rng.random() < 0.3, rng.uniform(0, 100)) for _ in range(500)]
    rows = sorted(distributions.threshold_curve(rates(data)).collect(), key=lambda r: r.threshold)
    assert [r.n for r in rows] == [sum(v >= t for _, v in data) for t in range(0, 101, 10)]


def brute_histogram(values, bins):
    lo, hi = min(values), max(values)
    width = (hi - lo) / (bins - 1) if hi > lo else 0.1
    origin = math.floor((lo - width / 2) / width) * width + width / 2
    counts = {}
    for v in values:
        b = max(math.ceil((v - origin) / width - 1e-8) - 1, 0)
        counts[b] = counts.get(b, 0) + 1
    return counts, max(math.ceil((hi - origin) / width - 1e-8), 1)


@pytest.mark.parametrize("seed", range(4))
def test_histogram(spark, seed):
    rng = random.Random(seed)
    shift = rng.choice([0, -7, 13])
    data = [(rng.random() < 0.4, float(int(rng.expovariate(0.1)) + shift)) for _ in range(400)] + [(True, None)]
    df = spark.createDataFrame(data, "completed boolean, v double")
    rows = histogram.histogram(df, "v", ["completed"], 20).collect()
    again = histogram.histogram(df, "v", ["completed"], 20, few_values=True).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    expected, n_bins = brute_histogram([v for _, v in data if v is not None], 20)
    assert {(r.completed, r.bin) for r in rows} == {(c, b) for c in (True, False) for b in range(n_bins)}
    got = {}
    for r in rows:
        got[r.bin] = got.get(r.bin, 0) + r.n
        for v in (v for c, v in data if v is not None and c == r.completed):
            assert r.n or not r.bin_start + 1e-6 < v <= r.bin_end - 1e-6
    assert {b: n for b, n in got.items() if n} == expected
    assert histogram.peak(histogram.histogram(df, "v", ["completed"], 20)).first().y_max == max(r.n for r in rows)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(True, 5.0), (False, 5.0), (False, 5.0)], "completed boolean, v double")
    rows = histogram.histogram(df, "v", ["completed"], 50).collect()
    assert {(r.completed, r.bin, r.n) for r in rows} == {(True, 0, 1), (False, 0, 2)}
    assert all(r.bin_start < 5 <= r.bin_end for r in rows)


def test_histogram_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (True, 3.0)], "completed boolean, v double")
    rows = histogram.histogram(df, "v", ["completed"], 3).collect()
    assert {(r.completed, r.bin, r.n) for r in rows} == {
        (None, 0, 1), (None, 1, 0), (None, 2, 0), (True, 0, 0), (True, 1, 0), (True, 2, 1),
    }


def as_long(spark, groups):
    rows = [("run", f"p{i}", c, m, v) for (m, c), values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "course_run string, learner_id string, completed boolean, metric string, value double"
    )


def heavy_groups(rng):
    """Skewed, tied, constant and tiny groups, one of them far larger than the rest."""
    return {
        ("a", True): [rng.lognormvariate(0, 3) for _ in range(5000)],
        ("a", False): [float(rng.randint(0, 5)) for _ in range(300)] + [None] * 5,
        ("b", True): [7.0] * 50,
        ("b", False): [1.0, 2.0, 4.0, 9.0],
        ("c", True): [3.5],
        ("c", False): [0.0, 100.0, 100.0, 100.0],
    }


@pytest.mark.parametrize("metrics", [None, "abc"])
def test_quartiles_are_exact(spark, metrics):
    groups = heavy_groups(random.Random(7))
    rows = boxplot.quartiles(as_long(spark, groups).repartition(6), metrics).collect()
    assert len(rows) == len(groups)
    for r in rows:
        values = [v for v in groups[r.metric, r.completed] if v is not None]
        assert [r.q1, r.median, r.q3] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12)


def test_box_statistics_and_outliers(spark):
    groups = heavy_groups(random.Random(2))
    df = as_long(spark, groups)
    out = boxplot.outliers(df).collect()
    boxes = boxplot.box_statistics(df).collect()
    assert len(boxes) == len(groups)
    for r in boxes:
        values = np.array([v for v in groups[r.metric, r.completed] if v is not None])
        q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        beyond = (values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))
        inner = np.concatenate([[q1, q2, q3], values[~beyond]])
        assert r.n == len(values) and r.n_outliers == beyond.sum()
        assert [r.lower_whisker, r.upper_whisker] == pytest.approx([inner.min(), inner.max()])
        listed = sorted(o.value for o in out if (o.metric, o.completed) == (r.metric, r.completed))
        assert listed == sorted(values[beyond])


def test_quartiles_of_every_small_group(spark):
    """Distinct second-precision durations, all sizes: no rank may be missed."""
    rng = random.Random(4)
    groups = {(f"m{n}", True): [s / 86400 for s in rng.sample(range(-9, 10**6), n)] for n in range(1, 61)}
    rows = boxplot.quartiles(as_long(spark, groups).repartition(6)).collect()
    assert len(rows) == 60
    for r in rows:
        expected = np.quantile(groups[r.metric, True], [0.25, 0.5, 0.75])
        assert [r.q1, r.median, r.q3] == pytest.approx(list(expected), rel=1e-12)


def test_box_plot_takes_the_metrics_there_are(spark):
    df = as_long(spark, {("a", True): [1.0, 2.0], ("Other", False): [3.0]})
    assert {r.metric for r in boxplot.box_statistics(df).collect()} == {"a", "Other"}
    assert {r.metric for r in boxplot.box_statistics(df, ["Other"]).collect()} == {"Other"}


def test_bands_of_the_lift(spark):
    levels = spark.createDataFrame([("Top", 0.6), ("Rest", 0.2)], "week1_engagement_level string, completion_rate double")
    bands = (("Rest", 0), ("Top", 60))
    assert tuple(report.week1_lift(levels, bands).first()) == (60.0, 20.0, 3.0)
    assert report.week1_high_share(levels, bands).first()[0] == 50.0


def brute_fits(xs, ys, centres, span=0.75):
    """Value and slope of the weighted quadratic at each centre."""
    fits = []
    for c in centres:
        d = np.abs(xs - c)
        q = int(span * len(xs))
        h = np.partition(d, q - 1)[q - 1] if q else 0
        if h == 0 or (d < h).sum() < 3:
            fits.append((None, None))
            continue
        keep = d < h
        w = (1 - (d[keep] / h) ** 3) ** 3
        fit = np.polyfit((xs[keep] - c) / h, ys[keep], 2, w=np.sqrt(w))
        fits.append((float(fit[-1]), float(fit[-2] / h)))
    return fits


def brute_cuts(low, high, most):
    if high - low + 1 <= most:
        return []
    middle = (low + high) // 2
    return [*brute_cuts(low, middle, most), middle, *brute_cuts(middle + 1, high, most)]


def brute_curve(xs, ys, positions):
    n = len(xs)
    margin = 0.005 * max(xs[-1] - xs[0], max(abs(xs[0]), abs(xs[-1])) * 1e-3 + 1e-30)
    cuts = [(xs[i] + xs[i + 1]) / 2 for i in brute_cuts(0, n - 1, max(int(n * 0.75 * 0.2), 1))]
    ends = [xs[0] - margin, *cuts, xs[-1] + margin]
    fits, curve = brute_fits(xs, ys, ends), []
    for x in np.linspace(xs[0], xs[-1], positions):
        i = int(np.searchsorted(ends, x, side="right")) - 1
        (v0, d0), (v1, d1) = fits[i], fits[i + 1]
        if v0 is None or v1 is None:
            curve.append(None)
            continue
        w = ends[i + 1] - ends[i]
        t = (x - ends[i]) / w
        curve.append(
            (1 - t) ** 2 * (1 + 2 * t) * v0 + t**2 * (3 - 2 * t) * v1 + w * (t * (1 - t) ** 2 * d0 - t**2 * (1 - t) * d1)
        )
    return curve


def agree(ours, expected, close=1e-6):
    assert [v is None for v in ours] == [v is None for v in expected]
    both = [(a, b) for a, b in zip(ours, expected) if b is not None]
    assert all(a == pytest.approx(b, rel=close, abs=close) for a, b in both)


@pytest.mark.parametrize("n", [1, 3, 8, 60])
def test_trend(spark, n):
    rng = random.Random(n)
    xs = np.array(sorted(rng.sample(range(200), n)), dtype=float)
    ys = np.array([rng.uniform(0, 100) for _ in range(n)])
    df = spark.createDataFrame([(int(x), float(y)) for x, y in zip(xs, ys)], "x bigint, y double")
    got = {r.x: r.trend for r in trend.local_trend(df, "x", "y").collect()}
    agree([got[int(x)] for x in xs], [v for v, _ in brute_fits(xs, ys, xs)])
    curve = trend.drawn_trend(df, "x", "y", positions=33).orderBy("x").collect()
    assert [r.x for r in curve] == pytest.approx(np.linspace(xs[0], xs[-1], 33))
    agree([r.trend for r in curve], brute_curve(xs, ys, 33))


def test_trend_of_any_number_of_points(spark):
    """50,000 distinct x, very unevenly spread; every 100th fit is computed plainly."""
    n, rng = 50_000, np.random.default_rng(4)
    xs = np.unique(np.concatenate([rng.choice(4 * n, n // 2, replace=False) * 1e-3, 1e4 + np.arange(n // 2) ** 2.0]))
    ys = rng.uniform(0, 100, len(xs)) + 30 * np.sin(np.arange(len(xs)) / 7000)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(xs, ys)], "x double, y double").repartition(8)
    got = {r.x: r.trend for r in trend.local_trend(df, "x", "y").collect()}
    assert len(got) == len(xs)
    some = xs[::100]
    agree([got[x] for x in some], [v for v, _ in brute_fits(xs, ys, some)])
    curve = [r.trend for r in trend.drawn_trend(df, "x", "y").orderBy("x").collect()]
    agree(curve, brute_curve(xs, ys, 80))
    # Cells in number as for a hundred points.
    assert len(trend.cell_ends(n)) == len(trend.cell_ends(100)) == 7


def test_trend_reads_a_bounded_number_of_blocks(spark):
    """A neighbourhood is put together from at most two blocks of each size on either side."""
    ranked = trend._ranked(spark.range(3_000).selectExpr("double(id * id) x", "double(id % 7) y"))
    assert ranked.points.agg({"r": "sum"}).first()[0] == 3_000 * 2_999 // 2
    near = trend._neighbourhoods(ranked, ranked.points.selectExpr("x c"), 2_250)
    levels = trend._levels(ranked)
    for r in near.sample(0.005, 1).collect():
        for a, b in ((r.a, r.b), (r.b, r.e)):
            blocks = spark.range(1).select(
                trend.F.inline(trend._covering(levels, trend.F.lit(a), trend.F.lit(b), 1))
            ).collect()
            places = sorted(p for x in blocks for p in range(x.block << x.level, (x.block + 1) << x.level))
            assert places == list(range(a, b)) and len(blocks) <= 2 * len(levels)


def test_trend_without_some_numbers(spark):
    rows = [(1.0, 2.0, "own")] * 1 + [(None, 1.0, "own"), (2.0, None, "own"), (3.0, float("nan"), "own"), (float("inf"), 1.0, "own")]
    rows += [(float(10 + i), float(i * i), "own") for i in range(12)]
    df = spark.createDataFrame(rows, "x double, y double, c string")
    out = trend.local_trend(df, "x", "y")
    assert out.columns == ["x", "y", "c", "trend"] and out.count() == len(rows)
    valid = [(x, y) for x, y, _ in rows if x is not None and y is not None and np.isfinite(x) and np.isfinite(y)]
    xs, ys = np.array(valid).T
    got = {r.x: r.trend for r in out.collect()}
    agree([got[x] for x in xs], [v for v, _ in brute_fits(xs, ys, xs)])
    assert [got[x] for x in (None, 2.0, 3.0, float("inf"))] == [None] * 4
    empty = df.where("x < 0")
    assert trend.local_trend(empty, "x", "y").count() == 0 and trend.drawn_trend(empty, "x", "y").count() == 0


def test_retention(activity):
    rows = activity(
        [("a", "1.1", 1, 1), ("b", "1.1", 1, 1), ("b", "1.2", 1, 1), ("a", "2.1", 1, 1), ("a", "2.1", 1, 1, "run-2"),
         ("c", "2.1", 1, 1, "run-2"), ("z", "3.1", 1, 1, "run-1", None)]
    )
    pooled = distributions.weekly_retention(rows).collect()
    assert [tuple(r) for r in pooled] == [(1, 2, 100.0), (2, 2, 100.0), (None, 1, 50.0)]
    by_run = distributions.weekly_retention(rows, by_run=True).collect()
    assert [tuple(r) for r in by_run] == [
        ("run-1", 1, 2, 100.0), ("run-1", 2, 1, 50.0), ("run-1", None, 1, 50.0), ("run-2", 2, 2, 100.0),
    ]
    only_null = distributions.weekly_retention(activity([("a", "1.1", 1, 1, "run-1", None)])).collect()
    assert [tuple(r) for r in only_null] == [(None, 1, 100.0)]


def test_level_labels(spark):
    df = spark.createDataFrame([("Low", 2)] * 93 + [("High", 4)] * 7, "week1_engagement_level string, week1_level_rank int")
    rows = {r.week1_engagement_level: (r.n, r.percentage, r.label) for r in distributions.level_distribution(df).collect()}
    assert rows == {"Low": (93, pytest.approx(93.0), "93\n(93%)"), "High": (7, pytest.approx(7.0), None)}


def test_funnel_label(spark):
    overall = spark.createDataFrame([(12345, 6000, 1)], "n_enrolled bigint, n_active bigint, n_completed bigint")
    rows = sorted(distributions.completion_funnel(overall).collect(), key=lambda r: r.stage_rank)
    assert [(r.stage, r.label) for r in rows] == [
        ("Enrolled", "12,345\n(100%)"), ("Active", "6,000\n(48.6%)"), ("Completed", "1\n(0%)"),
    ]


def test_format_summary_table(spark):
    df = spark.createDataFrame([("x", 1234567, 1234.5678, True), ("y", None, 1.0, False)], "a string, b bigint, c double, d boolean")
    assert [tuple(r) for r in report.format_summary_table(df, 1).collect()] == [
        ("x", "1,234,567", "1,234.6", True), ("y", None, "1.0", False),
    ]


def test_format_summary_table_to_common_width(spark):
    rows = [("x", 1234567, 1234.5678, 1, 12.0), ("y", 5, -1.0, -20, 3.0), (None, None, None, 3, None)]
    df = spark.createDataFrame(rows, "a string, b bigint, c double, d int, `e f` double").repartition(1)
    out = report.format_summary_table(df, padded=True)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [
        ("x", "1,234,567", "1,234.57", "  1", "12"), ("y", "        5", "   -1.00", "-20", " 3"), (None, None, None, "  3", None),
    ]
    # All columns are looked at in one pass.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") <= 2 and plan.count("Aggregate") <= 1
    assert report.format_summary_table(df.select("a")).collect() == df.select("a").collect()
    assert report.format_summary_table(df.limit(0), padded=True).collect() == []


def test_ratios_without_a_base(spark):
    levels = spark.createDataFrame([("High", 0.5), ("Very Low", 0.0)], "week1_engagement_level string, completion_rate double")
    assert report.week1_lift(levels).first().lift is None
    assert report.week1_lift(levels.where("week1_engagement_level = 'High'")).first().very_low_percent is None
