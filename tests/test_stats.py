import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import stats


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.normal(size=997)] + [("b", float(x)) for x in rng.integers(0, 4, 50)] + [("c", 7.0), ("c", None), ("d", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {(r.k, r.percent): r.v for r in stats.order_statistics(frame, "k", "v", [0, 5, 33.3, 50, 99, 100]).collect()}
    for k in "abc":
        values = [v for n, v in rows if n == k and v is not None]
        for p in (0, 5, 33.3, 50, 99, 100):
            assert got[k, p] == pytest.approx(np.percentile(values, p), abs=1e-12)
    assert len(got) == 18


def test_order_statistics_of_odd_values(spark):
    rng = np.random.default_rng(1)
    values = {
        "wide": [float(s * 2.0**e) for e in range(-1074, 1024, 13) for s in (-1, 1)],
        "narrow": [float(1 + k * 2.0**-52) for k in range(300)],
        "zeros": [0.0] * 90 + [-0.0, 5e-324, -5e-324],
        "floats": [float(x) for x in rng.normal(1000, 1e-3, 5000).astype("float32")],
        "infinite": [float("-inf"), -1.0, 2.0, 3.0, float("inf"), float("inf")],
        "one": [4.25],
    }
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(None, 1.0), ("one", None)], "k string, v double").repartition(5)
    percents = [0, 1, 25, 50, 62.5, 99.9, 100]
    got = {(r.k, r.percent): r.v for r in stats.order_statistics(frame, "k", "v", percents).collect()}
    assert len(got) == len(values) * len(percents)
    for k, vs in values.items():
        for p in percents:
            rank = p / 100 * (len(vs) - 1)
            lo, hi = sorted(vs)[int(np.floor(rank))], sorted(vs)[int(np.ceil(rank))]
            want = lo if lo == hi else lo + (hi - lo) * float(rank - np.floor(rank))
            assert got[k, p] == want or np.isnan(got[k, p]) and np.isnan(want), (k, p)


def test_percentiles_have_one_way_at_every_size(spark):
    cells = spark.range(1000).select((F.col("id") % 37 / 7).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("b"), F.lit(150.0).alias("z"))
    wanted = {"x": (F.col("a"), 90), "y": (F.col("b"), 5)}
    plain = cells.agg(*(stats.percentile(v, p).alias(n) for n, (v, p) in wanted.items())).first().asDict()
    assert stats.percentiles(cells, wanted).first().asDict() == pytest.approx(plain)
    band = stats.band_thresholds(cells, 75.0, 100.0, 10, score="a").first()
    assert (band.band, band.n) == (1, 1000) and band.threshold == pytest.approx(np.percentile([i % 37 / 7 for i in range(1000)], 75))
    assert stats.percentiles(cells.where("false"), wanted).first().asDict() == {"x": None, "y": None}
    assert {r.raster: r.p50 for r in stats.diagnostics(cells, ["a", "z"]).collect()} == pytest.approx({"a": np.percentile([i % 37 / 7 for i in range(1000)], 50), "z": 150.0})


def test_representativeness_in_words(spark):
    rows = [(0, 0.0, 10.0, True, None), (1, 10.0, 20.0, False, 1), (2, 20.0, 30.0, False, 1), (3, 30.0, 40.0, True, None)]
    found = spark.createDataFrame(rows, "bin int, low double, high double, covered boolean, gap long")
    said = stats.describe_representativeness(found, "altitude", "m").first()
    assert said.text == "altitude: zones cover 2 of 4 bins; missing 10.00 to 30.00 m" and said.warn
    all_ = stats.describe_representativeness(found.where("covered"), "altitude").first()
    assert all_.text == "altitude: zones cover 2 of 2 bins" and not all_.warn


def test_standard_errors(spark):
    from ridgeline.operators import sequences

    rng = np.random.default_rng(6)
    g = rng.uniform(-0.4, 0.4, 400)
    y = np.log(5.0) - 3.0 * np.abs(g + 0.05) + rng.normal(0, 0.2, 400)
    fit = sequences.fit_tobler(spark.createDataFrame([(float(a), float(b)) for a, b in zip(g, np.exp(y))], "gradient double, speed_kmh double"), [0.05]).first()
    x = np.stack([np.ones(400), np.abs(g + 0.05)], axis=1)
    beta, sse = np.linalg.lstsq(x, y, rcond=None)[:2]
    cov = np.linalg.inv(x.T @ x) * sse[0] / 398
    assert fit.decay == pytest.approx(-beta[1]) and fit.decay_se == pytest.approx(cov[1, 1] ** 0.5) and fit.fastest_se == pytest.approx(np.exp(beta[0]) * cov[0, 0] ** 0.5)
