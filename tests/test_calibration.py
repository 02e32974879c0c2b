"""Settings of routes against walked tracks, and windows of several settings in one fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import sequences, validation
from ridgeline.operators.validation import Setting
from ridgeline.plans import network
from ridgeline.sources.grid import Grid
from tests.duck import same
from tests.test_connectivity import frame
from tests.test_searches import heap_search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parameter_sweep", "window_sensitivity", "track_windows", "walking_speed_fit"])
def test_queries(spark, name):
    same(network.QUERIES[name](spark, SF), SF, network.ORACLES[name])


def test_all_settings_and_cases_are_one_set(spark):
    rng = np.random.default_rng(2)
    score, z, wet = rng.uniform(0, 1, (18, 22)), np.cumsum(rng.normal(0, 3, (18, 22)), axis=0), rng.random((18, 22)) < 0.2
    score[rng.random(score.shape) < 0.1] = np.nan
    score[0, 0] = score[17, 21] = score[17, 0] = 0.5
    g, cells = Grid(18, 22), frame(spark, score=score, z=z, wet=wet)
    settings, cases = [Setting(), Setting(0.0, 1.3), Setting(2.0, 5.0, 8.0)], [((0, 0), ((17, 21),)), ((17, 0), ((0, 0), (17, 21)))]
    got = validation.sweep(cells, g, settings, cases, drainage="wet", size=7, bounded=True).costs_of_targets()
    for k, s in enumerate(settings):
        cost = (1 + s.slowdown * (1 - score)) * np.where(wet, s.penalty, 1.0)
        for j, (start, ends) in enumerate(cases):
            far = heap_search(cost, start, z, decay=s.decay)
            for t, end in enumerate(ends):
                assert got[k * 2 + j, t] == pytest.approx(far[end])
    assert len(got) == 9


def test_calibration_prefers_the_setting_that_made_the_tracks(spark):
    score, z = np.full((24, 40), 0.1), np.zeros((24, 40))
    score[20, :] = score[:, 2] = score[:, 37] = 1.0  # a good way round
    g, cells = Grid(24, 40), frame(spark, score=score, z=z)
    round_ = [(r, 2) for r in range(2, 21)] + [(20, c) for c in range(3, 38)] + [(r, 37) for r in range(19, 1, -1)]
    rows = [(case, i, g.x0 + (c + 0.5) * g.dx, g.y0 + (r + 0.5) * g.dy) for case, cut in ((1, 0), (2, 3)) for i, (r, c) in enumerate(round_[cut : len(round_) - cut])]
    tracks = spark.createDataFrame(rows, "case long, seq long, x double, y double")
    found = validation.calibration(cells, g, tracks, [Setting(0.0), Setting(12.0)], within=45.0, step=15.0)
    value = {(r.setting, r.case): r.value for r in found.collect()}
    assert value[1, 1] > 0.95 and value[1, 2] > 0.95 and value[0, 1] < 0.6 and len(value) == 4
    assert {r.setting for r in sequences.leave_one_out(found).collect()} == {1}
    shut = cells.withColumn("score", F.when(F.col("c") != 20, F.col("score")))
    assert {r.value for r in validation.calibration(shut, g, tracks, [Setting()], within=45.0, step=15.0).collect()} == {0.0}


def test_windows_of_settings_are_those_of_each(spark):
    rng = np.random.default_rng(3)
    rows = [(t, i, float(x), float(y), float(e), float(s)) for t in range(4) for i, (x, y, e, s) in enumerate(zip(*(np.cumsum(rng.uniform(0, m, 300)) for m in (20, 20, 2, 40))))]
    fixes = spark.createDataFrame(rows + [(9, 0, None, 1.0, 1.0, 1.0)], "track long, seq long, x double, y double, ele double, t double").repartition(3)
    settings = [(90.0, 30.0), (180.0, 120.0), (360.0, 1e9)]
    every = sorted(map(tuple, sequences.windows_of_settings(fixes, settings).collect()))
    each = [(k, *row) for k, (length, pause) in enumerate(settings) for row in map(tuple, sequences.distance_windows(fixes, length, pause).collect())]
    assert every == sorted(each) and len({r[0] for r in every}) == 3
