"""GPS fixes as a stream: the distance windows of ``sequences`` with state for each track.

An extension; batches of files give the same windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "track string, win int, gradient double, speed_kmh double, dist_m double, dt_s double"
STATE = "win int, dist double, paused boolean, x0 double, y0 double, e0 double, t0 double, x double, y double, e double, t double"


def stream_windows(fixes: DataFrame, length: float = 180.0, most_pause: float = 120.0, speeds: tuple[float, float] = (0.2, 12.0), timeout_s: int = 3600) -> DataFrame:
    """Windows of a stream ``track, x, y, ele, t, ts``; a track silent for ``timeout_s`` of event time loses its state.

    The state of a track is one window, whatever its length.  Fixes that arrive in one batch are
    put in order by ``t``; one that is older than the last seen of its track is dropped.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        win, dist, paused, x0, y0, e0, t0, x, y, e, t = state.get if state.exists else (0, 0.0, False, *[None] * 8)
        out = []
        for row in pd.concat(list(batches)).sort_values("t").itertuples():
            if t is None:
                x0, y0, e0, t0 = x, y, e, t = row.x, row.y, row.ele, row.t
                continue
            if row.t < t:
                continue
            dist += math.hypot(row.x - x, row.y - y)
            paused = bool(paused or row.t - t > most_pause)
            x, y, e, t = row.x, row.y, row.ele, row.t
            if dist >= length:
                dt = t - t0
                speed = dist / dt * 3.6 if dt > 0 else math.inf
                if not paused and speeds[0] <= speed <= speeds[1]:
                    out.append((key[0], win, (e - e0) / dist, speed, dist, dt))
                win, dist, paused, x0, y0, e0, t0 = win + 1, 0.0, False, x, y, e, t
        if t is not None:
            state.update((win, float(dist), paused, *map(float, (x0, y0, e0, t0, x, y, e, t))))
            state.setTimeoutTimestamp(max(int(t * 1000), state.getCurrentWatermarkMs()) + 1000 * timeout_s)
        yield pd.DataFrame(out, columns=["track", "win", "gradient", "speed_kmh", "dist_m", "dt_s"])

    rows = fixes.select("track", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "ele", "t")), "ts").dropna().withWatermark("ts", f"{timeout_s} seconds")
    return rows.groupBy("track").applyInPandasWithState(fold, OUTPUT, STATE, "append", "EventTimeTimeout")
