"""Suitability score, risk and travel cost of a scene."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import cellwise as fn
from ridgeline.operators.stats import percentiles


@dataclass(frozen=True)
class ScoreOptions:
    alt_min: float = 0.0
    alt_max: float = 2600.0
    slope_max: float = 85.0
    slope_score_max: float = 50.0
    weights: dict = field(default_factory=lambda: {"altitude": 0.0, "slope": 1.0, "plan": 1.0, "profile": 1.0})
    optional: dict = field(default_factory=dict)  # column -> weight: wetness, roughness and the like
    extra: str | None = None
    extra_weight: float = 0.0
    extra_lower_is_better: bool = True
    plan_limit: float = 0.0  # 0: from the scene
    profile_limit: float = 0.0

    def __post_init__(self):
        if self.alt_min >= self.alt_max:
            raise ValueError("the least altitude must be below the greatest")
        if self.slope_max <= 0 or self.slope_score_max < 1:
            raise ValueError("slope limits must be positive")
        if sum(self.weights.values()) + sum(self.optional.values()) + self.extra_weight <= 0:
            raise ValueError("some weight must be positive")


def scene_limits(cells: DataFrame, o: ScoreOptions) -> DataFrame:
    """One row with every percentile that the score and the risk need."""
    size = lambda v: F.abs(v.cast("double"))
    sized = {"plan99": (F.col("plan"), 99), "profile99": (F.col("profile"), 99), "plan95": (F.col("plan"), 95), "profile95": (F.col("profile"), 95), **{f"{n}95": (F.when(F.col("valid"), F.col(n)), 95) for n in o.optional}}
    fixed = {n: v for n, v in (("plan99", o.plan_limit), ("profile99", o.profile_limit)) if v > 0}
    wanted = {n: (size(v), p) for n, (v, p) in sized.items() if n not in fixed}
    if o.extra:
        wanted |= {n: (F.when(F.col("valid"), F.col(o.extra)), p) for n, p in (("extra5", 5), ("extra95", 95))}
    found = percentiles(cells, wanted).join(F.broadcast(cells.agg(*(F.max(size(v)).alias(f"max_{n}") for n, (v, _) in sized.items()))))  # one row each
    # A percentile of 0 gives way to the maximum, and that to 1.
    chosen = {n: F.lit(fixed[n]) if n in fixed else F.coalesce(F.when(F.col(n) > 0, F.col(n)), F.when(F.col(f"max_{n}") > 0, F.col(f"max_{n}")), F.lit(1.0)) for n in sized}
    chosen |= {n: F.col(n) for n in ("extra5", "extra95") if o.extra}
    return found.select(*(v.alias(f"limit_{n}") for n, v in chosen.items()))


def score(cells: DataFrame, o: ScoreOptions = ScoreOptions()) -> DataFrame:
    """Adds ``valid``, ``in_zone_range``, ``passable``, ``score`` and ``risk``.

    Needs ``z, slope, plan, profile`` and the optional criteria.  The scene's limits are one row,
    broadcast beside the cells.
    """
    valid = F.col("z").isNotNull() & F.col("slope").isNotNull() & F.col("plan").isNotNull() & F.col("profile").isNotNull()
    rows = cells.withColumn("valid", valid)
    rows = rows.join(F.broadcast(scene_limits(rows, o)))
    low = F.col
    base = [
        (fn.linear(F.col("z"), o.alt_min, o.alt_max), o.weights.get("altitude", 0.0)), (fn.falling(F.col("slope"), 0.0, o.slope_score_max), o.weights.get("slope", 0.0)),
        (fn.preference(F.col("plan"), low("limit_plan99")), o.weights.get("plan", 0.0)), (fn.preference(F.col("profile"), low("limit_profile99")), o.weights.get("profile", 0.0)),
    ]
    optional = [(1.0 - fn.share_of_limit(F.col(n), low(f"limit_{n}95")), w) for n, w in o.optional.items()]
    if o.extra and o.extra_weight:
        optional.append((fn.between_percentiles(F.col(o.extra), low("limit_extra5"), low("limit_extra95"), o.extra_lower_is_better), o.extra_weight))
    total = fn.weighted(base, optional)
    danger = fn.risk(F.col("slope"), o.slope_max, fn.share_of_limit(F.col("plan"), low("limit_plan95")), fn.share_of_limit(F.col("profile"), low("limit_profile95")))
    out = rows.withColumns({
        "passable": F.col("valid") & (F.col("slope") <= o.slope_max),
        "in_zone_range": F.col("valid") & F.col("z").between(o.alt_min, o.alt_max) & (F.col("slope") <= o.slope_max),
        "raw_score": F.when(F.col("valid"), total).cast("float"), "risk": F.when(F.col("valid"), danger).cast("float"),
    })
    out = out.withColumn("score", F.when(F.col("in_zone_range"), F.col("raw_score")))
    return out.drop(*(c for c in out.columns if c.startswith("limit_")))


def constrain(cells: DataFrame, layer: str | None = None, stream_class: str | None = None, mode: str = "avoid") -> DataFrame:
    """Adds ``barrier`` and ``penalty`` for routes, and takes barred cells out of ``in_zone_range``.

    ``layer`` (boolean) bars cells in mode ``avoid`` and costs eight times as much in ``penalise``;
    ``stream_class`` is NULL off streams, 1 where a stream can be forded and 2 where it can't.
    """
    if mode not in ("avoid", "penalise"):
        raise ValueError(f"no constraint mode {mode}")
    hit = F.coalesce(F.col(layer), F.lit(False)) if layer else F.lit(False)
    deep = F.coalesce(F.col(stream_class) >= 2, F.lit(False)) if stream_class else F.lit(False)
    barrier = deep | hit if mode == "avoid" else deep
    penalty = F.when(hit, fn.PENALTY).otherwise(1.0) if mode == "penalise" else F.lit(1.0)
    out = cells.withColumns({"barrier": barrier, "penalty": penalty})
    return out.withColumn("in_zone_range", F.col("in_zone_range") & ~F.col("barrier"))
