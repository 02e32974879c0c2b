"""Cell-wise expressions: units, normalisation, scores, risk, travel cost and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET = 0.3048
#: Walking speed 6 km/h at the best grade of -5 %, and its decay.
BEST_SPEED, DECAY, BEST_GRADE = 6.0, 3.5, 0.05
PENALTY = 8.0


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NULL stays NULL, which least and greatest would skip."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def feet_to_metres(z: Column) -> Column:
    return (z.cast("double") * FEET).cast("float")


def degrees_to_percent(s: Column) -> Column:
    return F.tan(F.radians(clip(s.cast("double"), 0.0, 89.9))) * 100.0


def linear(v: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``; NULL is 0."""
    if high <= low:
        raise ValueError("the upper limit must be above the lower one")
    return F.coalesce(clip((v.cast("double") - low) / (high - low)), F.lit(0.0))


def falling(v: Column, low: float, high: float) -> Column:
    """1 at ``low``, 0 at ``high``; NULL is 0."""
    if high <= low:
        raise ValueError("the upper limit must be above the lower one")
    return F.coalesce(1.0 - clip((v.cast("double") - low) / (high - low)), F.lit(0.0))


def preference(v: Column, limit: Column, target: float = 0.0, floor: float = 0.2) -> Column:
    """1 at the target, down to ``floor`` at ``limit`` away from it; NULL is 0."""
    away = clip(F.abs(v.cast("double") - target) / limit)
    return F.coalesce((1.0 - away) * (1.0 - floor) + floor, F.lit(0.0))


def share_of_limit(v: Column, limit: Column) -> Column:
    return clip(F.abs(v.cast("double")) / limit)


def between_percentiles(v: Column, p5: Column, p95: Column, lower_is_better: bool) -> Column:
    """Position between two percentiles; raises if they coincide."""
    width = F.when(p95 - p5 < 1e-12, F.raise_error(F.lit("the criterion has no spread")).cast("double")).otherwise(p95 - p5)
    scaled = clip((v.cast("double") - p5) / width)
    return 1.0 - scaled if lower_is_better else scaled


def weighted(base: list[tuple[Column, float]], optional: list[tuple[Column, float]]) -> Column:
    """Weighted mean; an optional criterion that is NULL in a cell counts in neither sum there."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for v, w in base:
        total, weight = total + v * w, weight + w
    for v, w in optional:
        total, weight = total + F.coalesce(v * w, F.lit(0.0)), weight + F.when(v.isNull(), 0.0).otherwise(w)
    return F.try_divide(total, weight)


def risk(slope: Column, slope_max: float, plan_share: Column, profile_share: Column) -> Column:
    """Relative risk of the relief: three quarters slope, one quarter curvature."""
    steep = F.pow(clip(slope.cast("double") / max(slope_max, 1.0)), F.lit(1.35))
    return clip(steep * 0.75 + (plan_share + profile_share) / 2.0 * 0.25)


def route_cost(score: Column, model: str, contrast: float = 6.0, penalty: Column | None = None) -> Column:
    """Cost of a cell from its score: ``inverse``, ``exponential`` or the ``tobler`` slowdown."""
    cost = {"inverse": lambda: 1.0 / (score + 0.05), "exponential": lambda: F.exp((1.0 - score) * contrast), "tobler": lambda: (1.0 - score) * 2.0 + 1.0}
    if model not in cost:
        raise ValueError(f"no cost model {model}")
    return cost[model]() if penalty is None else cost[model]() * penalty


def tobler_hours(dz: Column, metres: Column) -> Column:
    """Hours to walk ``metres`` that rise by ``dz``; no distance takes no time."""
    grade = dz / metres
    return F.when(metres <= 0, 0.0).otherwise(metres / 1000.0 / (F.exp(F.abs(grade + BEST_GRADE) * -DECAY) * BEST_SPEED))


def tobler_speed(grade: Column, fastest: float = BEST_SPEED, decay: float = DECAY, best: float = BEST_GRADE) -> Column:
    return F.exp(F.abs(grade + best) * -decay) * fastest


def hours_text(hours: Column) -> Column:
    minutes = F.floor(hours * 60.0 + 0.5).cast("long")
    return F.concat(F.floor(minutes / 60).cast("long").cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def minimum_patch_ha(area_ha: Column) -> Column:
    """Automatic least size of a zone."""
    return F.least(F.greatest(area_ha * 0.0005, F.lit(1.0)), F.lit(50.0))


def class_labels(breaks: tuple[float, ...]) -> list[str]:
    edges = [f"{b:g}" for b in breaks]
    return [f"< {edges[0]} %", *(f"{a}-{b} %" for a, b in zip(edges, edges[1:])), f">= {edges[-1]} %"]


def slope_class(slope: Column, breaks: tuple[float, ...] = (20.0, 35.0, 60.0, 100.0)) -> Column:
    """Walkability class 1 to 5; a break belongs to the class above it; NULL is 0."""
    if len(breaks) != 4 or list(breaks) != sorted(set(breaks)):
        raise ValueError("four increasing breaks are needed")
    out = F.lit(1)
    for b in breaks:
        out = out + F.when(slope >= b, 1).otherwise(0)
    return F.when(slope.isNull(), 0).otherwise(out)


#: What the cost of a cell is in each model, for logs.
COST_MODELS = {"tobler": "walking time by gradient, slowed by low scores", "exponential": "exp(contrast * (1 - score))", "inverse": "1 / (score + 0.05)"}


def cost_model_text(model: Column) -> Column:
    """The model's name with what it computes; NULL for an unknown one."""
    known = F.create_map(*(F.lit(x) for pair in COST_MODELS.items() for x in pair))
    return F.concat_ws(": ", model, known[model])
