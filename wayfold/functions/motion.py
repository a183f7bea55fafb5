"""Column functions of motion: interpolation, headings, errors, and exact statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def wrap(angle: Column) -> Column:
    """To [-pi, pi); +pi becomes -pi."""
    return F.pmod(angle + math.pi, F.lit(TWO_PI)) - math.pi


def lerp(a: Column, b: Column, u: Column) -> Column:
    """Null if either end is."""
    return a + (b - a) * u


def heading_between(a: Column, b: Column, u: Column) -> Column:
    """Along the shortest arc."""
    return wrap(a + wrap(b - a) * u)


def hermite(a: Column, b: Column, va: Column, vb: Column, seconds: Column, u: Column) -> tuple[Column, Column]:
    """Position and velocity of a cubic with given end positions and velocities."""
    u2, u3 = u * u, u * u * u
    position = (2 * u3 - 3 * u2 + 1) * a + (u3 - 2 * u2 + u) * seconds * va + (3 * u2 - 2 * u3) * b + (u3 - u2) * seconds * vb
    velocity = ((6 * u2 - 6 * u) * (a - b)) / seconds + (3 * u2 - 4 * u + 1) * va + (3 * u2 - 2 * u) * vb
    return position, velocity


def segment_state(t: Column, kind: Column, prefix: str = "") -> dict[str, Column]:
    """x_m, y_m, z_m, heading_rad, velocity_x_mps, velocity_y_mps of a segment at time t within it.

    At the ends the stored values are returned as they are.
    """
    c = lambda n: F.col(prefix + n)
    span = c("end_time_ns") - c("start_time_ns")
    u = (t - c("start_time_ns")).cast("double") / F.when(span > 0, span).cast("double")
    seconds = span.cast("double") / 1e9
    cubic = kind == "cubic_hermite"

    def at(start: str, end: str, between: Column) -> Column:
        return F.when(t == c("start_time_ns"), c(start)).when(t == c("end_time_ns"), c(end)).otherwise(between)

    out = {}
    for axis in ("x", "y"):
        a, b, va, vb = (c(f"{e}_{n}") for n in (f"{axis}_m", f"velocity_{axis}_mps") for e in ("start", "end"))
        position, velocity = hermite(a, b, va, vb, seconds, u)
        out[f"{axis}_m"] = at(f"start_{axis}_m", f"end_{axis}_m", F.when(cubic, position).when(kind == "hold", a).otherwise(lerp(a, b, u)))
        out[f"velocity_{axis}_mps"] = at(f"start_velocity_{axis}_mps", f"end_velocity_{axis}_mps", F.when(cubic, velocity).otherwise(lerp(va, vb, u)))
    out["z_m"] = at("start_z_m", "end_z_m", lerp(c("start_z_m"), c("end_z_m"), u))
    out["heading_rad"] = at("start_heading_rad", "end_heading_rad", heading_between(c("start_heading_rad"), c("end_heading_rad"), u))
    return out


def position_error(x: Column, y: Column, z: Column, x2: Column, y2: Column, z2: Column) -> Column:
    """Euclidean; three-dimensional where the source has an elevation."""
    d = (x - x2) * (x - x2) + (y - y2) * (y - y2)
    return F.sqrt(F.when(z.isNotNull(), d + (z - z2) * (z - z2)).otherwise(d))


def heading_error(a: Column, b: Column) -> Column:
    return F.abs(wrap(a - b))


def velocity_error(vx: Column, vy: Column, vx2: Column, vy2: Column) -> Column:
    return F.sqrt((vx - vx2) * (vx - vx2) + (vy - vy2) * (vy - vy2))


def exact_sum(x: Column, digits: int = 6) -> Column:
    """Sum of a double rounded term by term, so that it doesn't depend on the order of rows."""
    return F.sum(F.round(x * F.lit(10.0**digits)).cast("long")).cast("double") / F.lit(10.0**digits)


def describe(x: Column) -> Column:
    """count, mean, median, p95, maximum, sum, sum_of_squares of the non-null values; null statistics if there are none.

    Quantiles interpolate linearly at (n - 1) q.
    """
    n = F.count(x)
    return F.struct(
        n.alias("count"), (exact_sum(x) / F.nullif(n, F.lit(0))).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"),
        F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("maximum"), F.coalesce(exact_sum(x), F.lit(0.0)).alias("sum"),
        F.coalesce(exact_sum(x * x), F.lit(0.0)).alias("sum_of_squares"),
    )


def nearest_rank(x: Column, q: float) -> Column:
    """The ceil(q n)-th smallest value; 0 if there are none."""
    values = F.array_sort(F.collect_list(x))
    return F.when(F.size(values) > 0, F.element_at(values, F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size(values)).cast("int")))).otherwise(0.0)


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two closed intervals over their union; 1 for two equal instants."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both.cast("double") / union.cast("double")).when((s1 == s2) & (e1 == e2), 1.0).otherwise(0.0)


def path_category(types: Column, length: Column) -> Column:
    """Category of a track from the set of its event types and the length of its valid path."""
    has = lambda t: F.array_contains(types, t)
    rules = (
        (has("gap"), "gap_affected"), (length <= 0.5, "stationary"), (has("stop"), "stop_and_go"),
        (has("left_turn") & has("right_turn"), "mixed"), (has("left_turn"), "left_turn"), (has("right_turn"), "right_turn"),
        (has("acceleration") & has("braking"), "mixed"), (has("acceleration"), "accelerating"), (has("braking"), "braking"),
    )
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("straight")


def practical_magnitude(effect: Column) -> Column:
    a = F.abs(effect)
    return F.when(effect.isNull(), "undefined_zero_variance").when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "moderate").otherwise("large")
