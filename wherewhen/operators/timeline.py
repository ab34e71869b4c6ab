"""Analytics over the timeline of each key: interpolation, gaps, crossings, steps and shapes. One shuffle by key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewhen.functions import quat


def _w(key: str, epoch: str, seq: str = "row_seq"):
    return Window.partitionBy(key).orderBy(epoch, seq)


def interpolate(grid: DataFrame, rows: DataFrame, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq", frame: str = "parent", unit: str = "units_pos") -> DataFrame:
    """grid (key, t) with x, y, z, q, frame, alpha and cross_frame: the pose at t.

    Between two samples positions are blended straight and turns along the sphere; where the frame or the unit
    changes the earlier sample holds and cross_frame says so. Before the first sample and after the last the
    pose is that sample's. Keys without samples are left out.
    """
    s = rows.groupBy(F.col(key).alias("_k"), F.col(epoch).alias("_t")).agg(F.min_by(F.struct(F.col(epoch).alias("e"), "x", "y", "z", F.col("quaternion").alias("q"), F.col(frame).alias("f"), F.col(unit).alias("u")), F.col(seq)).alias("_s"))
    both = grid.select(F.col(key).alias("_k"), F.col("t").alias("_t"), F.lit(1).alias("_side"), F.struct(*grid.columns).alias("_g")).unionByName(s.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    back = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("_a", F.last("_s", ignorenulls=True).over(back)).withColumn("_b", F.first("_s", ignorenulls=True).over(ahead)).where("_side = 1 AND (_a IS NOT NULL OR _b IS NOT NULL)")
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    alpha = F.when(F.col("_a").isNull() | F.col("_b").isNull() | (b["e"] == a["e"]), 0.0).otherwise((F.col("_t") - a["e"]) / (b["e"] - a["e"]))
    found = found.select("_g", a.alias("a"), b.alias("b"), alpha.alias("alpha"))
    cross = (F.col("a.f") != F.col("b.f")) | (F.col("a.u") != F.col("b.u"))
    blend = lambda c: F.when(cross, F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col("alpha"))
    turn = F.when(cross | (F.col("alpha") == 0), F.col("a.q")).otherwise(quat.slerp(F.col("a.q"), F.col("b.q"), F.col("alpha")))
    return found.select("_g.*", *[blend(c).alias(c) for c in "xyz"], turn.alias("q"), F.col("a.f").alias("frame"), "alpha", cross.alias("cross_frame"))


def steps(rows: DataFrame, value: str, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """rows with step: value less the key's value before."""
    return rows.withColumn("step", F.col(value) - F.lag(value).over(_w(key, epoch, seq)))


def first_run(rows: DataFrame, most: int, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """Each key's first unbroken run: run_end and n_run of the rows before the first step of over most."""
    broken = F.coalesce((F.col("step") > F.lit(most)).cast("int"), F.lit(0))
    run = steps(rows, epoch, key, epoch, seq).withColumn("_run", F.sum(broken).over(_w(key, epoch, seq).rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("_run = 0").groupBy(key).agg(F.max(epoch).alias("run_end"), F.count("*").alias("n_run"))


def runs(rows: DataFrame, most: int, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """All unbroken runs of each key: run number from 0, start, end and rows."""
    broken = F.coalesce((F.col("step") > F.lit(most)).cast("int"), F.lit(0))
    run = steps(rows, epoch, key, epoch, seq).withColumn("run", F.sum(broken).over(_w(key, epoch, seq).rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "run").agg(F.min(epoch).alias("run_start"), F.max(epoch).alias("run_end"), F.count("*").alias("n_run"))


def nodal_period(rows: DataFrame, value: str, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """Each key's mean time between upward crossings of 0, found by straight interpolation; null for under two."""
    w = _w(key, epoch, seq)
    v, t = F.lag(value).over(w), F.lag(epoch).over(w)
    at = F.when((v < 0) & (F.col(value) >= 0), t + (F.col(epoch) - t) * (-v) / (F.col(value) - v))
    up = rows.withColumn("_at", at).where("_at IS NOT NULL")
    return rows.select(key).distinct().join(up.groupBy(key).agg(F.when(F.count("*") > 1, (F.max("_at") - F.min("_at")) / (F.count("*") - 1)).alias("period"), F.count("*").alias("crossings")), key, "left").select(key, "period", F.coalesce("crossings", F.lit(0)).alias("crossings"))


def monotone(rows: DataFrame, value: str, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """Whether each key's value never falls, and how often it does."""
    falls = F.count_if(F.coalesce(F.col("step") < 0, F.lit(False)))
    return steps(rows, value, key, epoch, seq).groupBy(key).agg((falls == 0).alias("monotone"), falls.alias("falls"))


def exact_spacing(rows: DataFrame, spacing: int, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """Whether all steps of a key are spacing, with how many aren't and the rows that the spacing asks for."""
    return steps(rows, epoch, key, epoch, seq).groupBy(key).agg(F.count_if(F.col("step") != spacing).alias("uneven"), F.count("*").alias("n_rows"), (F.floor((F.max(epoch) - F.min(epoch)) / spacing) + 1).cast("bigint").alias("expected"))


def largest_turn(rows: DataFrame, angle_deg: str, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """Each key's largest step of an angle, taken the short way round."""
    step = F.abs(F.pmod(F.col("step") + 180, F.lit(360.0)) - 180)
    return steps(rows, angle_deg, key, epoch, seq).groupBy(key).agg(F.max(step).alias("max_turn"))


def unwrapped(rows: DataFrame, angle_deg: str, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """rows with unwrapped: the angle without its jumps by whole turns."""
    jump = F.coalesce(-F.round(F.col("step") / 360.0) * 360.0, F.lit(0.0))
    return steps(rows, angle_deg, key, epoch, seq).withColumn("unwrapped", F.col(angle_deg) + F.sum(jump).over(_w(key, epoch, seq).rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def rates(rows: DataFrame, value: str, hz: float, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """rows with speed and accel: first and second differences by the sampling rate."""
    w = _w(key, epoch, seq)
    out = rows.withColumn("speed", (F.col(value) - F.lag(value).over(w)) * hz)
    return out.withColumn("accel", (F.col("speed") - F.lag("speed").over(w)) * hz)


def extrapolation_gap(rows: DataFrame, values: list[str], key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """rows with gap: how far each is from what the parabola through the three before it foretells."""
    w = _w(key, epoch, seq)
    terms = [F.col(v) - (3 * F.lag(v, 1).over(w) - 3 * F.lag(v, 2).over(w) + F.lag(v, 3).over(w)) for v in values]
    return rows.withColumn("gap", F.sqrt(sum((t * t for t in terms), F.lit(0.0))))


def central_difference(rows: DataFrame, value: str, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """rows with rate: (next - before) over the time between, a second; null at the ends."""
    w = _w(key, epoch, seq)
    return rows.withColumn("rate", (F.lead(value).over(w) - F.lag(value).over(w)) / ((F.lead(epoch).over(w) - F.lag(epoch).over(w)) / 1e9))


def guide_line(rows: DataFrame, key: str = "entity", epoch: str = "epoch_ns", frame: str = "parent") -> DataFrame:
    """(key, shape, mean_radius, max_dev, n): of the samples in the key's current frame, whether they are a circle about its origin, a trail or nothing.

    Nothing: under two samples, a mean radius of 0, or a spread under 1e-6 of it; a circle: radii within 2 %.
    """
    now = rows.groupBy(key).agg(F.max_by(frame, F.struct(epoch, F.col("row_seq"))).alias("_now"))
    own = rows.join(now, key).where(F.col(frame) == F.col("_now")).withColumn("_r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    agg = own.groupBy(key).agg(F.count("*").alias("n"), F.avg("_r").alias("mean_radius"), F.max("_r").alias("_hi"), F.min("_r").alias("_lo"), F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("_span"))
    dev = F.greatest(F.col("_hi") - F.col("mean_radius"), F.col("mean_radius") - F.col("_lo")) / F.col("mean_radius")
    shape = F.when((F.col("n") < 2) | (F.col("mean_radius") == 0), "none").when(F.col("_span") < 1e-6 * F.col("mean_radius"), "none").when(dev < 0.02, "circle").otherwise("trail")
    return agg.select(key, shape.alias("shape"), "mean_radius", F.when(F.col("mean_radius") > 0, dev).alias("max_dev"), "n")


def circle_points(centre: DataFrame, key: str = "entity", points: int = 193) -> DataFrame:
    """(key, i, x, y, z): points on the circle of radius in the plane of unit vectors u and v."""
    turn = 2 * F.lit(3.141592653589793) * F.col("i") / (points - 1)
    rows = centre.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = [F.col("radius") * (F.cos(turn) * F.get("u", F.lit(k)) + F.sin(turn) * F.get("v", F.lit(k))) for k in range(3)]
    return rows.select(key, "i", *[c.alias(n) for c, n in zip(at, "xyz", strict=True)])


def fit_circle(rows: DataFrame, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """(key, radius, u, v) of the circle about the origin through each key's samples (x, y, z): its mean radius, u towards
    the first sample and v at right angles in the plane of the first and the sample that stands most across it, of equal
    ones the first. Keys whose samples are all in line with the first are left out.
    """
    from wherewhen.functions import quat

    samples = rows.select(key, F.struct(epoch, seq).alias("_order"), quat.vector(F.col("x"), F.col("y"), F.col("z")).alias("_p"))
    firsts = samples.groupBy(key).agg(F.min_by("_p", "_order").alias("_a"), F.avg(quat.norm(F.col("_p"))).alias("radius"))
    across = samples.join(firsts, key).withColumn("_n", quat.cross(F.col("_a"), F.col("_p"))).withColumn("_size", quat.norm(F.col("_n")))
    best = across.groupBy(key).agg(F.min_by(F.struct("_n", "_size", "_a", "radius"), F.struct(-F.col("_size"), F.col("_order"))).alias("_b")).select(key, "_b.*")
    best = best.where(F.try_divide(F.col("_size"), F.col("radius") * F.col("radius")) >= 1e-6)
    best = best.withColumns({"u": quat.scale(F.col("_a"), 1 / quat.norm(F.col("_a"))), "_w": quat.scale(F.col("_n"), 1 / F.col("_size"))})
    return best.select(key, "radius", "u", quat.cross(F.col("_w"), F.col("u")).alias("v"))


def extrema(rows: DataFrame, key: str = "entity") -> DataFrame:
    """(key, span of x, largest |y|, nearest and farthest distance from the origin)."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return rows.groupBy(key).agg((F.max("x") - F.min("x")).alias("span"), F.max(F.abs("y")).alias("largest"), F.min(r).alias("nearest"), F.max(r).alias("farthest"))


def closest_row(rows: DataFrame, distance2: Column, key: str = "entity", seq: str = "row_seq") -> DataFrame:
    """(key, seq) of each key's row with the least squared distance, of equal ones the first stored."""
    return rows.groupBy(key).agg(F.min_by(seq, F.struct(distance2, F.col(seq))).alias(seq))


def median_ratio(rows: DataFrame, above: Column, below: Column, key: str) -> DataFrame:
    """(key, ratio): the median of above over below, rows where below is 0 left out."""
    return rows.groupBy(key).agg(F.median(F.try_divide(above, below)).alias("ratio"))


def empty_slots(rows: DataFrame, step: int, epoch: str = "epoch_ns") -> DataFrame:
    """(slot): the whole steps between the first and the last row in which no row stands. The steps are made from the ends alone."""
    slot = rows.select(F.floor(F.col(epoch) / F.lit(step)).alias("slot"))
    due = slot.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("slot"))
    return due.join(slot.distinct(), "slot", "left_anti")


def polygon_area(rows: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """The area of each key's ring."""
    w = Window.partitionBy(key).orderBy(order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(all_)) for c in (x, y))
    return rows.withColumn("_cross", F.col(x) * ny - nx * F.col(y)).groupBy(key).agg((F.abs(F.sum("_cross")) / 2).alias("area"))


def resample(rows: DataFrame, key: str, order: str, x: str, y: str, step: float) -> DataFrame:
    """(key, i, x, y): points every step along each key's line."""
    w = Window.partitionBy(key).orderBy(order)
    leg = F.sqrt((F.lead(x).over(w) - F.col(x)) ** 2 + (F.lead(y).over(w) - F.col(y)) ** 2)
    legs = rows.select(key, order, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lead(x).over(w).alias("_nx"), F.lead(y).over(w).alias("_ny"), leg.alias("_leg"))
    legs = legs.withColumn("_from", F.coalesce(F.sum("_leg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where("_leg > 0")
    first, last = F.ceil(F.col("_from") / step).cast("bigint"), F.ceil((F.col("_from") + F.col("_leg")) / step).cast("bigint") - 1
    at = legs.withColumn("i", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("i") * step - F.col("_from")) / F.col("_leg")
    return at.select(key, "i", (F.col("_x") + (F.col("_nx") - F.col("_x")) * t).alias(x), (F.col("_y") + (F.col("_ny") - F.col("_y")) * t).alias(y))


def signal_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """RMS, kurtosis (3 for a normal signal), range and largest magnitude of each key."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.sqrt(F.avg(v * v)).alias("rms"), (F.kurtosis(v) + 3).alias("kurtosis"), (F.max(v) - F.min(v)).alias("peak_to_peak"), F.max(F.abs(v)).alias("max_abs"))


def peak_over_floor(spectrum: DataFrame, key: str, freq: str, amp: str, at: float, within: float) -> DataFrame:
    """The largest amplitude near a frequency over the median of all."""
    near = F.when(F.abs(F.col(freq) - at) <= within, F.col(amp))
    return spectrum.groupBy(key).agg((F.max(near) / F.median(amp)).alias("peak"))


def energy_momentum(rows: DataFrame, mu: float, key: str = "entity") -> DataFrame:
    """The spread of the specific energy and of |r x v| over each key's rows, from r (km) and v (km/s)."""
    r, v = F.col("r"), F.col("v")
    energy = quat.dot(v, v) / 2 - mu / quat.norm(r)
    h = quat.norm(quat.cross(r, v))
    return rows.withColumns({"_e": energy, "_h": h}).groupBy(key).agg((F.max("_e") - F.min("_e")).alias("energy_spread"), (F.max("_h") - F.min("_h")).alias("momentum_spread"))


def ground_speed(r: Column, v: Column) -> Column:
    """Speed without the part along r."""
    radial = quat.dot(r, v) / quat.norm(r)
    return F.sqrt(F.greatest(F.lit(0.0), quat.dot(v, v) - radial * radial))
