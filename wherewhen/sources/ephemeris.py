"""Celestial states from tables: samples of bodies' states, their spin and their mass.

An ephemeris is three tables, whatever they were made from:

* states: body, centre (NAIF numbers, centre 0 being the solar system's barycentre), epoch_ns, position (km) and
  velocity (km/s) in J2000 axes, at any spacing. Between samples a cubic meets both ends' positions and velocities.
* spins: body, ra0, ra1, dec0, dec1 (the pole's direction in degrees, and degrees a century), w0, w1 (the prime
  meridian in degrees, and degrees a day): how body-fixed axes turn.
* masses: body, gm (km3/s2).

Spans between samples are cut at buckets of time and in each at cells, as many as its spans, so that a lookup is an
equi-join on body, bucket and cell that meets a span or two, and a body that everything refers to is dealt over its cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherewhen.functions import ident, orbits, quat
from wherewhen.sources.builders import build_entities

J2000_AXES = 1
BARYCENTRE = 0
#: Centres between a body and the barycentre.
MAX_CENTRES = 8
TT_OFFSET_NS = 32_184_000_000
DAY_NS = 86_400_000_000_000
CENTURY_DAYS = 36_525.0
DEFAULT_SAMPLES, MAX_SAMPLES = 361, 100_000
#: Lookup tables of up to so many rows are sent to all executors; centres of so many bodies are followed on the driver.
FEW_ROWS = 50_000

STATES = "body int, centre int, epoch_ns bigint, position array<double>, velocity array<double>"
SPINS = "body int, ra0 double, ra1 double, dec0 double, dec1 double, w0 double, w1 double"
MASSES = "body int, gm double"


def _zero() -> Column:
    return quat.vector(0.0, 0.0, 0.0)


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def _apart(made: str, function: Column) -> Column:
    """function, a higher-order one of the column made; null where that is null.

    Such functions run outside generated code and so end it, and a column that is named twice is worked out before
    them, in generated code: that of several lookups in one method is too long for the JVM to compile it.
    """
    return F.when(F.col(made).isNotNull(), function)


@dataclass(frozen=True)
class Ephemeris:
    states: DataFrame
    spins: DataFrame
    masses: DataFrame
    bucket_ns: int = 30 * DAY_NS

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ephemeris:
        """The tables that save() wrote."""
        return Ephemeris(*[spark.read.schema(s).parquet(f"{path.rstrip('/')}/{n}") for n, s in (("states", STATES), ("spins", SPINS), ("masses", MASSES))])

    def save(self, path: str) -> None:
        for name, df in (("states", self.states), ("spins", self.spins), ("masses", self.masses)):
            df.write.parquet(f"{path.rstrip('/')}/{name}")

    def spans(self) -> DataFrame:
        """(body, centre, e0, e1, last, p0, v0, p1, v1, bucket): one row for each bucket that a span between samples touches."""
        after = Window.partitionBy("body").orderBy("e0")
        span = self.states.withColumnsRenamed({"epoch_ns": "e0", "position": "p0", "velocity": "v0"})
        span = span.withColumns({name: F.lead(column, n).over(after) for name, column, n in (("e1", "e0", 1), ("p1", "p0", 1), ("v1", "v0", 1), ("_after", "e0", 2))})
        last = F.col("_after").isNull()
        out = span.where("e1 IS NOT NULL").withColumn("last", last)
        return out.select("body", "centre", "e0", "e1", "last", "p0", "v0", "p1", "v1", F.explode(F.sequence(self._bucket(F.col("e0")), self._bucket(F.col("e1")))).alias("bucket"))

    def _bucket(self, epoch: Column) -> Column:
        """Divided as whole numbers, as a double doesn't hold an epoch."""
        return F.call_function("div", epoch - F.pmod(epoch, F.lit(self.bucket_ns)), F.lit(self.bucket_ns))

    @cached_property
    def _lookup(self) -> tuple[DataFrame, DataFrame, int]:
        """What states are looked up by, written once: (_b, _bucket, _wide ns) says how wide the cells of a body's bucket are, which are as
        many as the spans in it; the spans by (_b, _bucket, _cell), each in the cells that it touches, so two rows a span on average,
        whatever the spacing; and through how many centres a state can lead. Tables of few rows are sent to all executors."""
        from wherewhen.plans.tables import settled

        spans = settled(self.spans(), "spans").withColumnsRenamed({"body": "_b", "bucket": "_bucket"})
        wide = F.greatest(F.lit(1), F.ceil(F.lit(self.bucket_ns) / F.count("*"))).cast("bigint")
        widths = settled(spans.groupBy("_b", "_bucket").agg(wide.alias("_wide")), "widths")
        start = F.col("_bucket") * F.lit(self.bucket_ns)
        cell = lambda e: F.floor((F.least(F.greatest(e, start), start + F.lit(self.bucket_ns - 1)) - start) / F.col("_wide"))
        cells = spans.join(widths, ["_b", "_bucket"]).withColumn("_cell", F.explode(F.sequence(cell(F.col("e0")), cell(F.col("e1"))))).drop("_wide")
        h = (F.col("e1") - F.col("e0")) / F.lit(1e9)
        along = {}
        for i, n in enumerate("xyz"):  # the cubic through both ends: the chord, and what the ends' velocities differ from it by
            p0, p1, v0, v1 = (F.get(c, F.lit(i)) for c in ("p0", "p1", "v0", "v1"))
            along |= {f"_from_{n}": p0, f"_chord_{n}": p1 - p0, f"_lead_{n}": v0 * h - (p1 - p0), f"_lag_{n}": p1 - p0 - v1 * h}
        cells = settled(cells.select("_b", "_bucket", "_cell", F.col("centre").alias("_centre"), "e0", "e1", "last", h.alias("_h"), *[c.alias(k) for k, c in along.items()]), "cells")
        return _few(widths), _few(cells), self._levels()

    def _levels(self) -> int:
        """How many centres are looked up at most on a way to the barycentre: MAX_CENTRES + 1 for more, a cycle, or too many bodies to tell."""
        pairs = self.states.select("body", "centre").distinct().limit(FEW_ROWS + 1).collect()
        if len(pairs) > FEW_ROWS:
            return MAX_CENTRES + 1
        up: dict[int, set[int]] = {}
        for r in pairs:
            up.setdefault(r["body"], set()).add(r["centre"])
        levels, open_ = 1, set().union(*up.values()) - {BARYCENTRE}
        while open_ and levels <= MAX_CENTRES:
            levels, open_ = levels + 1, set().union(*[up.get(b, set()) for b in open_]) - {BARYCENTRE}
        return levels

    def _found(self, asked: DataFrame, body: Column) -> DataFrame:
        """asked (epoch and more) with a body's _centre and _dx to _dz (km) and _dvx to _dvz (km/s) about it; null outside the samples. Rows stay as they are: one join for the cell, one for the span.

        Numbers are columns of their own and worked out in steps, as generated code grows with what is written out more than once.
        """
        widths, cells, _ = self._lookup
        e = F.col("epoch")
        out = asked.withColumns({"_for": body, "_at_bucket": self._bucket(e)})
        out = out.join(widths, (F.col("_for") == F.col("_b")) & (F.col("_at_bucket") == F.col("_bucket")), "left").drop("_b", "_bucket")
        out = out.withColumn("_at_cell", F.call_function("div", F.pmod(e, F.lit(self.bucket_ns)), F.col("_wide")))
        hit = (F.col("_for") == F.col("_b")) & (F.col("_at_bucket") == F.col("_bucket")) & (F.col("_at_cell") == F.col("_cell")) & (e >= F.col("e0")) & ((e < F.col("e1")) | (F.col("last") & (e == F.col("e1"))))
        out = out.join(cells, hit, "left").withColumn("_s", (e - F.col("e0")) / (F.col("e1") - F.col("e0")))
        s = F.col("_s")
        out = out.withColumns({f"_bow_{n}": F.col(f"_lead_{n}") * (1 - s) + F.col(f"_lag_{n}") * s for n in "xyz"})
        at = [(F.col(f"_from_{n}") + F.col(f"_chord_{n}") * s + F.col(f"_bow_{n}") * s * (1 - s)).alias(f"_d{n}") for n in "xyz"]
        slope = [((F.col(f"_chord_{n}") + F.col(f"_bow_{n}") * (1 - 2 * s) + (F.col(f"_lag_{n}") - F.col(f"_lead_{n}")) * s * (1 - s)) / F.col("_h")).alias(f"_dv{n}") for n in "xyz"]
        return out.select(*asked.columns, "_centre", *at, *slope)

    def relative(self, asked: DataFrame) -> DataFrame:
        """asked (body, epoch and more) with centre, position (km) and velocity (km/s) about it; null outside the samples."""
        known = F.col("_centre").isNotNull()
        vector = lambda *names: F.when(known, F.array(*names))
        return self._found(asked, F.col("body")).select(*asked.columns, F.col("_centre").alias("centre"), vector("_dx", "_dy", "_dz").alias("position"), vector("_dvx", "_dvy", "_dvz").alias("velocity"))

    def with_states(self, asked: DataFrame, body: Column, position: str, velocity: str) -> DataFrame:
        """asked (epoch and more) with a body's position (km) and velocity (km/s) about the barycentre; null where samples lack, or body is null.

        Centre after centre is looked up along the row, so with tables of few rows no row is moved.
        """
        levels = self._lookup[2]
        out = asked.withColumn("_at", body.cast("int")).withColumn("_sum", F.array(*[F.lit(0.0)] * 6))
        open_ = F.col("_at") != BARYCENTRE
        for _ in range(min(levels, MAX_CENTRES)):
            out = self._found(out, F.when(open_, F.col("_at")))
            step = F.when(open_, F.when(F.col("_centre").isNotNull(), F.array("_dx", "_dy", "_dz", "_dvx", "_dvy", "_dvz"))).otherwise(F.array(*[F.lit(0.0)] * 6))
            out = out.select(*asked.columns, F.when(open_, F.col("_centre")).otherwise(F.col("_at")).alias("_at"), "_sum", step.alias("_step"))
            out = out.select(*asked.columns, "_at", _apart("_step", F.zip_with("_sum", "_step", lambda x, y: x + y)).alias("_sum"))
        if levels > MAX_CENTRES and not out.where(open_).isEmpty():
            raise ValueError("a body's centres do not lead to the barycentre")
        known = F.col("_at").isNotNull()
        return out.select(*asked.columns, *[F.when(known, F.array(*[F.get("_sum", F.lit(i + k)) for i in range(3)])).alias(n) for n, k in ((position, 0), (velocity, 3))])

    def states_at(self, asked: DataFrame) -> DataFrame:
        """(body, epoch, position, velocity) about the barycentre for distinct asked (body, epoch); null where samples lack."""
        asked = asked.select(F.col("body").cast("int").alias("body"), "epoch").distinct()
        return self.with_states(asked, F.col("body"), "position", "velocity")

    def turns_at(self, asked: DataFrame) -> DataFrame:
        """asked (body, epoch and more) with q, the turn of body-fixed axes into J2000's, and spin (rad/s, along the pole); null for bodies without a spin, no turn for J2000's own axes."""
        spins = F.broadcast(self.spins.withColumnRenamed("body", "_body"))  # a row a body
        own = F.col("body") == J2000_AXES
        out = asked.join(spins, F.col("body") == F.col("_body"), "left")
        days = (F.col("epoch") + F.lit(TT_OFFSET_NS)) / F.lit(float(DAY_NS))
        ra, dec = (F.radians(F.col(f"{n}0") + F.col(f"{n}1") * days / CENTURY_DAYS) for n in ("ra", "dec"))
        w = F.radians(F.pmod(F.col("w0") + F.col("w1") * days, F.lit(360.0)))
        # about z by ra + 90 degrees, about the new x by 90 degrees - dec, about the new z by w; all in half angles
        turn, tilt, spun = (ra + math.pi / 2) / 2, (F.lit(math.pi / 2) - dec) / 2, w / 2
        q = F.array(F.cos(tilt) * F.cos(turn + spun), F.sin(tilt) * F.cos(turn - spun), F.sin(tilt) * F.sin(turn - spun), F.cos(tilt) * F.sin(turn + spun))
        pole = quat.vector(F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec))
        return out.select(*asked.columns, F.when(own, quat.vector(*quat.IDENTITY)).when(F.col("_body").isNotNull(), q).alias("q"), F.when(own, _zero()).otherwise(quat.scale(pole, F.radians(F.col("w1")) / 86400.0)).alias("spin"))

    def motions(self, asked: DataFrame, target: bytes) -> DataFrame:
        """(frame_id, epoch, t km, q) from each distinct asked (frame_id, epoch) - astronomical frames - into the target frame.

        Raises, when read, where the tables don't reach. A frame that shares the target's centre is not moved, one
        that shares its axes not turned.
        """
        spark = asked.sparkSession
        goal = spark.range(1).select(*ident.astro_frame(F.lit(bytearray(target)))).first()
        if goal[0] is None:
            raise ValueError("the target is no astronomical frame")
        e, o = ident.astro_frame(F.col("frame_id"))
        out = asked.select("frame_id", "epoch").distinct().withColumns({"_e": e, "_o": o})
        moved = F.col("_e") != goal[0]
        out = self.with_states(out, F.when(moved, F.col("_e")), "_own", "_own_v")
        out = self.with_states(out, F.when(moved, F.lit(goal[0])), "_goal", "_goal_v")
        out = self.turns_at(out.withColumnRenamed("_o", "body")).withColumnsRenamed({"q": "_q", "body": "_o", "spin": "_s"})
        out = self.turns_at(out.withColumn("body", F.lit(goal[1]))).withColumnRenamed("q", "_to").drop("body")
        same = F.col("_e") == goal[0]
        away = quat.sub(F.col("_own"), F.col("_goal"))
        turned = F.col("_to").isNotNull()
        t = F.when(same, _zero()).when(turned & F.col("_own").isNotNull() & F.col("_goal").isNotNull(), quat.rotate(quat.conj(F.col("_to")), away))
        q = F.when(F.col("_o") == goal[1], quat.vector(*quat.IDENTITY)).when(turned & F.col("_q").isNotNull(), quat.mul(quat.conj(F.col("_to")), F.col("_q")))
        sure = lambda c, what: F.coalesce(c, F.raise_error(F.lit(what)).cast("array<double>"))
        return out.select("frame_id", "epoch", sure(t, "no state of a body at an epoch").alias("t"), sure(q, "no spin of a body").alias("q"))

    def celestial_state(self, asked: DataFrame) -> DataFrame:
        """(body, epoch, position km, velocity m/s, quaternion, angular_velocity rad/s, mass_kg) of distinct asked (body, epoch), in J2000 axes about the barycentre. No turn where a body's spin isn't known."""
        at = self.turns_at(self.states_at(asked)).join(F.broadcast(self.masses.withColumnRenamed("body", "_m")), F.col("body") == F.col("_m"), "left")
        return at.select("body", "epoch", "position", quat.scale(F.col("velocity"), F.lit(1000.0)).alias("velocity"), F.coalesce("q", quat.vector(*quat.IDENTITY)).alias("quaternion"), F.col("spin").alias("angular_velocity"), orbits.mass_kg(F.col("gm")).alias("mass_kg"))

    def snapshot(self, epochs: DataFrame, source: bytes, bodies: DataFrame | None = None) -> DataFrame:
        """Entity rows of the bodies (all of ident.bodies() unless given as body, entity_id) at each of epochs (epoch): ICRF, km, TAI, measured."""
        who = bodies if bodies is not None else ident.bodies(epochs.sparkSession).select(F.col("naif_id").alias("body"), "entity_id")
        who = F.broadcast(who.select(F.col("body").alias("_who"), "entity_id"))  # ten bodies, or as given
        asked = epochs.select("epoch", F.explode(F.array(*[F.lit(r["_who"]) for r in who.orderBy("_who").collect()])).alias("body")).distinct()
        found = self.celestial_state(asked).where("position IS NOT NULL").join(who, F.col("body") == F.col("_who"))
        return build_entities(found, frame=F.lit(bytearray(ident.frame_bytes("ICRF"))), source=F.lit(bytearray(source)), epoch=F.col("epoch"), position=F.col("position"), quaternion=F.col("quaternion"), entity=F.col("entity_id"), velocity=F.col("velocity"), angular_velocity=F.col("angular_velocity"), mass_kg=F.col("mass_kg"))

    def orbits(self, asked: DataFrame, samples: int | None = None) -> DataFrame:
        """(body, centre, epoch, the osculating elements, path_dt_s, path_km) of bound asked (body, centre, epoch): mu is both bodies' gm; the path has samples positions over the period about the epoch, null where states lack."""
        samples = DEFAULT_SAMPLES if samples is None else samples
        if not 2 <= samples <= MAX_SAMPLES:
            raise ValueError(f"samples has to be from 2 to {MAX_SAMPLES}")
        asked = asked.select(F.col("body").cast("int").alias("body"), F.col("centre").cast("int").alias("centre"), "epoch").distinct()

        def about(pairs: DataFrame) -> DataFrame:
            both = self.with_states(self.with_states(pairs, F.col("body"), "_pb", "_vb"), F.col("centre"), "_pc", "_vc")
            return both.select(*pairs.columns, *[_apart(f"_{x}b", F.zip_with(f"_{x}b", f"_{x}c", lambda a, b: a - b)).alias(n) for x, n in (("p", "r"), ("v", "v"))])

        gm = lambda n: F.broadcast(self.masses.select(F.col("body").alias(f"_m{n}"), F.col("gm").alias(f"_gm{n}")))
        now = about(asked).join(gm(1), F.col("body") == F.col("_m1"), "left").join(gm(2), F.col("centre") == F.col("_m2"))
        now = now.select("body", "centre", F.col("epoch").alias("at"), "r", "v", (F.coalesce("_gm1", F.lit(0.0)) + F.col("_gm2")).alias("mu"))
        # a row's number isn't known below the place where it is given, so the condition stays above the steps instead of being written out below them
        bound = orbits.with_elements(now, F.col("r"), F.col("v"), F.col("mu")).withColumn("_row", F.monotonically_increasing_id()).where("sma_km IS NOT NULL AND _row >= 0").drop("r", "v", "mu", "_row")
        dt = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.col("period_s") * (i / F.lit(samples - 1.0) - 0.5))
        times = bound.select("body", "centre", "at", F.posexplode(dt).alias("i", "dt")).withColumn("epoch", F.col("at") + F.round(F.col("dt") * 1e9).cast("bigint"))
        path = about(times).groupBy("body", "centre", "at").agg(F.array_sort(F.collect_list(F.struct("i", "dt", "r"))).alias("_path"))  # MAX_SAMPLES at most
        out = bound.join(path, ["body", "centre", "at"], "left")
        return out.select("body", "centre", F.col("at").alias("epoch"), *bound.columns[3:], F.transform("_path", lambda x: x["dt"]).alias("path_dt_s"), F.transform("_path", lambda x: x["r"]).alias("path_km"))
