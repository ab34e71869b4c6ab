import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherewhen.functions import ident, quat
from wherewhen.operators import rows as R
from wherewhen.operators import transform as X
from wherewhen.sources import builders
from wherewhen.sources.ephemeris import DAY_NS, Ephemeris

AU, MOON_KM = 149_597_870.7, 384_400.0
YEAR, MONTH = 365.25, 27.3


def circle(radius, days, t):
    w = 2 * math.pi / (days * 86400)
    a = w * t / 1e9
    return [radius * math.cos(a), radius * math.sin(a), 0.0], [-radius * w * math.sin(a), radius * w * math.cos(a), 0.0]


@pytest.fixture(scope="module")
def eph(spark):
    rows = []
    for k in range(-60, 61):
        t = k * DAY_NS // 4
        rows += [(399, 10, t, *circle(AU, YEAR, t)), (301, 399, t, *circle(MOON_KM, MONTH, t)), (10, 0, t, [1000.0, 2000.0, 0.0], [0.0, 0.0, 0.0])]
    states = spark.createDataFrame(rows, "body int, centre int, epoch_ns bigint, position array<double>, velocity array<double>")
    spins = spark.createDataFrame([(399, -90.0, 0.0, 90.0, 0.0, 0.0, 360.0), (301, 0.0, 0.0, 66.0, 0.0, 38.0, 13.0)], "body int, ra0 double, ra1 double, dec0 double, dec1 double, w0 double, w1 double")
    masses = spark.createDataFrame([(10, 1.32712440018e11), (399, 398600.4418), (301, 4902.8)], "body int, gm double")
    return Ephemeris(states, spins, masses, bucket_ns=3 * DAY_NS)


def asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), "body int, epoch bigint")


def test_states_follow_the_centres(spark, eph):
    t = DAY_NS // 10
    got = {r.body: r for r in eph.states_at(asked(spark, (301, t), (399, t), (0, t), (499, t), (399, 400 * DAY_NS), (399, 15 * DAY_NS))).collect() if r.epoch == t}
    earth, moon = np.array([1000, 2000, 0]) + circle(AU, YEAR, t)[0], np.array(circle(MOON_KM, MONTH, t)[0])
    assert np.allclose(got[399].position, earth, atol=1e-3) and np.allclose(got[301].position, earth + moon, atol=0.1)
    assert np.allclose(got[399].velocity, circle(AU, YEAR, t)[1], atol=1e-6)
    assert got[0].position == [0, 0, 0] and got[499].position is None
    far = {r.epoch: r.position for r in eph.states_at(asked(spark, (399, 400 * DAY_NS), (399, 15 * DAY_NS))).collect()}
    assert far[400 * DAY_NS] is None and far[15 * DAY_NS] is not None  # the last sample itself is inside


def test_snapshot_and_orbits(spark, eph):
    rows = eph.snapshot(spark.createDataFrame([(0,)], "epoch bigint"), ident.frame_bytes("ICRF"))
    assert rows.schema.simpleString() == R.ENTITY.simpleString()
    assert {bytes(r.entity_id) for r in rows.collect()} == {ident.astro_bytes(i, i) for i in (10, 399, 301)}
    earth = rows.where(F.col("entity_id") == F.lit(bytearray(ident.astro_bytes(399, 399)))).first()
    assert abs(earth.mass_kg / 5.97e24 - 1) < 0.01 and abs(earth.angular_velocity[2] / (2 * math.pi / 86400) - 1) < 1e-9
    o = eph.orbits(spark.createDataFrame([(399, 10, 0), (301, 399, 0)], "body int, centre int, epoch bigint"), samples=5)
    by = {r.body: r for r in o.collect()}
    assert abs(by[399].sma_km / AU - 1) < 0.01 and by[399].ecc < 0.01 and abs(by[399].period_s / 86400 / 365.25 - 1) < 0.02
    assert by[301].path_dt_s[2] == 0 and by[301].path_km[2] is not None and len(by[301].path_km) == 5 and by[399].path_km[0] is None
    for n in (1, 100_001):
        with pytest.raises(ValueError, match="samples"):
            eph.orbits(asked(spark, (1, 1)).withColumn("centre", F.lit(1)), samples=n)


def test_axes_turn(spark, eph):
    noon = -32_184_000_000  # the meridian's angle is counted in TT
    q = eph.turns_at(asked(spark, (399, noon), (399, noon + DAY_NS // 4), (1, noon), (599, noon))).select("body", "epoch", F.when(F.col("q").isNotNull(), quat.rotate(F.col("q"), quat.vector(1, 0, 0))).alias("x")).collect()
    got = {(r.body, r.epoch): r.x for r in q}
    assert np.allclose(got[399, noon], [1, 0, 0]) and np.allclose(got[399, noon + DAY_NS // 4], [0, 1, 0], atol=1e-9)
    assert got[1, noon] == [1, 0, 0] and got[599, noon] is None
    # the pole of a body is where its table says
    pole = eph.turns_at(asked(spark, (301, 0))).select(quat.rotate(F.col("q"), quat.vector(0, 0, 1)).alias("z")).first().z
    assert np.allclose(pole, [math.cos(math.radians(66)), 0, math.sin(math.radians(66))])


def entity(name):
    return ident.mint_entity(F.lit("acme.com"), F.lit(name))


def rig(spark, epoch):
    tokens = [("acme.com", n, f, a, u, "TAI", "gps", "MEASURED", epoch, [x, 0.0, 0.0], q) for n, f, a, u, x, q in (
        ("facility", "Earth", None, "km", 6378.0, None), ("truck", "facility", "acme.com", "m", 20.0, [math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5)]), ("robot", "truck", "acme.com", "km", 3.0, None), ("probe", "ICRF", None, "km", 7.0, None))]
    return builders.from_tokens(spark.createDataFrame(tokens, builders.TOKENS))


def resolver(rows):
    flat = rows.select(F.col("entity_id").alias("entity"), f"{R.STRUCT}.*", R.epoch_ns(rows).alias("epoch_ns"), F.monotonically_increasing_id().alias("row_seq"))
    return X.in_km(flat.withColumnRenamed("frame_id", "parent"))


def test_transform_to_a_target(spark, eph):
    t = -32_184_000_000 + DAY_NS // 4
    rows = rig(spark, t)
    out = X.transform(rows, ident.frame_bytes("GCRF"), eph, resolver(rows), unit=2)
    assert out.schema.simpleString() == rows.schema.simpleString()
    names = {bytes(spark.range(1).select(entity(n)).first()[0]): n for n in ("facility", "truck", "robot", "probe")}
    got = {names[bytes(r.entity_id)]: r[R.STRUCT] for r in out.collect()}
    # Earth has turned a quarter: its x axis is J2000's y axis. The truck's own axes are another quarter on
    assert np.allclose(got["facility"].position, [0, 6_378_000, 0], atol=1e-3) and got["facility"].units_pos == 2
    assert np.allclose(got["truck"].position, [0, 6_378_020, 0], atol=1e-3) and np.allclose(got["robot"].position, [-3000, 6_378_020, 0], atol=1e-3)
    earth = np.array([1000, 2000, 0]) + circle(AU, YEAR, t)[0]
    assert np.allclose(np.array(got["probe"].position) / 1000, [7 - earth[0], -earth[1], 0], atol=1e-2)
    assert bytes(got["robot"].frame_id) == ident.frame_bytes("GCRF") and got["robot"].position_covariance is None
    # flat rows, into the same frame they are in: nothing moves
    flat = rows.select(f"{R.STRUCT}.*").where(F.col("frame_id") == F.lit(bytearray(ident.frame_bytes("Earth"))))
    same = X.transform(flat, ident.frame_bytes("Earth"), eph).first()
    assert same.position == [6378.0, 0, 0] and same.quaternion == [1, 0, 0, 0]
    with pytest.raises(ValueError, match="resolve"):
        X.transform(rows, ident.frame_bytes("ICRF"), eph)
    with pytest.raises(ValueError, match="no root frame"):
        X.transform(rows, ident.frame_bytes("ICRF"), eph, resolver(rows).where("x < 1000"))
    with pytest.raises(ValueError, match="target"):
        X.transform(rows, bytes(spark.range(1).select(entity("truck")).first()[0]), eph, resolver(rows))
    with pytest.raises(Exception, match="no state"):
        X.transform(rows.where(F.lit(True)), ident.frame_bytes("Mars"), eph, resolver(rows)).collect()


def test_round_trip(spark, eph):
    rows = rig(spark, 5 * DAY_NS + 777)
    there = X.transform(rows, ident.frame_bytes("Moon"), eph, resolver(rows))
    back = X.transform(there, ident.frame_bytes("Earth"), eph)
    straight = X.transform(rows, ident.frame_bytes("Earth"), eph, resolver(rows))
    a, b = ({bytes(r.entity_id): r[R.STRUCT].position for r in df.collect()} for df in (back, straight))
    assert all(np.allclose(a[k], b[k], atol=1e-5) for k in b)


def test_poses_of_bodies_and_cells(spark, eph):
    t = spark.createDataFrame([(0,), (DAY_NS,)], "epoch bigint")
    p = {r.epoch: r for r in X.body_poses(eph, ident.frame_bytes("Moon"), t, ident.frame_bytes("GCRF")).collect()}
    assert np.allclose(p[0].centre, [MOON_KM, 0, 0]) and np.allclose(p[DAY_NS].centre, circle(MOON_KM, MONTH, DAY_NS)[0], atol=0.1)
    rows = spark.createDataFrame([(0, 5.0, 5.0, 5.0), (1, 1.0, 1.0, 1.0)], "epoch bigint, x double, y double, z double")
    assert [tuple(r) for r in X.body_centred(rows, rows.where("epoch = 0").withColumn("x", F.lit(1.0))).collect()] == [(0, 4.0, 0.0, 0.0)]
    place = spark.createDataFrame([("site", "Earth", 6378.137, 0.0, 0.0)], "entity string, parent string, x double, y double, z double").withColumn("quaternion", quat.yaw(F.radians(F.lit(90.0))))
    rows = spark.createDataFrame([("arm", "site", 1.0, 0.0, 0.0), ("lost", "x", 0.0, 0.0, 0.0)], "entity string, parent string, x double, y double, z double").withColumn("quaternion", quat.vector(*quat.IDENTITY))
    got = X.through_pose(rows, place)
    r = got.first()
    assert got.count() == 1 and (r.parent, round(r.x, 6), round(r.y, 6)) == ("Earth", 6378.137, 1.0)
    r = X.in_cell(got, 0.0, 0.0, 0.0, (5.0, 0.0, 2.0)).first()  # its own x axis points north... by a quarter turn east
    assert np.allclose([r.east_m, r.north_m, r.up_m], [1005, 2, 0], atol=1e-5)


def test_world_pose(spark):
    rows = spark.createDataFrame([(1, -1, 0, 0.0, 0), (1, -1, 100, 10.0, 1), (2, 1, 0, 1.0, 2), (2, -1, 100, 50.0, 3), (3, 9, 0, 2.0, 4)], "entity long, parent long, epoch_ns long, x double, row_seq long").withColumns({"y": F.lit(0.0), "z": F.lit(0.0), "quaternion": quat.vector(*quat.IDENTITY)})
    ask = spark.createDataFrame([(1, 50), (1, -5), (1, 500), (2, 50), (2, 100), (3, 7), (9, 7)], "frame long, epoch long")
    got = {(r.frame, r.epoch): (r.root, r.t[0], r.hops) for r in X.world_pose(ask, rows, lambda c: c == -1).collect()}
    assert got == {(1, 50): (-1, 5.0, 1), (1, -5): (-1, 0.0, 1), (1, 500): (-1, 10.0, 1), (2, 50): (-1, 6.0, 2), (2, 100): (-1, 50.0, 1), (3, 7): (9, 2.0, 1), (9, 7): (9, 0.0, 0)}


def test_builders(spark):
    buffer = builders.RowBuffer(spark)
    buffer.append(authority="a", name="b", frame="Earth", units="m", timescale="UTC", source="s", estimate="SIMULATED", epoch_ns=0, position=[1.0, 2.0, 3.0])
    with pytest.raises(ValueError, match="columns"):
        buffer.append(colour="red")
    with pytest.raises(Exception):
        buffer.append(epoch_ns="now")
    assert len(buffer) == 1
    rows = builders.from_tokens(buffer.flush())
    r = rows.first()[R.STRUCT]
    assert len(buffer) == 0 and (r.units_pos, r.timescale_id, r.estimate_type, r.duration_ns) == (2, 1, 3, 32_000_000_000)
    R.validate(rows, "entity_id")
    for bad in ({"units": "parsec"}, {"frame": "Nowhere"}, {"timescale": "TCG"}, {"name": ""}):
        buffer.append(**({"authority": "a", "name": "b", "frame": "Earth", "units": "m", "timescale": "UTC", "source": "s", "estimate": "MEASURED", "epoch_ns": 0, "position": [1.0, 2.0, 3.0]} | bad))
        with pytest.raises(Exception):
            builders.from_tokens(buffer.flush()).collect()
    again = builders.entities_from(spark, [x.asDict(recursive=True) for x in rows.collect()])
    assert again.schema == R.ENTITY and again.collect() == rows.collect()
    flat = builders.observations_from(spark, [x[R.STRUCT].asDict() for x in rows.collect()])
    assert builders.as_struct(flat).first()[R.STRUCT] == r


def test_lookups_meet_few_spans(spark, eph):
    """A bucket of many spans is cut at cells, so that an asked row meets a span or two, also where samples are dense for a while."""
    dense = eph.states.where("body = 10").crossJoin(spark.range(1, 2000).select((F.col("id") * 1_000_000_007).alias("more"))).where("epoch_ns = 0").withColumn("epoch_ns", F.col("epoch_ns") + F.col("more")).drop("more")
    wide = Ephemeris(eph.states.unionByName(dense), eph.spins, eph.masses)
    widths, cells, levels = wide._lookup
    n = wide.spans().count()
    assert levels == 3 and cells.count() <= 3 * n and widths.count() <= 9
    assert cells.where("_b <> 10").groupBy("_b", "_bucket", "_cell").count().agg(F.max("count")).first()[0] <= 3
    ask = asked(spark, *[(b, t) for b in (10, 399, 301, 0, 7) for t in (-15 * DAY_NS, -15 * DAY_NS - 1, 0, 1_500_000_000, 15 * DAY_NS, 15 * DAY_NS + 1)])
    a, b = ({(r.body, r.epoch): (r.position, r.velocity) for r in e.states_at(ask).collect()} for e in (wide, eph))
    assert a.keys() == b.keys() and len(a) == 30 and a[7, 0] == (None, None) and a[301, 15 * DAY_NS + 1] == (None, None)
    for k in a:
        assert (a[k][0] is None) == (b[k][0] is None)
        assert a[k][0] is None or (np.allclose(a[k][0], b[k][0], atol=1e-6, rtol=0) and np.allclose(a[k][1], b[k][1], atol=1e-9, rtol=0))
    loop = Ephemeris(eph.states.where("body <> 10").unionByName(eph.states.where("body = 10").withColumn("centre", F.lit(301))), eph.spins, eph.masses)
    with pytest.raises(ValueError, match="barycentre"):
        loop.states_at(asked(spark, (10, 0)))


def test_chain_rows_are_carried_whole(spark, monkeypatch):
    """A level of a chain is one as-of join of the open rows themselves, with nothing to be joined back."""
    rows = spark.createDataFrame([(2, 1, 0, 1.0, 0), (3, 2, 0, 10.0, 1), (3, 1, 50, 100.0, 2)], "entity long, parent long, epoch_ns long, x double, row_seq long").withColumns({"y": F.lit(0.0), "z": F.lit(0.0), "quaternion": quat.vector(*quat.IDENTITY)})
    seen, real = [], X.asof_join
    monkeypatch.setattr(X, "asof_join", lambda left, *a, **k: seen.append(left.columns) or real(left, *a, **k))
    ask = spark.createDataFrame([(3, 10), (3, 60), (2, 60), (3, -1), (1, 5)], "frame long, epoch long")
    got = {(r.frame, r.epoch): (r.root, r.t and r.t[0], r.hops) for r in X.resolve(ask, rows, lambda c: c == 1).collect()}
    assert {k: v[:2] for k, v in got.items()} == {(3, 10): (1, 11.0), (3, 60): (1, 100.0), (2, 60): (1, 1.0), (3, -1): (None, None), (1, 5): (1, 0.0)}
    assert len(seen) == 2 and all({"frame", "m", "hops"} <= set(c) for c in seen)
