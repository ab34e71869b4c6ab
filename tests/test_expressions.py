import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherewhen.functions import fields, geo, ident, orbits, quat, timeconv, vocab


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_frozen_ids(spark):
    h = lambda c: F.lower(F.hex(c))
    got = one(
        spark,
        h(ident.mint_entity(F.lit("acme.com"), F.lit("truck_A"))), h(ident.mint_entity(F.lit("ACME.com"), F.lit("cam"))), h(ident.mint_abstract(F.lit("acme.com"), F.lit("pipeline_v3"))),
        h(ident.astro_id(F.lit(0), F.lit(1))), h(ident.astro_id(F.lit(399), F.lit(399))), h(ident.astro_id(F.lit(399), F.lit(1))), h(ident.astro_id(F.lit(606), F.lit(1))),
    )
    assert got == (
        "70591c8b9b2b81edb6314748930a1713", "f5d55ca2261a81a0965c1100b928f306", "6af4052e183f82d2b617092fb6da6fa5",
        "00000000000080008000000001000000", "0000018f00008000800000018f000000", "0000018f000080008000000001000000", "0000025e000080008000000001000000",
    )
    assert ident.frame_bytes("IAU_EARTH") == ident.frame_bytes("Earth") and len(ident.FRAMES) == 64


def test_ids_that_are_refused(spark):
    m = ident.mint_entity
    assert one(spark, m(F.lit(""), F.lit("x")), m(F.lit("a"), F.lit("")), m(F.lit("a\0"), F.lit("x")), ident.astro_id(F.lit(5), F.lit(77))) == (None,) * 4
    truck = m(F.lit("acme.com"), F.lit("truck_A"))
    text = ident.hyphenated(truck)
    assert one(spark, text, ident.parse_hex(text) == truck, ident.is_valid(truck), ident.kind(truck), ident.is_valid(F.unhex(F.lit("00" * 16))), ident.parse_hex(F.lit("xyz"))) == ("70591c8b-9b2b-81ed-b631-4748930a1713", True, True, 1, False, None)
    e, o = ident.astro_frame(ident.astro_id(F.lit(606), F.lit(1)))
    assert one(spark, e, o, ident.default_centre(F.lit(606)), ident.default_centre(F.lit(399)), ident.default_centre(F.lit(10))) == (606, 1, 699, 10, None)


def test_labels(spark):
    truck = ident.mint_entity(F.lit("acme.com"), F.lit("truck_A"))
    rows = spark.range(3).select(F.when(F.col("id") == 0, F.lit(bytearray(ident.frame_bytes("Earth")))).when(F.col("id") == 1, truck).otherwise(ident.mint_entity(F.lit("a"), F.lit("b"))).alias("x"))
    names = spark.range(1).select(truck.alias("prescribed_id"), F.lit("truck_A").alias("common_name"))
    got = [r.label for r in ident.label(rows, "x", names).orderBy(F.length("label")).collect()]
    assert got[:2] == ["Earth", "truck_A"] and len(got[2]) == 36


def test_units(spark):
    assert one(spark, vocab.to_km(F.lit(2000.0), F.lit(2)), vocab.convert(F.lit(0.1), F.lit(2), F.lit(2)), vocab.from_km(F.lit(1.852), F.lit(9)), vocab.decode(F.lit(0)), vocab.decode(F.lit(10)), vocab.encode(F.lit("nmi"))) == (2.0, 0.1, 1.0, None, None, 9)


def test_epochs(spark):
    c, ns = timeconv.parts(F.lit(-1))
    assert one(spark, c, ns) == (-1, timeconv.CENTURY_NS - 1)
    t = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    tai = timeconv.tai_ns_of(t)
    assert one(spark, F.unix_micros(timeconv.utc_of(tai)) == F.unix_micros(t), timeconv.format_tai(F.lit(1_500_000)), timeconv.ticket_seconds(F.lit(0)), timeconv.to_tai(F.lit(0), F.lit(2)), timeconv.to_tai(F.lit(0), F.lit(10))) == (True, "2000-01-01T12:00:00.001", 3155716800.0, -32184000000, None)
    wide = timeconv.wide_ns(F.lit(30000).cast("smallint"), F.lit(5))
    assert int(one(spark, wide)[0]) == 30000 * timeconv.CENTURY_NS + 5


def test_quaternions(spark):
    q = quat.yaw(F.radians(F.lit(90.0)))
    p = quat.rotate(q, quat.vector(1, 0, 0))
    m = quat.compose(quat.motion(quat.vector(1, 0, 0), q), quat.motion(quat.vector(0, 2, 0), q))
    half = quat.slerp(quat.vector(1, 0, 0, 0), quat.vector(0, 0, 0, 1), F.lit(0.5))
    back = quat.from_matrix(quat.matrix(quat.vector(0.5, 0.5, -0.5, 0.5)))
    p, t, mq, half, back, h = one(spark, p, m["t"], m["q"], half, back, F.degrees(quat.heading(q)))
    assert np.allclose(p, [0, 1, 0]) and np.allclose(t, [-1, 0, 0]) and np.allclose(mq, [0, 0, 0, 1])
    assert np.allclose(half, [math.sqrt(0.5), 0, 0, math.sqrt(0.5)]) and np.allclose(back, [0.5, 0.5, -0.5, 0.5]) and abs(h - 90) < 1e-9


def test_geodesy(spark):
    x, y, z = geo.geodetic_to_fixed(F.lit(47.5), F.lit(-122.3), F.lit(1.25))
    df = spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, h = df.select(*geo.fixed_to_geodetic(F.col("x"), F.col("y"), F.col("z"))).first()
    assert abs(lat - 47.5) < 1e-9 and abs(lon + 122.3) < 1e-9 and abs(h - 1.25) < 1e-6
    la, lo = geo.along_great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.5))
    assert np.allclose(one(spark, la, lo, geo.wrap180(F.lit(190.0)), geo.bearing_deg(F.lit(1.0), F.lit(0.0))), (0, 45, -170, 90))
    assert one(spark, geo.hermite(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(1.0))) == (0.5,)
    # a body on the plane at that node and argument stands in the direction again
    for up in (True, False):
        node, u = one(spark, *geo.plane_through(quat.vector(1, 0.2, 0.3), 63.0, up))
        i, node, u = math.radians(63), math.radians(node), math.radians(u)
        p = [math.cos(node) * math.cos(u) - math.sin(node) * math.sin(u) * math.cos(i), math.sin(node) * math.cos(u) + math.cos(node) * math.sin(u) * math.cos(i), math.sin(u) * math.sin(i)]
        assert np.allclose(p, np.array([1, 0.2, 0.3]) / np.linalg.norm([1, 0.2, 0.3])) and (math.cos(u) > 0) == up
    along, side, down = one(spark, *geo.lvlh(quat.vector(0.1, 0, 1), quat.vector(7000, 0, 0)))
    assert np.allclose([along, side, down], [[0, 1, 0], [0, 0, -1], [-1, 0, 0]])
    axes = geo.vehicle_axes(F.lit(0.0), F.lit(0.0), F.radians(F.lit(90.0)), F.lit(0.0))
    assert np.allclose(one(spark, *[c for v in axes for c in v]), [0, 1, 0, 0, 0, -1, -1, 0, 0], atol=1e-12)


def test_orbits(spark):
    mu = 398600.4418
    r, v = orbits.kepler_state(*(np.array([x]) for x in (8000.0, 0.2, 0.7, 1.1, 2.0, 0.9)), np.array([mu]))
    e = orbits.elements(quat.vector(*r[0]), quat.vector(*v[0]), F.lit(mu))
    got = one(spark, *[e[k] for k in ("sma_km", "ecc", "inc_deg", "raan_deg", "aop_deg", "period_s")])
    assert np.allclose(got, (8000, 0.2, math.degrees(0.7), math.degrees(1.1), math.degrees(2.0), 2 * math.pi * math.sqrt(8000**3 / mu)))
    assert one(spark, orbits.elements(quat.vector(7000, 0, 0), quat.vector(0, 20, 0), F.lit(mu))["ecc"]) == (None,)
    r2, v2 = orbits.propagate(r[0], v[0], 1500.0, mu)
    n = math.sqrt(mu / 8000**3)
    r3, _ = orbits.kepler_state(*(np.array([x]) for x in (8000.0, 0.2, 0.7, 1.1, 2.0, 0.9 + n * 1500)), np.array([mu]))
    assert np.allclose(r2, r3[0], atol=1e-6)
    v1, vb = orbits.lambert(r[0], r2, 1500.0, mu, np.cross(r[0], v[0]))
    assert np.allclose(v1, v[0], atol=1e-6) and np.allclose(vb, v2, atol=1e-6)
    tip = orbits.forward(np.array([[0.0, math.pi / 2]]), [(0, 1.0, 0), (0, 2.0, 0)])[0]
    assert np.allclose(tip[:3, 3], [1, 2, 0])


@pytest.mark.parametrize("bits, expected", [(0, 0.5), (1, -1.0)])
def test_segment_distance(spark, bits, expected):
    d = geo.segment_distance(F.lit(0.5), F.lit(0.5), *[F.lit(float(v)) for v in ((0, 0, 1, 0) if bits == 0 else (0, 0.5, 1, 0.5))])
    assert abs(one(spark, d)[0] - max(expected, 0)) < 1e-12


def test_fields(spark):
    b = lambda a: fields.boat_speed(F.lit(a), F.lit(10.0), 40, 0.5, 0.8, 7)
    field = fields.WindField(350, 5, shift_deg=20, shift_period_s=14400, build_per_h=1, begin=0, end=7200)
    d, w = field.direction(F.lit(3600.0)), field.strength(F.lit(3600.0))
    u, v = fields.WindField(0, 3).vector(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    head = fields.head_rate(F.lit(1.0), F.lit(4.0), 6, 0.5)
    ahead, behind, calm = (fields.spread_rate(head, F.lit(x), F.lit(180.0), F.lit(0.0), F.lit(y), 0.3) for x, y in ((4.0, 1.0), (4.0, -1.0), (0.0, 1.0)))
    puffy = fields.WindField(0, 2, begin=0, end=100, extent=(-1e6, 1e6, -50, 50), puff_starts=[(0, 40), (1e5, 0)], puff_radius_m=50, puff_gain=0.4)
    g = puffy.boost(F.lit(0.0), F.lit(0.0), F.lit(20.0))  # after 20 s at 2 m/s to the south the first is here
    ((_, wrapped),) = fields.WindField(0, 2, extent=(0, 1, -50, 50), puff_starts=[(0, -40)]).puffs(F.lit(20.0))
    assert np.allclose(one(spark, wrapped), 20)
    kind = fields.fuel_class([("river", F.lit(1) > 2), ("slash", F.lit(2) > 1), ("corridor", F.lit(2) > 1)], "conifer")
    assert one(spark, kind, fields.fuel_factor(kind, {"slash": 1.5, "conifer": 1.0}), fields.fuel_factor(F.lit("x"), {"slash": 1.5})) == ("slash", 1.5, None)
    got = one(spark, b(39.0), b(-110.0), b(40.0), d, w, u, v, head, ahead, calm, g)
    assert np.allclose(got, (0, 7, 4, 10, 6, 0, -3, 0.3, 0.3, 0.3, 1.4), atol=1e-12)
    e = math.sqrt(1 - 1 / 2.2**2)
    assert abs(one(spark, behind)[0] - 0.3 * (1 - e) / (1 + e)) < 1e-12
