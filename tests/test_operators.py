import pytest
from pyspark.sql import functions as F

from wherewhen.functions import ident, vocab
from wherewhen.operators import asof, joins, state, timeline, topology, transform
from wherewhen.operators import rows as R

EARTH = -1


def obs(spark, rows):
    """(entity, parent, epoch, x[, estimate]) rows in stored order."""
    full = [(e, p, t, float(x), 0.0, 0.0, [1.0, 0.0, 0.0, 0.0], (more or [1])[0], i, 1) for i, (e, p, t, x, *more) in enumerate(rows)]
    return spark.createDataFrame(full, "entity long, parent long, epoch_ns long, x double, y double, z double, quaternion array<double>, estimate_type int, row_seq long, units_pos int")


def test_current_state_ties_and_cutoff(spark):
    df = obs(spark, [(1, EARTH, 100, 1, 3), (1, EARTH, 100, 2, 1), (1, EARTH, 100, 3, 1), (2, EARTH, 50, 4, 1), (3, EARTH, 99, 5, 1), (3, EARTH, 100, 6, 3)])
    rank = vocab.estimate_rank(F.col("estimate_type"))
    assert {r.entity: r.x for r in state.current_state(df, rank=rank, window_ns=10).collect()} == {1: 2.0, 3: 6.0}
    assert {r.entity: r.x for r in state.current_state(df, rank=rank, not_before=50).collect()} == {1: 2.0, 2: 4.0, 3: 6.0}
    ids = spark.createDataFrame([(2,)], "entity long")
    assert state.current_state(df, rank=rank, ids=ids, window_ns=10).collect() == []
    assert state.current_state(df.limit(0)).collect() == []


def test_asof_backfill_and_ties(spark):
    right = obs(spark, [(1, EARTH, 10, 10), (1, EARTH, 20, 20), (1, EARTH, 30, 30), (1, EARTH, 15, 15), (1, EARTH, 5, 5), (1, EARTH, 30, 99), (2, EARTH, 1, 7)])
    left = spark.createDataFrame([(1, 14), (1, 29), (1, 4), (1, 30), (3, 9), (2, 1000)], "k long, t long")
    expected = {(1, 14): 10.0, (1, 29): 20.0, (1, 4): None, (1, 30): 30.0, (3, 9): None, (2, 1000): 7.0}
    args = (left, right, "k", "entity", "t", "epoch_ns", {"x": "found"})
    for got in (asof.asof_join(*args), asof.asof_join(*args, bucket_ns=7), asof.asof_intervals(*args)):
        assert {(r.k, r.t): r.found for r in got.collect()} == expected
    first = {(r.k, r.t): r.found for r in asof.asof_or_first(*args).collect()}
    assert first == expected | {(1, 4): 5.0}


def test_topology_events(spark):
    df = obs(spark, [(1, 30, 300, 0), (1, 20, 200, 0), (1, 10, 100, 0), (1, 30, 400, 0)])
    log = topology.events(df)
    assert [(r.parent, r.epoch, r.old_parent) for r in log.orderBy("epoch").collect()] == [(10, 100, None), (20, 200, 10), (30, 300, 20)]
    assert [r.parent for r in topology.tree_at(log).collect()] == [30]
    assert topology.tree_at(log, 50).collect() == [] and topology.tree_at(log, 299).first().parent == 20
    known = spark.createDataFrame([(1, 10)], "child long, parent long")
    assert topology.events(df, known=known).count() == 2


def test_trim_and_merge(spark):
    log = spark.createDataFrame([(1, 10, 100, 0), (1, 20, 500, 1), (1, 30, 2000, 2), (2, 5, 100, 3), (2, 6, 100, 4)], "child long, parent long, epoch long, seq long")
    kept = topology.trim(log, 1000)
    assert sorted((r.child, r.parent) for r in kept.collect()) == [(1, 20), (1, 30), (2, 6)]
    assert topology.merge_log(log, log).count() == 0
    more = spark.createDataFrame([(1, 10, 100, 0), (9, 1, 7, 1), (9, 1, 7, 2)], "child long, parent long, epoch long, seq long")
    assert [(r.child, r.seq) for r in topology.merge_log(log, more).collect()] == [(9, 6)]


def test_cycles(spark):
    ok = spark.createDataFrame([(3, 2), (2, 1), (4, 2)], "child long, parent long")
    assert topology.require_acyclic(ok) is ok
    for edges in ([(1, 1)], [(1, 2), (2, 1), (3, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            topology.require_acyclic(spark.createDataFrame(edges, "child long, parent long"))


def test_rig_and_reparenting(spark):
    # facility on Earth at 1000, truck in it at 20, robot on the truck at 3; then the robot moves to Earth
    df = obs(spark, [(1, EARTH, 0, 1000), (2, 1, 0, 20), (3, 2, 0, 3), (3, EARTH, 1000, 500)])
    asked = spark.createDataFrame([(3, 999), (3, 1000), (2, 5), (7, 5), (EARTH, 5)], "frame long, epoch long")
    got = {(r.frame, r.epoch): (r.root, r.t[0] if r.t else None, r.hops) for r in transform.resolve(asked, df, topology.is_any(EARTH)).collect()}
    assert got[3, 999] == (EARTH, 1023.0, 3) and got[3, 1000] == (EARTH, 500.0, 1) and got[2, 5] == (EARTH, 1020.0, 2)
    assert got[7, 5][0] is None and got[EARTH, 5] == (EARTH, 0.0, 0)
    up = topology.ancestry(spark.createDataFrame([(3, 10)], "child long, epoch long"), topology.spans(topology.events(df)), topology.is_any(EARTH))
    assert [r.ancestor for r in up.orderBy("depth").collect()] == [3, 2, 1, EARTH]


def test_reexpress(spark):
    m = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0])], "frame_id long, epoch_ns long, t array<double>, q array<double>")
    df = spark.createDataFrame([(1, 0, [2000.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], 2, [1.0])], "frame_id long, epoch_ns long, position array<double>, quaternion array<double>, units_pos short, position_covariance array<double>")
    r = transform.reexpress(df, m, 1).first()
    assert [round(x, 9) for x in r.position] == [-1.0, 0.0, 0.0] and r.units_pos == 1 and r.position_covariance is None
    with pytest.raises(Exception, match="no motion"):
        transform.reexpress(df.withColumn("epoch_ns", F.lit(5).cast("long")), m, 1).collect()


def test_interpolation(spark):
    df = obs(spark, [(1, EARTH, 0, 0), (1, EARTH, 1000, 10), (1, 9, 2000, 50)])
    grid = spark.createDataFrame([(1, t) for t in (-5, 500, 1500, 2000, 9999)], "entity long, t long")
    got = {r.t: (r.x, r.frame, r.cross_frame, r.alpha) for r in timeline.interpolate(grid, df).collect()}
    assert got == {-5: (0.0, EARTH, False, 0.0), 500: (5.0, EARTH, False, 0.5), 1500: (10.0, EARTH, True, 0.5), 2000: (50.0, 9, False, 0.0), 9999: (50.0, 9, False, 0.0)}


def test_gaps_crossings_and_shapes(spark):
    df = obs(spark, [(1, EARTH, t, x) for t, x in ((0, -1), (10, 1), (20, -1), (30, 1), (100, 2))])
    assert timeline.first_run(df, 10).first()[1:] == (30, 4)
    assert timeline.nodal_period(df, "x").first()[1:] == (20.0, 2)
    assert timeline.monotone(df, "x").first()[1:] == (False, 1)
    ring = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 1), (0, 1)])], "k long, i int, x double, y double")
    assert timeline.polygon_area(ring, "k", "i", "x", "y").first().area == 2.0
    assert [(r.x, r.y) for r in timeline.resample(ring, "k", "i", "x", "y", 1.5).orderBy("i").collect()] == [(0.0, 0.0), (1.5, 0.0), (2.0, 1.0), (0.5, 1.0)]
    circle = obs(spark, [(1, EARTH, 0, 1), (1, EARTH, 1, -1)])
    assert timeline.guide_line(circle).first()["shape"] == "circle"


def test_spatial_filters_keep_boundary_and_nan(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (3.0, 4.0, 0.0), (10.0, 0.0, 0.0), (float("nan"), 0.0, 0.0)], "x double, y double, z double")
    assert df.where(R.in_sphere(F.col("x"), F.col("y"), F.col("z"), (0, 0, 0), 5)).count() == 3
    with pytest.raises(ValueError, match="mixed frames"):
        R.require_one_frame(df, F.col("x"))


def test_joins(spark):
    pts = spark.createDataFrame([(1, float(x), float(y)) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)]], "k long, x double, y double")
    assert [(r.x, r.y) for r in joins.convex_hulls(pts, "k").orderBy("i").collect()] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    pairs = spark.createDataFrame([(1, "a", "x", 3.0), (1, "a", "y", 1.0), (1, "b", "y", 2.0), (1, "b", "x", 9.0)], "g long, l string, r string, c double")
    assert sorted((r.l, r.r) for r in joins.assign_greedily(pairs, "g", "l", "r", "c").collect()) == [("a", "y"), ("b", "x")]
    # the line is x = 0 from (0, -5) to (0, 5): boat 1 starts late, rounds both legs and finishes; boat 2 is over at the gun
    boats = obs(spark, [(1, EARTH, t, x) for t, x in ((0, -10), (10, -10), (20, 10), (30, 100), (40, 50), (50, 10), (60, -10))] + [(2, EARTH, 5, 1), (2, EARTH, 10, 2), (2, EARTH, 40, 100)])
    got = {r.entity: (r.early, r.leg, r.started, r.finished, list(r.rounded)) for r in joins.race(boats, ((0, -5), (0, 5)), [[(100, 0)], [(50, 3), (50, -3)]], 4, 10).collect()}
    assert got[1] == (False, 2, 15.0, 55.0, [30.0, 40.0])
    assert got[2][:2] == (True, -1) and got[2][4] == []
    assert joins.same_rows(pts, pts.orderBy("x")) and not joins.same_rows(pts, pts.limit(3))
    merged = joins.merge_parts([pts.withColumn("entity", F.lit(1)), pts.withColumn("entity", F.col("x").cast("int"))])
    assert merged.where("entity = 1").count() == 6


def test_validation(spark):
    good = ident.mint_entity(F.lit("a"), F.lit("b"))
    vec = lambda n: F.array(*[F.lit(0.0)] * n)
    row = {"frame_id": F.lit(bytearray(ident.frame_bytes("Earth"))), "units_pos": F.lit(1).cast("short"), "timescale_id": F.lit(5).cast("short"), "source_id": good, "estimate_type": F.lit(1).cast("short"), "position": vec(3), "quaternion": vec(4), "duration_centuries": F.lit(0).cast("short"), "duration_ns": F.lit(5_000_000_000), "position_covariance": F.lit(None).cast("array<double>"), "orientation_covariance": F.lit(None).cast("array<double>")}
    flat = spark.range(1).select(*[c.alias(k) for k, c in row.items()])
    R.check_schema(flat.schema)
    R.validate(flat)
    deep = flat.select(F.struct(*flat.columns).alias(R.STRUCT))
    for df in (flat, deep):
        out = R.normalize_tai(df)
        got = out.select(R.field(out, "duration_ns").alias("n"), R.field(out, "timescale_id").alias("s")).first()
        assert tuple(got) == (37_000_000_000, 1)
    for bad in ({"units_pos": F.lit(0).cast("short")}, {"estimate_type": F.lit(4).cast("short")}, {"frame_id": ident.mint_abstract(F.lit("a"), F.lit("b"))}, {"frame_id": F.unhex(F.lit("00" * 16))}, {"position": F.lit(None).cast("array<double>")}):
        with pytest.raises(ValueError, match="rejected"):
            R.validate(flat.withColumns(bad))
    with pytest.raises(ValueError, match="missing"):
        R.check_schema(flat.drop("position").schema)
    with pytest.raises(TypeError):
        R.check_schema(flat.select(F.lit(1).alias(R.STRUCT)).schema)


def test_places_of_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    expected = {(g, k): i + 1 for i, (g, k) in enumerate(sorted((i % 3, i * 7919 % 5000) for i in range(5000)))}
    got = R.placed(df, "g", "k").collect()
    assert len(got) == 5000 and {(r.g, r.k): r.place for r in got} == expected
    assert R.placed(df.limit(0), "g", "k").collect() == []


def test_sort_by_epoch_keeps_every_row(spark):
    from wherewhen.plans.queries import QUERIES

    n = spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()
    places = [r.place for r in QUERIES["sort_by_epoch"](spark, "/root/testdata/sf0.01").select("place").collect()]
    assert n > 1000 and sorted(places) == list(range(1, n + 1))


def test_cycle_check_finds_nodes_below_the_cycle(spark):
    from wherewhen.plans.queries import QUERIES

    found = {r.child for r in QUERIES["cycle_check"](spark, "/root/testdata/sf0.001").collect()}
    assert {0, 1, 2} < found and max(found) > 2


def test_nearest_matches_all_pairs(spark):
    import random

    rnd = random.Random(3)
    spots = [(i, rnd.choice([0.0, rnd.uniform(0, 10), rnd.uniform(0, 1000)]), rnd.uniform(0, 50), i % 3) for i in range(120)]
    rows = [(i, rnd.uniform(-500, 2000), rnd.uniform(0, 50), i % 4) for i in range(150)] + [(900, None, 1.0, 0), (901, 1e7, 1.0, 0)]
    places = spark.createDataFrame(spots + [(777, None, 0.0, 1)], "p long, x double, y double, g long")
    df = spark.createDataFrame(rows, "i long, x double, y double, g long")
    for by in ((), ("g",)):
        want = {}
        for i, x, y, g in rows:
            near = [((x - a) ** 2 + (y - b) ** 2) ** 0.5 for _, a, b, h in spots if x is not None and (not by or g == h)]
            want[i] = min(near, default=None)
        found = [joins.nearest(df, places, ("x", "y"), ("p",), by, cell=c).collect() for c in (None, 7.0)]
        assert sorted(found[0], key=str) == sorted(found[1], key=str)  # a handful of places in the plan, or all in cells
        got = {r.i: r.distance for r in found[0]}
        assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    assert [r.distance for r in joins.nearest(df.limit(2), places.limit(0), ("x", "y")).collect()] == [None, None]


def test_fire_replay(spark):
    first = ["a", "b", "c"]
    track = [("a", 0.0, 0.0), ("b", 10.0, 0.0), ("c", 0.0, 10.0)]
    rows = [("f", n, t, x, y) for n, x, y in track for t in (0, 60, 120)] + [("f", "d", 60, 5.0, 0.0), ("f", "d", 120, 5.0, -1.0), ("f", "e", 120, 5.0, 5.0)]
    rows = [r for r in rows if not (r[1] == "b" and r[2] == 120)] + [("f", "b", 240, 10.0, 0.0)]  # b stops moving after 60
    df = spark.createDataFrame(rows, "fire string, name string, t_s long, x double, y double")
    asked = spark.createDataFrame([("f", 30), ("f", 60), ("f", 130)], "fire string, t long")
    got = joins.fire_replay(df, asked, first, 60).orderBy("t", "place").collect()
    ring = {t: [r.name for r in got if r.t == t] for t in (30, 60, 130)}
    assert ring == {30: ["a", "b", "c"], 60: ["a", "d", "b", "c"], 130: ["a", "d", "b", "e", "c"]}
    at = {(r.t, r.name): r for r in got}
    assert at[130, "d"].y == -1.0 and at[30, "b"].moving and not at[60, "b"].moving


def test_merge_checks_and_clips(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "entity long, x double")
    assert joins.merge_parts([a, a.where("entity = 1").unionByName(spark.createDataFrame([(3, 3.0)], a.schema))], check=["x"]).count() == 3
    with pytest.raises(ValueError, match="differ"):
        joins.merge_parts([a, a.withColumn("x", F.col("x") + 1)], check=["x"])
    seg = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, 5)], "id long, ax double, ay double, bx double, by double, born long")
    walls = spark.createDataFrame([(7, 6.0, -1.0, 6.0, 1.0, 1), (8, 4.0, -1.0, 4.0, 1.0, 2), (9, 2.0, -1.0, 2.0, 1.0, 9)], seg.schema)
    assert [tuple(r) for r in joins.clipped(seg, walls, 3.0).collect()] == [(1, 4.0, 0.0)]
    with pytest.raises(ValueError, match="named"):
        R.named_like(a.withColumn("n", F.lit("abc")), "n", ["B", "zz"], strict=True)
    assert R.named_like(a.withColumn("n", F.lit("abc")), "n", ["B"], strict=True).count() == 2


def test_as_of_keeps_nulls(spark):
    left = spark.createDataFrame([(1, 10)], "k long, t long")
    right = spark.createDataFrame([(1, 1, "old", 0), (1, 5, None, 1)], "e long, t2 long, v string, row_seq long")
    assert asof.asof_or_first(left, right, "k", "e", "t", "t2", {"v": "w"}).first().w is None


def test_nearest_in_groups_of_any_size(spark, monkeypatch, tmp_path):
    """Groups of few places are asked as one list each: no round of cells writes their rows anew; larger ones go by cells, with the same result."""
    from wherewhen.plans import tables

    rows = [(i, float(i * 37 % 101), float(i * 53 % 97), i % 40 if i % 5 else 1000, i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, x double, y double, g long, e long")
    want = {i: min((((x - a) ** 2 + (y - b) ** 2) ** 0.5 for _, a, b, h, o in rows if h == g and o != e), default=None) for i, x, y, g, e in rows}
    written, settled = [], tables.settled
    monkeypatch.setattr(tables, "settled", lambda d, name: written.append(name) or settled(d, name))
    for few in (256, 50, 1):
        monkeypatch.setattr(joins, "FEW_IN_GROUP", few)
        written.clear()
        got = {r.i: r.distance for r in joins.nearest_moving(df, "e", ("g",)).select("i", "distance").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert few != 256 or written.count("nearest") == 1
