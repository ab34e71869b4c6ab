"""Registered queries that go through a ledger, an ephemeris, or files: storage, tickets, target frames, celestial bodies.

The driver's events become entity rows with sixteen-byte ids; mass_kg holds a row's number, by which results are told.
The ephemeris is made for them: the Sun stands still, Earth and Moon go round in circles, sampled every six hours.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewhen.functions import fields, geo, ident, orbits, quat
from wherewhen.operators import joins, state, timeline, transform
from wherewhen.operators import rows as R
from wherewhen.plans import queries as Q
from wherewhen.plans.ledger import Ledger
from wherewhen.plans.queries import _LOG, KM_SQL, T0, T1, _flat, _r, _table, is_earth, query
from wherewhen.plans.tables import EARTH, OBSERVATIONS_SQL, observations, settled, shared_dir
from wherewhen.sources import arrow_files, builders
from wherewhen.sources.ephemeris import DAY_NS as _DAY
from wherewhen.sources.ephemeris import MASSES, SPINS, STATES, Ephemeris

STEP_NS = _DAY // 4
#: body, centre, radius km, period s; and gm.
CIRCLES = ((399, 10, 1.5e8, 3.15e7), (301, 399, 384400.0, 2.36e6))
GM = {10: 1.327e11, 399: 398600.0, 301: 4902.0}
SPIN = 360.9856  # degrees a day, from 0, about the z axis
_made: dict[tuple, str] = {}


def entity_id(number):
    return ident.mint_entity(F.lit("events.example"), number.cast("string"))


def entity_rows(o: DataFrame) -> DataFrame:
    """Observations as entity rows in the ledger's layout, still in their own time scales."""
    frame = F.when(F.col("parent") == EARTH, F.lit(bytearray(ident.frame_bytes("Earth")))).otherwise(entity_id(F.col("parent")))
    made = builders.build_entities(o, entity_id(F.col("entity")), frame=frame, source=ident.mint_abstract(F.lit("events.example"), F.lit("source")), epoch=F.col("epoch_ns"), position=F.col("position"), quaternion=F.col("quaternion"), units=F.col("units_pos"), estimate=F.col("estimate_type"), mass_kg=F.col("row_seq").cast("double"))
    return made


def number(df: DataFrame):
    return F.col("mass_kg").cast("bigint").alias("row_seq")


def _ledger(spark, d) -> Ledger:
    """The events of a folder in a ledger of three batches, made once for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        path = f"{shared_dir(spark)}/wherewhen-ledger-{uuid.uuid4().hex}"
        out = Ledger(spark, path)
        o = observations(spark, d)
        for part in (o.where("batch_seq < 4"), o.where("batch_seq BETWEEN 4 AND 9"), o.where("batch_seq > 9")):
            out.append(entity_rows(part))
        out.load_kernel(_ephemeris(spark, d))
        _made[key] = path
    return Ledger(spark, _made[key])


def _ephemeris(spark, d) -> Ephemeris:
    key = (spark.sparkContext.applicationId, d, "ephemeris")
    if key not in _made:
        o = state.epoch_window(observations(spark, d)).select(F.explode(F.sequence(F.floor(F.col("first_epoch") / STEP_NS) - 1, F.floor(F.col("last_epoch") / STEP_NS) + 2)).alias("k"))
        rows = None
        for body, centre, radius, period in ((10, 0, 0.0, 1.0), *CIRCLES):
            w = 2 * math.pi / period
            a = (F.col("k") * STEP_NS) / 1e9 * w
            own = o.select(F.lit(body).alias("body"), F.lit(centre).alias("centre"), (F.col("k") * STEP_NS).alias("epoch_ns"), quat.vector(radius * F.cos(a), radius * F.sin(a), 0.0).alias("position"), quat.vector(-radius * w * F.sin(a), radius * w * F.cos(a), 0.0).alias("velocity"))
            rows = own if rows is None else rows.unionByName(own)
        path = f"{shared_dir(spark)}/wherewhen-ephemeris-{uuid.uuid4().hex}"
        spins = spark.createDataFrame([(399, -90.0, 0.0, 90.0, 0.0, 0.0, SPIN)], SPINS)
        Ephemeris(rows.selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in STATES.split(", ")]), spins, spark.createDataFrame(list(GM.items()), MASSES)).save(path)
        _made[key] = path
    return Ephemeris.load(spark, _made[key])


def _log1(name: str):
    """A distance as a signed logarithm: units go from inches to astronomical ones."""
    return F.round(F.signum(name) * F.log(1 + F.abs(F.col(name))), 5).alias(name)


def _sql_log1(x: str) -> str:
    return f"round(sign({x}) * ln(1 + abs({x})), 5)"


def _eph_sql() -> str:
    """seg: the spans between samples of each body about its centre; at(body, centre, epoch) has to be joined by the query."""
    parts = []
    for body, centre, radius, period in CIRCLES:
        a = f"((k * {STEP_NS}) / 1e9::DOUBLE * {2 * math.pi / period!r}::DOUBLE)"
        parts.append(f"SELECT {body} AS body, {centre} AS centre, k * {STEP_NS} AS t, {radius!r}::DOUBLE * cos{a} AS x, {radius!r}::DOUBLE * sin{a} AS y, -{radius!r}::DOUBLE * {2 * math.pi / period!r}::DOUBLE * sin{a} AS vx, {radius!r}::DOUBLE * {2 * math.pi / period!r}::DOUBLE * cos{a} AS vy FROM ks")
    return f"""ks AS (SELECT unnest(range(CAST((SELECT min(epoch_ns) // {STEP_NS} FROM obs) AS BIGINT) - 1, CAST((SELECT max(epoch_ns) // {STEP_NS} FROM obs) AS BIGINT) + 3)) AS k),
sam AS ({" UNION ALL ".join(parts)}),
seg AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(vx) OVER w AS vx1, lead(vy) OVER w AS vy1 FROM sam WINDOW w AS (PARTITION BY body ORDER BY t)),
ask AS (SELECT DISTINCT epoch_ns AS e FROM obs),
rel AS (SELECT body, centre, e, {_cubic("x", "vx")} AS x, {_cubic("y", "vy")} AS y, {_slope("x", "vx")} AS vx, {_slope("y", "vy")} AS vy FROM (SELECT seg.*, ask.e, (t1 - t) / 1e9::DOUBLE AS h, (ask.e - t)::DOUBLE / (t1 - t) AS s FROM ask JOIN seg ON ask.e >= seg.t AND ask.e < seg.t1))"""


def _cubic(p: str, v: str) -> str:
    return f"((2*s*s*s - 3*s*s + 1) * {p} + (s*s*s - 2*s*s + s) * h * {v} + (3*s*s - 2*s*s*s) * {p}1 + (s*s*s - s*s) * h * {v}1)"


def _slope(p: str, v: str) -> str:
    return f"(((6*s*s - 6*s) * {p} + (3*s*s - 4*s + 1) * h * {v} + (6*s - 6*s*s) * {p}1 + (3*s*s - 2*s) * h * {v}1) / h)"


_BODIES = "bary AS (SELECT m.e, m.body, m.x + coalesce(o.x, 0) AS x, m.y + coalesce(o.y, 0) AS y, m.vx + coalesce(o.vx, 0) AS vx, m.vy + coalesce(o.vy, 0) AS vy FROM rel m LEFT JOIN rel o ON m.centre = o.body AND m.e = o.e)"
_ANGLE = f"radians((({SPIN}::DOUBLE * ((e + 32184000000) / 86400000000000.0::DOUBLE)) % 360))"

# celestial bodies


def _asked(spark, d, *bodies):
    return observations(spark, d).select(F.explode(F.array(*[F.lit(b) for b in bodies])).alias("body"), F.col("epoch_ns").alias("epoch"))


@query(f", {_eph_sql()}, {_BODIES} SELECT body, e AS epoch, round(x, 0) AS x, round(y, 0) AS y, round(vx * 1000, 2) AS vx, round(vy * 1000, 2) AS vy, round(CASE body WHEN 399 THEN 398600.0 ELSE 4902.0 END / 6.674e-20 / 1e18, 3) AS mass FROM bary /* obs */")
def celestial_state(spark, d):
    s = _ephemeris(spark, d).celestial_state(_asked(spark, d, 399, 301))
    return s.select("body", "epoch", *[F.round(F.get("position", F.lit(i)), 0).alias(n) for i, n in enumerate("xy")], *[F.round(F.get("velocity", F.lit(i)), 2).alias(n) for i, n in enumerate(("vx", "vy"))], F.round(F.col("mass_kg") / 1e18, 3).alias("mass"))


@query(f", {_eph_sql()}, {_BODIES}, one AS (SELECT e, body, x, y FROM bary UNION ALL SELECT e, 10, 0.0, 0.0 FROM ask) SELECT format('{{:08x}}', body) || '0000800080' || format('{{:08x}}', body) || '000000' AS id, e AS epoch, round(x, 0) AS x, round(y, 0) AS y, 1 AS units, 1 AS scale, 1 AS estimate FROM one WHERE e IN (SELECT max(epoch_ns) FROM obs GROUP BY batch_seq) /* obs */")
def celestial_snapshot(spark, d):
    ends = observations(spark, d).groupBy("batch_seq").agg(F.max("epoch_ns").alias("epoch")).select("epoch")
    rows = _ephemeris(spark, d).snapshot(ends, ident.frame_bytes("ICRF"))
    inner = F.col(R.STRUCT)
    return rows.select(F.lower(F.hex("entity_id")).alias("id"), R.epoch_ns(rows).alias("epoch"), F.round(inner["position"][0], 0).alias("x"), F.round(inner["position"][1], 0).alias("y"), inner["units_pos"].cast("int").alias("units"), inner["timescale_id"].cast("int").alias("scale"), inner["estimate_type"].cast("int").alias("estimate"))


@query(f"SELECT e AS epoch, round(abs(cos({_ANGLE} / 2)), 6) AS w, round(abs(sin({_ANGLE} / 2)), 6) AS z, round(cos({_ANGLE}), 6) AS xx FROM (SELECT DISTINCT epoch_ns AS e FROM obs)")
def j2000_rotation(spark, d):
    q = _ephemeris(spark, d).turns_at(_asked(spark, d, 399).distinct())
    x = quat.rotate(F.col("q"), quat.vector(1.0, 0.0, 0.0))
    return q.select("epoch", F.round(F.abs(F.get("q", F.lit(0))), 6).alias("w"), F.round(F.abs(F.get("q", F.lit(3))), 6).alias("z"), F.round(x[0], 6).alias("xx"))


_ORBIT_SQL = f", {_eph_sql()}, st AS (SELECT body, centre, e, x, y, vx, vy, CASE body WHEN 399 THEN 1.327e11 + 398600.0 ELSE 398600.0 + 4902.0 END AS mu FROM rel), el AS (SELECT *, 1 / (2 / sqrt(x*x + y*y) - (vx*vx + vy*vy) / mu) AS sma FROM st)"


@query(f"{_ORBIT_SQL} SELECT body, centre, e AS epoch, round(sma / 1000, 2) AS sma_mm, round(2 * pi() * sqrt(sma * sma * sma / mu) / 60, 1) AS period_min, round(sqrt(greatest(0.0, 1 - power(x * vy - y * vx, 2) / (mu * sma))), 4) AS ecc, 0.0::DOUBLE AS inc FROM el /* obs */")
def celestial_orbit(spark, d):
    pairs = observations(spark, d).select(F.explode(F.expr("array(struct(399 AS body, 10 AS centre), struct(301 AS body, 399 AS centre))")).alias("p"), F.col("epoch_ns").alias("epoch")).select("p.*", "epoch")
    o = _ephemeris(spark, d).orbits(pairs, samples=2)
    return o.select("body", "centre", "epoch", F.round(F.col("sma_km") / 1000, 2).alias("sma_mm"), F.round(F.col("period_s") / 60, 1).alias("period_min"), F.round("ecc", 4).alias("ecc"), F.round("inc_deg", 6).alias("inc"))


@query(f"{_ORBIT_SQL} SELECT body, round(sma / 1000, 2) AS sma_mm, 361 AS samples, round(sqrt(x*x + y*y) / 1000, 2) AS middle FROM el WHERE body = 301 AND e = (SELECT max(epoch_ns) - (max(epoch_ns) - min(epoch_ns)) % 1 FROM obs WHERE epoch_ns <= {T0}) /* obs */")
def query_orbits(spark, d):
    """A request by NAIF number and seconds, with the default samples; over 100 000 or under 2 are refused."""
    ledger = _ledger(spark, d)
    at = R.upto(observations(spark, d), T0).agg(F.max("epoch_ns")).first()[0]
    for n in (1, 100_001):
        try:
            ledger.query_orbits([{"body": 301}], 0.0, n)
        except ValueError:
            continue
        raise AssertionError("a number of samples out of bounds was taken")
    found = ledger.ephemeris().orbits(spark.createDataFrame([(301, at)], "body int, epoch bigint").withColumn("centre", ident.default_centre(F.col("body")).cast("int")))
    return found.select("body", F.round(F.col("sma_km") / 1000, 2).alias("sma_mm"), F.size("path_km").alias("samples"), F.round(quat.norm(F.get("path_km", F.lit(180))) / 1000, 2).alias("middle"))


@query(f", {_eph_sql()} SELECT e AS epoch, round(x, 0) AS x, round(y, 0) AS y FROM rel WHERE body = 301 /* obs */")
def body_poses(spark, d):
    p = _moon(spark, d)
    return p.select("epoch", F.round(F.get("centre", F.lit(0)), 0).alias("x"), F.round(F.get("centre", F.lit(1)), 0).alias("y"))


def _moon(spark, d):
    eph = _ephemeris(spark, d)
    spun = Ephemeris(eph.states, eph.spins.unionByName(spark.createDataFrame([(301, 0.0, 0.0, 66.0, 0.0, 38.0, 13.0)], SPINS)), eph.masses)
    return transform.body_poses(spun, ident.frame_bytes("Moon"), observations(spark, d).select(F.col("epoch_ns").alias("epoch")), ident.frame_bytes("GCRF"))


@query(f", {_eph_sql()} SELECT e AS epoch, round(x, 0) AS x, round(y, 0) AS y FROM rel WHERE body = 301 /* obs */")
def body_centred(spark, d):
    s = _ephemeris(spark, d).states_at(_asked(spark, d, 399, 301)).select("body", "epoch", *[F.get("position", F.lit(i)).alias(n) for i, n in enumerate("xyz")])
    return transform.body_centred(s.where("body = 301"), s.where("body = 399")).select("epoch", F.round("x", 0).alias("x"), F.round("y", 0).alias("y"))


# target frames

_ROOT_SQL = f"""WITH RECURSIVE {OBSERVATIONS_SQL}, k AS (SELECT row_seq, entity, parent, epoch_ns, x {KM_SQL} AS x, y {KM_SQL} AS y, z {KM_SQL} AS z, 2 * half_deg AS a FROM obs),
p AS (SELECT *, lead(epoch_ns) OVER (PARTITION BY entity ORDER BY epoch_ns) AS until FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY entity, epoch_ns ORDER BY row_seq) = 1)),
c AS (SELECT row_seq, epoch_ns AS e, parent AS top, x, y, z FROM k UNION ALL
SELECT c.row_seq, c.e, p.parent, p.x + cos(radians(p.a)) * c.x - sin(radians(p.a)) * c.y, p.y + sin(radians(p.a)) * c.x + cos(radians(p.a)) * c.y, p.z + c.z FROM c JOIN p ON c.top = p.entity AND c.e >= p.epoch_ns AND (p.until IS NULL OR c.e < p.until) WHERE c.top <> {EARTH}),
gcrf AS (SELECT row_seq, cos(w) * x - sin(w) * y AS x, sin(w) * x + cos(w) * y AS y, z FROM (SELECT *, {_ANGLE} AS w FROM c WHERE top = {EARTH}))"""
_GCRF_SQL = f"{_ROOT_SQL} SELECT row_seq, 2 AS unit, {', '.join(f'{_sql_log1(f"({v} * 1000.0)")} AS {v}' for v in 'xyz')} FROM gcrf"


def _rooted(spark, d):
    """The events whose frame leads to Earth: a frame needs a row of its own at or before the event, all the way up."""
    o = observations(spark, d)
    km = transform.in_km(o)
    up = transform.resolve(o.select(F.col("parent").alias("frame"), F.col("epoch_ns").alias("epoch")), km, is_earth).where("root IS NOT NULL")
    return o.join(up.select(F.col("frame").alias("parent"), F.col("epoch").alias("epoch_ns")), ["parent", "epoch_ns"], "left_semi").select(o.columns)


def _in_metres(df: DataFrame) -> DataFrame:
    p = F.col(f"{R.STRUCT}.position")
    return df.select(number(df), F.col(f"{R.STRUCT}.units_pos").cast("int").alias("unit"), *[F.get(p, F.lit(i)).alias(n) for i, n in enumerate("xyz")]).select("row_seq", "unit", *[_log1(n) for n in "xyz"])


@query(_GCRF_SQL)
def transform_target(spark, d):
    """Every row that leads to Earth, through the chain of its frames and Earth's turning, in metres in the Earth-centred inertial frame."""
    o = observations(spark, d)
    poses = transform.in_km(o).withColumns({"entity": entity_id(F.col("entity")), "parent": F.when(F.col("parent") == EARTH, F.lit(bytearray(ident.frame_bytes("Earth")))).otherwise(entity_id(F.col("parent")))})
    return _in_metres(transform.transform(entity_rows(_rooted(spark, d)), ident.frame_bytes("GCRF"), _ephemeris(spark, d), poses, unit=2))


@query(_GCRF_SQL)
def ledger_transform(spark, d):
    """The same through a ledger, whose stored rows resolve the frames of rows that it doesn't store."""
    return _in_metres(_ledger(spark, d).transform(entity_rows(_rooted(spark, d)), "GCRF", "m"))


@query(f"{_ROOT_SQL} SELECT DISTINCT k.parent AS frame, c.e AS epoch, '0000018f00008000800000018f000000' AS root FROM c JOIN k USING (row_seq) WHERE c.top = {EARTH}")
def root_frame(spark, d):
    asked = _rooted(spark, d).select("parent", "epoch_ns").distinct()
    asked = settled(asked.select("parent", F.when(F.col("parent") == EARTH, F.lit(bytearray(ident.frame_bytes("Earth")))).otherwise(entity_id(F.col("parent"))).alias("frame"), F.col("epoch_ns").alias("epoch")), "asked")
    found = _ledger(spark, d).root_frame(asked)
    return asked.join(found, ["frame", "epoch"]).select(F.col("parent").alias("frame"), "epoch", F.lower(F.hex("root")).alias("root"))


@query("SELECT o.row_seq, round(500 + cos(radians(30)) * o.x - sin(radians(30)) * o.y, 6) AS x, round(sin(radians(30)) * o.x + cos(radians(30)) * o.y, 6) AS y FROM obs o WHERE parent < 8 AND parent >= 0")
def in_body(spark, d):
    """Rows on the frames of eight static places, each 500 km out and turned by 30 degrees, in the body's frame."""
    place = spark.range(8).select(F.col("id").alias("entity"), F.lit(EARTH).cast("bigint").alias("parent"), F.lit(500.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), quat.yaw(F.radians(F.lit(30.0))).alias("quaternion"))
    o = _flat(observations(spark, d)).select("row_seq", "entity", "parent", "x", "y", "z", "quaternion")
    return transform.through_pose(o, place).select("row_seq", *_r("x", "y"))


@query("SELECT row_seq, round(-sin(radians(20)) * x + cos(radians(20)) * y, 3) AS east, round((-sin(radians(10)) * cos(radians(20)) * x - sin(radians(10)) * sin(radians(20)) * y + cos(radians(10)) * z), 3) AS north FROM (SELECT row_seq, 1000 * (x - ox + cos(radians(2 * half_deg)) * 0.25) AS x, 1000 * (y - oy + sin(radians(2 * half_deg)) * 0.25) AS y, 1000 * (z - oz) AS z FROM obs, (SELECT n * cos(radians(10)) * cos(radians(20)) AS ox, n * cos(radians(10)) * sin(radians(20)) AS oy, n * (1 - e2) * sin(radians(10)) AS oz FROM (SELECT 6378.137 / sqrt(1 - e2 * power(sin(radians(10)), 2)) AS n, e2 FROM (SELECT 2 / 298.257223563 - power(1 / 298.257223563, 2) AS e2))))")
def in_cell(spark, d):
    """Rows as body-fixed points, with a tool 250 m along their own x axis, east and north of a place on the ground."""
    o = _flat(observations(spark, d))
    return transform.in_cell(o, 10.0, 20.0, 0.0, (250.0, 0.0, 0.0)).select("row_seq", F.round("east_m", 3).alias("east"), F.round("north_m", 3).alias("north"))


# the ledger


@query(f"SELECT row_seq, entity, epoch_ns FROM obs WHERE epoch_ns BETWEEN {T0} AND {T1}")
def ledger_query(spark, d):
    rows = _ledger(spark, d).query(T0, T1)
    return rows.select(number(rows), "epoch_ns").join(observations(spark, d).select("row_seq", "entity"), "row_seq").select("row_seq", "entity", "epoch_ns")


@query(f"SELECT CASE WHEN batch_seq < 4 THEN 0 WHEN batch_seq <= 9 THEN 1 ELSE 2 END AS folder, count(*) AS n FROM obs WHERE epoch_ns BETWEEN {T0} AND {T1} GROUP BY ALL")
def stream_query(spark, d):
    """The same query folder by folder."""
    out = [(int(r["b"]), int(r["n"])) for part in _ledger(spark, d).stream_query(T0, T1) for r in part.groupBy(F.col("batch_seq").alias("b")).agg(F.count("*").alias("n")).collect()]
    return spark.createDataFrame(out, "folder int, n bigint")


@query("SELECT entity, arg_max(row_seq, row(epoch_ns, 1 - estimate_type, -row_seq)) AS row_seq FROM obs WHERE epoch_ns >= (SELECT max(epoch_ns) FROM obs) - 3600000000000 GROUP BY entity")
def ledger_current_state(spark, d):
    rows = _ledger(spark, d).run_ticket({"query_type": "current_state"})
    return rows.select(number(rows)).join(observations(spark, d).select("row_seq", "entity"), "row_seq").select("entity", "row_seq")


@query(f", {_LOG} SELECT seq AS row_seq, child, epoch FROM log /* obs */")
def ledger_topology(spark, d):
    """The events of three appends, told by the rows they come from: as those of all rows at once where time goes on from batch to batch."""
    ledger = _ledger(spark, d)
    rows = ledger.rows()
    log = ledger.topology_log()
    told = log.select("seq", "epoch").join(rows.select(F.col("row_seq").alias("seq"), number(rows)), "seq").select("row_seq", "epoch")
    return told.join(observations(spark, d).select("row_seq", F.col("entity").alias("child")), "row_seq").select("row_seq", "child", "epoch")


@query("SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, min(epoch_ns) AS first_epoch, max(epoch_ns) AS last_epoch, count(*) AS distinct_seq FROM obs")
def save_load_ledger(spark, d):
    """A ledger saved, loaded at another place and asked again; its rows' numbers are all different."""
    path = f"{shared_dir(spark)}/wherewhen-saved-{uuid.uuid4().hex}"
    _ledger(spark, d).action("save_ledger", {"path": path})
    again = Ledger.load(spark, path, f"{path}-again")
    return again.rows().agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"), F.min("epoch_ns").alias("first_epoch"), F.max("epoch_ns").alias("last_epoch"), F.count_distinct("row_seq").alias("distinct_seq"))


@query("SELECT 1 AS folders, count(*) AS n_rows, count(*) AS distinct_seq, sum(row_seq) AS total FROM obs")
def seal_tail(spark, d):
    """A ledger of many small batches sealed into one: the same rows with the same numbers."""
    path = f"{shared_dir(spark)}/wherewhen-tail-{uuid.uuid4().hex}"
    ledger, o = Ledger(spark, path), observations(spark, d)
    for k in range(3):
        ledger.append(entity_rows(o.where(F.col("row_seq") % 3 == k)), checked=True)
    held = sum(x["bytes"] for x in ledger._live().values())  # so that the number of batches decides, whatever the table's size
    assert not ledger.seal(most=5, most_bytes=held) and ledger.seal(most=2, most_bytes=held) and not ledger.seal(most=0)
    rows = ledger.rows()
    return rows.agg(F.lit(len(ledger._live())).alias("folders"), F.count("*").alias("n_rows"), F.count_distinct("row_seq").alias("distinct_seq"), F.sum(F.col("mass_kg").cast("bigint")).alias("total"))


@query("SELECT row_seq FROM (SELECT *, max(epoch_ns) OVER (PARTITION BY entity) AS m, CASE WHEN batch_seq < 4 THEN 0 WHEN batch_seq <= 9 THEN 1 ELSE 2 END AS b FROM obs) WHERE b = (SELECT arg_max(b, m) FROM (SELECT CASE WHEN batch_seq < 4 THEN 0 WHEN batch_seq <= 9 THEN 1 ELSE 2 END AS b, max(epoch_ns) AS m FROM obs GROUP BY ALL)) OR epoch_ns = m")
def set_memory_limit(spark, d):
    """What is left under a limit that no two batches fit: the batch that ends last, and each entity's rows at its latest epoch."""
    ledger = _ledger(spark, d)
    copy = Ledger(spark, f"{shared_dir(spark)}/wherewhen-small-{uuid.uuid4().hex}")
    for x in ledger._live().values():
        part = ledger._read([x["dir"]])
        copy.append(part.select(R.ENTITY.fieldNames()), checked=True)
    copy.evict(1)
    rows = copy.rows()
    return rows.select(number(rows))


@query("SELECT CASE WHEN batch_seq < 4 THEN 0 WHEN batch_seq <= 9 THEN 1 ELSE 2 END AS batch_seq, count(*) AS n_rows, min(epoch_ns) AS first_epoch, max(epoch_ns) AS last_epoch, true AS has_bytes FROM obs GROUP BY ALL")
def resident_bytes(spark, d):
    return _ledger(spark, d).resident_bytes().where("n_rows > 0").select(F.col("batch_seq").cast("int").alias("batch_seq"), "n_rows", "first_epoch", "last_epoch", (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT entity, row_seq, row_number() OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq) AS place FROM obs")
def index_by_entity(spark, d):
    """Each entity's rows in order, from a ledger's index: places within files of one range."""
    from pyspark.sql import Window

    rows = _ledger(spark, d).index_by_entity(files=1)
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("epoch_ns", "row_seq"))
    return rows.select(number(rows), place.cast("bigint").alias("place")).join(observations(spark, d).select("row_seq", "entity"), "row_seq").select("entity", "row_seq", "place")


@query("SELECT CAST(3 AS BIGINT) AS batches, count(*) AS n_rows FROM obs")
def describe(spark, d):
    text = _ledger(spark, d).describe()
    return spark.range(1).select(F.regexp_extract(F.lit(text), r"^(\d+) batches", 1).cast("bigint").alias("batches"), F.regexp_extract(F.lit(text), r", (\d+) rows, [0-9.]+ MB$", 1).cast("bigint").alias("n_rows"))


@query("SELECT c_custkey, c_name AS label FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, id[1:8] || '-' || id[9:12] || '-' || id[13:16] || '-' || id[17:20] || '-' || id[21:32] FROM (" + Q._MINT_SQL.format(key="c_custkey", kind="01", kind1="1", authority="'customers'", name="c_name", table="customer") + ") WHERE c_custkey % 3 <> 0")
def register_display(spark, d):
    """Names merged into a registry, and what ids are then called: the name where there is one, else the id's text."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/wherewhen-names-{uuid.uuid4().hex}")
    n = Q._names(spark, d)
    ledger.import_names([n.where("c_custkey % 6 = 0").drop("c_custkey"), n.where("c_custkey % 6 = 3").drop("c_custkey")])
    return ledger.display(n.select("c_custkey", "prescribed_id"), "prescribed_id").select("c_custkey", "label")


# files and rows


@query("SELECT row_seq, units_pos, round(x, 6) AS x FROM obs")
def ipc_files(spark, d):
    """Rows written as Arrow files by the executors and read back by them."""
    path = f"{shared_dir(spark)}/wherewhen-arrow-{uuid.uuid4().hex}"
    o = observations(spark, d).select("row_seq", "units_pos", "position")
    assert arrow_files.write_files(o.repartition(3), path, 1000).agg(F.sum("n_rows")).first()[0] == o.count()
    back = arrow_files.read_file(spark, path)
    assert arrow_files.read_schema(spark, path).fieldNames() == back.columns
    return back.select("row_seq", "units_pos", F.round(F.get("position", F.lit(0)), 6).alias("x"))


@query("SELECT s_suppkey, round(s_acctbal, 2) AS x, CAST(2 AS SMALLINT) AS units, s_suppkey * 1000 + 32000000000 AS epoch FROM supplier")
def row_builder(spark, d):
    """Rows in words - units, scales, frames, names - as the ledger has them: codes, ids and TAI."""
    s = _table(spark, d, "supplier")
    words = s.select(F.lit("supply").alias("authority"), F.col("s_name").alias("name"), F.lit("Earth").alias("frame"), F.lit(None).cast("string").alias("frame_authority"), F.lit("m").alias("units"), F.lit("UTC").alias("timescale"), F.lit("desk").alias("source"), F.lit("ESTIMATED").alias("estimate"), (F.col("s_suppkey") * 1000).alias("epoch_ns"), F.array("s_acctbal", F.lit(0.0), F.lit(0.0)).alias("position"), F.lit(None).cast("array<double>").alias("quaternion"))
    rows = R.validate(builders.from_tokens(words), "entity_id")
    inner = F.col(R.STRUCT)
    return rows.withColumn("epoch", R.epoch_ns(rows)).join(s.select("s_suppkey", ident.mint_entity(F.lit("supply"), F.col("s_name")).alias("entity_id")), "entity_id").select("s_suppkey", F.round(inner["position"][0], 2).alias("x"), inner["units_pos"].alias("units"), "epoch")


@query("SELECT row_seq, epoch_ns FROM obs WHERE timescale_id = 1")
def viz_load(spark, d):
    """Rows for a viewer, which takes TAI alone."""
    o = observations(spark, d)
    try:
        R.require_tai(o, struct="none")
    except ValueError:
        o = o.where("timescale_id = 1")
    rows, window = R.viewer_rows(R.require_tai(o, struct="none"), "entity", "epoch_ns")
    assert window.first()["first_epoch"] is not None
    return rows.select("row_seq", "epoch_ns")


@query("SELECT row_seq, CAST(floor(sum(b) OVER (ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 4096) AS BIGINT) AS chunk FROM (SELECT row_seq, 100 + length(event_type) AS b FROM obs) QUALIFY row_number() OVER (ORDER BY row_seq) > 1 UNION ALL SELECT min(row_seq), 0 FROM obs")
def slice_chunks(spark, d):
    o = observations(spark, d).select("row_seq", "event_type")
    return R.slice_chunks(o, "row_seq", 100 + F.length("event_type"), 4096).select("row_seq", "chunk")


@query("SELECT entity, row_seq FROM obs")
def sort_dirty(spark, d):
    return R.sort_dirty(observations(spark, d), "entity", "epoch_ns", "row_seq").select("entity", "row_seq")


# fields, geometry, motion


@query("SELECT row_seq, round(u, 5) AS u, round(v, 5) AS v FROM (SELECT row_seq, -s * sin(radians(dir)) AS u, -s * cos(radians(dir)) AS v FROM (SELECT row_seq, ((225 + 20 * sin(2 * pi() * t / 1800 + 0.5)) % 360 + 360) % 360 AS dir, (6 + 0.5 * t / 3600) * (1 + 0.4 * exp(-(power(x - ((((100 + t * 6 * sin(radians(45))) % 1000) + 1000) % 1000), 2) + power(y - ((((200 + t * 6 * cos(radians(45))) % 1000) + 1000) % 1000), 2)) / (2 * 90.0 * 90.0))) AS s FROM (SELECT row_seq, x, y, least(7200.0, greatest(0.0, row_seq * 1.0)) AS t FROM obs)))")
def wind_field(spark, d):
    """A wind that swings and builds up, with a puff that drifts and comes in again on the other side."""
    w = fields.WindField(225, 6, 20, 1800, 0.5, 0.5, 0, 7200, (0, 1000, 0, 1000), [(100, 200)], 90, 0.4)
    o = _flat(observations(spark, d))
    u, v = w.vector(F.col("x"), F.col("y"), F.col("row_seq").cast("double"))
    return o.select("row_seq", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


@query("SELECT row_seq, CASE WHEN a < 40 THEN 0 ELSE round(least(3.5, 0.65 * 6 * (0.7 + 0.3 * sin(pi() * (a - 40) / 140))), 6) END AS speed FROM (SELECT row_seq, abs((((y + 180) % 360) + 360) % 360 - 180) AS a FROM obs)")
def boat_polar(spark, d):
    o = _flat(observations(spark, d))
    return o.select("row_seq", F.round(fields.boat_speed(F.col("y"), F.lit(6.0)), 6).alias("speed"))


@query("SELECT row_seq, round((head - back) / 2 * d + sqrt(power((head + back) / 2 * d, 2) + power((head + back) / 2 / lb * c, 2)), 9) AS rate, kind FROM (SELECT *, head * (1 - e) / (1 + e) AS back FROM (SELECT *, sqrt(1 - 1 / (lb * lb)) AS e, 0.5 / 60 * (1 + ws) * f AS head FROM (SELECT row_seq, kind, CASE kind WHEN 'water' THEN 0.0 WHEN 'slash' THEN 1.6 ELSE 1.0 END AS f, ws, 1 + 0.3 * ws AS lb, -sin(radians(y)) * sin(radians(a)) - cos(radians(y)) * cos(radians(a)) AS d, cos(radians(a)) * -sin(radians(y)) - sin(radians(a)) * -cos(radians(y)) AS c FROM (SELECT row_seq, y, 2 * half_deg AS a, z / 10 AS ws, CASE WHEN abs(x - 50) <= 5 THEN 'water' WHEN x > 20 AND x < 90 AND y > 100 AND y < 500 THEN 'slash' ELSE 'conifer' END AS kind FROM obs))))")
def fire_spread(spark, d):
    """Spread along a normal by fuel class and wind, everywhere that a row stands."""
    o = _flat(observations(spark, d))
    line = joins.polyline_distance(o, [(50.0, -1e6), (50.0, 1e6)], "x", "y")
    kind = fields.fuel_class([("water", line <= 5), ("slash", (F.col("x") > 20) & (F.col("x") < 90) & (F.col("y") > 100) & (F.col("y") < 500))], "conifer")
    wind, a = F.col("z") / 10, F.radians((F.col("row_seq") % 8) * 45.0)
    head = fields.head_rate(fields.fuel_factor(kind, {"water": 0.0, "slash": 1.6, "conifer": 1.0}), wind)
    return o.select("row_seq", F.round(fields.spread_rate(head, wind, F.col("y"), F.sin(a), F.cos(a)), 9).alias("rate"), kind.alias("kind"))


@query("SELECT c_custkey, round(lat, 5) AS lat, round(lon, 5) AS lon, round(p, 6) AS hermite FROM (SELECT c_custkey, degrees(asin(sin(radians(30.0)) * cos(s) + cos(radians(30.0)) * sin(s) * cos(b))) AS lat, 10 + degrees(atan2(sin(b) * sin(s) * cos(radians(30.0)), cos(s) - sin(radians(30.0)) * sin(asin(sin(radians(30.0)) * cos(s) + cos(radians(30.0)) * sin(s) * cos(b))))) AS lon, (2*t*t*t - 3*t*t + 1) * 1 + (t*t*t - 2*t*t + t) * 3 * 2 + (3*t*t - 2*t*t*t) * 5 + (t*t*t - t*t) * 3 * -1 AS p FROM (SELECT c_custkey, t, t * 2 * asin(sqrt(power(sin(radians(20) / 2), 2) + cos(radians(30)) * cos(radians(50)) * power(sin(radians(40) / 2), 2))) AS s, atan2(sin(radians(40)) * cos(radians(50)), cos(radians(30)) * sin(radians(50)) - sin(radians(30)) * cos(radians(50)) * cos(radians(40))) AS b FROM (SELECT c_custkey, c_custkey % 101 / 100.0 AS t FROM customer)))")
def great_circle_path(spark, d):
    """Points along a great circle, and a cubic through two ends with given slopes."""
    t = F.col("c_custkey") % 101 / 100.0
    lat, lon = geo.along_great_circle(F.lit(30.0), F.lit(10.0), F.lit(50.0), F.lit(50.0), t)
    h = geo.hermite(F.lit(1.0), F.lit(2.0), F.lit(5.0), F.lit(-1.0), t, F.lit(3.0))
    return _table(spark, d, "customer").select("c_custkey", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"), F.round(h, 6).alias("hermite"))


@query("SELECT entity, 0.0::DOUBLE AS energy_spread, 0.0::DOUBLE AS momentum_spread FROM obs GROUP BY entity")
def energy_momentum(spark, d):
    """States along one orbit for each entity, carried on to its rows: energy and momentum stay."""
    o = observations(spark, d).select("entity", "row_seq", (F.col("row_seq") % 5000).cast("double").alias("dt"))
    s = o.withColumn("s", orbits.propagated(F.array(F.lit(7000.0) + F.col("entity") % 100 * 10, F.lit(100.0), F.lit(-50.0)), F.array(F.lit(0.3), F.lit(7.4), F.lit(1.0)), F.col("dt"), F.lit(398600.4418)))
    out = timeline.energy_momentum(s.select("entity", F.col("s.position").alias("r"), F.col("s.velocity").alias("v")), 398600.4418)
    return out.select("entity", F.round("energy_spread", 6).alias("energy_spread"), F.round("momentum_spread", 4).alias("momentum_spread"))


@query("SELECT row_seq, id FROM (SELECT row_seq, x, y FROM obs), (SELECT n_nationkey AS id, n_nationkey * 30.0 AS w, n_nationkey * 30.0 + 55 AS e, n_regionkey * 200.0 AS s, n_regionkey * 200.0 + 150 AS n FROM nation) WHERE x > w AND x < e AND y > s AND y < n AND x <> w AND y <> s")
def polygons_join(spark, d):
    """Rows with every box that they stand in; both sides meet by cell."""
    w, s = F.col("n_nationkey") * 30.0, F.col("n_regionkey") * 200.0
    boxes = _table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), w.alias("west"), s.alias("south"), (w + 55).alias("east"), (s + 150).alias("north"))
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"))])
    found = joins.within_polygons(_flat(observations(spark, d)).select("row_seq", "x", "y"), boxes.withColumn("rings", F.array(ring)), 60.0)
    on_edge = boxes.select(F.col("id"), F.col("west").alias("_w"), F.col("south").alias("_s"))
    return found.join(on_edge, "id").where("x <> _w AND y <> _s").select("row_seq", "id")


_POINTS = "h AS (SELECT DISTINCT entity, x, y FROM obs)"


@query(f", {_POINTS}, n AS (SELECT entity, count(*) AS n FROM h GROUP BY entity), edge AS (SELECT p.entity, p.x, p.y FROM h p JOIN h q ON p.entity = q.entity AND (p.x <> q.x OR p.y <> q.y) JOIN h r ON r.entity = p.entity GROUP BY p.entity, p.x, p.y, q.x, q.y HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0 OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) <= 0))), corner AS (SELECT DISTINCT * FROM edge UNION SELECT h.entity, x, y FROM h JOIN n USING (entity) WHERE n = 1), mid AS (SELECT entity, avg(x) AS mx, avg(y) AS my, min(row(x, y)) AS low FROM corner GROUP BY entity) SELECT c.entity, row_number() OVER (PARTITION BY c.entity ORDER BY ((atan2(y - my, x - mx) - atan2(low[2] - my, low[1] - mx) + 4 * pi()) % (2 * pi()) + 1e-9) % (2 * pi())) - 1 AS i, x, y FROM corner c JOIN mid USING (entity) /* obs */")
def convex_hull(spark, d):
    return joins.convex_hulls(_flat(observations(spark, d)), "entity")


@query(f"""WITH RECURSIVE {OBSERVATIONS_SQL}, o AS (SELECT batch_seq, entity, parent, round(x, 6) AS cost, row_number() OVER (PARTITION BY batch_seq ORDER BY round(x, 6), entity, parent) AS i FROM obs),
g AS (SELECT batch_seq, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS l, CAST([] AS BIGINT[]) AS r, false AS took FROM (SELECT DISTINCT batch_seq FROM obs)
UNION ALL SELECT g.batch_seq, o.i, CASE WHEN NOT list_contains(g.l, o.entity) AND NOT list_contains(g.r, o.parent) THEN list_append(g.l, o.entity) ELSE g.l END, CASE WHEN NOT list_contains(g.l, o.entity) AND NOT list_contains(g.r, o.parent) THEN list_append(g.r, o.parent) ELSE g.r END, NOT list_contains(g.l, o.entity) AND NOT list_contains(g.r, o.parent) FROM g JOIN o ON o.batch_seq = g.batch_seq AND o.i = g.i + 1)
SELECT o.batch_seq, o.entity, o.parent, o.cost FROM g JOIN o USING (batch_seq, i) WHERE took""")
def greedy_assign(spark, d):
    o = _flat(observations(spark, d)).select("batch_seq", "entity", "parent", F.round("x", 6).alias("cost"))
    return joins.assign_greedily(o, "batch_seq", "entity", "parent", "cost")
