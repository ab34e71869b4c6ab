"""Poses up the chain of frames, and rows re-expressed in another frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewhen.functions import ident, quat, vocab
from wherewhen.operators import rows as R
from wherewhen.operators.asof import asof_join
from wherewhen.operators.topology import MAX_DEPTH


def resolve(asked: DataFrame, rows: DataFrame, is_root, key: str = "entity", parent: str = "parent", epoch: str = "epoch_ns", seq: str = "row_seq", max_depth: int = MAX_DEPTH) -> DataFrame:
    """(frame, epoch, root, t, q, hops) for every asked (frame, epoch): the motion from the frame into its root.

    A level at a time: the as-of row of each distinct (frame, epoch) still open gives its pose in its parent,
    and the motions so far are composed with it. rows has x, y, z in km and a unit quaternion. An entity
    without a row early enough gives a null root.
    """
    from wherewhen.plans.tables import settled

    one = quat.motion(quat.vector(0, 0, 0), quat.vector(*quat.IDENTITY))
    # what every level looks up: one row for each key and epoch, worked out and written once
    firsts = settled(rows.groupBy(key, epoch).agg(F.min(seq).alias("_seq")).withColumnsRenamed({key: "_k", epoch: "_t"}), "first-rows")
    narrow = rows.select(key, epoch, seq, parent, "x", "y", "z", "quaternion")
    poses = settled(narrow.join(firsts, (narrow[key] == F.col("_k")) & (narrow[epoch] == F.col("_t")) & (narrow[seq] == F.col("_seq"))).drop("_k", "_t", "_seq"), "poses")
    open_ = asked.distinct().select("frame", "epoch", F.col("frame").alias("at"), one.alias("m"), F.lit(0).alias("hops"))
    done = open_.where(is_root(F.col("at")))
    open_ = open_.where(~is_root(F.col("at")))
    for _ in range(max_depth):
        pose = {parent: "up", "x": "px", "y": "py", "z": "pz", "quaternion": "pq"}
        mine = poses.join(open_.select(F.col("at").alias(key)).distinct(), key, "left_semi")
        # each open row is carried along the join whole: its frame's pose comes back to it without a distinct and a join of its own
        found = asof_join(open_, mine, "at", key, "epoch", epoch, pose, seq, unique=True)
        hop = quat.motion(quat.vector(F.col("px"), F.col("py"), F.col("pz")), F.col("pq"))
        step = found.select("frame", "epoch", F.col("up").alias("at"), quat.compose(hop, F.col("m")).alias("m"), (F.col("hops") + 1).alias("hops"))
        step = settled(step, "chain")
        done = done.unionByName(step.where(F.coalesce(is_root(F.col("at")), F.lit(True))))
        open_ = step.where(~is_root(F.col("at")))
        if open_.isEmpty():
            return done.select("frame", "epoch", F.col("at").alias("root"), F.col("m.t").alias("t"), F.col("m.q").alias("q"), "hops")
    raise ValueError(f"a chain of over {max_depth} steps: a cycle")


def looked_up(rows: DataFrame, keys: list[str], answer) -> DataFrame:
    """rows with the columns that answer() adds to a table of their distinct keys: each is worked out once and joined back."""
    found = answer(rows.select(*keys).distinct())
    names = {k: f"_{k}" for k in keys}
    found = found.withColumnsRenamed(names)
    hit = rows[keys[0]].eqNullSafe(found[names[keys[0]]])
    for k in keys[1:]:
        hit = hit & rows[k].eqNullSafe(found[names[k]])
    return rows.join(found, hit, "left").drop(*names.values())


def require_roots(resolved: DataFrame) -> DataFrame:
    """resolved, or ValueError if a frame doesn't lead to a root: an entity on its way has no row early enough."""
    lost = resolved.where("root IS NULL").limit(3).collect()
    if lost:
        raise ValueError("no root frame for " + ", ".join(str(bytes(r["frame"]).hex() if isinstance(r["frame"], (bytes, bytearray)) else r["frame"]) for r in lost))
    return resolved


def to_root(df: DataFrame, resolved: DataFrame, parent: str = "parent", epoch: str = "epoch_ns", unit: str = "units_pos") -> DataFrame:
    """df with root, root_x, root_y, root_z (km) and root_q: each row's pose composed with its frame's motion."""
    m = resolved.select(F.col("frame").alias("_f"), F.col("epoch").alias("_e"), F.col("root"), quat.motion(F.col("t"), F.col("q")).alias("_m"))
    rows = df.withColumns({"_p": F.transform(F.col("position"), lambda v: vocab.to_km(v, F.col(unit))), "_q": quat.normalise(F.col("quaternion"))})
    out = rows.join(m, (df[parent] == m["_f"]) & (df[epoch] == m["_e"]), "left").withColumn("_p", quat.apply(F.col("_m"), F.col("_p")))
    q = quat.mul(F.col("_m.q"), F.col("_q"))
    return out.select(*df.columns, "root", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("root_x", "root_y", "root_z"))], q.alias("root_q"))


def in_km(df: DataFrame, position: str = "position", unit: str = "units_pos", quaternion: str = "quaternion") -> DataFrame:
    """df with x, y, z in km and a unit quaternion."""
    x, y, z = (vocab.to_km(c, F.col(unit)) for c in quat.at(F.col(position), 3))
    return df.withColumns({"x": x, "y": y, "z": z, "quaternion": quat.normalise(F.col(quaternion))})


def reexpress(df: DataFrame, motions: DataFrame, target_unit: int = 1, frame: str = "frame_id", epoch: str = "epoch_ns", target: Column | None = None) -> DataFrame:
    """df with its pose in a target frame: motions is (frame_id, epoch_ns, t km, q) into it, for every pair that df has.

    Positions go through km; covariances become null; everything else stays. A pair that motions lacks raises.
    """
    m = motions.select(F.col(frame).alias("_f"), F.col(epoch).alias("_e"), quat.motion(F.col("t"), F.col("q")).alias("_m"))
    out = df.join(m, (df[frame] == m["_f"]) & (df[epoch] == m["_e"]), "left")
    known = F.coalesce(F.col("_m"), F.raise_error(F.lit("a frame has no motion into the target")).cast("struct<t:array<double>,q:array<double>>"))
    p = quat.apply(known, F.transform(F.col("position"), lambda v: vocab.to_km(v, F.col("units_pos"))))
    new = {"position": F.transform(p, lambda v: vocab.from_km(v, F.lit(target_unit))), "quaternion": quat.mul(F.col("_m.q"), quat.normalise(F.col("quaternion"))), "units_pos": F.lit(target_unit).cast("smallint")}
    if target is not None:
        new[frame] = target
    for c in ("position_covariance", "orientation_covariance"):
        if c in df.columns:
            new[c] = F.lit(None).cast("array<double>")
    return out.withColumns(new).select(df.columns)


def between(a: Column, b: Column, point: Column) -> Column:
    """A point of frame a in frame b, from both frames' motions into one root."""
    back = quat.conj(b["q"])
    return quat.rotate(back, quat.sub(quat.apply(a, point), b["t"]))


def transform(df: DataFrame, target: bytes, ephemeris, resolver: DataFrame | None = None, unit: int = 1, struct: str = R.STRUCT) -> DataFrame:
    """df - observations, flat or in a struct - in an astronomical target frame and a unit; all else but covariances, which become null, stays.

    Frames that are entities are resolved through resolver (entity, parent, epoch_ns, row_seq, x, y, z in km, quaternion),
    each distinct (frame, epoch) once; their roots and the astronomical frames go by the ephemeris tables. Raises
    ValueError for abstract frames, and for entities whose chain ends nowhere.
    """
    frame, at = R.field(df, "frame_id", struct), R.epoch_ns(df, struct)
    rows = df.withColumn("_at", at)
    from wherewhen.plans.tables import settled

    need = settled(rows.select(frame.alias("frame"), F.col("_at").alias("epoch")).distinct(), "frames")  # read by each step below
    kind = ident.kind(F.col("frame"))
    if not need.where(kind == ident.ABSTRACT).isEmpty():
        raise ValueError("an abstract id is no frame")
    one = quat.motion(quat.vector(0, 0, 0), quat.vector(*quat.IDENTITY))
    chains = need.where(kind == ident.ASTRO).select("frame", "epoch", F.col("frame").alias("root"), one.alias("own"))
    entity = need.where(kind == ident.ENTITY)
    if not entity.isEmpty():
        if resolver is None:
            raise ValueError("rows are on entities' frames, and there is nothing to resolve them by")
        up = require_roots(resolve(entity, resolver, lambda c: ident.kind(c) != ident.ENTITY))
        if not up.where(ident.kind(F.col("root")) == ident.ABSTRACT).isEmpty():
            raise ValueError("an abstract id is no frame")
        chains = chains.unionByName(up.select("frame", "epoch", "root", quat.motion(F.col("t"), F.col("q")).alias("own")))
    outer = ephemeris.motions(chains.select(F.col("root").alias("frame_id"), "epoch"), target).select(F.col("frame_id").alias("root"), "epoch", quat.motion(F.col("t"), F.col("q")).alias("outer"))
    whole = chains.join(outer, ["root", "epoch"]).select(F.col("frame").alias("_f"), F.col("epoch").alias("_e"), quat.compose(F.col("outer"), F.col("own")).alias("_m"))
    unit_of = R.field(df, "units_pos", struct)
    joined = rows.withColumns({"_p": F.transform(R.field(df, "position", struct), lambda v: vocab.to_km(v, unit_of)), "_q": quat.normalise(R.field(df, "quaternion", struct))})
    joined = joined.join(whole, (frame == F.col("_f")) & (F.col("_at") == F.col("_e"))).withColumn("_p", quat.apply(F.col("_m"), F.col("_p")))
    none = F.lit(None).cast("array<double>")
    new = {
        "frame_id": F.lit(bytearray(target)),
        "units_pos": F.lit(unit).cast("smallint"),
        "position": F.transform("_p", lambda v: vocab.from_km(v, F.lit(unit))),
        "quaternion": quat.mul(F.col("_m.q"), F.col("_q")),
        "position_covariance": none,
        "orientation_covariance": none,
    }
    if R.nested(df.schema, struct):
        inner = F.col(struct)
        for name, column in new.items():
            inner = inner.withField(name, column)
        joined = joined.withColumn(struct, inner)
    else:
        joined = joined.withColumns(new)
    return joined.select(df.columns)


def body_poses(ephemeris, frame: bytes, epochs: DataFrame, target: bytes) -> DataFrame:
    """(epoch, centre km, quaternion): where an astronomical frame's origin and axes are in the target, at each of epochs (epoch)."""
    asked = epochs.select(F.lit(bytearray(frame)).alias("frame_id"), "epoch")
    return ephemeris.motions(asked, target).select("epoch", F.col("t").alias("centre"), F.col("q").alias("quaternion"))


def body_centred(rows: DataFrame, centres: DataFrame, on: str = "epoch") -> DataFrame:
    """rows (x, y, z) less the centre (x, y, z) at the same epoch; rows without one go."""
    mid = centres.select(F.col(on).alias("_on"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    return rows.join(mid, F.col(on) == F.col("_on")).withColumns({c: F.col(c) - F.col(f"_{c}") for c in "xyz"}).select(rows.columns)


def through_pose(rows: DataFrame, poses: DataFrame, frame: str = "parent", place: str = "entity") -> DataFrame:
    """rows (x, y, z, quaternion in km, by frame) composed with the static pose (x, y, z, quaternion, parent) of the place that their frame is: rows of a facility in its body, and with a second call on the body's own pose on its site. Rows on other frames go."""
    pose = poses.select(F.col(place).alias("_place"), F.col("parent").alias("_up"), quat.motion(quat.vector(F.col("x"), F.col("y"), F.col("z")), F.col("quaternion")).alias("_pose"))
    out = rows.join(pose, F.col(frame) == F.col("_place"))
    m = quat.compose(F.col("_pose"), quat.motion(quat.vector(F.col("x"), F.col("y"), F.col("z")), F.col("quaternion")))
    out = out.withColumn("_m", m).withColumns({c: F.get("_m.t", F.lit(i)) for i, c in enumerate("xyz")} | {"quaternion": F.col("_m.q"), frame: F.col("_up")})
    return out.select(rows.columns)


def in_cell(rows: DataFrame, lat_deg: float, lon_deg: float, height_km: float, offset_m: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Body-fixed rows (x, y, z km, quaternion) in metres east, north and up of a place on the ground: the point offset_m along the row's own axes, as a tool has it."""
    from wherewhen.functions import geo

    lat, lon = F.lit(float(lat_deg)), F.lit(float(lon_deg))
    origin, basis = geo.geodetic_to_fixed(lat, lon, F.lit(float(height_km))), geo.enu_basis(lat, lon)
    tip = quat.rotate(F.col("quaternion"), quat.vector(*[float(v) / 1000 for v in offset_m]))
    away = [F.col(c) + F.get(tip, F.lit(i)) - origin[i] for i, c in enumerate("xyz")]
    east, north, up = (sum((a * b for a, b in zip(away, axis, strict=True)), F.lit(0.0)) * 1000.0 for axis in basis)
    return rows.withColumns({"east_m": east, "north_m": north, "up_m": up})


#: Levels that an interpolated chain is followed up.
WORLD_DEPTH = 16


def world_pose(asked: DataFrame, rows: DataFrame, is_root, key: str = "entity", parent: str = "parent", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """(frame, epoch, root, t, q, hops) as resolve(), but with poses between a key's rows: linear positions and turned
    axes where both rows are in one frame, the earlier row's where not, and the end rows' beyond the ends.

    A frame without any row counts as unmoved in a root of its own; WORLD_DEPTH levels at most, the rest is left out.
    """
    from wherewhen.plans.tables import settled

    names = {parent: "up", "x": "px", "y": "py", "z": "pz", "quaternion": "pq", epoch: "pt"}
    later = {c: f"{n}2" for c, n in names.items()}
    firsts = settled(rows.groupBy(key, epoch).agg(F.min_by(F.struct(parent, "x", "y", "z", "quaternion"), seq).alias("_r")).select(key, epoch, "_r.*"), "first-rows").withColumn("_none", F.lit(0))
    mirrored = firsts.withColumn("_back", -F.col(epoch))
    one = quat.motion(quat.vector(0, 0, 0), quat.vector(*quat.IDENTITY))
    open_ = asked.distinct().select("frame", "epoch", F.col("frame").alias("at"), one.alias("m"), F.lit(0).alias("hops"))
    done = open_.where(is_root(F.col("at")))
    open_ = open_.where(~is_root(F.col("at")))
    for _ in range(WORLD_DEPTH):
        need = open_.select("at", "epoch").distinct().withColumn("_back", -F.col("epoch"))
        found = asof_join(need, firsts, "at", key, "epoch", epoch, names, "_none", unique=True)
        found = asof_join(found, mirrored, "at", key, "_back", "_back", later, "_none", unique=True)
        before, after = F.col("pt").isNotNull(), F.col("pt2").isNotNull()
        share = F.when(F.col("pt2") > F.col("pt"), (F.col("epoch") - F.col("pt")) / (F.col("pt2") - F.col("pt"))).otherwise(F.lit(0.0))
        first = quat.motion(quat.vector(F.col("px"), F.col("py"), F.col("pz")), F.col("pq"))
        second = quat.motion(quat.vector(F.col("px2"), F.col("py2"), F.col("pz2")), F.col("pq2"))
        line = quat.add(first["t"], quat.scale(quat.sub(second["t"], first["t"]), share))
        hop = F.when(before & after & (F.col("up") == F.col("up2")), quat.motion(line, quat.slerp(F.col("pq"), F.col("pq2"), share))).when(before, first).when(after, second)
        up = F.when(before, F.col("up")).otherwise(F.col("up2"))
        step = open_.join(found.select("at", "epoch", up.alias("up"), hop.alias("hop")), ["at", "epoch"])
        step = settled(step.select("frame", "epoch", F.coalesce("up", "at").alias("at"), F.when(F.col("hop").isNull(), F.col("m")).otherwise(quat.compose(F.col("hop"), F.col("m"))).alias("m"), (F.col("hops") + F.col("up").isNotNull().cast("int")).alias("hops"), F.col("up").isNull().alias("end")), "chain")
        ended = F.col("end") | is_root(F.col("at"))
        done = done.unionByName(step.where(ended).drop("end"))
        open_ = step.where(~ended).drop("end")
        if open_.isEmpty():
            break
    return done.select("frame", "epoch", F.col("at").alias("root"), F.col("m.t").alias("t"), F.col("m.q").alias("q"), "hops")
