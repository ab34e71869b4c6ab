"""Observation rows: their layout, filters, projections and checks.

A row has the fields below, either at the top level or inside one struct column. Every function takes the
name of that struct column where there is one; a struct of that name wins over fields at the top level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wherewhen.functions import ident, timeconv, vocab

STRUCT = "observation"
_V = T.ArrayType(T.DoubleType())
FIELDS = T.StructType([
    T.StructField("frame_id", T.BinaryType(), False), T.StructField("units_pos", T.ShortType(), False, {"words": list(vocab.LENGTH_UNITS)}),
    T.StructField("timescale_id", T.ShortType(), False, {"words": list(vocab.TIME_SCALES)}), T.StructField("source_id", T.BinaryType(), False),
    T.StructField("estimate_type", T.ShortType(), False, {"words": list(vocab.ESTIMATES)}), T.StructField("position", _V, False), T.StructField("quaternion", _V, False),
    T.StructField("duration_centuries", T.ShortType(), False), T.StructField("duration_ns", T.LongType(), False),
    T.StructField("position_covariance", _V, True), T.StructField("orientation_covariance", _V, True),
])
ENTITY = T.StructType([
    T.StructField("entity_id", T.BinaryType(), False), T.StructField(STRUCT, FIELDS, False), T.StructField("velocity", _V), T.StructField("angular_velocity", _V),
    T.StructField("acceleration", _V), T.StructField("mass_kg", T.DoubleType()), T.StructField("state_covariance", _V), T.StructField("dimensions", _V),
])


@dataclass(frozen=True)
class LedgerSpec:
    """A ledger's schema and the name of its id column ("" for none)."""

    schema: T.StructType
    id_column: str = "entity_id"

    def __post_init__(self):
        check_schema(self.schema)
        if self.id_column:
            found = {f.name: f.dataType for f in self.schema.fields}
            if found.get(self.id_column) != T.BinaryType():
                raise ValueError(f"id column {self.id_column!r} has to be binary")


def nested(schema: T.StructType, struct: str = STRUCT) -> bool:
    for f in schema.fields:
        if f.name == struct:
            if not isinstance(f.dataType, T.StructType):
                raise TypeError(f"column {struct!r} is not a struct")
            return True
    return False


def field(df: DataFrame, name: str, struct: str = STRUCT) -> Column:
    """A field wherever it stands."""
    return df[struct][name] if nested(df.schema, struct) else df[name]


def check_schema(schema: T.StructType, struct: str = STRUCT) -> None:
    """Raises unless all fields are there with exactly their types; nullability and metadata are free."""
    where = next(f.dataType for f in schema.fields if f.name == struct) if nested(schema, struct) else schema
    types = {f.name: f.dataType for f in where.fields}
    for f in FIELDS.fields:
        if f.name not in types:
            raise ValueError(f"field {f.name!r} is missing")
        if types[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"field {f.name!r} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in schema's layout; raises where names or types differ. Metadata may differ, and nullability is what validate() counts, as files forget it."""

    def same(a: T.DataType, b: T.DataType) -> bool:
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            return len(a) == len(b) and all(x.name == y.name and same(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
        if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            return same(a.elementType, b.elementType)
        return a == b

    if not same(df.schema, schema):
        raise ValueError("schema differs: " + df.schema.simpleString() + " is not " + schema.simpleString())
    return df


def violations(df: DataFrame, id_column: str | None = None, struct: str = STRUCT) -> DataFrame:
    """One row of counts of what validate() rejects."""
    bad = {f"bad_{name}": ~vocab.is_code(field(df, name, struct), words) for name, words in (("units_pos", vocab.LENGTH_UNITS), ("timescale_id", vocab.TIME_SCALES), ("estimate_type", vocab.ESTIMATES))}
    missing = F.lit(False)
    for f in FIELDS.fields:
        if not f.nullable:
            missing = missing | field(df, f.name, struct).isNull()
    bad["missing_field"] = missing
    frame = field(df, "frame_id", struct)
    bad["bad_frame_id"] = frame.isNotNull() & ~ident.is_valid(frame)
    bad["abstract_frame"] = frame.isNotNull() & ident.is_valid(frame) & (ident.kind(frame) == ident.ABSTRACT)
    if id_column:
        own = F.col(id_column)
        bad["bad_entity_id"] = ~ident.is_valid(own) | (ident.kind(own) == ident.ABSTRACT)
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in bad.items()])


def validate(df: DataFrame, id_column: str | None = None, struct: str = STRUCT) -> DataFrame:
    """df, or ValueError if any row has a code out of its vocabulary, a corrupt or abstract frame, or a bad entity id. One aggregate; all or nothing."""
    found = {k: n for k, n in violations(df, id_column, struct).first().asDict().items() if n}
    if found:
        raise ValueError("rejected: " + ", ".join(f"{k} in {n} rows" for k, n in sorted(found.items())))
    return df


def normalize_tai(df: DataFrame, struct: str = STRUCT) -> DataFrame:
    """Every row's epoch in TAI: only the scale and the two parts of the epoch are rewritten. Scales without a constant offset raise when such a row is read."""
    scale = field(df, "timescale_id", struct)
    total = timeconv.total_ns(field(df, "duration_centuries", struct), field(df, "duration_ns", struct))
    tai = F.when(scale == 1, total).otherwise(F.coalesce(timeconv.to_tai(total, scale), F.raise_error(F.lit("a time scale has no constant offset to TAI")).cast("bigint")))
    c, ns = timeconv.parts(tai)
    new = {"timescale_id": F.lit(1).cast("smallint"), "duration_centuries": c, "duration_ns": ns}
    if not nested(df.schema, struct):
        return df.withColumns(new)
    out = df[struct]
    for k, v in new.items():
        out = out.withField(k, v)
    return df.withColumn(struct, out)


def epoch_ns(df: DataFrame, struct: str = STRUCT) -> Column:
    """TAI nanoseconds since J2000, whatever the row's scale."""
    return timeconv.to_tai(timeconv.total_ns(field(df, "duration_centuries", struct), field(df, "duration_ns", struct)), field(df, "timescale_id", struct))


# filters


def in_time(epoch: Column, start, end) -> Column:
    """Both ends included."""
    return (epoch >= F.lit(start)) & (epoch <= F.lit(end))


def in_window(epoch: Column, start, end) -> Column:
    """The start included, the end not."""
    return (epoch >= F.lit(start)) & (epoch < F.lit(end))


def in_sphere(x: Column, y: Column, z: Column, origin, radius: float) -> Column:
    """Squared distance up to the squared radius; rows whose distance isn't a number are kept. Numbers are compared as they are, in the rows' units."""
    d2 = (x - F.lit(float(origin[0]))) ** 2 + (y - F.lit(float(origin[1]))) ** 2 + (z - F.lit(float(origin[2]))) ** 2
    return (d2 <= F.lit(float(radius) ** 2)) | F.isnan(d2)


def require_one_frame(df: DataFrame, frame: Column) -> DataFrame:
    """df, or ValueError if its rows have several frames: distances between mixed frames mean nothing."""
    if len(df.select(frame.alias("f")).where("f IS NOT NULL").distinct().limit(2).collect()) > 1:
        raise ValueError("mixed frames in a spatial filter")
    return df


def with_ids(df: DataFrame, key: str, ids: DataFrame, invert: bool = False) -> DataFrame:
    """Rows whose key is (or is not) in ids, a table with a column of that name."""
    return df.join(ids.select(key).distinct(), key, "left_anti" if invert else "left_semi")


def named_like(df: DataFrame, label: str, patterns: list[str], strict: bool = False) -> DataFrame:
    """Rows whose label contains one of the patterns, whatever the case. strict: ValueError for a pattern that no row has."""
    hits = [F.lower(F.col(label)).contains(p.lower()) for p in patterns]
    if strict and patterns:
        found = df.agg(*[F.coalesce(F.max(h), F.lit(False)).alias(f"p{i}") for i, h in enumerate(hits)]).first()
        missed = [p for i, p in enumerate(patterns) if not found[i]]
        if missed:
            raise ValueError(f"nothing is named like {missed}")
    return df.where(F.coalesce(*[F.when(h, F.lit(True)) for h in hits], F.lit(False)))


def masked(df: DataFrame, mask: Column) -> DataFrame:
    """Rows for which a mask holds; null doesn't."""
    return df.where(F.coalesce(mask, F.lit(False)))


def in_frames(df: DataFrame, frame: Column, frames: list) -> DataFrame:
    """Rows in one of some frames."""
    return df.where(frame.isin(*frames))


def upto(df: DataFrame, end, epoch: str = "epoch_ns") -> DataFrame:
    """Rows at or before an epoch."""
    return df.where(F.col(epoch) <= F.lit(end))


def with_vectors(df: DataFrame, source: str = "position", names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """df with a vector's components as columns; NaN for what is null."""
    nan = F.lit(float("nan"))
    return df.withColumns({n: F.coalesce(F.get(source, F.lit(i)), nan) for i, n in enumerate(names)})


def decoded(df: DataFrame, epoch: str = "epoch_ns") -> DataFrame:
    """df with unit, scale and estimate in words and tai, the epoch as text; columns that are null in every row are left out."""
    out = df.withColumns({"unit": vocab.decode(F.col("units_pos")), "scale": vocab.decode(F.col("timescale_id"), vocab.TIME_SCALES), "estimate": vocab.decode(F.col("estimate_type"), vocab.ESTIMATES), "tai": timeconv.format_tai(F.col(epoch))})
    seen = out.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(out.columns)]).first()
    return out.select(*[F.col(f"`{c}`") for i, c in enumerate(out.columns) if seen[i] is not False])


def with_names(df: DataFrame, key: str, names: DataFrame, names_key: str, name: str, missing: str = "?") -> DataFrame:
    """df with label: the name that a table of names has for key, or missing."""
    known = names.select(F.col(names_key).alias("_key"), F.col(name).alias("_name"))
    return df.join(known, df[key] == known["_key"], "left").select(*df.columns, F.coalesce("_name", F.lit(missing)).alias("label"))


def require_tai(df: DataFrame, struct: str = STRUCT) -> DataFrame:
    """df, or ValueError if any row's epoch isn't in TAI."""
    if not df.where(field(df, "timescale_id", struct) != 1).isEmpty():
        raise ValueError("rows are not in TAI")
    return df


def viewer_rows(df: DataFrame, key: str = "entity_id", epoch: str = "epoch_ns") -> tuple[DataFrame, DataFrame]:
    """(df dealt by key with each key's rows in order of their epochs, the window (first_epoch, last_epoch) of all): what a viewer loads."""
    return df.repartition(key).sortWithinPartitions(key, epoch), df.agg(F.min(epoch).alias("first_epoch"), F.max(epoch).alias("last_epoch"))


def concat(parts: list[DataFrame], order: str | None = None) -> DataFrame:
    """The rows of all parts, by name; with order, that column says which part a row is of, from 0 up."""
    tagged = [p if order is None else p.withColumn(order, F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return out


def sort_dirty(df: DataFrame, key: str, epoch: str, seq: str) -> DataFrame:
    """All rows by key, epoch and the order stored; ranges are sorted apart, no task gets all rows."""
    return df.orderBy(key, epoch, seq)


def slice_chunks(df: DataFrame, order: str, size: Column, most: int) -> DataFrame:
    """df with chunk, from 0 up: runs of rows in order of about most bytes by size, each row whole. Sums go over sorted ranges, as placed() has it, so no task gets all rows."""
    from wherewhen.plans.tables import settled

    spread = settled(df.withColumn("_size", size.cast("bigint")).repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "slices")
    part, before, sums = F.shiftright("_at", 33), 0, []
    for r in spread.groupBy(part.alias("_part")).agg(F.sum("_size").alias("s")).orderBy("_part").toLocalIterator():
        sums.append((r["_part"], before))
        before += r["s"]
    ahead = df.sparkSession.createDataFrame(sums, "_part long, _before long")
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = spread.withColumn("_part", part).join(F.broadcast(ahead), "_part")  # one row a range
    return found.withColumn("chunk", F.floor((F.col("_before") + F.coalesce(F.sum("_size").over(own), F.lit(0))) / F.lit(most)).cast("bigint")).select(*df.columns, "chunk")


def page(df: DataFrame, order: str, offset: int = 0, limit: int | None = None, tail: int | None = None) -> DataFrame:
    """A slice in stored order, or the last rows."""
    if tail is not None:
        return df.orderBy(F.desc(order)).limit(tail)
    out = df.orderBy(order).offset(offset)
    return out if limit is None else out.limit(limit)


def every_nth(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first row of each key and every n-th after it."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where((F.col("_n") - 1) % n == 0).drop("_n")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed: those with the smallest hashes."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def placed(df: DataFrame, *order: str, place: str = "place") -> DataFrame:
    """All rows with their place, from 1 up, in the order of the columns; order tells rows apart, or places of ties are arbitrary.

    Rows are dealt by ranges of order and sorted inside each; a place is the row's number in its range after the rows of
    the ranges before. No task gets all rows. The ranges are written once, as they come from a sample.
    """
    from wherewhen.plans.tables import settled

    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread = settled(spread, "placed")
    part, before, sizes = F.shiftright("_at", 33), 0, []
    for r in spread.groupBy(part.alias("_part")).count().orderBy("_part").toLocalIterator():
        sizes.append((r["_part"], before))
        before += r["count"]
    ahead = df.sparkSession.createDataFrame(sizes, "_part long, _before long")
    found = spread.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return found.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(place))
