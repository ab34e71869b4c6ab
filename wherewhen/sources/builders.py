"""Observation rows from columns, tokens or Python values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wherewhen.functions import ident, timeconv, vocab
from wherewhen.operators import rows as R


def build_observation(frame: Column, source: Column, epoch: Column, position: Column, quaternion: Column, units: Column | None = None, estimate: Column | None = None, position_covariance: Column | None = None, orientation_covariance: Column | None = None) -> Column:
    """One observation as a struct, in TAI; epoch in TAI nanoseconds since J2000."""
    none = F.lit(None).cast("array<double>")
    c, ns = timeconv.parts(epoch)
    code = lambda x: (F.lit(1) if x is None else x).cast("smallint")
    return F.struct(frame.alias("frame_id"), code(units).alias("units_pos"), F.lit(1).cast("smallint").alias("timescale_id"), source.alias("source_id"), code(estimate).alias("estimate_type"), position.alias("position"), quaternion.alias("quaternion"), c.alias("duration_centuries"), ns.alias("duration_ns"), (none if position_covariance is None else position_covariance).alias("position_covariance"), (none if orientation_covariance is None else orientation_covariance).alias("orientation_covariance"))


def build_entities(df: DataFrame, entity: Column, velocity: Column | None = None, angular_velocity: Column | None = None, acceleration: Column | None = None, mass_kg: Column | None = None, state_covariance: Column | None = None, dimensions: Column | None = None, **observation) -> DataFrame:
    """Entity rows in the ledger's layout from columns of df; what isn't given is null."""
    none = F.lit(None).cast("array<double>")
    rest = {"velocity": velocity, "angular_velocity": angular_velocity, "acceleration": acceleration, "state_covariance": state_covariance, "dimensions": dimensions}
    named = {k: (none if c is None else c) for k, c in rest.items()} | {"mass_kg": F.lit(None).cast("double") if mass_kg is None else mass_kg}
    out = df.select(entity.alias("entity_id"), build_observation(**observation).alias(R.STRUCT), *[c.alias(k) for k, c in named.items()])
    return out.select(*R.ENTITY.fieldNames())


#: Columns of tokens(): what a row says in words, and its numbers.
TOKENS = "authority string, name string, frame string, frame_authority string, units string, timescale string, source string, estimate string, epoch_ns bigint, position array<double>, quaternion array<double>"


def frame_of(name: Column, authority: Column) -> Column:
    """The id of a frame in words: an entity's where there is an authority, else the astronomical frame of that very name; null for none."""
    known = F.create_map(*[F.lit(x) for n, e, o in ident.FRAMES for x in (n, ident.astro_bytes(e, o).hex())])
    return F.when(authority.isNotNull(), ident.mint_entity(authority, name)).otherwise(F.unhex(F.try_element_at(known, name)))


def from_tokens(df: DataFrame) -> DataFrame:
    """Entity rows from a table of TOKENS. Words become codes and ids, and the epoch - nanoseconds since J2000 in its own scale - is shifted to TAI.

    A word that is in no vocabulary, or a frame or name that gives no id, raises when such a row is read.
    """
    sure = lambda c, kind, what: F.coalesce(c, F.raise_error(F.lit(what)).cast(kind))
    code = lambda column, words: sure(vocab.encode(F.col(column), words), "smallint", f"no such word in {column}")
    scale = code("timescale", vocab.TIME_SCALES)
    tai = sure(timeconv.to_tai(F.col("epoch_ns"), scale), "bigint", "a time scale has no constant offset to TAI")
    return build_entities(
        df,
        sure(ident.mint_entity(F.col("authority"), F.col("name")), "binary", "authority and name must not be empty"),
        frame=sure(frame_of(F.col("frame"), F.col("frame_authority")), "binary", "no such frame"),
        source=sure(ident.mint_abstract(F.col("authority"), F.col("source")), "binary", "no source"),
        epoch=tai,
        position=F.col("position"),
        quaternion=F.coalesce("quaternion", F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)])),
        units=code("units", vocab.LENGTH_UNITS),
        estimate=code("estimate", vocab.ESTIMATES),
    )


class RowBuffer:
    """Rows that a client collects one by one and hands over as one batch; checked against a schema as they come."""

    def __init__(self, spark: SparkSession, schema: T.StructType | None = None):
        self.spark, self.schema, self.rows = spark, schema or T._parse_datatype_string(TOKENS), []

    def append(self, **values) -> None:
        """One row by column names; columns left out are null, others raise."""
        unknown = set(values) - set(self.schema.fieldNames())
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")
        row = tuple(values.get(f.name) for f in self.schema.fields)
        T._make_type_verifier(self.schema)(row)
        self.rows.append(row)

    def __len__(self) -> int:
        return len(self.rows)

    def flush(self) -> DataFrame:
        """The rows so far as a table; the buffer is empty after."""
        rows, self.rows = self.rows, []
        return self.spark.createDataFrame(rows, self.schema)


def observations_from(spark: SparkSession, rows: list[Mapping]) -> DataFrame:
    """Flat observation rows (R.FIELDS) from Python mappings; every field has to be there, with its type."""
    return spark.createDataFrame([tuple(r[f.name] for f in R.FIELDS.fields) for r in rows], R.FIELDS)


def entities_from(spark: SparkSession, rows: list[Mapping]) -> DataFrame:
    """Entity rows (R.ENTITY) from Python mappings with the observation's fields inside or beside the others."""
    made = []
    for r in rows:
        inner = r.get(R.STRUCT, r)
        made.append(tuple(tuple(inner.get(f.name) for f in R.FIELDS.fields) if g.name == R.STRUCT else r.get(g.name) for g in R.ENTITY.fields))
    return spark.createDataFrame(made, R.ENTITY)


def as_struct(df: DataFrame, name: str = R.STRUCT) -> DataFrame:
    """Flat observation rows with their fields in one struct column."""
    fields = R.FIELDS.fieldNames()
    return df.select(*[c for c in df.columns if c not in fields], F.struct(*fields).alias(name))
