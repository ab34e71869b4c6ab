"""Sixteen-byte identities derived from names, as column expressions.

An id is a version 8 UUID whose low nibble of byte 6 is its kind: an astronomical frame that embeds its two
numbers, an entity whose pose comes from rows, or a source that is never a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASTRO, ENTITY, ABSTRACT = 0, 1, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The namespace of the hashed ids, and the frames by name with their ephemeris and orientation numbers.
NAMESPACE = bytes([0xEE, 0x8C, 0x42, 0x09, 0x0D, 0xD5, 0x9D, 0x8D, 0x14, 0xAF, 0xC9, 0x54, 0x1C, 0xAF, 0xE9, 0x5D])
FRAMES = (
    ("ICRF", 0, 1), ("J2000", 0, 1), ("SSB", 0, 1), ("GCRF", 399, 1), ("EME2000", 399, 1), ("EMB", 3, 1),
    ("MERCURY_BARYCENTER", 1, 1), ("VENUS_BARYCENTER", 2, 1), ("MARS_BARYCENTER", 4, 1), ("JUPITER_BARYCENTER", 5, 1),
    ("SATURN_BARYCENTER", 6, 1), ("URANUS_BARYCENTER", 7, 1), ("NEPTUNE_BARYCENTER", 8, 1), ("PLUTO_BARYCENTER", 9, 1),
    ("Sun", 10, 10), ("Mercury", 199, 199), ("Venus", 299, 299), ("Earth", 399, 399), ("Moon", 301, 301), ("Mars", 499, 499),
    ("Jupiter", 599, 599), ("Saturn", 699, 699), ("Uranus", 799, 799), ("Neptune", 899, 899),
    ("Pluto", 999, 1), ("Phobos", 401, 1), ("Deimos", 402, 1), ("Io", 501, 1), ("Europa", 502, 1), ("Ganymede", 503, 1),
    ("Callisto", 504, 1), ("Titan", 606, 1), ("Enceladus", 602, 1),
    ("IAU_SUN", 10, 10), ("IAU_MERCURY", 199, 199), ("IAU_VENUS", 299, 299), ("IAU_EARTH", 399, 399), ("IAU_MOON", 301, 301),
    ("IAU_MARS", 499, 499), ("IAU_JUPITER", 599, 599), ("IAU_SATURN", 699, 699), ("IAU_URANUS", 799, 799), ("IAU_NEPTUNE", 899, 899),
    ("IAU_PLUTO", 999, 999), ("IAU_CHARON", 901, 901), ("IAU_PHOBOS", 401, 401), ("IAU_DEIMOS", 402, 402), ("IAU_IO", 501, 501),
    ("IAU_EUROPA", 502, 502), ("IAU_GANYMEDE", 503, 503), ("IAU_CALLISTO", 504, 504), ("IAU_MIMAS", 601, 601), ("IAU_ENCELADUS", 602, 602),
    ("IAU_TETHYS", 603, 603), ("IAU_DIONE", 604, 604), ("IAU_RHEA", 605, 605), ("IAU_TITAN", 606, 606), ("IAU_IAPETUS", 608, 608),
    ("IAU_ARIEL", 701, 701), ("IAU_UMBRIEL", 702, 702), ("IAU_TITANIA", 703, 703), ("IAU_OBERON", 704, 704), ("IAU_MIRANDA", 705, 705),
    ("IAU_TRITON", 801, 801),
)
BODIES = (("Sun", 10), ("Mercury", 199), ("Venus", 299), ("Earth", 399), ("Moon", 301), ("Mars", 499), ("Jupiter", 599), ("Saturn", 699), ("Uranus", 799), ("Neptune", 899))


def _blob(data: bytes) -> Column:
    return F.lit(bytearray(data))


def _mint(kind: int, authority: Column, name: Column) -> Column:
    folded = F.translate(authority, _UPPER, _LOWER)
    digest = F.sha2(F.concat(_blob(NAMESPACE + bytes([kind])), F.encode(folded, "UTF-8"), _blob(b"\0"), F.encode(name, "UTF-8")), 256)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    stamped = F.concat(F.substring(digest, 1, 12), F.lit(f"8{kind:x}"), F.substring(digest, 15, 2), variant, F.substring(digest, 18, 15))
    empty = (F.char_length(authority) == 0) | (F.char_length(name) == 0) | authority.contains("\0") | name.contains("\0")
    # joined to the text, not a branch around it: what stands in a branch alone is worked out anew for each place that names it, here the digest's five
    return F.unhex(F.concat(stamped, F.when(empty, F.lit(None).cast("string")).otherwise(F.lit(""))))


def mint_entity(authority: Column, name: Column) -> Column:
    """The id of an entity; null where a part is null, empty or holds NUL."""
    return _mint(ENTITY, authority, name)


def mint_abstract(authority: Column, name: Column) -> Column:
    """The id of a source that is never a frame."""
    return _mint(ABSTRACT, authority, name)


def _int_hex(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.pmod(n.cast("bigint"), F.lit(1 << 32))), 8, "0"))


def astro_id(ephemeris: Column, orientation: Column) -> Column:
    """The id of an astronomical frame; null unless the pair is one of FRAMES."""
    known = F.lit(False)
    for pair in sorted({(e, o) for _, e, o in FRAMES}):
        known = known | ((ephemeris == pair[0]) & (orientation == pair[1]))
    return F.when(known, F.unhex(F.concat(_int_hex(ephemeris), F.lit("0000800080"), _int_hex(orientation), F.lit("000000"))))


def astro_bytes(ephemeris: int, orientation: int) -> bytes:
    if not any((e, o) == (ephemeris, orientation) for _, e, o in FRAMES):
        raise ValueError(f"no frame ({ephemeris}, {orientation})")
    return ephemeris.to_bytes(4, "big", signed=True) + b"\0\0\x80\0\x80" + orientation.to_bytes(4, "big", signed=True) + b"\0\0\0"


def frame_bytes(name: str) -> bytes:
    """The id of a frame's name, which has to match byte for byte."""
    for n, e, o in FRAMES:
        if n == name:
            return astro_bytes(e, o)
    raise ValueError(f"no frame is named {name!r}")


def frames(spark: SparkSession) -> DataFrame:
    """(name, ephemeris_id, orientation_id, frame_id, rank): the lowest rank is a pair's own name."""
    rows = [(n, e, o, bytearray(astro_bytes(e, o)), i) for i, (n, e, o) in enumerate(FRAMES)]
    return spark.createDataFrame(rows, "name string, ephemeris_id int, orientation_id int, frame_id binary, rank int")


def registrable_names(spark: SparkSession) -> DataFrame:
    """(name) of the frames whose own names a registry may hold: those that are the first of their numbers."""
    return frames(spark).groupBy("ephemeris_id", "orientation_id").agg(F.min_by("name", "rank").alias("name")).select("name")


def is_registrable(name: Column) -> Column:
    """Whether a name is a frame's own."""
    first = {}
    for n, e, o in FRAMES:
        first.setdefault((e, o), n)
    return F.coalesce(name.isin(*first.values()), F.lit(False))


def bodies(spark: SparkSession) -> DataFrame:
    """(body, naif_id, entity_id) of the ten bodies, by distance."""
    return spark.createDataFrame([(n, i, bytearray(astro_bytes(i, i))) for n, i in BODIES], "body string, naif_id int, entity_id binary")


def kind(id_: Column) -> Column:
    return F.conv(F.substring(F.hex(id_), 14, 1), 16, 10).cast("int")


def is_valid(id_: Column) -> Column:
    """Sixteen bytes, version 8, RFC variant; null isn't valid."""
    text = F.hex(id_)
    return F.coalesce((F.octet_length(id_) == 16) & (F.substring(text, 13, 1) == "8") & F.substring(text, 17, 1).isin("8", "9", "A", "B"), F.lit(False))


def _signed(hex8: Column) -> Column:
    n = F.conv(hex8, 16, 10).cast("bigint")
    return (n - F.when(n >= (1 << 31), F.lit(1 << 32)).otherwise(F.lit(0))).cast("int")


def astro_frame(id_: Column) -> tuple[Column, Column]:
    """The two numbers that an astronomical id embeds; null for other kinds."""
    text, astro = F.hex(id_), kind(id_) == ASTRO
    return F.when(astro, _signed(F.substring(text, 1, 8))), F.when(astro, _signed(F.substring(text, 19, 8)))


def hyphenated(id_: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(id_)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def parse_hex(text: Column) -> Column:
    """An id from 32 hex digits, with hyphens or without; null for anything else."""
    plain = F.replace(text, F.lit("-"), F.lit(""))
    return F.when(plain.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(plain))


def default_centre(ephemeris: Column) -> Column:
    """The NAIF number that a body orbits by numbering: planets and barycentres the Sun, moons their planet; else null."""
    tail = ephemeris % 100
    return F.when(ephemeris.between(1, 9) | (ephemeris.between(100, 999) & (tail == 99)), F.lit(10)).when(ephemeris.between(100, 999) & (tail != 0), ephemeris - tail + 99)


def label(rows: DataFrame, id_column: str, names: DataFrame | None = None) -> DataFrame:
    """rows with label: a frame's own name, else the registered name, else the id's hyphenated text."""
    own = frames(rows.sparkSession).groupBy("frame_id").agg(F.min_by("name", "rank").alias("_frame"))
    out = rows.join(F.broadcast(own), rows[id_column] == own["frame_id"], "left").drop("frame_id" if id_column != "frame_id" else own["frame_id"])
    if names is not None:
        known = names.select(F.col("prescribed_id").alias("_id"), F.col("common_name").alias("_name"))
        out = out.join(known, out[id_column] == known["_id"], "left").drop("_id")
    else:
        out = out.withColumn("_name", F.lit(None).cast("string"))
    return out.withColumn("label", F.coalesce("_frame", "_name", hyphenated(F.col(id_column)))).drop("_frame", "_name")
