"""Arrow IPC files and other small formats at the edges of the engine; large tables are Parquet."""

from __future__ import annotations

import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(kind: pa.DataType) -> pa.DataType:
    """The same type without what Spark lacks: unsigned integers, fixed sizes, dictionaries."""
    if isinstance(kind, pa.BaseExtensionType):
        kind = kind.storage_type
    if pa.types.is_uint8(kind):
        return pa.int16()
    if pa.types.is_uint16(kind):
        return pa.int32()
    if pa.types.is_uint32(kind) or pa.types.is_uint64(kind):
        return pa.int64()
    if pa.types.is_fixed_size_binary(kind):
        return pa.binary()
    if pa.types.is_fixed_size_list(kind) or pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type), f.nullable) for f in kind])
    return _plain(kind.value_type) if pa.types.is_dictionary(kind) else kind


def _table(table: pa.Table) -> pa.Table:
    return table.cast(pa.schema([pa.field(f.name, _plain(f.type), f.nullable) for f in table.schema]))


def check_ipc(data: bytes, what: str = "file") -> bytes:
    """data, or ValueError with what it seems to be: not every URL answers with Arrow."""
    if data[:6] != b"ARROW1":
        looks = "an HTML page" if data.lstrip()[:1] == b"<" else "no Arrow file"
        raise ValueError(f"{what} is {looks}")
    return data


def read_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    with pa.ipc.open_file(pa.BufferReader(check_ipc(data, "data"))) as r:
        return spark.createDataFrame(_table(r.read_all()))


def _opened(data: bytes, what: str):
    return pa.ipc.open_file(pa.BufferReader(check_ipc(data, what)))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, from whatever store Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, to whatever store Spark writes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(text.encode())
    out.close()


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of an Arrow IPC file, or of the first file of a folder of them; a file without batches has one too."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def peek(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.record_batch({"schema": pa.array([_table(_opened(data, name).schema.empty_table()).schema.serialize().to_pybytes()], pa.binary())})

    found = spark.read.format("binaryFile").load(path).limit(1).select("path", "content").mapInArrow(peek, "schema binary").first()
    if found is None:
        raise ValueError(f"{path} holds no files")
    return from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(found["schema"])))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """All batches of an Arrow IPC file, or of a folder of files of one schema; a file with none has its schema. Files are read by executors, each whole by one."""

    def batches_of(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with _opened(data, name) as r:
                    for i in range(r.num_record_batches):
                        yield from _table(pa.Table.from_batches([r.get_batch(i)])).to_batches()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(batches_of, read_schema(spark, path))


def write_bytes(df: DataFrame, rows_per_batch: int = 65_536) -> bytes:
    """One self-contained file in memory; for results that fit the driver."""
    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table, rows_per_batch)
    return sink.getvalue().to_pybytes()


def write_file(df: DataFrame, path: str, rows_per_batch: int = 65_536) -> None:
    """One self-contained file on this machine; for results that fit the driver. write_files() is for others."""
    with open(path, "wb") as f:
        f.write(write_bytes(df, rows_per_batch))


def write_files(df: DataFrame, path: str, rows_per_batch: int = 65_536) -> DataFrame:
    """A folder of self-contained files, one for each partition with rows, written by the executors; (file, n_rows) of each.

    path is of a file system that pyarrow knows and all executors share. A task that is run again writes its file again.
    """
    from pyarrow import fs

    def store(batches):
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        name, n, writer, out = f"part-{TaskContext.get().partitionId():05d}.arrow", 0, None, None
        draft = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if writer is None:
                out = system.open_output_stream(draft)
                writer = pa.ipc.new_file(out, batch.schema)
            for at in range(0, batch.num_rows, rows_per_batch):
                writer.write_batch(batch.slice(at, rows_per_batch))
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            system.move(draft, f"{folder}/{name}")
            yield pa.record_batch({"file": pa.array([name]), "n_rows": pa.array([n], pa.int64())})

    rows = df.mapInArrow(store, "file string, n_rows long").collect()  # one row a partition
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "file string, n_rows long")


def write_schema(schema: T.StructType, path: str) -> None:
    with open(path, "w") as f:
        f.write(schema.json())


def load_schema(path: str) -> T.StructType:
    with open(path) as f:
        return T.StructType.fromJson(json.load(f))


def read_horizons(spark: SparkSession, path: str) -> DataFrame:
    """(t, x, y, z, vx, vy, vz) of a vector table in CSV between its $$SOE and $$EOE lines."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_extract("value", r"(?s)\$\$SOE\s*\n(.*?)\$\$EOE", 1), "\n")).alias("line"))
    c = F.split("line", r"\s*,\s*")
    t = F.to_timestamp(F.regexp_replace(F.get(c, F.lit(1)), r"^A\.D\. ", ""), "yyyy-MMM-dd HH:mm:ss.SSSS")
    return lines.where(F.size(c) >= 8).select(t.alias("t"), *[F.get(c, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "vx", "vy", "vz"), 2)])


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(id, rings, west, south, east, north) of a GeoJSON file's polygons; rings are arrays of (x, y), the first the outline."""
    ring = "array<array<array<double>>>"
    one = "struct<type:string,features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", one).alias("g")).select(F.posexplode("g.features").alias("id", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    many = F.when(kind == "Polygon", F.array(F.from_json(text, ring))).when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>"))
    polygons = raw.select("id", F.explode(many).alias("rings"))

    def outline(k: int):
        return F.transform(F.get("rings", F.lit(0)), lambda p: F.get(p, F.lit(k)))

    x, y = outline(0), outline(1)
    return polygons.select("id", "rings", F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))


def spk_segments(data: bytes) -> list[tuple[int, int]]:
    """(target, centre) of the segments of a binary SPK kernel, from the summary records of its DAF container."""
    if data[:7] != b"DAF/SPK":
        raise ValueError("not an SPK kernel")
    order = "<" if data[88:96] == b"LTL-IEEE" else ">"
    nd, ni = struct.unpack_from(order + "2i", data, 8)
    (record,) = struct.unpack_from(order + "i", data, 76)
    size, out = nd + (ni + 1) // 2, []
    while record:
        at = (record - 1) * 1024
        nxt, _, n = struct.unpack_from(order + "3d", data, at)
        for k in range(int(n)):
            target, centre = struct.unpack_from(order + "2i", data, at + 24 + 8 * (k * size + nd))
            out.append((target, centre))
        record = int(nxt)
    return out


_SIZES = {"": 1, "B": 1, "K": 10**3, "KB": 10**3, "M": 10**6, "MB": 10**6, "G": 10**9, "GB": 10**9, "T": 10**12, "TB": 10**12, "KIB": 1 << 10, "MIB": 1 << 20, "GIB": 1 << 30, "TIB": 1 << 40}


def byte_size(text: str) -> int:
    """"5GB" or "512 MiB" in bytes; units of 1000 or, with an i, of 1024."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in _SIZES:
        raise ValueError(f"not a size: {text!r}")
    size = float(m[1]) * _SIZES[m[2].upper()] if "." in m[1] else int(m[1]) * _SIZES[m[2].upper()]
    if size >= 1 << 64:
        raise ValueError(f"too large: {text!r}")
    return int(size)


def grid(spark: SparkSession, extent_m: float, step_m: float) -> DataFrame:
    """(e, n) of a flat lattice from -extent to extent."""
    k = int(extent_m // step_m)
    line = spark.range(-k, k + 1)
    row = F.sequence(F.lit(-k), F.lit(k))
    return line.select((F.col("id") * F.lit(float(step_m))).alias("e"), F.explode(row).alias("j")).select("e", (F.col("j") * F.lit(float(step_m))).alias("n"))
