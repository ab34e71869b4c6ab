"""Reading tables and sizing the work of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import math
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one pass in the JVM that moves one number."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def chunked(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(chunk, key, text): rows dealt by a hash of key and text into chunks of about chunk_bytes, as many as size asks for.

    Other columns are left out, so clashing names do no harm. A chunk is what one Python call holds; it stays
    of one size however large the input is, but for a text that is longer by itself. Rows of one key, or without
    one, spread by their texts, and copies of a text by their keys.
    """
    n = max(8, math.ceil(size / chunk_bytes))
    return docs.select(F.pmod(F.xxhash64(key, text), F.lit(n)).alias("chunk"), F.col(key).alias(key), F.col(text).alias(text))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode one of this machine's own will do where it is unset; on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wherewhen-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there and lost executors don't matter. files: at most so many, for tables that are small beside the stages that make them."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wherewhen-{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Text bytes for each file of a table that has some bytes a document.
NARROW_BYTES = 16 << 20


def narrow_files(size: int) -> int:
    """Files for tables that have some bytes for each document of size bytes of text."""
    return max(12, math.ceil(size / NARROW_BYTES))


def driver_table(spark: SparkSession, columns: dict[str, list], ddl: str) -> DataFrame:
    """A table of the driver's own columns, through Arrow: from a list of rows Spark would start Python workers of another kind, and keep them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(_parse_datatype_string(ddl))), ddl)


#: Workers that have grown by so many bytes give what they don't use back to the system.
RELEASE_BYTES = 32 << 20
_left = 0


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE")


def release() -> None:
    """Gives a Python worker's freed memory back to the system: workers stay, idle, beside the stages that follow. Where there is no /proc or malloc_trim nothing happens."""
    global _left
    import pyarrow as pa

    try:
        if _resident() > _left + RELEASE_BYTES:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            _left = _resident()
    except (OSError, AttributeError):
        pass


#: What operators keep in a worker from task to task: an operator's name, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, drop: Callable[[], None]) -> None:
    """Says that an operator keeps something in this worker, until another operator uses the worker."""
    _kept[name] = drop


def _begin(name: str) -> None:
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()


def light(visit, name: str = ""):
    """visit, for applyInArrow, without what other operators than name keep, and with a release() after each group."""

    def run(table):
        _begin(name)
        out = visit(table)
        release()
        return out

    return run


def light_pair(visit, name: str = ""):
    """light() for cogrouped tables."""

    def run(left, right):
        _begin(name)
        out = visit(left, right)
        release()
        return out

    return run


def light_map(visit, name: str = ""):
    """light() for mapInArrow: a release() after each batch and at the end."""

    def run(batches):
        _begin(name)
        for batch in visit(batches):
            yield batch
            del batch
            release()
        release()

    return run


FILTER_BITS = 1 << 26


def _bits(table):
    import numpy as np
    import pyarrow as pa

    bits = np.zeros(1 << 15, dtype=bool)
    bits[table.column("bit").to_numpy() & 32767] = True
    return pa.table({"cell": table.column("cell").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def filter_bits(ids: DataFrame, key: str):
    """A filter of FILTER_BITS bits, whatever the number of ids: the bit of every id is set, and few others'."""
    import numpy as np

    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    found = ids.select(bit.alias("bit")).distinct().withColumn("cell", F.shiftright("bit", 15)).groupBy("cell").applyInArrow(_bits, "cell long, bits binary").collect()
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in found:
        bits[r["cell"] * 4096 : (r["cell"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in ids (one column, of the same name). Rows with a null key stay.

    A filter of fixed size settles most rows where they are; only the rows that it can't clear, with their
    texts, are shuffled for the exact join.
    """
    ids = settled(ids.where(F.col(key).isNotNull()).select(F.col(key).alias("_gone")).distinct(), "gone")
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits(ids, "_gone"))

    @F.pandas_udf("boolean")
    def maybe(bit: pd.Series) -> pd.Series:
        n = bit.to_numpy()
        return pd.Series((shared.value[n >> 3] >> (7 - (n & 7)).astype("uint8") & 1).astype(bool))

    kept = docs.columns
    flagged = docs.withColumn("_maybe", maybe(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))) & F.col(key).isNotNull())
    doubt = flagged.where("_maybe").select(kept)
    return flagged.where("NOT _maybe").select(kept).union(doubt.join(ids, doubt[key] == ids["_gone"], "left_anti"))
