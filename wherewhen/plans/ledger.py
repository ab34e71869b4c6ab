"""The ledger: an append-only table of observation rows in Parquet, with its topology and names.

Every batch is written whole to a folder of its own, which a numbered commit file then names; readers see what commits
name, so whole batches or nothing. Of writers that race for a number one wins, and the others number their batch anew.
A commit says what it adds and what it takes out - sealing and eviction replace folders - with the rows, epochs and
bytes of what it adds, by which reads are pruned. Rows get batch_seq and row_seq, the order in which they were stored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wherewhen.functions import ident, timeconv, vocab
from wherewhen.operators import rows as R
from wherewhen.operators import state, topology, transform
from wherewhen.sources import arrow_files
from wherewhen.sources import names as N
from wherewhen.sources.ephemeris import Ephemeris

#: A tail of more batches, or of more bytes, is sealed into one folder.
SEAL_BATCHES, SEAL_BYTES = 50, 256 << 20
LOG = "child binary, parent binary, epoch bigint, seq bigint, old_parent binary"
#: Times that a batch is numbered anew after losing a race.
MAX_RACES = 20


class Ledger:
    """Facade over a folder. Methods return DataFrames or write; no rows are held in memory."""

    def __init__(self, spark: SparkSession, path: str, spec: R.LedgerSpec | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.spec = spec or R.LedgerSpec(R.ENTITY)
        self._seen: dict[int, dict] = {}

    # storage

    def _fs(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _commits(self) -> dict[int, dict]:
        """All commits by number. A commit never changes, so each is read once."""
        fs, at = self._fs("commits")
        if fs.exists(at):
            jvm = self.spark.sparkContext._jvm
            for s in fs.listStatus(at):
                name = s.getPath().getName()
                if name.isdigit() and int(name) not in self._seen:
                    stream = fs.open(s.getPath())
                    self._seen[int(name)] = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                    stream.close()
        return dict(sorted(self._seen.items()))

    def _commit(self, seq: int, entry: dict) -> bool:
        """Writes commit seq unless there is one: the file is complete before it gets its name."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, final = self._fs(f"commits/{seq:012d}")
        _, draft = self._fs(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(entry).encode())
        out.close()
        fs.mkdirs(final.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, none)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or fs.exists(final):
                return False
            raise
        return True

    def _live(self) -> dict[str, dict]:
        """What is stored now: folder to what its commit says of it, in the order of the commits."""
        live: dict[str, dict] = {}
        for seq, entry in self._commits().items():
            for gone in entry.get("drop", ()):
                live.pop(gone, None)
            if entry.get("rows"):
                live[entry["rows"]["dir"]] = entry["rows"] | {"seq": seq}
        return live

    def _stored_schema(self) -> T.StructType:
        return T.StructType([*self.spec.schema.fields, T.StructField("epoch_ns", T.LongType()), T.StructField("batch_seq", T.LongType()), T.StructField("row_seq", T.LongType())])

    def _write(self, df: DataFrame) -> dict:
        """df (of the stored schema) in a new folder, and what a commit says of it."""
        name = f"rows/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        found = self.spark.read.schema(self._stored_schema()).parquet(f"{self.path}/{name}").agg(F.count("*").alias("n"), F.min("epoch_ns").alias("first"), F.max("epoch_ns").alias("last"), F.max("row_seq").alias("row")).first()
        fs, at = self._fs(name)
        return {"dir": name, **found.asDict(), "bytes": fs.getContentSummary(at).getLength()}

    def _write_log(self, log: DataFrame) -> str:
        name = f"topology/{uuid.uuid4().hex}"
        log.select("child", "parent", "epoch", "seq", "old_parent").write.parquet(f"{self.path}/{name}")
        return name

    def _forget(self, *names: str | None) -> None:
        for name in names:
            if name:
                fs, at = self._fs(name)
                fs.delete(at, True)

    def append(self, df: DataFrame, checked: bool = False, token: str | None = None) -> int:
        """Stores a batch and returns its number: conform, validate, normalise, write, commit. A rejected batch changes nothing.

        token: what the batch is known by to its writer; a batch whose token is committed is not stored again.
        row_seq ascends with batches, and in a batch with partitions and rows: 2**33 rows a partition, 2**30
        partitions over the ledger's life.
        """
        batch = R.conform(df, self.spec.schema)
        if not checked:
            R.validate(batch, self.spec.id_column or None)
        batch = R.normalize_tai(batch)
        batch = batch.withColumn("epoch_ns", R.epoch_ns(batch))
        for _ in range(MAX_RACES):
            commits = self._commits()
            if token is not None:
                for seq, entry in commits.items():
                    if entry.get("token") == token:
                        return seq
            seq = max(commits, default=-1) + 1
            base = max((e["next"] for e in commits.values()), default=0)
            known = self.tree() if commits else None
            rows = self._write(batch.withColumns({"batch_seq": F.lit(seq).cast("bigint"), "row_seq": F.lit(base).cast("bigint") + F.monotonically_increasing_id()}))
            log = None
            try:
                if self.spec.id_column:
                    log = self._ingest(rows["dir"], known)
                after = base if rows["row"] is None else ((rows["row"] >> 33) + 1) << 33
                if self._commit(seq, {"rows": rows, "log": log, "next": after, "token": token}):
                    return seq
            except BaseException:
                self._forget(rows["dir"], log)
                raise
            self._forget(rows["dir"], log)
        raise RuntimeError(f"lost {MAX_RACES} races for a batch number")

    def _ingest(self, name: str, known: DataFrame | None) -> str:
        """The events of a folder of rows, written; ValueError if they would close a cycle."""
        out = self.spark.read.schema(self._stored_schema()).parquet(f"{self.path}/{name}")
        log = topology.events(out.select(F.col(self.spec.id_column).alias("entity"), R.field(out, "frame_id").alias("parent"), "epoch_ns", "row_seq"), known=known)
        written = self._write_log(log)
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/{written}")
        edges = log.groupBy("child").agg(F.max_by("parent", F.struct("epoch", "seq")).alias("parent"))
        entity = edges.where(ident.kind(F.col("parent")) == ident.ENTITY)
        if not entity.isEmpty():
            now = entity if known is None else known.join(edges.select("child"), "child", "left_anti").where(ident.kind(F.col("parent")) == ident.ENTITY).select("child", "parent").unionByName(entity)
            try:
                topology.require_acyclic(now)
            except ValueError:
                self._forget(written)
                raise
        return written

    def _read(self, folders: list[str]) -> DataFrame:
        schema = self._stored_schema()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def rows(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """All rows; or those of the batches that reach into a closed range of epochs - not all of which need lie in it."""
        live = self._live().values()
        some = [x["dir"] for x in live if x["n"] and (start is None or x["last"] >= start) and (end is None or x["first"] <= end)]
        return self._read(some)

    def is_empty(self) -> bool:
        return not any(x["n"] for x in self._live().values())

    def schema(self) -> T.StructType:
        return self.spec.schema

    def _latest(self) -> int | None:
        """The largest epoch, from the commits alone."""
        return max((x["last"] for x in self._live().values() if x["n"]), default=None)

    # sealing, eviction, copies

    def seal(self, most: int = SEAL_BATCHES, most_bytes: int = SEAL_BYTES) -> bool:
        """Puts the tail - the batches since the last seal - into one folder ordered by entity and epoch, if it has over most of them or over most_bytes; says whether it did. Rows keep their numbers."""
        tail: list[dict] = []
        for x in self._live().values():
            tail = [] if x.get("sealed") else [*tail, x]
        if len(tail) < 2 or (len(tail) <= most and sum(x["bytes"] for x in tail) <= most_bytes):
            return False
        return self._replace([x["dir"] for x in tail], self._read([x["dir"] for x in tail if x["n"]]), sealed=True)

    def _replace(self, gone: list[str], df: DataFrame, sealed: bool, trim: int | None = None) -> bool:
        """Takes folders out and puts df in, in one commit; False if another writer was first."""
        commits = self._commits()
        seq = max(commits, default=-1) + 1
        key = [self.spec.id_column] if self.spec.id_column else []
        size = max(1, sum(x["bytes"] for x in self._live().values() if x["dir"] in gone) // SEAL_BYTES)
        rows = self._write(df.repartitionByRange(size, "epoch_ns").sortWithinPartitions(*key, "epoch_ns", "row_seq")) | {"sealed": sealed}
        entry = {"rows": rows, "drop": gone, "next": max(e["next"] for e in commits.values())}
        if trim is not None:
            entry |= {"log": self._write_log(topology.trim(self.topology_log(), trim)), "log_drop": [e["log"] for e in commits.values() if e.get("log")]}
        if not self._commit(seq, entry):
            self._forget(rows["dir"], entry.get("log"))
            return False
        return True

    def evict(self, most_bytes: int) -> int:
        """Takes out the oldest batches, by their last epoch, until what is stored fits most_bytes; each row at its
        entity's latest epoch stays, and the log is trimmed to what the rest needs. Returns how many batches went."""
        if not self.spec.id_column:
            raise ValueError("eviction needs an id column")
        live = sorted(self._live().values(), key=lambda x: (x["last"] is not None, x["last"] or 0, x["seq"]))
        held, gone = sum(x["bytes"] for x in live), []
        while held > most_bytes and len(gone) + 1 < len(live):
            gone.append(live[len(gone)])
            held -= gone[-1]["bytes"]
        if not gone:
            return 0
        kept = [x["first"] for x in live[len(gone) :] if x["n"]]
        last = self.rows().groupBy(self.spec.id_column).agg(F.max("epoch_ns").alias("_last"))
        pinned = self._read([x["dir"] for x in gone if x["n"]]).join(last, self.spec.id_column).where(F.col("epoch_ns") == F.col("_last")).select(self._stored_schema().fieldNames())
        if not self._replace([x["dir"] for x in gone], pinned, sealed=True, trim=min(kept, default=None)):
            raise RuntimeError("another writer was first")
        return len(gone)

    def _copy(self, target: str, rows: DataFrame, log: DataFrame) -> Ledger:
        out = Ledger(self.spark, target, self.spec)
        written = out._write(rows) | {"sealed": True}
        after = 0 if written["row"] is None else ((written["row"] >> 33) + 1) << 33
        if not out._commit(0, {"rows": written, "log": out._write_log(log), "next": after}):
            out._forget(written["dir"])
            raise ValueError(f"there is a ledger at {target}")
        return out

    def compact(self, target: str, files: int = 8) -> Ledger:
        """A copy with its rows in few files, ordered by entity and epoch within ranges of the epoch."""
        return self._copy(target, self.index_by_entity(files), self.topology_log())

    def retain(self, target: str, window_start: int) -> Ledger:
        """A copy without rows older than window_start but for those at their entity's latest epoch; the log is trimmed alike."""
        if not self.spec.id_column:
            raise ValueError("retention needs an id column")
        return self._copy(target, state.retain(self.rows(), window_start, self.spec.id_column), topology.trim(self.topology_log(), window_start))

    def index_by_entity(self, files: int = 8) -> DataFrame:
        """All rows, each entity's together in ranges of the epoch, by epoch and row. A range of over SEAL_BYTES is dealt over tasks in its order, so a range's files follow one another."""
        key = [self.spec.id_column] if self.spec.id_column else []
        order, rows = [*key, "epoch_ns", "row_seq"], self.rows()
        parts = -(-sum(x["bytes"] for x in self._live().values()) // SEAL_BYTES)
        if parts <= files:
            return rows.repartitionByRange(files, "epoch_ns").sortWithinPartitions(*order)
        ends = rows.approxQuantile("epoch_ns", [i / files for i in range(1, files)], 0.001) if files > 1 else []
        part = sum(((F.col("epoch_ns") >= F.lit(int(e))).cast("int") for e in ends), F.lit(0))
        return rows.withColumn("_range", part).repartitionByRange(parts, "_range", *order).sortWithinPartitions("_range", *order).drop("_range")

    def resident_bytes(self) -> DataFrame:
        """(batch_seq, n_rows, first_epoch, last_epoch, bytes) of what is stored, from the commits; bytes are those of the files."""
        rows = [(x["seq"], x["n"], x["first"], x["last"], x["bytes"]) for x in self._live().values()]
        return self.spark.createDataFrame(rows, "batch_seq bigint, n_rows bigint, first_epoch bigint, last_epoch bigint, bytes bigint")

    def save(self, path: str) -> None:
        """The rows as they were appended, the topology's log and the names beside them; an empty ledger raises."""
        if self.is_empty():
            raise ValueError("the ledger is empty")
        names = [f.name for f in self.spec.schema.fields]
        self.rows().select(*names, "batch_seq", "row_seq").write.parquet(f"{path.rstrip('/')}/rows")
        self.names().write.parquet(f"{path.rstrip('/')}/names")
        arrow_files.write_text(self.spark, f"{path.rstrip('/')}/schema.json", self.spec.schema.json())

    @staticmethod
    def load(spark: SparkSession, saved: str, target: str, id_column: str = "entity_id") -> Ledger:
        """A ledger at target from what save() wrote: the schema is checked, an empty one rejected, topology and states follow from the rows, and the saved names are merged. Rows keep their order."""
        saved = saved.rstrip("/")
        schema = T.StructType.fromJson(json.loads(arrow_files.read_text(spark, f"{saved}/schema.json")))
        out = Ledger(spark, target, R.LedgerSpec(schema, id_column))
        found = spark.read.parquet(f"{saved}/rows")
        R.conform(found.select(schema.fieldNames()), schema)
        if found.isEmpty():
            raise ValueError("there are no rows")
        rows = found.select(*schema.fieldNames(), "batch_seq", "row_seq")
        out._adopt(rows.withColumn("epoch_ns", R.epoch_ns(rows)).select(out._stored_schema().fieldNames()))
        names = spark.read.schema(N.SCHEMA).parquet(f"{saved}/names")
        if not names.isEmpty():
            out.merge_names(names)
        return out

    def _adopt(self, rows: DataFrame) -> None:
        """Makes stored rows this ledger's first batch, topology and all."""
        written = self._write(rows) | {"sealed": True}
        log = self._ingest(written["dir"], None) if self.spec.id_column else None
        if not self._commit(0, {"rows": written, "log": log, "next": ((written["row"] >> 33) + 1) << 33}):
            self._forget(written["dir"], log)
            raise ValueError("the ledger isn't new")

    def to_bytes(self) -> bytes:
        """All rows as one Arrow IPC file in memory, for ledgers that fit there; names aren't in it."""
        if self.is_empty():
            raise ValueError("the ledger is empty")
        return arrow_files.write_bytes(self.rows().orderBy("row_seq").select(*self.spec.schema.fieldNames(), "batch_seq", "row_seq"))

    @staticmethod
    def from_bytes(spark: SparkSession, data: bytes, target: str, spec: R.LedgerSpec | None = None) -> Ledger:
        """A ledger at target from to_bytes()."""
        out = Ledger(spark, target, spec)
        found = arrow_files.read_bytes(spark, data)
        R.conform(found.select(out.spec.schema.fieldNames()), out.spec.schema)
        if found.isEmpty():
            raise ValueError("there are no rows")
        out._adopt(found.withColumn("epoch_ns", R.epoch_ns(found)).select(out._stored_schema().fieldNames()))
        return out

    def save_schema(self, path: str) -> None:
        arrow_files.write_text(self.spark, path, self.spec.schema.json())

    @staticmethod
    def with_schema(spark: SparkSession, schema_path: str, target: str, id_column: str = "entity_id") -> Ledger:
        """An empty ledger at target of a schema that save_schema() wrote."""
        return Ledger(spark, target, R.LedgerSpec(T.StructType.fromJson(json.loads(arrow_files.read_text(spark, schema_path))), id_column))

    # queries

    def query(self, start: int | None = None, end: int | None = None, origin=None, radius: float | None = None, units: str | None = None) -> DataFrame:
        """Rows in a closed time range and a sphere. The sphere needs one frame among the rows in the range; with units its numbers are in that unit, else in the rows' own."""
        return self._filtered(self.rows(start, end), start, end, origin, radius, units)

    def _filtered(self, df: DataFrame, start, end, origin, radius, units) -> DataFrame:
        if start is not None:
            df = df.where(R.in_time(F.col("epoch_ns"), start, end))
        if (origin is None) != (radius is None):
            raise ValueError("a sphere has an origin and a radius")
        if origin is not None:
            R.require_one_frame(df, R.field(df, "frame_id"))
            p = [F.get(R.field(df, "position"), F.lit(i)) for i in range(3)]
            if units is not None:
                code = F.lit(vocab.LENGTH_UNITS.index(units) + 1)
                p = [vocab.convert(c, R.field(df, "units_pos"), code) for c in p]
            df = df.where(R.in_sphere(*p, origin, radius))
        return df

    def stream_query(self, start: int | None = None, end: int | None = None, origin=None, radius: float | None = None, units: str | None = None) -> Iterator[DataFrame]:
        """query() folder by folder, in the order stored: each is read when it is asked for. The sphere's one frame is that of each folder."""
        for x in list(self._live().values()):
            if x["n"] and (start is None or x["last"] >= start) and (end is None or x["first"] <= end):
                yield self._filtered(self._read([x["dir"]]), start, end, origin, radius, units)

    def current_state(self, ids: DataFrame | None = None, not_before: int | None = None) -> DataFrame:
        """Each entity's best row from not_before on, an hour before the latest epoch unless given; the latest is known from the commits, so only batches that reach into it are read."""
        if not_before is None and self._latest() is not None:
            not_before = self._latest() - state.HOUR_NS
        df = self.rows(not_before)
        rank = vocab.estimate_rank(R.field(df, "estimate_type"))
        if not self.spec.id_column:
            return state.current_state_by_position(df, rank=rank, not_before=not_before) if ids is None else df.limit(0)
        return state.current_state(df, self.spec.id_column, rank=rank, ids=ids, not_before=-(1 << 62) if not_before is None else not_before)

    def latest_snapshot(self, ids: DataFrame | None = None) -> DataFrame:
        return state.latest_snapshot(self.rows(), key=self.spec.id_column, ids=ids)

    def run_ticket(self, ticket: dict | str) -> DataFrame:
        """A query as JSON: {"query_type": "filter" | "current_state", ...}; seconds count from 1900, TAI."""
        t = json.loads(ticket) if isinstance(ticket, str) else ticket
        if t.get("query_type") == "filter":
            start, end = (ticket_ns(s) for s in t["time_range_tai_s"]) if t.get("time_range_tai_s") else (None, None)
            return self.query(start, end, t.get("spatial_origin"), t.get("spatial_radius"))
        if t.get("query_type") == "current_state":
            ids = None
            if t.get("entity_ids"):
                found = [self.wire_id(w) for w in t["entity_ids"]]
                ids = self.spark.createDataFrame([(bytearray(i),) for i in found], f"{self.spec.id_column} binary")
            return self.current_state(ids, None if t.get("not_before_tai_s") is None else ticket_ns(t["not_before_tai_s"]))
        raise ValueError(f"unknown query_type {t.get('query_type')!r}")

    def wire_id(self, w: dict) -> bytes:
        """The id of {"authority", "name"}, {"ephemeris_id", "orientation_id"} or {"id": hex}."""
        if "id" in w:
            out = bytes.fromhex(w["id"].replace("-", ""))
            if len(out) != 16 or out[6] >> 4 != 8 or out[8] >> 6 != 2:
                raise ValueError("not an id")
            return out
        if "ephemeris_id" in w:
            return ident.astro_bytes(w["ephemeris_id"], w["orientation_id"])
        found = self.spark.range(1).select(ident.mint_entity(F.lit(w["authority"]), F.lit(w["name"]))).first()[0]
        if found is None:
            raise ValueError("authority and name must not be empty or hold NUL")
        return bytes(found)

    # frames

    def poses(self) -> DataFrame:
        """(entity, parent, epoch_ns, row_seq, x, y, z km, unit quaternion) of every row: what frames are resolved by."""
        df = self.rows()
        x = [F.get(R.field(df, "position"), F.lit(i)) for i in range(3)]
        km = [vocab.to_km(c, R.field(df, "units_pos")).alias(n) for c, n in zip(x, "xyz", strict=True)]
        return df.select(F.col(self.spec.id_column).alias("entity"), R.field(df, "frame_id").alias("parent"), "epoch_ns", "row_seq", *km, quat_of(df).alias("quaternion"))

    def ephemeris(self) -> Ephemeris:
        """The tables that were loaded last."""
        fs, at = self._fs("ephemeris")
        if not fs.exists(at):
            raise ValueError("no ephemeris is loaded")
        newest = max(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())
        return Ephemeris.load(self.spark, f"{self.path}/ephemeris/{newest}")

    def load_kernel(self, ephemeris: Ephemeris) -> int:
        """Makes an ephemeris this ledger's: a new version is written whole, then renamed into place."""
        fs, at = self._fs("ephemeris")
        n = max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=-1) + 1 if fs.exists(at) else 0
        draft = f"ephemeris/draft-{uuid.uuid4().hex}"
        ephemeris.save(f"{self.path}/{draft}")
        if not fs.rename(self._fs(draft)[1], self._fs(f"ephemeris/{n}")[1]):
            raise RuntimeError("another writer was first")
        return n

    def transform(self, df: DataFrame, target: bytes | str, units: str = "km", ephemeris: Ephemeris | None = None) -> DataFrame:
        """df, which is not stored, in a target frame (an id or a frame's name) and unit, at each row's own epoch. The ledger's rows resolve entities' frames, and are read only if a row is on one."""
        target = ident.frame_bytes(target) if isinstance(target, str) else target
        by = None
        if self.spec.id_column and not df.where(ident.kind(R.field(df, "frame_id")) == ident.ENTITY).isEmpty():
            by = self.poses()
        return transform.transform(df, target, ephemeris or self.ephemeris(), by, vocab.LENGTH_UNITS.index(units) + 1)

    def root_frame(self, frames: DataFrame) -> DataFrame:
        """(frame, epoch, root) for asked (frame, epoch); ValueError for an abstract id or a frame that leads nowhere."""
        kind = ident.kind(F.col("frame"))
        if not frames.where(~ident.is_valid(F.col("frame")) | (kind == ident.ABSTRACT)).isEmpty():
            raise ValueError("an abstract or corrupt id is no frame")
        found = transform.resolve(frames.select("frame", "epoch"), self.poses(), lambda c: ident.kind(c) != ident.ENTITY)
        return transform.require_roots(found).select("frame", "epoch", "root")

    def append_snapshot(self, epochs: DataFrame, source: bytes, ephemeris: Ephemeris | None = None) -> int:
        """Stores the celestial bodies' states at epochs (epoch) as a batch."""
        return self.append((ephemeris or self.ephemeris()).snapshot(epochs, source))

    def query_orbits(self, asked: list[dict], epoch_tai_s: float, samples: int | None = None) -> DataFrame:
        """Ephemeris.orbits() of [{"body", "centre"}, ...] by NAIF number; without a centre the one that the body's number says."""
        rows = self.spark.createDataFrame([(int(x["body"]), x.get("centre"), ticket_ns(epoch_tai_s)) for x in asked], "body int, centre int, epoch bigint")
        rows = rows.withColumn("centre", F.coalesce("centre", ident.default_centre(F.col("body")).cast("int")))
        return self.ephemeris().orbits(rows, samples)

    # topology and names

    def topology_log(self) -> DataFrame:
        commits, gone = self._commits().values(), set()
        for entry in commits:
            gone |= set(entry.get("log_drop", ()))
        paths = [f"{self.path}/{e['log']}" for e in commits if e.get("log") and e["log"] not in gone]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def tree(self, epoch: int | None = None) -> DataFrame:
        return topology.tree_at(self.topology_log(), epoch)

    def export_topology(self) -> DataFrame:
        return self.topology_log().orderBy("seq")

    def merge_topology(self, log: DataFrame) -> int:
        """Adds the events that are new; returns how many. A log that would close a cycle is rejected whole."""
        for _ in range(MAX_RACES):
            own, commits = self.topology_log(), self._commits()
            fresh = topology.merge_log(own, log).withColumn("old_parent", F.lit(None).cast("binary"))
            name = self._write_log(fresh)
            fresh = self.spark.read.schema(LOG).parquet(f"{self.path}/{name}")
            n = fresh.count()
            tree = topology.tree_at(own.select("child", "parent", "epoch", "seq").unionByName(fresh.select("child", "parent", "epoch", "seq")))
            try:
                topology.require_acyclic(tree.where(ident.kind(F.col("parent")) == ident.ENTITY))
            except ValueError:
                self._forget(name)
                raise
            after = max((e["next"] for e in commits.values()), default=0)
            if not n or self._commit(max(commits, default=-1) + 1, {"log": name, "next": after}):
                if not n:
                    self._forget(name)
                return n
            self._forget(name)
        raise RuntimeError(f"lost {MAX_RACES} races for a commit")

    def names(self) -> DataFrame:
        fs, at = self._fs("names")
        if not fs.exists(at):
            return N.empty(self.spark)
        newest = max(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())
        return self.spark.read.schema(N.SCHEMA).parquet(f"{self.path}/names/{newest:012d}")

    def merge_names(self, more: DataFrame) -> int:
        """Adds verified names; returns how many ids were learned. The new list is written whole, then renamed into place."""
        out, fresh = N.merge(self.names(), more)
        fs, at = self._fs("names")
        n = max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=-1) + 1 if fs.exists(at) else 0
        draft = f"names/draft-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.path}/{draft}")
        if not fs.rename(self._fs(draft)[1], self._fs(f"names/{n:012d}")[1]):
            raise RuntimeError("another writer was first")
        return fresh

    def import_names(self, batches: list[DataFrame]) -> int:
        """merge_names() of several batches at once; one bad name rejects them all."""
        whole = batches[0]
        for b in batches[1:]:
            whole = whole.unionByName(b)
        return self.merge_names(whole)

    def register_name(self, authority: str, name: str, id_: bytes | None = None) -> bytes:
        """Adds one entity's name; its id, if given, has to be the one that the name mints."""
        minted = self.wire_id({"authority": authority, "name": name})
        if id_ is not None and bytes(id_) != minted:
            raise ValueError("a name does not mint its id")
        self.merge_names(self.spark.createDataFrame([(bytearray(minted), authority, name, ident.ENTITY)], N.SCHEMA))
        return minted

    def display(self, df: DataFrame, id_column: str | None = None) -> DataFrame:
        """df with label: what each id is called."""
        return ident.label(df, id_column or self.spec.id_column, self.names())

    def action(self, name: str, body: dict | None = None):
        """A server's action by name. Tables come as DataFrames and paths as text, in body."""
        b = body or {}
        known = {
            "export_topology": lambda: self.export_topology(),
            "import_topology": lambda: self.merge_topology(b["log"]),
            "export_names": lambda: N.exported(self.names()),
            "import_names": lambda: self.import_names(b["names"] if isinstance(b["names"], list) else [b["names"]]),
            "save_ledger": lambda: self.save(b["path"]),
            "load_ledger": lambda: Ledger.load(self.spark, b["path"], b["target"], self.spec.id_column),
            "load_kernel": lambda: self.load_kernel(b["ephemeris"] if "ephemeris" in b else Ephemeris.load(self.spark, b["path"])),
            "append_snapshot": lambda: self.append_snapshot(self.spark.createDataFrame([(ticket_ns(s),) for s in b["epochs_tai_s"]], "epoch bigint"), self.wire_id({"id": b["source"]})),
            "query_orbits": lambda: self.query_orbits(b["orbits"], b["epoch_tai_s"], b.get("samples")),
        }
        if name not in known:
            raise ValueError(f"unknown action {name!r}; there are {sorted(known)}")
        return known[name]()

    def describe(self) -> str:
        live = list(self._live().values())
        return f"{len(live)} batches, {sum(x['n'] for x in live)} rows, {sum(x['bytes'] for x in live) / 1e6:.1f} MB"


def quat_of(df: DataFrame):
    from wherewhen.functions import quat

    return quat.normalise(R.field(df, "quaternion"))


def ticket_ns(seconds: float) -> int:
    """Nanoseconds since J2000 from a ticket's seconds since 1900, both TAI."""
    return round((seconds - timeconv.J1900_TO_J2000_S) * 1e9)


CONFIG = {"path": "WHEREWHEN_LEDGER", "id_column": "WHEREWHEN_ID_COLUMN", "memory_limit": "WHEREWHEN_MEMORY_LIMIT", "kernel": "WHEREWHEN_KERNEL"}


def load_config(path: str | None = None, environment: dict | None = None) -> dict:
    """A ledger's settings: those of a TOML file, else of the environment, else none; sizes in bytes."""
    import tomllib

    environment = dict(os.environ) if environment is None else environment
    found = {}
    if path is not None:
        with open(path, "rb") as f:
            found = tomllib.load(f)
        unknown = set(found) - set(CONFIG)
        if unknown:
            raise ValueError(f"no settings {sorted(unknown)}")
    out = {k: found.get(k, environment.get(v)) for k, v in CONFIG.items()}
    if out["memory_limit"] is not None:
        out["memory_limit"] = arrow_files.byte_size(str(out["memory_limit"]))
    return out


def open_ledger(spark: SparkSession, config: dict) -> Ledger:
    """The ledger that load_config() describes, with its kernel where it names one and has none yet."""
    if not config.get("path"):
        raise ValueError("no path of a ledger")
    out = Ledger(spark, config["path"], R.LedgerSpec(R.ENTITY, "entity_id" if config.get("id_column") is None else config["id_column"]))
    if config.get("kernel") and not out._fs("ephemeris")[0].exists(out._fs("ephemeris")[1]):
        out.load_kernel(Ephemeris.load(spark, config["kernel"]))
    return out
