import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wherewhen.functions import ident, timeconv
from wherewhen.operators import rows as R
from wherewhen.plans.ledger import Ledger, load_config, open_ledger
from wherewhen.sources import arrow_files, names
from wherewhen.streaming import ingest


def batch(spark, rows):
    """(name, parent name or frame, tai ns, x km, estimate code) rows."""
    raw = spark.createDataFrame([(n, p, t, float(x), k) for n, p, t, x, k in rows], "n string, p string, t long, x double, k short").coalesce(1)
    frame = F.col("p")
    known = {n for n, _, _ in ident.FRAMES}
    id_ = F.when(frame.isin(*known), F.lit(None).cast("binary"))
    for n in {p for _, p, _, _, _ in rows} & known:
        id_ = F.when(frame == n, F.lit(bytearray(ident.frame_bytes(n)))).otherwise(id_)
    id_ = F.coalesce(id_, ident.mint_entity(F.lit("acme.com"), frame))
    none = F.lit(None).cast("array<double>")
    obs = F.struct(id_.alias("frame_id"), F.lit(1).cast("short").alias("units_pos"), F.lit(1).cast("short").alias("timescale_id"), ident.mint_abstract(F.lit("a"), F.lit("s")).alias("source_id"), F.col("k").alias("estimate_type"), F.array("x", F.lit(0.0), F.lit(0.0)).alias("position"), F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)]).alias("quaternion"), timeconv.parts(F.col("t"))[0].alias("duration_centuries"), timeconv.parts(F.col("t"))[1].alias("duration_ns"), none.alias("position_covariance"), none.alias("orientation_covariance"))
    df = raw.select(ident.mint_entity(F.lit("acme.com"), F.col("n")).alias("entity_id"), obs.alias(R.STRUCT), none.alias("velocity"), none.alias("angular_velocity"), none.alias("acceleration"), F.lit(None).cast("double").alias("mass_kg"), none.alias("state_covariance"), none.alias("dimensions"))
    return spark.createDataFrame(df.collect(), R.ENTITY)


@pytest.fixture
def ledger(spark, tmp_path):
    out = Ledger(spark, f"file://{tmp_path}/ledger")
    out.append(batch(spark, [("facility", "Earth", 0, 1000, 1), ("truck", "facility", 0, 20, 1), ("robot", "truck", 0, 3, 1)]))
    out.append(batch(spark, [("robot", "Earth", 7_000_000_000_000, 500, 3), ("robot", "Earth", 7_000_000_000_000, 600, 1)]))
    return out


def test_append_query_and_state(spark, ledger):
    assert ledger.rows().count() == 5 and ledger.query(0, 10).count() == 3
    assert [r.x for r in ledger.current_state().select(F.col(f"{R.STRUCT}.position")[0].alias("x")).collect()] == [600.0]
    assert ledger.topology_log().count() == 4 and ledger.latest_snapshot().count() == 2
    ticket = {"query_type": "current_state", "entity_ids": [{"authority": "acme.com", "name": "robot"}], "not_before_tai_s": 3155716800.0}
    assert ledger.run_ticket(ticket).count() == 1
    assert ledger.run_ticket('{"query_type": "filter", "time_range_tai_s": [3155716800.0, 3155716801.0]}').count() == 3
    with pytest.raises(ValueError, match="mixed frames"):
        ledger.query(origin=(0, 0, 0), radius=5)
    with pytest.raises(ValueError):
        ledger.run_ticket({"query_type": "other"})


def test_rejected_batches_change_nothing(spark, ledger):
    with pytest.raises(ValueError, match="cycle"):
        ledger.append(batch(spark, [("facility", "truck", 8, 1, 1)]))
    with pytest.raises(ValueError, match="rejected"):
        ledger.append(batch(spark, [("a", "Earth", 8, 1, 4)]))
    with pytest.raises(ValueError, match="schema differs"):
        ledger.append(spark.range(1))
    assert ledger.rows().count() == 5 and ledger.topology_log().count() == 4


def test_federation_and_retention(spark, ledger, tmp_path):
    other = Ledger(spark, f"file://{tmp_path}/other")
    other.append(batch(spark, [("ship", "Earth", 5, 7, 1)]))
    assert other.merge_topology(ledger.export_topology()) == 4 and other.merge_topology(ledger.export_topology()) == 0
    n = spark.range(1).select(ident.mint_entity(F.lit("acme.com"), F.lit("robot")).alias("prescribed_id"), F.lit("acme.com").alias("authority"), F.lit("robot").alias("common_name"), F.lit(1).cast("short").alias("kind"))
    assert other.merge_names(n) == 1 and other.merge_names(n) == 0 and other.names().count() == 1
    with pytest.raises(ValueError, match="mint"):
        names.verified(n.withColumn("common_name", F.lit("tampered")))
    kept = ledger.retain(f"file://{tmp_path}/kept", 1000)
    assert kept.rows().count() == 4 and kept.topology_log().count() == 4
    assert ledger.compact(f"file://{tmp_path}/compact").rows().count() == 5


def test_stream_equals_batch(spark, ledger, tmp_path):
    batch(spark, [("drone", "Earth", 1, 1, 1)]).write.parquet(f"{tmp_path}/in/1")
    batch(spark, [("drone", "Earth", 2, 2, 1)]).write.parquet(f"{tmp_path}/in/2")
    out, seen = Ledger(spark, f"file://{tmp_path}/streamed"), []
    stream = spark.readStream.schema(R.ENTITY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.stream_into(out, stream, f"{tmp_path}/ckpt", decide=lambda s: seen.append(s.count())).awaitTermination()
    assert out.rows().count() == 2 and seen and set(seen) == {1}
    # a micro-batch that is run again after a crash is known by its number
    again = batch(spark, [("drone", "Earth", 3, 3, 1)])
    assert out.append(again, token="x#7") == out.append(again, token="x#7") == 2
    assert out.rows().count() == 3


def test_row_numbers_and_races(spark, tmp_path):
    a = Ledger(spark, f"file://{tmp_path}/a")
    many = batch(spark, [(f"e{i}", "Earth", i, i, 1) for i in range(400)]).repartition(200)
    a.append(many, checked=True)
    b = Ledger(spark, f"file://{tmp_path}/a")
    assert b._commits() and not b._commit(0, {"next": 0})  # a number is taken once
    seen = a._commits
    # a writer that doesn't know of another's commit loses the race and numbers its batch anew
    b.append(batch(spark, [("x", "Earth", 1, 1, 1)]))
    stale = [dict(list(seen().items())[:1])]
    a._commits = lambda: stale.pop() if stale else seen()
    assert a.append(batch(spark, [("y", "Earth", 1, 1, 1)])) == 2
    del a._commits
    rows = Ledger(spark, f"file://{tmp_path}/a").rows()
    assert rows.count() == 402 == rows.select("row_seq").distinct().count()
    assert [r.m for r in rows.groupBy("batch_seq").agg(F.max("row_seq").alias("m")).orderBy("batch_seq").collect()] == sorted(r.m for r in rows.groupBy("batch_seq").agg(F.max("row_seq").alias("m")).collect())


def test_seal_evict_save_and_load(spark, ledger, tmp_path):
    before = sorted((r.row_seq, r.batch_seq, r.epoch_ns) for r in ledger.rows().collect())
    assert not ledger.seal() and ledger.seal(most=1) and not ledger.seal(most=1)
    assert sorted((r.row_seq, r.batch_seq, r.epoch_ns) for r in ledger.rows().collect()) == before
    ledger.append(batch(spark, [("facility", "Earth", 9_000_000_000_000, 1, 1)]))
    assert ledger.rows(8_000_000_000_000).count() == 1 and ledger.query(0, 10).count() == 3
    assert len(list(ledger.stream_query())) == 2 and ledger.resident_bytes().agg(F.sum("n_rows")).first()[0] == 6
    ledger.register_name("acme.com", "robot")
    with pytest.raises(ValueError, match="mint"):
        ledger.register_name("acme.com", "robot", b"x" * 16)
    assert {r.label for r in ledger.display(ledger.rows()).select("label").distinct().collect()} >= {"robot"}
    ledger.action("save_ledger", {"path": f"file://{tmp_path}/saved"})
    again = ledger.action("load_ledger", {"path": f"file://{tmp_path}/saved", "target": f"file://{tmp_path}/again"})
    assert again.rows().count() == 6 and again.names().count() == 1 and again.topology_log().count() == 4
    small = Ledger.from_bytes(spark, again.to_bytes(), f"file://{tmp_path}/small")
    assert sorted(r.row_seq for r in small.rows().collect()) == sorted(r.row_seq for r in again.rows().collect())
    # the older folder goes but for rows at their entity's latest epoch: truck, and the robot's two of one epoch
    assert ledger.evict(1) == 1 and ledger.rows().count() == 4
    assert ledger.evict(1 << 40) == 0
    for wrong in (lambda: Ledger(spark, f"file://{tmp_path}/none").save(f"file://{tmp_path}/x"), lambda: ledger.action("reboot"), lambda: Ledger.load(spark, f"file://{tmp_path}/saved", f"file://{tmp_path}/again")):
        with pytest.raises(ValueError):
            wrong()
    ledger.save_schema(f"file://{tmp_path}/schema.json")
    assert Ledger.with_schema(spark, f"file://{tmp_path}/schema.json", f"file://{tmp_path}/empty").is_empty()


def test_config(spark, tmp_path):
    (tmp_path / "c.toml").write_text('memory_limit = "2 MB"\n')
    found = load_config(f"{tmp_path}/c.toml", {"WHEREWHEN_LEDGER": f"file://{tmp_path}/l", "WHEREWHEN_MEMORY_LIMIT": "1"})
    assert found == {"path": f"file://{tmp_path}/l", "id_column": None, "memory_limit": 2_000_000, "kernel": None}
    assert open_ledger(spark, found).is_empty()
    (tmp_path / "d.toml").write_text("colour = 1\n")
    for wrong in (lambda: load_config(f"{tmp_path}/d.toml", {}), lambda: open_ledger(spark, {})):
        with pytest.raises(ValueError):
            wrong()


def test_running_poses(spark, tmp_path):
    for k, rows in enumerate(([(1, 5, 1.0), (2, 5, 2.0)], [(1, 4, 9.0), (2, 6, 3.0)])):
        spark.createDataFrame(rows, "entity long, epoch_ns long, x double").coalesce(1).write.parquet(f"{tmp_path}/p/{k}")
    stream = spark.readStream.schema("entity long, epoch_ns long, x double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p")
    out = []
    ingest.pose_stream(stream, values=("x",)).writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {k: (e, x) for k, e, x in out} == {1: (5, 1.0), 2: (6, 3.0)}


def test_arrow_files(spark, tmp_path):
    table = pa.table({"i": pa.array([b"x" * 16], pa.binary(16)), "u": pa.array([7], pa.uint8()), "v": pa.array([[1.0, 2.0, 3.0]], pa.list_(pa.float64(), 3)), "d": pa.array(["a"]).dictionary_encode()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    df = arrow_files.read_bytes(spark, sink.getvalue().to_pybytes())
    assert df.first().asDict() == {"i": b"x" * 16, "u": 7, "v": [1.0, 2.0, 3.0], "d": "a"}
    arrow_files.write_file(df, f"{tmp_path}/t.arrow")
    assert arrow_files.read_file(spark, f"{tmp_path}/t.arrow").collect() == df.collect()
    assert arrow_files.read_schema(spark, f"{tmp_path}/t.arrow").fieldNames() == ["i", "u", "v", "d"]
    written = arrow_files.write_files(spark.range(100).repartition(3), f"file://{tmp_path}/many", 7).collect()
    assert len(written) == 3 and sum(r.n_rows for r in written) == 100
    assert sorted(r.id for r in arrow_files.read_file(spark, f"{tmp_path}/many").collect()) == list(range(100))
    with open(f"{tmp_path}/page.html", "w") as f:
        f.write("<html>")
    with pytest.raises(Exception, match="HTML"):
        arrow_files.read_file(spark, f"{tmp_path}/page.html").collect()
    with pytest.raises(ValueError, match="HTML"):
        arrow_files.read_bytes(spark, b"<html>")
    arrow_files.write_schema(R.ENTITY, f"{tmp_path}/s.json")
    assert arrow_files.load_schema(f"{tmp_path}/s.json") == R.ENTITY
    assert [arrow_files.byte_size(x) for x in ("5GB", "512 MiB", "7")] == [5 * 10**9, 512 << 20, 7]
    with pytest.raises(ValueError):
        arrow_files.byte_size("5 parsecs")


def test_text_sources(spark, tmp_path):
    (tmp_path / "h.csv").write_text("head\n$$SOE\n2451545.0, A.D. 2000-Jan-01 12:00:00.0000, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0,\n$$EOE\ntail\n")
    r = arrow_files.read_horizons(spark, f"{tmp_path}/h.csv").first()
    assert (str(r.t), r.x, r.vz) == ("2000-01-01 12:00:00", 1.0, 6.0)
    (tmp_path / "g.json").write_text('{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    got = arrow_files.read_polygons(spark, f"{tmp_path}/g.json").orderBy("id").collect()
    assert [(p.west, p.north) for p in got] == [(0.0, 2.0), (5.0, 6.0)]
    assert arrow_files.grid(spark, 100, 50).count() == 25


def test_seal_tail_of_many_bytes(spark, monkeypatch):
    """The query's thresholds go by its own tail: a table of over SEAL_BYTES is sealed by its number of batches too."""
    from wherewhen.plans import frame_queries

    monkeypatch.setattr(Ledger.seal, "__defaults__", (50, 1000))
    assert frame_queries.seal_tail(spark, "/root/testdata/sf0.001").first()["folders"] == 1


def test_index_of_many_bytes(spark, ledger, monkeypatch):
    """A range of the epoch that is too large for a task is dealt over several, in the index's order."""
    from wherewhen.plans import ledger as module

    few = [r.row_seq for r in ledger.index_by_entity(files=1).collect()]
    monkeypatch.setattr(module, "SEAL_BYTES", 4000)
    rows = ledger.index_by_entity(files=1)
    assert rows.rdd.getNumPartitions() > 1 and [r.row_seq for r in rows.collect()] == few
    two = [(r.epoch_ns, bytes(r.entity_id), r.row_seq) for r in ledger.index_by_entity(files=2).collect()]
    assert len(two) == 5 and [t[0] for t in two] == sorted(t[0] for t in two)
