"""The registered queries, by operator, over the driver's tables; and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherewhen.functions import geo, ident, orbits, quat, timeconv, vocab
from wherewhen.operators import asof, joins, state, timeline, topology, transform
from wherewhen.operators import rows as R
from wherewhen.plans.tables import EARTH, OBSERVATIONS_SQL, observations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY_NS = 24 * state.HOUR_NS
#: 2024-01-10 and 2024-01-20, TAI nanoseconds since J2000.
T0, T1 = 758_160_032_000_000_000, 759_024_032_000_000_000
is_earth = topology.is_any(EARTH)


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = f"WITH {OBSERVATIONS_SQL} {sql}" if " obs" in sql and not sql.lstrip().startswith("WITH") else sql
        return f

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flat(o: DataFrame) -> DataFrame:
    x, y, z = quat.at(F.col("position"), 3)
    return o.withColumns({"x": x, "y": y, "z": z})


def _km(o: DataFrame) -> DataFrame:
    return transform.in_km(o)


def _r(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


KM_SQL = "* [1.0,1.0,1.0,1.0,149597870700.0,254.0,3048.0,1609344.0,1852.0][units_pos] / [1.0,1000.0,100000.0,1000000.0,1000.0,10000000.0,10000000.0,1000000.0,1000.0][units_pos]"

# scans, filters, projections


@query("SELECT row_seq, entity, epoch_ns FROM obs")
def filter_none(spark, d):
    return observations(spark, d).select("row_seq", "entity", "epoch_ns")


@query("SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM obs")
def query_all(spark, d):
    return observations(spark, d).agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"))


@query(f"SELECT row_seq, entity, epoch_ns FROM obs WHERE epoch_ns BETWEEN {T0} AND {T1}")
def filter_time(spark, d):
    o = observations(spark, d)
    return o.where(R.in_time(F.col("epoch_ns"), T0, T1)).select("row_seq", "entity", "epoch_ns")


@query("SELECT row_seq, entity FROM obs WHERE (x - 50)*(x - 50) + (y - 500)*(y - 500) + (z - 20)*(z - 20) <= 40000 OR isnan((x - 50)*(x - 50) + (y - 500)*(y - 500) + (z - 20)*(z - 20))")
def filter_spatial(spark, d):
    o = _flat(observations(spark, d))
    return o.where(R.in_sphere(F.col("x"), F.col("y"), F.col("z"), (50, 500, 20), 200)).select("row_seq", "entity")


@query(f"SELECT row_seq, entity FROM obs WHERE epoch_ns BETWEEN {T0} AND {T1} AND (x - 50)*(x - 50) + (y - 500)*(y - 500) + (z - 20)*(z - 20) <= 90000")
def filter_time_space(spark, d):
    o = _flat(observations(spark, d))
    return o.where(R.in_time(F.col("epoch_ns"), T0, T1) & R.in_sphere(F.col("x"), F.col("y"), F.col("z"), (50, 500, 20), 300)).select("row_seq", "entity")


@query("SELECT event_type, count(DISTINCT parent) <= 1 AS uniform FROM obs WHERE entity < 10 OR event_type = 'click' GROUP BY event_type")
def frame_uniformity(spark, d):
    """Whether the spatial filter's check finds one frame, by kind of event, over the rows of low entities and of clicks."""
    o = observations(spark, d).where("entity < 10 OR event_type = 'click'")
    out = []
    for kind in sorted(r[0] for r in o.select("event_type").distinct().collect()):  # a handful of kinds
        try:
            R.require_one_frame(o.where(F.col("event_type") == kind), F.col("parent"))
            out.append((kind, True))
        except ValueError:
            out.append((kind, False))
    return spark.createDataFrame(out, "event_type string, uniform boolean")


@query("SELECT row_seq, entity FROM obs WHERE entity IN (SELECT s_suppkey FROM supplier)")
def id_filter(spark, d):
    ids = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return R.with_ids(observations(spark, d), "entity", ids).select("row_seq", "entity")


@query("SELECT row_seq, entity FROM obs WHERE entity NOT IN (SELECT s_suppkey FROM supplier)")
def id_is_in(spark, d):
    ids = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return R.with_ids(observations(spark, d), "entity", ids, invert=True).select("row_seq", "entity")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'an') OR contains(lower(n_name), '1')")
def name_like(spark, d):
    return R.named_like(_table(spark, d, "nation"), "n_name", ["AN", "1"]).select("n_nationkey", "n_name")


@query(f"SELECT entity, count(*) AS n_rows FROM obs WHERE epoch_ns >= {T0} AND epoch_ns < {T1} GROUP BY entity")
def entity_window(spark, d):
    return observations(spark, d).where(R.in_window(F.col("epoch_ns"), T0, T1)).groupBy("entity").agg(F.count("*").alias("n_rows"))


@query("SELECT row_seq, parent FROM obs WHERE parent IN (-399, 1, 2, 3)")
def frame_filter(spark, d):
    return R.in_frames(observations(spark, d), F.col("parent"), [EARTH, 1, 2, 3]).select("row_seq", "parent")


@query(f"SELECT entity, count(*) AS n_rows FROM obs WHERE epoch_ns <= {T1} GROUP BY entity")
def upto(spark, d):
    return R.upto(observations(spark, d), T1).groupBy("entity").agg(F.count("*").alias("n_rows"))


@query("SELECT row_seq, entity FROM obs ORDER BY row_seq LIMIT 50 OFFSET 100")
def offset_limit_tail(spark, d):
    return R.page(observations(spark, d), "row_seq", 100, 50).select("row_seq", "entity")


@query("SELECT row_seq, entity FROM obs ORDER BY row_seq DESC LIMIT 25")
def limit_tail(spark, d):
    return R.page(observations(spark, d), "row_seq", tail=25).select("row_seq", "entity")


@query("SELECT entity, row_seq FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq) AS n FROM obs) WHERE (n - 1) % 12 = 0")
def thin_every_n(spark, d):
    return R.every_nth(observations(spark, d), "entity", ["epoch_ns", "row_seq"], 12).select("entity", "row_seq")


@query("SELECT row_seq, entity FROM obs ORDER BY md5('7/' || row_seq), row_seq LIMIT 100")
def sample_seeded(spark, d):
    return R.sample(observations(spark, d), "row_seq", 100, 7).select("row_seq", "entity")


@query("SELECT row_seq, round(x, 6) AS x, y, z FROM obs")
def project_vectors(spark, d):
    return R.with_vectors(observations(spark, d)).select("row_seq", F.round("x", 6).alias("x"), "y", "z")


@query("SELECT row_seq, ['km','m','cm','mm','au','in','ft','mi','nmi'][units_pos] AS unit, ['TAI','TT','ET','TDB','UTC','GPST'][timescale_id] AS scale, ['MEASURED','ESTIMATED','SIMULATED'][estimate_type] AS estimate, strftime(make_timestamp(CAST(floor(epoch_ns / 1000) AS BIGINT) + 946728000000000), '%Y-%m-%dT%H:%M:%S.%g') AS tai FROM obs")
def project_decode(spark, d):
    o = R.decoded(observations(spark, d).withColumn("nothing", F.lit(None).cast("double")))
    assert "nothing" not in o.columns
    return o.select("row_seq", "unit", "scale", "estimate", "tai")


# validation, vocabularies, time


@query("SELECT count(*) FILTER (units_pos > 9) AS bad_units_pos, count(*) FILTER (row_seq % 50 = 0) AS bad_timescale_id, count(*) FILTER (row_seq % 70 = 0) AS bad_estimate_type, count(*) FILTER (row_seq % 90 = 0) AS missing_field, count(*) FILTER (row_seq % 30 = 0) AS bad_frame_id, count(*) FILTER (row_seq % 30 <> 0 AND row_seq % 40 = 0) AS abstract_frame FROM obs")
def validate_vocab(spark, d):
    """The counts of what validate() rejects, over all rows with faults planted by number."""
    o = observations(spark, d)
    n = F.col("row_seq")
    frame = F.when(n % 30 == 0, F.lit(bytearray(b"short"))).when(n % 40 == 0, ident.mint_abstract(F.lit("a"), F.lit("b"))).otherwise(ident.mint_entity(F.lit("a"), F.col("parent").cast("string")))
    none = F.lit(None).cast("array<double>")
    bad = o.select(frame.alias("frame_id"), "units_pos", F.when(n % 50 == 0, 99).otherwise(F.col("timescale_id")).cast("smallint").alias("timescale_id"), ident.mint_abstract(F.lit("a"), F.lit("s")).alias("source_id"), F.when(n % 70 == 0, 0).otherwise(F.col("estimate_type")).cast("smallint").alias("estimate_type"), F.when(n % 90 != 0, F.col("position")).alias("position"), "quaternion", "duration_centuries", "duration_ns", none.alias("position_covariance"), none.alias("orientation_covariance"))
    return R.violations(bad)


@query("SELECT row_seq, CAST(1 AS SMALLINT) AS timescale_id, CAST(epoch_ns // 3155760000000000000 AS SMALLINT) AS duration_centuries, epoch_ns % 3155760000000000000 AS duration_ns FROM obs")
def normalize_tai(spark, d):
    return R.normalize_tai(observations(spark, d)).select("row_seq", "timescale_id", "duration_centuries", "duration_ns")


@query("SELECT row_seq, CAST(raw_ns // 3155760000000000000 AS SMALLINT) AS c, raw_ns % 3155760000000000000 AS ns, raw_ns AS total FROM obs")
def epoch_to_parts(spark, d):
    o = observations(spark, d)
    return o.select("row_seq", F.col("duration_centuries").alias("c"), F.col("duration_ns").alias("ns"), timeconv.total_ns(F.col("duration_centuries"), F.col("duration_ns")).alias("total"))


@query("SELECT event_id, (epoch_us(ts) - 946728000000000) * 1000 + 32000000000 AS tai_ns, ((epoch_us(ts) - 946728000000000) * 1000 + 32000000000) / 1e9::DOUBLE + 3155716800.0::DOUBLE AS ticket_s, epoch_us(ts) AS utc_us FROM events")
def utc_tai(spark, d):
    e = _table(spark, d, "events").withColumn("tai_ns", timeconv.tai_ns_of(F.col("ts").cast("timestamp")))
    return e.select("event_id", "tai_ns", timeconv.ticket_seconds(F.col("tai_ns")).alias("ticket_s"), F.unix_micros(timeconv.utc_of(F.col("tai_ns"))).alias("utc_us"))


@query(f"SELECT row_seq, x {KM_SQL} AS km, y {KM_SQL} * 1000.0 / 1.0 AS m FROM obs")
def unit_convert(spark, d):
    o = _flat(observations(spark, d))
    u = F.col("units_pos")
    return o.select("row_seq", vocab.to_km(F.col("x"), u).alias("km"), vocab.from_km(vocab.to_km(F.col("y"), u), F.lit(2)).alias("m"))


@query("SELECT estimate_type, CAST(estimate_type - 1 AS INTEGER) AS rank, count(*) AS n FROM obs GROUP BY ALL")
def estimate_priority(spark, d):
    return observations(spark, d).groupBy("estimate_type").agg(F.count("*").alias("n")).select("estimate_type", vocab.estimate_rank(F.col("estimate_type")).alias("rank"), "n")


@query("SELECT units_pos AS code, ['km','m','cm','mm','au','in','ft','mi','nmi'][units_pos] AS word, units_pos AS back FROM (SELECT DISTINCT units_pos FROM obs)")
def vocab_encode_decode(spark, d):
    o = observations(spark, d).select("units_pos").distinct()
    word = vocab.decode(F.col("units_pos"))
    return o.select(F.col("units_pos").alias("code"), word.alias("word"), vocab.encode(word).alias("back"))


# identities

_MINT_SQL = """WITH h AS (SELECT {key}, sha256(unhex('ee8c42090dd59d8d14afc9541cafe95d{kind}') || encode({authority}) || unhex('00') || encode({name})) AS s FROM {table})
SELECT {key}, s[1:12] || '8{kind1}' || s[15:16] || ['8','9','a','b'][(CAST('0x' || s[17:17] AS INT) & 3) + 1] || s[18:32] AS id FROM h"""


@query(_MINT_SQL.format(key="c_custkey", kind="01", kind1="1", authority="'customers.example'", name="c_name", table="customer"))
def id_mint_entity(spark, d):
    return _table(spark, d, "customer").select("c_custkey", F.lower(F.hex(ident.mint_entity(F.lit("Customers.EXAMPLE"), F.col("c_name")))).alias("id"))


@query(_MINT_SQL.format(key="s_suppkey", kind="02", kind1="2", authority="'suppliers'", name="s_name", table="supplier"))
def id_mint_abstract(spark, d):
    return _table(spark, d, "supplier").select("s_suppkey", F.lower(F.hex(ident.mint_abstract(F.lit("Suppliers"), F.col("s_name")))).alias("id"))


@query("WITH i AS (" + _MINT_SQL.format(key="c_custkey", kind="01", kind1="1", authority="'c'", name="c_name", table="customer") + ") SELECT c_custkey, id[1:8] || '-' || id[9:12] || '-' || id[13:16] || '-' || id[17:20] || '-' || id[21:32] AS text, id, true AS valid, 1 AS kind FROM i")
def id_hyphenated(spark, d):
    i = _table(spark, d, "customer").select("c_custkey", ident.mint_entity(F.lit("c"), F.col("c_name")).alias("i"))
    text = ident.hyphenated(F.col("i"))
    return i.select("c_custkey", text.alias("text"), F.lower(F.hex(ident.parse_hex(text))).alias("id"), ident.is_valid(F.col("i")).alias("valid"), ident.kind(F.col("i")).alias("kind"))


@query("WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {e}, {o})" for n, e, o in ident.FRAMES) + ") t(name, e, o)), i AS (SELECT *, format('{:08x}', e) || '0000800080' || format('{:08x}', o) || '000000' AS id FROM f) SELECT name, CAST(e AS INTEGER) AS ephemeris_id, CAST(o AS INTEGER) AS orientation_id, id, CAST(e AS INTEGER) AS e, CAST(o AS INTEGER) AS o, 0 AS kind, id[1:8] || '-' || id[9:12] || '-' || id[13:16] || '-' || id[17:20] || '-' || id[21:32] AS text, row_number() OVER (PARTITION BY e, o ORDER BY list_position([" + ", ".join(f"'{n}'" for n, _, _ in ident.FRAMES) + "], name)) = 1 AS own FROM i")
def id_astro(spark, d):
    f = ident.frames(spark)
    e, o = ident.astro_frame(F.col("frame_id"))
    made = ident.astro_id(F.col("ephemeris_id"), F.col("orientation_id"))
    return f.select("name", "ephemeris_id", "orientation_id", F.lower(F.hex(made)).alias("id"), e.alias("e"), o.alias("o"), ident.kind(F.col("frame_id")).alias("kind"), ident.hyphenated(F.col("frame_id")).alias("text"), ident.is_registrable(F.col("name")).alias("own"))


@query("SELECT body, CAST(n AS INTEGER) AS naif_id, format('{:08x}', n) || '0000800080' || format('{:08x}', n) || '000000' AS entity_id, CASE WHEN n >= 100 AND n % 100 = 99 THEN 10 WHEN n >= 100 THEN n - n % 100 + 99 END AS centre FROM (VALUES " + ", ".join(f"('{b}', {n})" for b, n in ident.BODIES) + ") t(body, n)")
def celestial_body(spark, d):
    return ident.bodies(spark).select("body", "naif_id", F.lower(F.hex("entity_id")).alias("entity_id"), ident.default_centre(F.col("naif_id")).alias("centre"))


@query("SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 9 OR (n BETWEEN 100 AND 999 AND n % 100 = 99) THEN 10 WHEN n BETWEEN 100 AND 999 AND n % 100 <> 0 THEN n - n % 100 + 99 END AS centre FROM (SELECT p_partkey, p_partkey % 1200 AS n FROM part)")
def default_centre(spark, d):
    return _table(spark, d, "part").select("p_partkey", ident.default_centre(F.col("p_partkey") % 1200).alias("centre"))


@query("SELECT s_suppkey, coalesce(n_name, '?') AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def names_left_join(spark, d):
    return R.with_names(_table(spark, d, "supplier"), "s_nationkey", _table(spark, d, "nation"), "n_nationkey", "n_name").select("s_suppkey", "label")


# states

_BEST = "arg_max(row_seq, row(epoch_ns, 1 - estimate_type, -row_seq))"


@query(f"SELECT entity, {_BEST} AS row_seq FROM obs WHERE epoch_ns >= (SELECT max(epoch_ns) FROM obs) - {2 * DAY_NS} GROUP BY entity")
def current_state(spark, d):
    o = observations(spark, d)
    return state.current_state(o, rank=vocab.estimate_rank(F.col("estimate_type")), window_ns=2 * DAY_NS).select("entity", "row_seq")


@query(f"SELECT entity, {_BEST.replace('epoch_ns', 'h')} AS row_seq FROM (SELECT *, epoch_ns // {state.HOUR_NS} AS h FROM obs) GROUP BY entity")
def current_state_ties(spark, d):
    o = observations(spark, d).withColumn("h", F.floor(F.col("epoch_ns") / state.HOUR_NS))
    return state.current_state(o, epoch="h", rank=vocab.estimate_rank(F.col("estimate_type")), not_before=0).select("entity", "row_seq")


@query(f"SELECT entity, {_BEST} AS row_seq FROM obs WHERE epoch_ns >= (SELECT max(epoch_ns) FROM obs) - {2 * DAY_NS} AND entity IN (SELECT s_suppkey FROM supplier) GROUP BY entity")
def current_state_ids(spark, d):
    ids = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return state.current_state(observations(spark, d), rank=vocab.estimate_rank(F.col("estimate_type")), ids=ids, window_ns=2 * DAY_NS).select("entity", "row_seq")


@query("SELECT arg_max(row_seq, row(epoch_ns, -row_seq)) AS row_seq, place FROM (SELECT *, row_number() OVER (PARTITION BY batch_seq ORDER BY row_seq) - 1 AS place FROM obs) GROUP BY place")
def current_state_noid(spark, d):
    return state.current_state_by_position(observations(spark, d), not_before=0).select("row_seq", F.col("place").cast("bigint").alias("place"))


@query("SELECT row_seq, entity FROM obs WHERE batch_seq = (SELECT max(batch_seq) FROM obs)")
def latest_snapshot(spark, d):
    return state.latest_snapshot(observations(spark, d)).select("row_seq", "entity")


@query("SELECT max(epoch_ns) AS epoch FROM obs")
def latest_stored(spark, d):
    return state.latest_epoch(observations(spark, d))


@query("SELECT batch_seq, entity, arg_max(row_seq, row(epoch_ns, -row_seq)) AS row_seq FROM obs GROUP BY batch_seq, entity")
def latest_rows(spark, d):
    return state.batch_latest(observations(spark, d)).select("batch_seq", "entity", "row_seq")


@query("SELECT batch_seq, count(*) AS n_rows, min(epoch_ns) AS min_epoch, max(epoch_ns) AS max_epoch, CAST(sum(16 + 2 * 8 + strlen(event_type)) AS BIGINT) AS bytes FROM obs GROUP BY batch_seq")
def segment_stats(spark, d):
    o = observations(spark, d).select("batch_seq", "epoch_ns", "event_type", F.array("row_seq", "entity").alias("ids"))
    return state.batch_stats(o, size=state.row_bytes(o))


@query("SELECT batch_seq, max(epoch_ns) AS max_epoch FROM obs GROUP BY batch_seq ORDER BY max_epoch, batch_seq LIMIT 1")
def topk_evict(spark, d):
    return state.oldest_batch(observations(spark, d))


@query(f"SELECT entity, row_seq FROM (SELECT *, max(epoch_ns // {DAY_NS}) OVER (PARTITION BY entity) AS m FROM obs) WHERE epoch_ns // {DAY_NS} = m")
def still_latest(spark, d):
    o = observations(spark, d).withColumn("day", F.floor(F.col("epoch_ns") / DAY_NS))
    return state.still_latest(o, epoch="day").select("entity", "row_seq")


@query(f"SELECT row_seq FROM (SELECT *, max(epoch_ns) OVER (PARTITION BY entity) AS m FROM obs) WHERE epoch_ns >= {T1} OR epoch_ns = m")
def retain_evict(spark, d):
    return state.retain(observations(spark, d), T1).select("row_seq")


@query("SELECT min(epoch_ns) AS window_start FROM obs WHERE batch_seq > 0")
def window_start(spark, d):
    return state.window_start(observations(spark, d), F.col("batch_seq") == 0)


@query("SELECT entity, CAST(sum(n) AS BIGINT) AS n_rows, min(a) AS first_epoch, max(b) AS last_epoch, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY s) AS frames FROM (SELECT entity, parent, min(row_seq) AS s, count(*) AS n, min(epoch_ns) AS a, max(epoch_ns) AS b FROM obs GROUP BY entity, parent) GROUP BY entity")
def entity_summary(spark, d):
    return state.entity_summary(observations(spark, d))


@query("SELECT entity, median(step) AS median_step, max(epoch_ns) AS last_epoch FROM (SELECT entity, epoch_ns, epoch_ns - lag(epoch_ns) OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq) AS step FROM obs) GROUP BY entity")
def entity_cadence(spark, d):
    return state.cadence(observations(spark, d))


@query("SELECT units_pos, timescale_id, count(*) AS n FROM obs GROUP BY ALL")
def counts_by_code(spark, d):
    return state.counts_by(observations(spark, d), "units_pos", "timescale_id")


@query("SELECT DISTINCT entity FROM obs")
def distinct_ids(spark, d):
    return state.distinct_ids(observations(spark, d))


@query("SELECT min(epoch_ns) AS first_epoch, max(epoch_ns) AS last_epoch FROM obs")
def epoch_window(spark, d):
    return state.epoch_window(observations(spark, d))


# topology

_LOG = "log AS (SELECT * FROM (SELECT entity AS child, parent, epoch_ns AS epoch, row_seq AS seq, lag(parent) OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq) AS old_parent FROM obs) WHERE parent IS DISTINCT FROM old_parent)"
_TREE = "tree AS (SELECT child, arg_max(parent, row(epoch, seq)) AS parent FROM log GROUP BY child)"


def _log(spark, d):
    return topology.events(observations(spark, d))


@query(f", {_LOG} SELECT child, parent, epoch, seq, old_parent FROM log /* obs */")
def topology_events(spark, d):
    return _log(spark, d)


@query(f", {_LOG} SELECT child, parent, epoch, old_parent FROM log WHERE old_parent IS NOT NULL /* obs */")
def parent_changes(spark, d):
    return topology.parent_changes(_log(spark, d)).select("child", "parent", "epoch", "old_parent")


@query(f", {_LOG} SELECT child, arg_max(parent, row(epoch, seq)) AS parent FROM log WHERE epoch <= {T0} GROUP BY child /* obs */")
def tree_at(spark, d):
    return topology.tree_at(_log(spark, d), T0)


@query(f", {_LOG}, {_TREE} SELECT * FROM tree /* obs */")
def parent_current(spark, d):
    return topology.tree_at(_log(spark, d))


@query(f", {_LOG}, asked AS (SELECT DISTINCT entity AS child, CAST({T1} AS BIGINT) AS epoch FROM obs), top AS (SELECT child, max(epoch) AS te, arg_max(parent, row(epoch, seq)) AS tp FROM log GROUP BY child), logged AS (SELECT child, arg_max(parent, seq) AS lp FROM log WHERE epoch <= {T1} GROUP BY child) SELECT asked.child, asked.epoch, CASE WHEN te <= asked.epoch THEN tp ELSE lp END AS parent FROM asked LEFT JOIN top USING (child) LEFT JOIN logged USING (child) /* obs */")
def parent_asof(spark, d):
    asked = observations(spark, d).select(F.col("entity").alias("child"), F.lit(T1).alias("epoch")).distinct()
    return topology.parent_as_logged(_log(spark, d), asked)


@query(f", {_LOG} SELECT child, parent, epoch FROM (SELECT *, row_number() OVER (PARTITION BY child, epoch < {T1} ORDER BY epoch DESC, seq DESC) AS n FROM log) WHERE epoch >= {T1} OR n = 1 /* obs */")
def trim_log(spark, d):
    return topology.trim(_log(spark, d), T1).select("child", "parent", "epoch")


@query(f", {_LOG}, a AS (SELECT DISTINCT child, parent, epoch FROM log WHERE epoch < {T1}), b AS (SELECT DISTINCT child, parent, epoch FROM log) SELECT * FROM b EXCEPT SELECT * FROM a /* obs */")
def merge_log(spark, d):
    log = _log(spark, d)
    return topology.merge_log(log.where(F.col("epoch") < T1), log).select("child", "parent", "epoch")


@query(f", {_LOG}, {_TREE} SELECT DISTINCT parent AS root FROM tree WHERE parent NOT IN (SELECT child FROM tree) /* obs */")
def roots(spark, d):
    return topology.roots(topology.tree_at(_log(spark, d)))


_UP = f"up AS (SELECT child, 0 AS depth, child AS ancestor FROM tree UNION ALL SELECT up.child, depth + 1, tree.parent FROM up JOIN tree ON up.ancestor = tree.child WHERE up.ancestor <> {EARTH})"


@query(f"WITH RECURSIVE {OBSERVATIONS_SQL}, {_LOG}, {_TREE}, {_UP} SELECT child, depth, ancestor FROM up")
def ancestry(spark, d):
    log = _log(spark, d)
    last = observations(spark, d).agg(F.max("epoch_ns")).first()[0]
    asked = log.select("child", F.lit(last).alias("epoch")).distinct()
    return topology.ancestry(asked, topology.spans(log), is_earth).select("child", "depth", "ancestor")


@query(f"WITH RECURSIVE {OBSERVATIONS_SQL}, {_LOG}, {_TREE}, {_UP}, t AS (SELECT child, arg_max(ancestor, depth) AS root, max(depth) AS depth FROM up GROUP BY child) SELECT root, count(*) AS n_children, max(depth) AS max_depth FROM t GROUP BY root")
def topology_roots_depth(spark, d):
    return topology.depth_by_root(topology.tree_at(_log(spark, d)), is_earth)




_LOOPED = "looped AS (SELECT child, parent FROM tree WHERE child > 2 UNION ALL SELECT * FROM (VALUES (0, 1), (1, 2), (2, 0)) t(child, parent))"


@query(f"WITH RECURSIVE {OBSERVATIONS_SQL}, {_LOG}, {_TREE}, {_LOOPED}, way AS (SELECT child, parent AS above FROM looped UNION SELECT way.child, looped.parent FROM way JOIN looped ON way.above = looped.child) SELECT DISTINCT way.child FROM way WHERE above IN (SELECT child FROM way WHERE child = above)")
def cycle_check(spark, d):
    """The nodes on or below a cycle that is planted in the whole current tree."""
    tree = topology.tree_at(_log(spark, d)).select(F.col("child").cast("bigint").alias("child"), F.col("parent").cast("bigint").alias("parent"))
    return topology.cycle_members(tree.where("child > 2").unionByName(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "child long, parent long")))


# as-of joins and chains

_ONE = f"one AS (SELECT entity AS e2, h, arg_min(row_seq, row_seq) AS px FROM (SELECT *, epoch_ns // {state.HOUR_NS} AS h FROM obs) GROUP BY entity, h)"


@query(f", {_ONE} SELECT o.row_seq, one.px AS pose_seq FROM (SELECT *, epoch_ns // {state.HOUR_NS} AS hh FROM obs) o ASOF LEFT JOIN one ON o.parent = one.e2 AND o.hh >= one.h /* obs */")
def pose_asof(spark, d):
    o = observations(spark, d).withColumn("h", F.floor(F.col("epoch_ns") / state.HOUR_NS))
    right = o.select("entity", "h", "row_seq", F.col("row_seq").alias("pose"))
    return asof.asof_join(o, right, "parent", "entity", "h", "h", {"pose": "pose_seq"}).select("row_seq", "pose_seq")


@query(ORACLE_SQL["pose_asof"])
def pose_asof_buckets(spark, d):
    o = observations(spark, d).withColumn("h", F.floor(F.col("epoch_ns") / state.HOUR_NS))
    right = o.select("entity", "h", "row_seq", F.col("row_seq").alias("pose"))
    return asof.asof_join(o, right, "parent", "entity", "h", "h", {"pose": "pose_seq"}, bucket_ns=48).select("row_seq", "pose_seq")


@query(ORACLE_SQL["pose_asof"])
def pose_asof_intervals(spark, d):
    o = observations(spark, d).withColumn("h", F.floor(F.col("epoch_ns") / state.HOUR_NS))
    right = o.select("entity", "h", "row_seq", F.col("row_seq").alias("pose"))
    return asof.asof_intervals(o, right, "parent", "entity", "h", "h", {"pose": "pose_seq"}).select("row_seq", "pose_seq")


@query("SELECT entity, arg_max(row_seq, row(epoch_ns, -row_seq)) AS row_seq FROM obs GROUP BY entity")
def pose_latest(spark, d):
    return state.latest_pose(observations(spark, d)).select("entity", "row_seq")


@query(f", f AS (SELECT entity AS e2, epoch_ns AS t, row_seq AS s FROM obs), first AS (SELECT entity AS e3, arg_min(row_seq, row(epoch_ns, row_seq)) AS s0 FROM obs GROUP BY entity) SELECT a.entity, coalesce(f.s, first.s0) AS row_seq FROM (SELECT DISTINCT entity, CAST({T0} AS BIGINT) AS at FROM obs) a ASOF LEFT JOIN f ON a.entity = f.e2 AND a.at >= f.t LEFT JOIN first ON a.entity = e3 /* obs */")
def row_at(spark, d):
    o = observations(spark, d)
    asked = o.select("entity", F.lit(T0).alias("at")).distinct()
    right = o.select(F.col("entity").alias("e2"), "epoch_ns", "row_seq", F.col("row_seq").alias("s"))
    return asof.asof_or_first(asked, right, "entity", "e2", "at", "epoch_ns", {"s": "row_seq_found"}).select("entity", F.col("row_seq_found").alias("row_seq"))


@query(f"SELECT a.entity, a.at, count(o.row_seq) AS n_before FROM (SELECT DISTINCT entity, unnest([{T0}, {T1}]) AS at FROM obs) a LEFT JOIN obs o ON o.entity = a.entity AND o.epoch_ns <= a.at GROUP BY ALL")
def count_at_or_before(spark, d):
    o = observations(spark, d)
    asked = o.select("entity").distinct().withColumn("at", F.explode(F.array(F.lit(T0), F.lit(T1))))
    return asof.count_at_or_before(asked, o, "entity", "entity", "at", "epoch_ns").select("entity", "at", F.coalesce("n_before", F.lit(0)).cast("bigint").alias("n_before"))


def _resolved(spark, d):
    o = _km(observations(spark, d))
    last = o.agg(F.max("epoch_ns")).first()[0]
    asked = o.select(F.col("entity").alias("frame"), F.lit(last).alias("epoch")).distinct()
    return transform.resolve(asked, o, is_earth)


@query(f"""WITH RECURSIVE {OBSERVATIONS_SQL}, p AS (SELECT entity, arg_max(struct_pack(up := parent, x := x {KM_SQL}, y := y {KM_SQL}, z := z {KM_SQL}, a := 2 * half_deg), row(epoch_ns, -row_seq)) AS r FROM obs GROUP BY entity),
c AS (SELECT entity AS frame, entity AS top, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 0.0::DOUBLE AS a, 0 AS hops FROM p
UNION ALL SELECT c.frame, p.r.up, p.r.x + cos(radians(p.r.a)) * c.x - sin(radians(p.r.a)) * c.y, p.r.y + sin(radians(p.r.a)) * c.x + cos(radians(p.r.a)) * c.y, p.r.z + c.z, c.a + p.r.a, c.hops + 1 FROM c JOIN p ON c.top = p.entity WHERE c.top <> {EARTH})
SELECT frame, top AS root, hops, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM c WHERE top = {EARTH}""")
def chain_pose(spark, d):
    r = _resolved(spark, d)
    return r.select("frame", "root", "hops", *[F.round(F.get("t", F.lit(i)), 3).alias(n) for i, n in enumerate("xyz")])


@query("SELECT row_seq, parent, epoch_ns // 86400000000000 AS day, dense_rank() OVER (ORDER BY parent, epoch_ns // 86400000000000) AS found FROM obs")
def transform_lookup(spark, d):
    """A costly answer - here a place among all - looked up for each distinct (frame, day) once and joined back to the rows."""
    o = observations(spark, d).withColumn("day", F.floor(F.col("epoch_ns") / DAY_NS))
    return transform.looked_up(o, ["parent", "day"], lambda need: R.placed(need, "parent", "day", place="found")).select("row_seq", "parent", "day", "found")


@query(f"""WITH RECURSIVE {OBSERVATIONS_SQL}, k AS (SELECT row_seq, entity, parent, epoch_ns, x {KM_SQL} AS x, y {KM_SQL} AS y, z {KM_SQL} AS z, 2 * half_deg AS a FROM obs),
p AS (SELECT *, lead(epoch_ns) OVER (PARTITION BY entity ORDER BY epoch_ns) AS until FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY entity, epoch_ns ORDER BY row_seq) = 1)),
c AS (SELECT row_seq, epoch_ns AS e, parent AS top, x, y, z FROM k UNION ALL
SELECT c.row_seq, c.e, p.parent, p.x + cos(radians(p.a)) * c.x - sin(radians(p.a)) * c.y, p.y + sin(radians(p.a)) * c.x + cos(radians(p.a)) * c.y, p.z + c.z FROM c JOIN p ON c.top = p.entity AND c.e >= p.epoch_ns AND (p.until IS NULL OR c.e < p.until) WHERE c.top <> {EARTH})
SELECT k.row_seq, CASE WHEN c.top IS NOT NULL THEN {EARTH} END AS root, {", ".join(f"round(sign(c.{v}) * ln(1 + abs(c.{v})), 5) AS root_{v}" for v in "xyz")} FROM k LEFT JOIN c ON k.row_seq = c.row_seq AND c.top = {EARTH}""")
def transform_to_root(spark, d):
    """Every row's pose in its root at its own epoch; distances as signed logarithms, as units go from inches to astronomical ones."""
    o = _km(observations(spark, d))
    need = o.select(F.col("parent").alias("frame"), F.col("epoch_ns").alias("epoch"))
    found = transform.to_root(observations(spark, d), transform.resolve(need, o, is_earth))
    return found.select("row_seq", "root", *[F.round(F.signum(c) * F.log(1 + F.abs(F.col(c))), 5).alias(c) for c in ("root_x", "root_y", "root_z")])


# timelines


@query(f""", g AS (SELECT entity, lo + (hi - lo) // 9 * i AS t FROM (SELECT DISTINCT entity FROM obs), (SELECT min(epoch_ns) AS lo, max(epoch_ns) AS hi FROM obs), range(10) r(i)),
s AS (SELECT entity, epoch_ns AS e, x, parent AS f, units_pos AS u FROM obs),
a AS (SELECT g.entity, g.t, s.e AS ae, s.x AS ax, s.f AS af, s.u AS au FROM g ASOF LEFT JOIN s ON g.entity = s.entity AND g.t >= s.e),
b AS (SELECT a.*, s.e AS be, s.x AS bx, s.f AS bf, s.u AS bu FROM a ASOF LEFT JOIN s ON a.entity = s.entity AND a.t < s.e)
SELECT entity, t, round(CASE WHEN ae IS NULL THEN bx WHEN be IS NULL OR af <> bf OR au <> bu THEN ax ELSE ax + (bx - ax) * (CAST(t - ae AS DOUBLE) / (be - ae)) END, 6) AS x,
coalesce(ae IS NOT NULL AND be IS NOT NULL AND (af <> bf OR au <> bu), false) AS cross_frame FROM b /* obs */""")
def interpolate(spark, d):
    o = _flat(observations(spark, d))
    ends = o.agg(F.min("epoch_ns").alias("lo"), F.max("epoch_ns").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) // 9
    grid = o.select("entity").distinct().withColumn("t", F.explode(F.array(*[F.lit(ends["lo"] + step * i) for i in range(10)])))
    return timeline.interpolate(grid, o).select("entity", "t", F.round("x", 6).alias("x"), "cross_frame")


_STEP = "SELECT *, epoch_ns - lag(epoch_ns) OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq) AS step FROM obs"


@query(f"SELECT entity, max(epoch_ns) AS run_end, count(*) AS n_run FROM (SELECT *, sum(CASE WHEN step > {12 * state.HOUR_NS} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq ROWS UNBOUNDED PRECEDING) AS run FROM ({_STEP})) WHERE run = 0 GROUP BY entity")
def gap_run(spark, d):
    return timeline.first_run(observations(spark, d), 12 * state.HOUR_NS)


@query(f"SELECT entity, CAST(run AS BIGINT) AS run, count(*) AS n_run FROM (SELECT *, sum(CASE WHEN step > {12 * state.HOUR_NS} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq ROWS UNBOUNDED PRECEDING) AS run FROM ({_STEP})) GROUP BY ALL")
def gap_runs(spark, d):
    return timeline.runs(observations(spark, d), 12 * state.HOUR_NS).select("entity", "run", "n_run")


@query("""SELECT entity, round(CASE WHEN count(xt) > 1 THEN (max(xt) - min(xt)) / (count(xt) - 1) END / 1e9, 3) AS period_s, count(xt) AS crossings FROM (SELECT entity, CASE WHEN v < 0 AND w >= 0 THEN t + (epoch_ns - t) * (-v) / (w - v) END AS xt FROM
(SELECT entity, epoch_ns, y - 500 AS w, lag(y - 500) OVER p AS v, lag(epoch_ns) OVER p AS t FROM obs WINDOW p AS (PARTITION BY entity ORDER BY epoch_ns, row_seq))) GROUP BY entity""")
def nodal_period(spark, d):
    o = _flat(observations(spark, d)).withColumn("v", F.col("y") - 500)
    return timeline.nodal_period(o, "v").select("entity", F.round(F.col("period") / 1e9, 3).alias("period_s"), "crossings")


@query("SELECT entity, count(*) FILTER (x < p) = 0 AS monotone, count(*) FILTER (x < p) AS falls FROM (SELECT entity, x, lag(x) OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq) AS p FROM obs) GROUP BY entity")
def monotone_check(spark, d):
    return timeline.monotone(_flat(observations(spark, d)), "x")


@query(f"SELECT entity, count(*) FILTER (step <> {state.HOUR_NS}) AS uneven, count(*) AS n_rows, CAST((max(epoch_ns) - min(epoch_ns)) // {state.HOUR_NS} + 1 AS BIGINT) AS expected FROM ({_STEP}) GROUP BY entity")
def exact_spacing(spark, d):
    return timeline.exact_spacing(observations(spark, d), state.HOUR_NS)


@query("SELECT entity, max(abs((((s + 180) % 360) + 360) % 360 - 180)) AS max_turn FROM (SELECT entity, a - lag(a) OVER (PARTITION BY entity ORDER BY epoch_ns, row_seq) AS s FROM (SELECT *, half_deg * 2.0::DOUBLE AS a FROM obs)) GROUP BY entity")
def alias_step(spark, d):
    o = observations(spark, d).withColumn("a", (F.col("row_seq") % 8) * 45.0)
    return timeline.largest_turn(o, "a")


@query("SELECT row_seq, round(sqrt(power(x - (3 * lag(x, 1) OVER w - 3 * lag(x, 2) OVER w + lag(x, 3) OVER w), 2)), 6) AS gap FROM obs WINDOW w AS (PARTITION BY entity ORDER BY epoch_ns, row_seq)")
def extrapolation_gap(spark, d):
    return timeline.extrapolation_gap(_flat(observations(spark, d)), ["x"]).select("row_seq", F.round("gap", 6).alias("gap"))


@query("""SELECT row_seq, round(speed, 6) AS speed, round((speed - lag(speed) OVER w) * 5, 6) AS accel FROM (SELECT *, (u - lag(u) OVER w) * 5 AS speed FROM
(SELECT *, a + sum(coalesce(-round_even((a - p) / 360.0, 0) * 360.0, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS u FROM (SELECT *, lag(a) OVER w AS p FROM (SELECT *, (x * 3.7 + row_seq % 5 * 80) % 360 AS a FROM obs) WINDOW w AS (PARTITION BY entity ORDER BY epoch_ns, row_seq)) WINDOW w AS (PARTITION BY entity ORDER BY epoch_ns, row_seq))
WINDOW w AS (PARTITION BY entity ORDER BY epoch_ns, row_seq)) WINDOW w AS (PARTITION BY entity ORDER BY epoch_ns, row_seq)""")
def joint_speed_accel(spark, d):
    """Rates of an angle that jumps by whole turns, which are taken out first."""
    o = _flat(observations(spark, d)).withColumn("a", (F.col("x") * 3.7 + F.col("row_seq") % 5 * 80) % 360)
    return timeline.rates(timeline.unwrapped(o, "a"), "unwrapped", 5.0).select("row_seq", *_r("speed", "accel"))


@query("SELECT row_seq, round((lead(x) OVER w - lag(x) OVER w) / ((lead(epoch_ns) OVER w - lag(epoch_ns) OVER w) / 1e9), 9) AS rate FROM obs WINDOW w AS (PARTITION BY entity ORDER BY epoch_ns, row_seq)")
def central_difference(spark, d):
    return timeline.central_difference(_flat(observations(spark, d)), "x").select("row_seq", F.round("rate", 9).alias("rate"))


@query(""", now AS (SELECT entity, arg_max(parent, row(epoch_ns, row_seq)) AS p FROM obs GROUP BY entity), own AS (SELECT obs.*, sqrt(x*x + y*y + z*z) AS r FROM obs JOIN now USING (entity) WHERE parent = p),
agg AS (SELECT entity, count(*) AS n, avg(r) AS m, max(r) AS hi, min(r) AS lo, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM own GROUP BY entity)
SELECT entity, CASE WHEN n < 2 OR m = 0 OR span < 1e-6 * m THEN 'none' WHEN greatest(hi - m, m - lo) / m < 0.02 THEN 'circle' ELSE 'trail' END AS shape, round(m, 6) AS mean_radius, n FROM agg /* obs */""")
def guide_line(spark, d):
    return timeline.guide_line(_flat(observations(spark, d))).select("entity", "shape", F.round("mean_radius", 6).alias("mean_radius"), "n")


@query("SELECT entity, round(sqrt(avg(x*x)), 6) AS rms, round(kurtosis_pop(x) + 3, 6) AS kurtosis, round(max(x) - min(x), 6) AS peak_to_peak, round(max(abs(x)), 6) AS max_abs FROM obs GROUP BY entity HAVING count(*) > 3")
def rms_kurtosis(spark, d):
    o = _flat(observations(spark, d))
    many = o.groupBy("entity").count().where("count > 3").select("entity")
    return timeline.signal_stats(o.join(many, "entity"), "entity", "x").select("entity", *_r("rms", "kurtosis", "peak_to_peak", "max_abs"))


@query("SELECT entity, round(abs(sum(x * ny - nx * y)) / 2, 3) AS area FROM (SELECT *, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY entity ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY entity ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ny FROM obs WINDOW w AS (PARTITION BY entity ORDER BY row_seq)) GROUP BY entity")
def polygon_area(spark, d):
    return timeline.polygon_area(_flat(observations(spark, d)), "entity", "row_seq", "x", "y").select("entity", F.round("area", 3).alias("area"))


# joins


@query("SELECT count(*) AS n, max(abs(a.x - b.value)) AS max_error FROM obs a JOIN events b ON a.row_seq = b.event_id")
def truth_exact_join(spark, d):
    o = _flat(observations(spark, d)).withColumnRenamed("row_seq", "k")
    return joins.exact_join_error(o, _table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("value").alias("x")), ["k"], "x")


@query("SELECT row_seq FROM (SELECT *, epoch_ns // 86400000000000 AS d FROM obs) o WHERE NOT EXISTS (SELECT 1 FROM (SELECT entity, epoch_ns // 86400000000000 AS d FROM obs) p WHERE p.entity = o.parent AND p.d = o.d)")
def same_epoch_parent(spark, d):
    o = observations(spark, d).withColumn("day", F.floor(F.col("epoch_ns") / DAY_NS))
    return joins.without_parent_row(o, epoch="day").select("row_seq")


@query("SELECT row_seq FROM obs WHERE batch_seq = (SELECT min(batch_seq) FROM obs b WHERE b.entity = obs.entity)")
def merge_dedup(spark, d):
    o = observations(spark, d)
    first = o.groupBy("entity").agg(F.min("batch_seq").alias("first"))
    tagged = o.join(first, "entity")
    parts = [tagged.where("batch_seq = first"), tagged.where("batch_seq > first")]
    return joins.merge_parts(parts).select("row_seq")


@query(", h AS (SELECT entity, epoch_ns // 86400000000000 AS d, min(x) AS x, min(y) AS y, min(z) AS z FROM obs GROUP BY ALL) SELECT o.row_seq, round(sqrt(power(o.x - h.x, 2) + power(o.y - h.y, 2) + power(o.z - h.z, 2)), 6) AS distance FROM (SELECT *, epoch_ns // 86400000000000 AS d FROM obs) o JOIN h ON o.parent = h.entity AND o.d = h.d /* obs */")
def host_pairing(spark, d):
    o = _flat(observations(spark, d)).withColumn("day", F.floor(F.col("epoch_ns") / DAY_NS))
    hosts = o.groupBy("entity", "day").agg(*[F.min(c).alias(c) for c in "xyz"])
    return joins.host_pairs(o.select("row_seq", "parent", "day", "x", "y", "z"), hosts, epoch="day").select("row_seq", F.round("distance", 6).alias("distance"))


@query(", pl AS (SELECT n_name, n_nationkey * 40.0 AS x, n_nationkey * 39.0 AS y, CAST(n_regionkey AS DOUBLE) AS z FROM nation) SELECT row_seq, arg_min(n_name, row(power(o.x - pl.x, 2) + power(o.y - pl.y, 2) + power(o.z - pl.z, 2), pl.x)) AS nearest, round(min(sqrt(power(o.x - pl.x, 2) + power(o.y - pl.y, 2) + power(o.z - pl.z, 2))), 6) AS distance FROM obs o, pl GROUP BY row_seq /* obs */")
def nearest_place(spark, d):
    n = _table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 40.0).alias("x"), (F.col("n_nationkey") * 39.0).alias("y"), F.col("n_regionkey").cast("double").alias("z"))
    return joins.nearest_place(_flat(observations(spark, d)), n, "n_name").select("row_seq", "nearest", F.round("distance", 6).alias("distance"))


@query(f"SELECT row_seq FROM obs WHERE batch_seq = (SELECT max(batch_seq) FROM obs WHERE batch_seq <= 7)")
def grid_asof(spark, d):
    return joins.grid_asof(observations(spark, d), 7, "batch_seq").select("row_seq")


@query("SELECT row_seq FROM obs WHERE x > 10 AND x < 200 AND y > 100 AND y < 900 AND NOT (x > 50 AND x < 100 AND y > 300 AND y < 500) AND x NOT IN (10, 50, 100, 200) AND y NOT IN (100, 300, 500, 900)")
def point_in_polygon(spark, d):
    box = lambda a, b, c, e: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((a, c), (b, c), (b, e), (a, e))])
    o = _flat(observations(spark, d)).where("x NOT IN (10, 50, 100, 200) AND y NOT IN (100, 300, 500, 900)")
    return o.where(geo.in_polygon(F.col("x"), F.col("y"), F.array(box(10, 200, 100, 900), box(50, 100, 300, 500)))).select("row_seq")


@query(""", s AS (SELECT row_seq AS id, z AS ax, CAST(row_seq % 977 AS DOUBLE) AS ay, z + 3.5 AS bx, CAST(row_seq % 977 AS DOUBLE) + CAST(row_seq % 7 AS DOUBLE) - 3.25 AS by_, row_seq AS born, event_type FROM obs),
t AS (SELECT id, ax + 1.0 AS ax, ay - 1.25 AS ay, bx - 1.5 AS bx, ay + 2.5 AS by_, born FROM s WHERE event_type = 'purchase')
SELECT s.id AS segment, t.id AS barrier FROM s, t WHERE t.born < s.born
AND ((s.bx-s.ax)*(t.ay-s.ay)-(s.by_-s.ay)*(t.ax-s.ax))*((s.bx-s.ax)*(t.by_-s.ay)-(s.by_-s.ay)*(t.bx-s.ax)) < 0
AND ((t.bx-t.ax)*(s.ay-t.ay)-(t.by_-t.ay)*(s.ax-t.ax))*((t.bx-t.ax)*(s.by_-t.ay)-(t.by_-t.ay)*(s.bx-t.ax)) < 0 /* obs */""")
def segment_intersect(spark, d):
    o = _flat(observations(spark, d))
    y = (F.col("row_seq") % 977).cast("double")
    s = o.select(F.col("row_seq").alias("id"), F.col("z").alias("ax"), y.alias("ay"), (F.col("z") + 3.5).alias("bx"), (y + (F.col("row_seq") % 7).cast("double") - 3.25).alias("by"), F.col("row_seq").alias("born"), "event_type")
    t = s.where("event_type = 'purchase'").select("id", (F.col("ax") + 1.0).alias("ax"), (F.col("ay") - 1.25).alias("ay"), (F.col("bx") - 1.5).alias("bx"), (F.col("ay") + 2.5).alias("by"), "born")
    return joins.crossings(s, t, 8.0)


def _leg(a, b):
    (ax, ay), (bx, by) = a, b
    dx, dy = bx - ax, by - ay
    t = f"greatest(0.0, least(1.0, ((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {dx * dx + dy * dy}))"
    return f"sqrt(power({ax} + {t} * {dx} - x, 2) + power({ay} + {t} * {dy} - y, 2))"


_LINE = [(0.0, 0.0), (100.0, 300.0), (50.0, 700.0), (300.0, 1000.0)]


@query(f"SELECT row_seq, round(least({', '.join(_leg(a, b) for a, b in zip(_LINE[:-1], _LINE[1:], strict=True))}), 6) AS distance FROM obs")
def polyline_distance(spark, d):
    o = _flat(observations(spark, d))
    return o.select("row_seq", F.round(joins.polyline_distance(o, _LINE, "x", "y"), 6).alias("distance"))


@query("SELECT entity, day, 'left' AS side FROM (SELECT DISTINCT entity, epoch_ns // 86400000000000 AS day FROM obs WHERE event_type = 'click' EXCEPT SELECT DISTINCT entity, epoch_ns // 86400000000000 FROM obs WHERE event_type = 'purchase') UNION ALL SELECT entity, day, 'right' FROM (SELECT DISTINCT entity, epoch_ns // 86400000000000 AS day FROM obs WHERE event_type = 'purchase' EXCEPT SELECT DISTINCT entity, epoch_ns // 86400000000000 FROM obs WHERE event_type = 'click')")
def set_equality(spark, d):
    """The days on which an entity clicked and those on which it bought, less what both have."""
    o = observations(spark, d).withColumn("day", F.floor(F.col("epoch_ns") / DAY_NS))
    side = lambda t: o.where(F.col("event_type") == t).select("entity", "day").distinct()
    return joins.difference(side("click"), side("purchase"))


@query("SELECT CAST(g AS BIGINT) AS slot FROM (SELECT unnest(range(lo, hi + 1)) AS g FROM (SELECT min(epoch_ns // 60000000000) AS lo, max(epoch_ns // 60000000000) AS hi FROM obs)) WHERE g NOT IN (SELECT epoch_ns // 60000000000 FROM obs)")
def schedule_check(spark, d):
    """The minutes in which no row stands."""
    return timeline.empty_slots(observations(spark, d), 60_000_000_000)


# expressions


@query("SELECT row_seq, round(degrees(atan2(sin(radians(2 * half_deg)), cos(radians(2 * half_deg)))), 4) AS yaw, round(x * cos(radians(2 * half_deg)) - y * sin(radians(2 * half_deg)), 6) AS rx, round(x * sin(radians(2 * half_deg)) + y * cos(radians(2 * half_deg)), 6) AS ry FROM obs")
def quat_rotate(spark, d):
    o = observations(spark, d)
    p = quat.rotate(F.col("quaternion"), F.col("position"))
    return o.select("row_seq", F.round(F.degrees(quat.heading(F.col("quaternion"))), 4).alias("yaw"), F.round(p[0], 6).alias("rx"), F.round(p[1], 6).alias("ry"))


@query("SELECT row_seq, round(cos(radians(half_deg + 15)), 6) AS w, round(sin(radians(half_deg + 15)), 6) AS z FROM obs")
def quat_mul(spark, d):
    q = quat.mul(quat.yaw(F.radians(F.lit(30.0))), F.col("quaternion"))
    return observations(spark, d).select("row_seq", F.round(q[0], 6).alias("w"), F.round(q[3], 6).alias("z"))


@query("SELECT c_custkey, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(h AS DOUBLE) AS h FROM (SELECT c_custkey, c_custkey % 160 - 80.0 AS lat, c_custkey % 340 - 170.0 AS lon, c_custkey % 30 * 0.5 AS h FROM customer)")
def geodetic_round_trip(spark, d):
    c = _table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 160 - 80.0).alias("lat"), (F.col("c_custkey") % 340 - 170.0).alias("lon"), (F.col("c_custkey") % 30 * 0.5).alias("h"))
    x, y, z = geo.geodetic_to_fixed(F.col("lat"), F.col("lon"), F.col("h"))
    c = c.withColumns({"x": x, "y": y, "z": z})
    back = geo.fixed_to_geodetic(F.col("x"), F.col("y"), F.col("z"), steps=10)
    return c.select("c_custkey", *[F.round(v, 6).alias(n) for v, n in zip(back, ("lat", "lon", "h"), strict=True)])


@query("SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * power(sin(radians(f - e) / 2), 2)))), 4) AS km FROM (SELECT c_custkey, c_custkey % 170 - 85.0 AS a, c_custkey % 130 - 65.0 AS b, c_custkey % 350 - 175.0 AS e, c_custkey % 310 - 155.0 AS f FROM customer)")
def great_circle(spark, d):
    k = F.col("c_custkey")
    return _table(spark, d, "customer").select("c_custkey", F.round(geo.great_circle_km(k % 170 - 85.0, k % 350 - 175.0, k % 130 - 65.0, k % 310 - 155.0), 4).alias("km"))


@query("SELECT row_seq, ((x + 180) % 360 + 360) % 360 - 180 AS wrapped, round((degrees(atan2(x, y - 500)) + 360) % 360, 6) AS bearing FROM (SELECT row_seq, round(x * 10) AS x, y FROM obs)")
def wrap_bearing(spark, d):
    o = _flat(observations(spark, d)).select("row_seq", F.round(F.col("x") * 10).alias("x"), "y")
    return o.select("row_seq", geo.wrap180(F.col("x")).alias("wrapped"), F.round(geo.bearing_deg(F.col("x"), F.col("y") - 500), 6).alias("bearing"))


@query("SELECT c_custkey, CAST(7000.0 + c_custkey % 900 * 10 AS DOUBLE) AS sma_km, CAST(c_custkey % 80 / 100.0 AS DOUBLE) AS ecc, CAST(c_custkey % 170 + 5.0 AS DOUBLE) AS inc_deg, CAST(c_custkey % 360 AS DOUBLE) AS raan_deg, CAST(CASE WHEN c_custkey % 80 = 0 THEN 0 ELSE c_custkey % 350 END AS DOUBLE) AS aop_deg, round(2 * pi() * sqrt(power(7000.0 + c_custkey % 900 * 10, 3) / 398600.4418), 4) AS period_s, round(sqrt(398600.4418 * (7000.0 + c_custkey % 900 * 10) * (1 - power(c_custkey % 80 / 100.0, 2))), 2) AS momentum FROM customer")
def orbit_elements(spark, d):
    """Kepler orbits by customer, turned into states, carried on by 1000 s and back, and turned into elements again."""
    k = F.col("c_custkey")
    angle = lambda c: F.radians(c * 1.0)
    c = _table(spark, d, "customer").select("c_custkey", (7000.0 + k % 900 * 10).alias("sma"), (k % 80 / 100.0).alias("ecc"), F.radians(k % 170 + 5.0).alias("inc"), angle(k % 360).alias("raan"), angle(k % 350).alias("aop"), angle(k % 300).alias("mean"), F.lit(398600.4418).alias("mu"))
    c = c.withColumn("s", orbits.kepler_states("sma", "ecc", "inc", "raan", "aop", "mean", "mu"))
    for dt in (1000.0, -1000.0):
        c = c.withColumn("s", orbits.propagated(F.col("s.position"), F.col("s.velocity"), F.lit(dt), F.col("mu")))
    c = c.select("c_custkey", "mu", F.col("s.position").alias("r"), F.col("s.velocity").alias("v"))
    e = orbits.elements(F.col("r"), F.col("v"), F.col("mu"))
    turn = lambda name: F.pmod(F.round(e[name], 4), F.lit(360.0)).alias(name)
    return c.select("c_custkey", F.round(e["sma_km"], 4).alias("sma_km"), F.round(e["ecc"], 6).alias("ecc"), F.round(e["inc_deg"], 4).alias("inc_deg"), turn("raan_deg"), F.when(F.round(e["ecc"], 6) == 0, 0.0).otherwise(turn("aop_deg")).alias("aop_deg"), F.round(e["period_s"], 4).alias("period_s"), F.round(quat.norm(quat.cross(F.col("r"), F.col("v"))), 2).alias("momentum"))






_TURN = "2 * pi() * ((j * k) % n) / n"


@query(f""", s AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY row_seq) - 1 AS j, count(*) OVER (PARTITION BY entity) AS n, x FROM obs),
ks AS (SELECT entity, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT entity, n FROM s)),
band AS (SELECT s.entity, s.n, k, sum(x * cos({_TURN.replace("n)", "s.n)").replace("/ n", "/ s.n")})) AS re, -sum(x * sin({_TURN.replace("n)", "s.n)").replace("/ n", "/ s.n")})) AS im FROM s JOIN ks USING (entity) WHERE 2 * k < s.n AND k * 100.0 / s.n BETWEEN 5 AND 40 GROUP BY ALL),
e AS (SELECT s.entity, j, s.n, coalesce(sqrt(power(sum(re * cos({_TURN.replace("n)", "s.n)").replace("/ n", "/ s.n")}) - im * sin({_TURN.replace("n)", "s.n)").replace("/ n", "/ s.n")})), 2) + power(sum(re * sin({_TURN.replace("n)", "s.n)").replace("/ n", "/ s.n")}) + im * cos({_TURN.replace("n)", "s.n)").replace("/ n", "/ s.n")})), 2)) * 2 / s.n, 0) AS env FROM s LEFT JOIN band USING (entity) GROUP BY s.entity, j, s.n),
d AS (SELECT entity, j, n, env - avg(env) OVER (PARTITION BY entity) AS v FROM e)
SELECT d.entity, round(k * 100.0::DOUBLE / d.n, 6) AS freq, round(sqrt(power(sum(v * cos({_TURN.replace("n)", "d.n)").replace("/ n", "/ d.n")})), 2) + power(sum(v * sin({_TURN.replace("n)", "d.n)").replace("/ n", "/ d.n")})), 2)) * 2 / d.n, 6) AS amp FROM d JOIN ks USING (entity) GROUP BY d.entity, k, d.n /* obs */""")
def envelope_spectrum(spark, d):
    o = _flat(observations(spark, d))
    return joins.envelope_spectra(o, "entity", "row_seq", "x", 100.0, 5.0, 40.0).select("entity", F.round("freq", 6).alias("freq"), F.round("amp", 6).alias("amp"))


@query(f""", w AS (SELECT entity, epoch_ns AS t, x, y, y - 400 AS side, row_number() OVER p AS n, lag(epoch_ns) OVER p AS ot, lag(y - 400) OVER p AS os, lag(x) OVER p AS oa FROM obs WINDOW p AS (PARTITION BY entity ORDER BY epoch_ns)),
c AS (SELECT *, CASE WHEN n > 1 AND sign(side) <> sign(os) AND oa + os / (os - side) * (x - oa) BETWEEN 0 AND 300 THEN ot + os / (os - side) * (t - ot) END AS met FROM w),
a AS (SELECT *, min(CASE WHEN os < 0 AND side >= 0 AND met >= {T0} THEN n END) OVER (PARTITION BY entity) AS n0 FROM c),
b AS (SELECT *, min(CASE WHEN n > n0 AND sqrt(power(x - 100, 2) + power(y - 900, 2)) <= 200 THEN n END) OVER (PARTITION BY entity) AS n1 FROM a),
e AS (SELECT *, min(CASE WHEN n > n1 AND least(sqrt(power(x - 50, 2) + power(y - 100, 2)), sqrt(power(x - 150, 2) + power(y - 100, 2))) <= 200 THEN n END) OVER (PARTITION BY entity) AS n2 FROM b),
f AS (SELECT *, min(CASE WHEN n > n2 AND os >= 0 AND side < 0 AND met IS NOT NULL THEN n END) OVER (PARTITION BY entity) AS n3 FROM e),
r AS (SELECT entity, bool_or(n > 1 AND t = {T0} AND side > 0) AS early, CAST(max((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT - (n0 IS NULL)::INT) AS BIGINT) AS leg, max(CASE WHEN n = n0 THEN met END) AS started, max(CASE WHEN n = n3 THEN met END) AS finished FROM f GROUP BY entity)
SELECT *, row_number() OVER (ORDER BY finished IS NULL, finished, -leg, leg, entity) AS place FROM r /* obs */""")
def replay_referee(spark, d):
    o = _flat(observations(spark, d))
    result = joins.race(o, ((0.0, 400.0), (300.0, 400.0)), [[(100.0, 900.0)], [(50.0, 100.0), (150.0, 100.0)]], 200.0, T0)
    return joins.standings(result, "leg").drop("rounded")


@query("SELECT row_seq, CASE WHEN batch_seq % 2 = 0 THEN 0 ELSE 1 END AS part FROM obs")
def concat_batches(spark, d):
    o = observations(spark, d)
    return R.concat([o.where("batch_seq % 2 = 0"), o.where("batch_seq % 2 = 1")], "part").select("row_seq", "part")


@query("SELECT entity, row_seq, row_number() OVER (ORDER BY entity, epoch_ns, row_seq) AS place FROM obs")
def sort_by_epoch(spark, d):
    return R.placed(observations(spark, d).select("entity", "epoch_ns", "row_seq"), "entity", "epoch_ns", "row_seq").select("entity", "row_seq", "place")




@query("SELECT row_seq FROM obs WHERE y > 300 AND x > 20")
def mask_apply(spark, d):
    o = _flat(observations(spark, d))
    return R.masked(o, F.when(F.col("y") > 300, F.col("x") > 20)).select("row_seq")


@query("SELECT batch_seq, count(*) FILTER (parent <> -399) > 0 AS refers FROM obs WHERE batch_seq <= 3 GROUP BY batch_seq UNION ALL SELECT -1, false")
def rows_on_entity_frames(spark, d):
    """Whether any row of a batch is on an entity's frame: of the first four, and of the rows that aren't."""
    o = observations(spark, d)
    first = sorted(r[0] for r in o.where("batch_seq <= 3").select("batch_seq").distinct().collect())  # four at most
    parts = {b: o.where(F.col("batch_seq") == b) for b in first} | {-1: o.where(F.col("parent") == EARTH)}
    return spark.createDataFrame([(b, topology.refers_to_entities(p, is_earth)) for b, p in parts.items()], "batch_seq bigint, refers boolean")


@query("SELECT entity, max(x) - min(x) AS span, max(abs(y)) AS largest, round(min(sqrt(x*x + y*y + z*z)), 6) AS nearest, round(max(sqrt(x*x + y*y + z*z)), 6) AS farthest FROM obs GROUP BY entity")
def extrema_checks(spark, d):
    return timeline.extrema(_flat(observations(spark, d))).select("entity", "span", "largest", *_r("nearest", "farthest"))


@query("SELECT entity, arg_min(row_seq, row(x*x + y*y, row_seq)) AS row_seq FROM obs GROUP BY entity")
def perihelion(spark, d):
    return timeline.closest_row(_flat(observations(spark, d)), F.col("x") * F.col("x") + F.col("y") * F.col("y"))


@query("SELECT parent, round(median(x / (y + 1)), 6) AS slip FROM obs GROUP BY parent")
def median_slip(spark, d):
    return timeline.median_ratio(_flat(observations(spark, d)), F.col("x"), F.col("y") + 1, "parent").select("parent", F.round("ratio", 6).alias("slip"))


@query("SELECT entity, round(max(CASE WHEN abs(y - 500) <= 100 THEN x END) / median(x), 6) AS peak FROM obs GROUP BY entity HAVING median(x) > 0")
def median_floor_peak(spark, d):
    o = _flat(observations(spark, d))
    some = o.groupBy("entity").agg(F.median("x").alias("m")).where("m > 0").select("entity")
    return timeline.peak_over_floor(o.join(some, "entity"), "entity", "y", "x", 500, 100).select("entity", F.round("peak", 6).alias("peak"))


@query("SELECT p.row_seq, round(min(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))), 6) AS distance FROM obs p LEFT JOIN obs q ON p.parent = q.parent AND p.batch_seq = q.batch_seq AND p.entity <> q.entity GROUP BY p.row_seq")
def nearest_moving(spark, d):
    o = _flat(observations(spark, d)).select("row_seq", "entity", "parent", "batch_seq", "x", "y")
    return joins.nearest_moving(o).select("row_seq", F.round("distance", 6).alias("distance"))


def _names(spark, d):
    c = _table(spark, d, "customer")
    i = ident.mint_entity(F.lit("customers"), F.col("c_name"))
    return c.select(i.alias("prescribed_id"), F.lit("customers").alias("authority"), F.col("c_name").alias("common_name"), F.lit(1).cast("smallint").alias("kind"), "c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY id) AS place FROM (" + _MINT_SQL.format(key="c_custkey", kind="01", kind1="1", authority="'customers'", name="c_name", table="customer") + ")")
def export_names(spark, d):
    return R.placed(_names(spark, d), "prescribed_id").select("c_custkey", "place")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3")
def registry_verify(spark, d):
    from wherewhen.sources import names

    tampered = _names(spark, d).withColumn("common_name", F.when(F.col("c_custkey") % 10 == 3, F.concat("common_name", F.lit("x"))).otherwise(F.col("common_name")))
    return names.unverified(tampered).select("c_custkey")


@query("SELECT count(*) AS n_names, count(*) FILTER (c_custkey % 2 = 1) AS learned FROM customer")
def merge_names(spark, d):
    from wherewhen.sources import names

    n = _names(spark, d)
    merged, fresh = names.merge(n.where("c_custkey % 2 = 0").drop("c_custkey"), n.drop("c_custkey"))
    return merged.agg(F.count("*").alias("n_names")).withColumn("learned", F.lit(fresh).cast("bigint"))


@query("SELECT c_name AS common_name, 'left' AS side FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0 UNION ALL SELECT c_name, 'right' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0")
def symmetric_diff(spark, d):
    n = _names(spark, d)
    return joins.difference(n.where("c_custkey % 5 = 0").select("common_name"), n.where("c_custkey % 7 = 0").select("common_name"))


@query("SELECT true AS equal, false AS altered_equal, count(*) FILTER (row_seq % 10 = 0) AS n_left, count(*) FILTER (row_seq % 10 = 0) + count(*) FILTER (row_seq % 100 = 3) AS n_right FROM obs")
def ledger_equal(spark, d):
    """A ledger's rows against themselves dealt anew, and against a copy with some rows altered and some twice."""
    o = observations(spark, d).select("row_seq", "entity", "epoch_ns")
    altered = o.withColumn("entity", F.when(F.col("row_seq") % 10 == 0, F.col("entity") + 1).otherwise(F.col("entity"))).unionByName(o.where("row_seq % 100 = 3"))
    same = joins.same_rows(o, o.repartition(7, "entity"))
    n = joins.difference(o, altered).groupBy().agg(F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"))
    return n.select(F.lit(same).alias("equal"), ((F.col("n_left") + F.col("n_right")) == 0).alias("altered_equal"), "n_left", "n_right")


@query("SELECT row_seq, round(cos(radians(h / 2)), 6) AS w, round(sin(radians(h / 2)), 6) AS z FROM (SELECT row_seq, CASE WHEN half_deg <= 90 THEN half_deg ELSE half_deg - 180 END AS h FROM obs)")
def slerp(spark, d):
    o = observations(spark, d)
    q = quat.slerp(quat.vector(*quat.IDENTITY), F.col("quaternion"), F.lit(0.5))
    return o.select("row_seq", F.round(q[0], 6).alias("w"), F.round(q[3], 6).alias("z"))


@query("SELECT row_seq, round(abs(cos(radians(half_deg))), 6) AS w, round(cos(radians(2 * half_deg)), 6) AS xx FROM obs")
def quat_matrix(spark, d):
    m = quat.matrix(F.col("quaternion"))
    return observations(spark, d).select("row_seq", F.round(F.abs(quat.from_matrix(m)[0]), 6).alias("w"), F.round(m[0][0], 6).alias("xx"))


@query("SELECT row_seq, round(cos(radians(2 * half_deg)) * x - sin(radians(2 * half_deg)) * y + 10, 6) AS px, round(sin(radians(2 * half_deg)) * x + cos(radians(2 * half_deg)) * y - 5, 6) AS py FROM obs")
def isometry_apply(spark, d):
    m = quat.motion(quat.vector(10, -5, 0), F.col("quaternion"))
    p = quat.apply(m, F.col("position"))
    return observations(spark, d).select("row_seq", F.round(p[0], 6).alias("px"), F.round(p[1], 6).alias("py"))


@query("SELECT c_custkey, round(-sin(radians(c_custkey % 340 - 170)), 6) AS east_x, round(cos(radians(c_custkey % 160 - 80)), 6) AS north_z, round(sin(radians(c_custkey % 160 - 80)), 6) AS up_z FROM customer")
def enu_basis(spark, d):
    e, n, u = geo.enu_basis(F.col("c_custkey") % 160 - 80, F.col("c_custkey") % 340 - 170)
    return _table(spark, d, "customer").select("c_custkey", F.round(e[0], 6).alias("east_x"), F.round(n[2], 6).alias("north_z"), F.round(u[2], 6).alias("up_z"))


@query("SELECT row_seq, round(sqrt(greatest(0.0, x*x + y*y - power((x*y + y*(1000 - y)) / sqrt(y*y + power(1000 - y, 2)), 2) - 0*z)), 4) AS speed FROM (SELECT row_seq, x, y, z FROM obs)")
def spheroid_speed(spark, d):
    o = _flat(observations(spark, d))
    r = F.array(F.col("y"), 1000 - F.col("y"), F.lit(0.0))
    v = F.array(F.col("x"), F.col("y"), F.lit(0.0))
    return o.select("row_seq", F.round(timeline.ground_speed(r, v), 4).alias("speed"))


@query(f", {_LOG} SELECT row_number() OVER (ORDER BY seq) AS place, child, parent FROM log /* obs */")
def export_topology(spark, d):
    return R.placed(_log(spark, d), "seq").select("place", "child", "parent")




@query("""SELECT entity, i, round(x + (nx - x) * ((i * 250.0 - s) / leg), 6) AS x, round(y + (ny - y) * ((i * 250.0 - s) / leg), 6) AS y FROM (SELECT *, unnest(range(CAST(ceil(s / 250.0) AS BIGINT), CAST(ceil((s + leg) / 250.0) AS BIGINT))) AS i FROM
(SELECT *, coalesce(sum(leg) OVER (PARTITION BY entity ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s FROM (SELECT *, sqrt(power(nx - x, 2) + power(ny - y, 2)) AS leg FROM (SELECT entity, row_seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM obs WINDOW w AS (PARTITION BY entity ORDER BY row_seq)))) WHERE leg > 0)""")
def resample_polyline(spark, d):
    o = _flat(observations(spark, d))
    return timeline.resample(o, "entity", "row_seq", "x", "y", 250.0).select("entity", "i", *_r("x", "y"))


@query(""", s AS (SELECT entity, epoch_ns, row_seq, x, y, z FROM obs), a AS (SELECT entity, arg_min(struct_pack(x := x, y := y, z := z), row(epoch_ns, row_seq)) AS a, avg(sqrt(x*x + y*y + z*z)) AS radius FROM s GROUP BY entity),
c AS (SELECT s.entity, epoch_ns, row_seq, a.a, radius, a.a.y * z - a.a.z * y AS nx, a.a.z * x - a.a.x * z AS ny, a.a.x * y - a.a.y * x AS nz FROM s JOIN a USING (entity)),
b AS (SELECT entity, arg_min(struct_pack(a := a, radius := radius, nx := nx, ny := ny, nz := nz, n := sqrt(nx*nx + ny*ny + nz*nz)), row(-sqrt(nx*nx + ny*ny + nz*nz), epoch_ns, row_seq)) AS b FROM c GROUP BY entity),
u AS (SELECT entity, b.radius AS radius, b.a.x / l AS ux, b.a.y / l AS uy, b.a.z / l AS uz, b.nx / b.n AS wx, b.ny / b.n AS wy, b.nz / b.n AS wz FROM (SELECT *, sqrt(b.a.x * b.a.x + b.a.y * b.a.y + b.a.z * b.a.z) AS l FROM b) WHERE b.n / (b.radius * b.radius) >= 1e-6)
SELECT entity, CAST(i AS INTEGER) AS i, round(radius * (cos(2 * pi() * i / 192) * ux + sin(2 * pi() * i / 192) * (wy * uz - wz * uy)), 4) AS x, round(radius * (cos(2 * pi() * i / 192) * uy + sin(2 * pi() * i / 192) * (wz * ux - wx * uz)), 4) AS y, round(radius * (cos(2 * pi() * i / 192) * uz + sin(2 * pi() * i / 192) * (wx * uy - wy * ux)), 4) AS z FROM u, range(193) r(i) /* obs */""")
def fit_circle(spark, d):
    return timeline.circle_points(timeline.fit_circle(_flat(observations(spark, d)))).select("entity", "i", *[F.round(c, 4).alias(c) for c in "xyz"])
