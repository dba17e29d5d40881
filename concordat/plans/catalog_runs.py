"""Queries over runs: reduced events, throttles and listings, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.blake3 import blake3
from ..operators import chunking, dedup, diff, plan, reconcile, resolve
from ..operators.locks import Locked, LockTable
from ..sources import derived, listing, staged, tree
from ..storage import changed, scratch, stored
from ..streaming import events as ev
from ..streaming import reducer, throttle, watch
from ..streaming.reducer import KINDS, PHASES
from .catalog import _EVENTS, _decided, _events, _missing, _moves, _table, query

N_NODES = derived.N_NODES
HOUR = 3_600_000_000


def run_events(events):
    """The driver's events as a few runs' events: a spread number picks kind, node and the rest."""
    h = F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 31, F.lit(1009)).cast("int")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    source = (h % 3).cast("int")
    return events.select(
        (F.col("user_id") % 7).alias("run"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), pick(KINDS, h % len(KINDS)).alias("kind"),
        F.when(F.floor(h / 8) % 2 == 0, F.lit("collecting")).otherwise(pick(PHASES, h % 8)).alias("phase"), (F.floor(h / 21) % 4).cast("int").alias("node_idx"),
        F.concat(F.lit("file/"), (F.col("user_id") % 97).cast("string")).alias("path"), pick(("create", "update", "delete"), F.floor(h / 5) % 3).alias("operation"), source.alias("from_node"), ((h + 1) % 3).cast("int").alias("to_node"),
        F.array(((source + 1) % 3).cast("int"), ((source + 2) % 3).cast("int")).alias("to_nodes"), F.floor(F.col("value") * 100).cast("long").alias("size"), h.cast("long").alias("files"), (h % 2 == 0).alias("present"),
        F.when(h % 3 == 0, source).alias("winner"), F.lit("info").alias("level"), F.col("event_type").alias("message"),
    )


_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_PHASE_LIST = "[" + ", ".join(f"'{p}'" for p in PHASES) + "]"
_RUNS = f"""
r AS (
  SELECT user_id % 7 AS run, event_id AS seq, ts, {_KIND_LIST}[h % {len(KINDS)} + 1] AS kind,
    CASE WHEN h // 8 % 2 = 0 THEN 'collecting' ELSE {_PHASE_LIST}[h % 8 + 1] END AS phase, h // 21 % 4 AS node, 'file/' || user_id % 97 AS path,
    ['create', 'update', 'delete'][h // 5 % 3 + 1] AS operation, h % 3 AS source, (h + 1) % 3 AS target, floor(value * 100)::BIGINT AS size, h AS files, h % 2 = 0 AS present, event_type AS message
  FROM (SELECT *, (event_id * 7919 + user_id * 31) % 1009 AS h FROM events)),
begun AS (SELECT run, seq, phase FROM r WHERE kind = 'phase_started')
"""
_STATE = f"""
WITH {_RUNS}
SELECT run, count(*) AS n_events, max_by(phase, seq) FILTER (kind IN ('phase_started', 'phase_changed')) AS phase, count(*) FILTER (kind IN ('completed', 'failed')) = 0 AS running,
  max_by(CASE kind WHEN 'conflict_detected' THEN 'conflicts' WHEN 'failed' THEN 'logs' ELSE 'nodes' END, seq) FILTER (kind IN ('conflict_detected', 'completed', 'failed') OR kind = 'phase_started' AND phase = 'collecting') AS pane,
  count(*) FILTER (kind = 'conflict_detected') AS n_conflicts, count(*) FILTER (kind = 'conflict_resolved') AS n_resolved, max_by(files, seq) FILTER (kind = 'progress') AS files,
  max_by(size, seq) FILTER (kind = 'progress') AS bytes, max_by(message, seq) FILTER (kind = 'failed') AS failure
FROM r GROUP BY run
"""
_NODES = f"""
WITH {_RUNS}, dealt AS (
  SELECT run, node, seq, ts, kind, message, files, size, NULL AS side FROM r WHERE kind IN ('node_connected', 'node_ready', 'node_disconnecting', 'node_connection_failed', 'node_stats')
  UNION ALL SELECT run, n, seq, ts, kind, NULL, NULL, NULL, NULL FROM r, (VALUES (0), (1), (2)) AS x(n) WHERE kind = 'phase_started'
  UNION ALL SELECT run, source, seq, ts, kind, NULL, NULL, size, 'sent' FROM r WHERE kind = 'operation_completed' AND operation <> 'delete' AND size > 0
  UNION ALL SELECT run, target, seq, ts, kind, NULL, NULL, size, 'received' FROM r WHERE kind = 'operation_completed' AND operation <> 'delete' AND size > 0),
stats AS (SELECT d.*, (SELECT max_by(phase, b.seq) FROM begun b WHERE b.run = d.run AND b.seq < d.seq) AS at_phase FROM dealt d WHERE kind = 'node_stats'),
shown AS (
  SELECT run, node, max_by(files, seq) AS shown_files, max_by(size, seq) AS shown_bytes FROM stats s
  WHERE at_phase = 'collecting' AND NOT EXISTS (SELECT 1 FROM begun b WHERE b.run = s.run AND b.phase <> 'collecting' AND b.seq > s.seq) GROUP BY run, node)
SELECT d.run, d.node::INT AS node_idx, coalesce(max_by(kind IN ('node_connected', 'node_ready'), seq) FILTER (kind IN ('node_connected', 'node_ready', 'node_disconnecting', 'node_connection_failed')), false) AS connected,
  max_by(message, seq) FILTER (kind = 'node_connection_failed') AS error, max_by(files, seq) FILTER (kind = 'node_stats') AS files, max_by(size, seq) FILTER (kind = 'node_stats') AS bytes,
  any_value(shown_files) AS shown_files, any_value(shown_bytes) AS shown_bytes, count(*) FILTER (side = 'sent') AS files_sent, coalesce(sum(size) FILTER (side = 'sent'), 0)::BIGINT AS bytes_sent,
  count(*) FILTER (side = 'received') AS files_received, coalesce(sum(size) FILTER (side = 'received'), 0)::BIGINT AS bytes_received
FROM dealt d LEFT JOIN shown s ON s.run = d.run AND s.node = d.node WHERE d.node < 3 GROUP BY d.run, d.node
"""
_FILES = f"""
WITH {_RUNS}, moves AS (
  SELECT run, path, seq, 0 AS turn, node, CASE WHEN present THEN 'exists' ELSE 'missing' END AS status FROM r WHERE kind = 'file_discovered'
  UNION ALL SELECT run, path, seq, 0, node, 'missing' FROM r WHERE kind = 'file_delete'
  UNION ALL SELECT run, path, seq, 1, target, 'missing' FROM r WHERE kind = 'operation_completed' AND operation = 'delete'
  UNION ALL SELECT run, path, seq, 1, source, 'exists' FROM r WHERE kind = 'operation_completed' AND operation <> 'delete' OR kind = 'file_sync'
  UNION ALL SELECT run, path, seq, 2, target, 'synced' FROM r WHERE kind = 'operation_completed' AND operation <> 'delete'
  UNION ALL SELECT run, path, seq, 1 + k, (source + k) % 3, 'pending' FROM r, (VALUES (1), (2)) AS x(k) WHERE kind = 'file_sync'),
known AS (SELECT run, path, min(seq) AS since, {', '.join(f"coalesce(max_by(status, seq * 10 + turn) FILTER (node = {i}), 'unknown') AS s{i}" for i in range(3))} FROM moves GROUP BY ALL),
f AS (SELECT run, path, max(seq) FILTER (kind = 'conflict_detected') AS conflict, max(seq) FILTER (kind = 'operation_completed') AS done FROM r WHERE kind IN ('file_discovered', 'file_delete', 'operation_completed', 'operation_started', 'file_sync', 'conflict_detected') GROUP BY ALL)
SELECT f.run, f.path, [coalesce(s0, 'unknown'), coalesce(s1, 'unknown'), coalesce(s2, 'unknown')] AS statuses, coalesce(conflict > since, false) AS is_conflict,
  (SELECT count(*) FROM r WHERE r.run = f.run AND r.path = f.path AND kind = 'operation_started' AND (done IS NULL OR seq > done)) AS n_active
FROM f LEFT JOIN known k ON k.run = f.run AND k.path = f.path
"""


def _run_stream(spark, d):
    return run_events(ev.read_stream(spark, d, "events"))


@query(_STATE, tables=False)
def run_state(spark, d):
    return reducer.run_state(run_events(_table(spark, d, "events")))


@query(_NODES, tables=False)
def node_state(spark, d):
    return reducer.node_state(run_events(_table(spark, d, "events")), N_NODES)


@query(_FILES, tables=False)
def file_state(spark, d):
    return reducer.file_state(run_events(_table(spark, d, "events")), N_NODES)


@query(_STATE, tables=False)
def stream_run_state(spark, d):
    return ev.run_available(reducer.stream_runs(_run_stream(spark, d)), "complete", "stream-runs")


@query(_NODES, tables=False)
def stream_node_state(spark, d):
    rows = ev.run_available(reducer.stream_nodes(_run_stream(spark, d), N_NODES), "update", "stream-nodes", ("run", "node_idx"), ("stalled",), settings=ev.ROCKSDB)
    return rows.drop("stalled")


@query(_FILES, tables=False)
def stream_file_state(spark, d):
    return ev.run_available(reducer.stream_files(_run_stream(spark, d), N_NODES), "update", "stream-files", ("run", "path"), settings=ev.ROCKSDB)


@query(
    f"""
WITH {_RUNS}, l AS (
  SELECT run, seq, CASE WHEN kind IN ('node_connected', 'node_ready', 'operation_completed', 'conflict_resolved', 'completed') THEN 'success' WHEN kind IN ('node_connection_failed', 'error', 'failed') THEN 'error'
    WHEN kind = 'conflict_detected' THEN 'warning' ELSE 'info' END AS level, CASE WHEN kind IN ('error', 'log') THEN message WHEN kind = 'phase_started' THEN 'phase started: ' || phase END AS message
  FROM r WHERE kind NOT IN ('progress', 'node_stats', 'file_discovered'))
SELECT run, level, count(*) AS n, max(seq) AS last, count(*) FILTER (starts_with(message, 'phase started: ')) AS n_started FROM l GROUP BY run, level
""",
    tables=False,
)
def run_log_levels(spark, d):
    records = reducer.log_records(run_events(_table(spark, d, "events")))
    return records.groupBy("run", "level").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.count_if(F.col("message").startswith("phase started: ")).alias("n_started"))


# Throttles: the SQL follows each event's pointer to the next one kept.


def _chain(every: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT node_idx, epoch_us(ts) AS t, seq, row_number() OVER (PARTITION BY node_idx ORDER BY ts, seq) AS k FROM ({_EVENTS})),
first AS (SELECT node_idx, t, min(k) AS k FROM e GROUP BY ALL),
p AS (SELECT e.node_idx, e.seq, e.k, {every} AS next FROM e ASOF LEFT JOIN first f ON f.node_idx = e.node_idx AND f.t >= e.t + {HOUR}),
kept AS (SELECT * FROM p WHERE k = 1 UNION ALL SELECT p.* FROM kept JOIN p ON p.node_idx = kept.node_idx AND p.k = kept.next)
SELECT node_idx, seq FROM kept
"""


def _timed(spark, d):
    return _events(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


@query(_chain("f.k"), tables=False)
def thinned_by_gap(spark, d):
    return throttle.thin(_timed(spark, d), "node_idx", "t", "seq", HOUR).select("node_idx", "seq")


@query(_chain("least(coalesce(f.k, 1000000000000), (e.k // 10 + 1) * 10)"), tables=False)
def thinned_by_gap_or_count(spark, d):
    return throttle.thin(_timed(spark, d), "node_idx", "t", "seq", HOUR, every=10).select("node_idx", "seq")


@query(_chain("least(coalesce(f.k, 1000000000000), (e.k // 10 + 1) * 10)"), tables=False)
def stream_thinned(spark, d):
    stream = ev.translate(ev.read_stream(spark, d, "events")).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return ev.run_available(stream, "append", "stream-thinned", each=throttle.thin_batch("node_idx", "t", "seq", HOUR, 10)).select("node_idx", "seq")


#: Ten days into the driver's events.
_BEGUN = 1_704_067_200_000_000


@query(f"SELECT node_idx, seq FROM (SELECT *, row_number() OVER (PARTITION BY node_idx ORDER BY ts, seq) AS k FROM ({_EVENTS})) WHERE k % 10 = 0 OR epoch_us(ts) - {_BEGUN} >= {240 * HOUR}", tables=False)
def every_tenth_or_late(spark, d):
    return throttle.every_or_after(_timed(spark, d), "node_idx", "t", "seq", 10, 240 * HOUR, F.lit(_BEGUN)).select("node_idx", "seq")


# Listings


@query("SELECT node_idx::VARCHAR AS node, path, tp, mode, size, target, coalesce(n, 0)::BIGINT AS n_chunks, coalesce(last, '') AS last_hash FROM inv LEFT JOIN (SELECT node_idx, path, count(*) AS n, max_by(hash, pos) AS last FROM chunks WHERE tp = 'F' GROUP BY ALL) USING (node_idx, path)")
def listing_in_splits(spark, d):
    """Listings cut into splits of 32 kB, far from where files begin and end."""
    folder = scratch(spark, "listing-splits")
    for node in range(N_NODES):
        listing.write_listing(derived.inventory(spark, d).filter(F.col("node_idx") == node), f"{folder}/node={node}")
    with changed(spark, {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "4k"}):
        back = stored(listing.parse_listing(listing.ordered_lines(spark, folder)), "listing-back")
    last = F.coalesce(F.try_element_at("chunks", F.lit(-1))["hash"], F.lit(""))
    return back.select(F.regexp_extract("file", "node=([0-9]+)", 1).alias("node"), "path", "tp", "mode", "size", "target", F.size("chunks").cast("long").alias("n_chunks"), last.alias("last_hash"))


# Locks and watching


@query("SELECT 'lock/' || c_custkey AS path, 2::BIGINT AS pid FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'lock/' || c_custkey, 4 FROM customer WHERE c_custkey % 3 = 2", tables=False)
def lock_table(spark, d):
    """Four processes in turn: two get their paths, one finds some held, one has released."""
    table = LockTable(spark, scratch(spark, "lock-table"))
    third = lambda i: _table(spark, d, "customer").filter(F.col("c_custkey") % 3 == i).select(F.concat(F.lit("lock/"), F.col("c_custkey").cast("string")).alias("path"))
    first = table.acquire(third(2), 1, 0)
    table.acquire(third(1), 2, 0)
    try:
        table.acquire(third(0).union(third(1)), 3, 0)
    except Locked:
        table.release(first)
        table.acquire(third(2), 4, 0)
    return table.held().select("path", "pid")


@query("SELECT path, status, CASE WHEN status = 'winner' THEN candidate END AS winner_node, n_present FROM diff")
def stream_diff_resumed(spark, d):
    """A watch that ends after each node's inventory and begins again on its state folder."""
    drop, out, state = (scratch(spark, f"watch-{x}") for x in ("drops", "diffs", "state"))
    for node in range(N_NODES):
        derived.inventory(spark, d).filter(F.col("node_idx") == node).write.parquet(f"{drop}/{node}")
        watch.watch(spark, drop, derived.prev_state(spark, d), N_NODES, out, True, state).awaitTermination()
    return watch.latest(spark, out).select("path", "status", "winner_node", "n_present")


# Rules


@query(
    """
WITH d AS (SELECT source, doc_id, doc_id::VARCHAR AS name, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents),
k AS (SELECT o_orderkey AS k, o_orderkey % 3 AS form, ['prefer-first', 'prefer-last', 'prefer-newest'][o_orderkey % 3 + 1] AS strategy FROM orders),
m AS (
  SELECT path, k, strategy FROM d JOIN k ON form = 0 AND doc_id = k AND source = 'src' || k % 10
  UNION ALL SELECT path, k, strategy FROM d JOIN k ON form = 1 AND name[:-2] = (k // 10)::VARCHAR
  UNION ALL SELECT path, k, strategy FROM (SELECT path, name[:n] AS head, name[n + 1] AS more FROM d, (VALUES (1), (2), (3), (4), (5), (6)) AS x(n)) JOIN k ON form = 2 AND head = (k // 7)::VARCHAR AND more BETWEEN '0' AND '4')
SELECT d.path, coalesce(min_by(strategy, k), 'skip') AS strategy FROM d LEFT JOIN m ON m.path = d.path GROUP BY d.path
""",
    tables=False,
)
def strategy_by_many_rules(spark, d):
    """As many rules as there are orders, of three forms, over all documents' paths."""
    k = F.col("o_orderkey")
    number = lambda c: c.cast("long").cast("string")
    pattern = F.when(k % 3 == 0, F.concat(F.lit("src"), number(k % 10), F.lit("/*/"), number(k), F.lit(".txt"))).when(k % 3 == 1, F.concat(F.lit("**/"), number(F.floor(k / 10)), F.lit("?.txt")))
    pattern = pattern.otherwise(F.concat(F.lit("*/"), number(F.floor(k / 7)), F.lit("[0-4]*")))
    strategy = F.element_at(F.array(F.lit("prefer-first"), F.lit("prefer-last"), F.lit("prefer-newest")), (k % 3 + 1).cast("int"))
    rules = _table(spark, d, "orders").select(k.alias("priority"), pattern.alias("pattern"), strategy.alias("strategy"))
    paths = _table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return resolve.strategy_by_table(paths, rules, "skip")


# Versions, gates and policies on rows that have something to find


@query("SELECT path, [coalesce(max(letter) FILTER (node_idx = 0), '-'), coalesce(max(letter) FILTER (node_idx = 1), '-'), coalesce(max(letter) FILTER (node_idx = 2), '-')] AS letters FROM (SELECT path, node_idx, chr(64 + dense_rank() OVER (PARTITION BY path ORDER BY mtime)::INT) AS letter FROM inv) GROUP BY path")
def version_rows(spark, d):
    return diff.version_row(derived.inventory(spark, d), N_NODES)


@query("SELECT node_idx, path, pos FROM (SELECT node_idx, path, pos, moved, coalesce(lag(moved + len) OVER (PARTITION BY node_idx, path ORDER BY pos), 0) AS expected FROM (SELECT *, start + CASE WHEN pos % 3 = 1 AND len % 5 = 0 THEN 1 ELSE 0 END AS moved FROM chunks)) WHERE moved <> expected")
def chunk_gaps(spark, d):
    """Every third chunk of a length in fives begins a byte late."""
    late = (F.col("pos") % 3 == 1) & (F.col("size") % 5 == 0)
    rows = diff.chunk_rows(derived.inventory(spark, d)).withColumn("offset", F.col("offset") + late.cast("int"))
    return diff.contiguity_violations(rows).select("node_idx", "path", "pos")


@query("SELECT hash, dst_node FROM moves WHERE right(hash, 1) IN ('0', '7') AND dst_node <> 1")
def unserved_chunks(spark, d):
    """The moves of some hashes to two of the nodes are lost."""
    moves = _moves(spark, d)
    return plan.unserved(_missing(spark, d), moves.filter("NOT (right(hash, 1) IN ('0', '7') AND dst_node <> 1)"))


@query("SELECT path, size FROM winners WHERE tp = 'F' AND size > 0 AND doc_id % 3 = 0")
def files_without_chunks(spark, d):
    """Winners of every third document have lost their chunks."""
    winners = plan.winners(derived.inventory(spark, d), _decided(spark, d))
    lost = F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long") % 3 == 0
    return plan.empty_files(winners.withColumn("chunks", F.when(~lost, F.col("chunks"))))


_CAPS = "SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS node_idx, c_acctbal > -900 AS chown, c_custkey % 11 <> 0 AS chmod, c_acctbal > 9000 AS xattrs, c_custkey % 13 <> 0 OR c_nationkey % 2 = 0 AS sensitive FROM customer"


def _capabilities(spark, d):
    """Customers as the nodes of their nation's run."""
    first = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return _table(spark, d, "customer").select(
        F.col("c_nationkey").alias("nation"), (F.row_number().over(first) - 1).alias("node_idx"), (F.col("c_acctbal") > -900).alias("can_chown"), (F.col("c_custkey") % 11 != 0).alias("can_chmod"), (F.col("c_acctbal") > 9000).alias("can_set_xattrs"),
        ((F.col("c_custkey") % 13 != 0) | (F.col("c_nationkey") % 2 == 0)).alias("case_sensitive"),
    )


def _policies(how: str) -> str:
    pick = {"all": "bool_and({0})", "any": "bool_or({0})", "one": "coalesce(bool_or({0}) FILTER (node_idx = 3), bool_and({0}))"}[how]
    sensitive = pick if how == "one" else "bool_and({0})"
    columns = [f"{pick.format(c)} AS {name}" for c, name in (("chown", "compare_owner"), ("chmod", "compare_permissions"), ("xattrs", "compare_xattrs"))]
    return f"SELECT nation, {', '.join(columns)}, true AS compare_timestamps, CASE WHEN {sensitive.format('sensitive')} THEN 1 ELSE 2 END AS tolerance FROM ({_CAPS}) GROUP BY nation"


@query(_policies("all"), tables=False)
def caps_lcd_by_nation(spark, d):
    return reconcile.least_common(_capabilities(spark, d), "nation")


@query(_policies("any"), tables=False)
def caps_best_effort_by_nation(spark, d):
    return reconcile.best_effort(_capabilities(spark, d), "nation")


@query(_policies("one"), tables=False)
def caps_source_wins_by_nation(spark, d):
    return reconcile.source_wins(_capabilities(spark, d), 3, "nation")


_HOSTS = "SELECT s_nationkey AS nation, s_suppkey AS k, 'host' || s_suppkey || '.' || lower(replace(n_name, ' ', '-')) || '.example.org' AS host, lower(replace(n_name, ' ', '-')) || '.example.org' AS domain FROM supplier JOIN nation ON n_nationkey = s_nationkey"


@query(f"SELECT k, host, CASE WHEN count(*) OVER (PARTITION BY nation) >= 2 THEN domain END AS domain, CASE WHEN count(*) OVER (PARTITION BY nation) >= 2 THEN 'host' || k ELSE host END AS short FROM ({_HOSTS})", tables=False)
def short_hosts(spark, d):
    """Suppliers as hosts of their nation's domain."""
    rows = _table(spark, d, "supplier").join(_table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("k"), F.concat(F.lit("host"), F.col("s_suppkey").cast("string"), F.lit("."), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example.org")).alias("host"))
    domains = rows.groupBy("nation").agg(F.array_sort(F.collect_list("host")).alias("hosts")).select("nation", labels.common_domain(F.col("hosts")).alias("domain"))  # a run's hosts
    rows = rows.join(domains, "nation")
    return rows.select("k", "host", "domain", F.coalesce(labels.short_host(F.col("host"), F.col("domain")), F.col("host")).alias("short"))


@query("SELECT c_custkey AS k, CASE WHEN octet_length(encode(name)) <= 14 THEN name ELSE left(name, 6) || '…' || right(name, 5) END AS label FROM (SELECT c_custkey, repeat(c_mktsegment, (c_custkey % 3)::INT) || c_custkey AS name FROM customer)", tables=False)
def truncated_names(spark, d):
    name = F.concat(F.repeat("c_mktsegment", (F.col("c_custkey") % 3).cast("int")), F.col("c_custkey").cast("string"))
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), labels.truncate_middle(name).alias("label"))


# Files


@query()
def cdc_edges(spark, d):
    """Every file's chunks: where they begin, how long they are and their BLAKE3 digests."""
    files = derived.contents(spark, d).filter("tp = 'F'").select("node_idx", "path", F.col("body").alias("content"))
    c = chunking.cdc_chunks(files, chunking.ChunkConfig(bits=8, most=4), "blake3")
    return c.select("node_idx", "path", F.posexplode("chunks").alias("pos", "c")).select("node_idx", "path", "pos", "c.offset", "c.size", "c.hash")


@query("SELECT node_idx, path, md5(body) AS digest FROM content WHERE body <> ''")
def blake3_verified_reassembly(spark, d):
    """Chunks named by BLAKE3, one replica of each damaged, read back by digest and put together."""
    files = derived.contents(spark, d).filter("tp = 'F'").select("node_idx", "path", F.col("body").cast("binary").alias("content"))
    c = chunking.cdc_chunks(files, chunking.ChunkConfig(bits=8, most=4), "blake3", payloads=True).select("node_idx", "path", F.explode("chunks").alias("c"))
    places = stored(c.select("node_idx", "path", "c.hash", "c.offset", "c.data"), "blake3-payloads")
    torn = places.select("hash", F.lit(-1).alias("position"), F.lit(-1).alias("node_idx"), F.concat("data", F.lit("?").cast("binary")).alias("data"))
    replicas = places.select("hash", F.col("node_idx").alias("position"), "node_idx", "data").union(torn)
    read = dedup.verified_read(places.select("hash"), replicas, blake3)
    return dedup.reassemble(places, read).select("node_idx", "path", F.md5("content").alias("digest"))


@query("SELECT node_idx, path, octet_length(encode(body)) AS size, md5(body) AS digest FROM content WHERE tp = 'F'")
def staged_and_scanned(spark, d):
    """Each node's files staged, committed, moved into place, scanned and read again."""
    rows = derived.contents(spark, d).filter("tp = 'F'").select("node_idx", "path", F.col("body").cast("binary").alias("content"), F.lit(0o640).alias("mode"), "mtime")
    found = None
    for node in range(N_NODES):
        root = scratch(spark, f"tree-{node}").removeprefix("file://")
        staged.finish(spark, root, staged.stage(rows.filter(F.col("node_idx") == node), root))
        scan = tree.scan_tree(spark, root, node, (".concordat", ".concordat/**"))
        got = scan.filter("tp = 'F'").select("node_idx", "path", "size").join(tree.read_contents(scan, root), ["node_idx", "path"])
        got = got.select("node_idx", "path", "size", F.md5("content").alias("digest"))
        found = got if found is None else found.unionAll(got)
    return found
