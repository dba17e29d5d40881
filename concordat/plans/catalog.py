"""The query catalogue: each operator over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, labels, literals, paths
from ..functions.globs import to_regex
from ..operators import chunking, dedup, diff, filters, plan, reconcile, resolve, state
from ..sources import derived, listing, snapshot
from ..sources.derived import N_NODES, ORACLE_CTES
from ..storage import scratch, stored
from ..streaming import events as ev
from ..streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_700_030_000
EXCLUDE = ("src1/**", "**/*7.txt", "src[2-3]/fr/*")
INCLUDE = ("src1/en/*", "src9/*/1?7.txt")
RULES = (("src1*/**", "prefer-newest"), ("**/fr/*", "prefer-oldest"), ("**/*.txt", "prefer-largest"))


def query(sql: str | None = None, tables: bool = True):
    """Register a query under its function's name; tables: sql needs the derived ones."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {ORACLE_CTES} {sql}" if tables else sql
        return f

    return add


def _inv(spark, d):
    return derived.inventory(spark, d)


def _diff(spark, d):
    return diff.diff(_inv(spark, d), derived.prev_state(spark, d), N_NODES)


def _decided(spark, d):
    x = _diff(spark, d)
    return plan.with_resolution(x, resolve.resolve(x.filter("status = 'conflict'"), "prefer-newest"))


def _transfers(spark, d):
    return plan.transfers(_inv(spark, d), _decided(spark, d), N_NODES)


def _missing(spark, d):
    return plan.missing_chunks(_inv(spark, d), _transfers(spark, d))


def _moves(spark, d):
    return plan.chunk_moves(_inv(spark, d), _missing(spark, d))


def _table(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


# Scans and statistics


@query("SELECT node_idx, count(*) AS n_entries, count(*) FILTER (tp = 'F') AS n_files, count(*) FILTER (tp = 'D') AS n_dirs, count(*) FILTER (tp = 'L') AS n_symlinks, coalesce(sum(size) FILTER (tp = 'F'), 0)::BIGINT AS bytes FROM inv GROUP BY node_idx")
def node_stats(spark, d):
    return diff.node_stats(_inv(spark, d))


@query("SELECT tp, count(*) AS n FROM inv GROUP BY tp")
def type_counts(spark, d):
    return _inv(spark, d).groupBy("tp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.path, n.node_idx, i.path IS NOT NULL AS present FROM (SELECT DISTINCT path FROM inv) p CROSS JOIN (SELECT unnest([0, 1, 2]) AS node_idx) n LEFT JOIN inv i ON i.path = p.path AND i.node_idx = n.node_idx")
def presence_matrix(spark, d):
    return diff.presence_matrix(_inv(spark, d), derived.nodes(spark))


@query("SELECT node_idx, path, pos, hash, start AS \"offset\", len AS size FROM chunks")
def chunk_explode(spark, d):
    return diff.chunk_rows(_inv(spark, d))


@query("SELECT node_idx, path, pos, coalesce(sum(len) OVER (PARTITION BY node_idx, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS running_offset FROM chunks")
def chunk_offsets_running_sum(spark, d):
    return diff.running_offsets(diff.chunk_rows(_inv(spark, d))).select("node_idx", "path", "pos", "running_offset")


@query("SELECT node_idx, path, pos FROM (SELECT *, coalesce(lag(start + len) OVER (PARTITION BY node_idx, path ORDER BY pos), 0) AS e FROM chunks) WHERE start <> e")
def chunk_contiguity_violations(spark, d):
    return diff.contiguity_violations(diff.chunk_rows(_inv(spark, d))).select("node_idx", "path", "pos")


@query("SELECT hash, count(*) AS n_locations, min(node_idx) AS first_node FROM (SELECT DISTINCT hash, node_idx, path FROM chunks) GROUP BY hash")
def chunk_inverted_index(spark, d):
    return diff.inverted_index(diff.chunk_rows(_inv(spark, d))).select("hash", "n_locations", F.col("first.node_idx").alias("first_node"))


@query('SELECT hash, node_idx, path, min(start) AS "offset", count(*) AS n_in_file FROM chunks GROUP BY hash, node_idx, path')
def chunk_locations(spark, d):
    return diff.locations(diff.chunk_rows(_inv(spark, d)))


@query("SELECT DISTINCT node_idx, hash FROM chunks")
def distinct_chunks_per_node(spark, d):
    return diff.node_chunks(_inv(spark, d))


@query("SELECT DISTINCT path FROM inv")
def union_of_paths(spark, d):
    return _inv(spark, d).select("path").distinct()


@query("SELECT node_idx, path, mtime FROM (SELECT *, row_number() OVER (PARTITION BY node_idx, path ORDER BY seq DESC) AS k FROM (SELECT node_idx, path, mtime, 0 AS seq FROM inv UNION ALL SELECT node_idx, path, mtime + 1, 1 FROM inv WHERE doc_id % 3 = 0)) WHERE k = 1")
def collect_last_wins(spark, d):
    rows = derived.contents(spark, d).select("node_idx", "path", "mtime", "doc_id")
    listed = rows.withColumn("seq", F.lit(0)).union(rows.filter("doc_id % 3 = 0").withColumn("mtime", F.col("mtime") + 1).withColumn("seq", F.lit(1)))
    return diff.collect_node(listed).select("node_idx", "path", "mtime")


# Filters


def _oracle_glob(globs, literal=False):
    return " OR ".join("regexp_matches(path, '" + to_regex(g, literal)[4:].replace("'", "''") + "', 's')" for g in globs)


_ALWAYS = _oracle_glob(filters.ALWAYS_EXCLUDED)
_EXCLUDED = f"(({_ALWAYS}) OR (NOT ({_oracle_glob(INCLUDE, True)}) AND ({_oracle_glob(EXCLUDE)})))"


@query(f"SELECT node_idx, path FROM inv WHERE NOT (({_ALWAYS}) OR ({_oracle_glob(EXCLUDE)}))")
def exclude_globs(spark, d):
    return _inv(spark, d).filter(~filters.is_excluded(F.col("path"), EXCLUDE)).select("node_idx", "path")


_TRICKY = "CASE doc_id % 8 WHEN 0 THEN '.concordat/' || path WHEN 1 THEN path || '.concordat-tmp' WHEN 2 THEN path || '~' WHEN 3 THEN 'a/.DS_Store' WHEN 4 THEN path || '.swp' WHEN 5 THEN 'lost+found' ELSE path END"


@query(f"SELECT path, {_ALWAYS} AS excluded FROM (SELECT {_TRICKY} AS path FROM inv)")
def always_excluded(spark, d):
    rows = derived.contents(spark, d).select(F.expr(_TRICKY).alias("path"))
    return rows.select("path", filters.is_excluded(F.col("path")).alias("excluded"))


@query(f"SELECT node_idx, path FROM inv WHERE NOT {_EXCLUDED}")
def include_overrides(spark, d):
    return filters.retain(_inv(spark, d), exclude=EXCLUDE, include=INCLUDE).select("node_idx", "path")


@query(f"SELECT node_idx, count(*) FILTER ({_EXCLUDED}) AS n_excluded, count(*) AS n_total FROM inv GROUP BY node_idx")
def excluded_counts(spark, d):
    return filters.excluded_counts(_inv(spark, d), exclude=EXCLUDE, include=INCLUDE)


@query("SELECT node_idx, path, size FROM inv WHERE size BETWEEN 500 AND 2000")
def size_filter(spark, d):
    return _inv(spark, d).filter(filters.PropertyFilter(min_size=500, max_size=2000).matches()).select("node_idx", "path", "size")


@query(f"SELECT node_idx, path, mtime FROM inv WHERE mtime > {NOW} OR {NOW} - mtime BETWEEN 600 AND 20000")
def age_filter(spark, d):
    return _inv(spark, d).filter(filters.PropertyFilter(min_age=600, max_age=20_000, now=NOW).matches()).select("node_idx", "path", "mtime")


@query("SELECT node_idx, path, tp FROM inv WHERE tp IN ('D', 'L')")
def type_filter(spark, d):
    return _inv(spark, d).filter(filters.PropertyFilter(types=("D", "L")).matches()).select("node_idx", "path", "tp")


@query(f"SELECT node_idx, path FROM inv WHERE tp = 'F' AND size <= 4000 AND (mtime > {NOW} OR {NOW} - mtime >= 300)")
def property_filters_combined(spark, d):
    return _inv(spark, d).filter(filters.PropertyFilter(max_size=4000, min_age=300, types=("F",), now=NOW).matches()).select("node_idx", "path")


IGNORE = ("*5.txt", "!src2/**/15.txt", "src3/", "/src4/en", "de/*1.txt", "!*11.txt")


def _oracle_last(column):
    cases = ""
    for p in reversed(IGNORE):
        r = filters.ignore_rule(p)
        hit = f"regexp_matches({column}, '{r.regex[4:]}', 's')"
        cases += f"WHEN {hit}{' AND dir' if r.only_dirs else ''} THEN {str(not r.negated).lower()} "
    return f"CASE {cases}ELSE false END"


@query(
    f"SELECT path, bool_or({_oracle_last('p')}) AS ignored FROM (SELECT DISTINCT path, tp = 'D' AS dir, path AS p FROM inv UNION SELECT DISTINCT path, true, split_part(path, '/', 1) FROM inv UNION SELECT DISTINCT path, true, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM inv) GROUP BY path"
)
def gitignore_last_match(spark, d):
    rows = _inv(spark, d).select("path", "tp").distinct()
    return rows.select("path", filters.is_ignored(F.col("path"), F.col("tp") == "D", IGNORE).alias("ignored"))


@query("SELECT DISTINCT path, split_part(path, '/', 1) AS ancestor FROM inv UNION SELECT DISTINCT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM inv")
def ancestor_dirs(spark, d):
    return _inv(spark, d).select("path").distinct().select("path", F.explode(paths.ancestors(F.col("path"))).alias("ancestor"))


_CLIMB = "CASE doc_id % 4 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path WHEN 2 THEN 'src1/../' || path ELSE path END"


@query(f"SELECT node_idx, p AS path, NOT list_contains(string_split(p, '/'), '..') AS safe, p = 'src1' OR starts_with(p, 'src1/') AS within, NOT starts_with(p, '/') AS relative FROM (SELECT node_idx, {_CLIMB} AS p FROM inv)")
def path_safety(spark, d):
    p = derived.contents(spark, d).select("node_idx", F.expr(_CLIMB).alias("path"))
    return p.select("node_idx", "path", paths.is_safe(F.col("path")).alias("safe"), paths.is_within(F.col("path"), "src1").alias("within"), paths.is_relative(F.col("path")).alias("relative"))


# The diff


_FIRST = ORACLE_CTES.replace("inv i LEFT JOIN prev p ON p.path = i.path)", "inv i LEFT JOIN prev p ON false)")


@query(f"WITH {_FIRST} SELECT path, status, CASE WHEN status = 'winner' THEN candidate END AS winner_node FROM diff", tables=False)
def diff_first_sync(spark, d):
    return diff.diff(_inv(spark, d), None, N_NODES).select("path", "status", "winner_node")


@query("SELECT path, status, CASE WHEN status = 'winner' THEN candidate END AS winner_node, n_present FROM diff")
def diff_three_way(spark, d):
    return _diff(spark, d).select("path", "status", "winner_node", "n_present")


@query("SELECT path, n_present FROM diff WHERE status = 'conflict'")
def conflicts(spark, d):
    return _diff(spark, d).filter("status = 'conflict'").select("path", "n_present")


@query(
    "SELECT p.path, 1 + (s1 IS DISTINCT FROM s0)::INT + (s2 IS DISTINCT FROM s1)::INT::BIGINT AS n_versions FROM (SELECT path, max(full_sig) FILTER (node_idx = 0) AS s0, max(full_sig) FILTER (node_idx = 1) AS s1, max(full_sig) FILTER (node_idx = 2) AS s2 FROM inv GROUP BY path) p"
)
def n_versions_adjacent(spark, d):
    return _diff(spark, d).select("path", "n_versions")


@query("SELECT path FROM prev WHERE path NOT IN (SELECT path FROM inv)")
def deleted_paths(spark, d):
    return diff.deleted_paths(_inv(spark, d), derived.prev_state(spark, d))


@query("SELECT path FROM diff WHERE status = 'none'")
def in_sync_paths(spark, d):
    return _diff(spark, d).filter("status = 'none'").select("path")


@query("SELECT path, status, CASE WHEN status = 'winner' THEN candidate END AS winner_node FROM (SELECT path, CASE WHEN count(*) = 3 AND count(DISTINCT full_sig || ctime) = 1 THEN 'none' WHEN bool_or(has_prev) AND count(*) FILTER (changed) = 0 THEN 'none' WHEN bool_or(has_prev) AND count(*) FILTER (changed) = 1 THEN 'winner' WHEN bool_or(has_prev) THEN 'conflict' WHEN count(DISTINCT sig) = 1 THEN 'winner' ELSE 'conflict' END AS status, CASE WHEN bool_or(has_prev) THEN min(node_idx) FILTER (changed) ELSE min(node_idx) END AS candidate FROM marked GROUP BY path)")
def diff_compat_ctime(spark, d):
    return diff.diff(_inv(spark, d), derived.prev_state(spark, d), N_NODES, diff.COMPAT_FULL_FIELDS).select("path", "status", "winner_node")


# Resolution


def _conflicts(spark, d):
    return _diff(spark, d).filter("status = 'conflict'").select("path", "versions")


def _resolved(strategy, **kw):
    return lambda spark, d: resolve.resolve(_conflicts(spark, d), strategy, **kw).select("path", "winner_node")


_PICK = "SELECT path, node_idx AS winner_node FROM (SELECT i.path, i.node_idx, row_number() OVER (PARTITION BY i.path ORDER BY {}) AS k, row_number() OVER (PARTITION BY i.path ORDER BY i.node_idx) AS pos FROM inv i JOIN diff d ON d.path = i.path WHERE d.status = 'conflict') WHERE k = 1"
for _name, _order in {"first": "i.node_idx", "last": "i.node_idx DESC", "newest": "i.mtime DESC, i.node_idx DESC", "oldest": "i.mtime, i.node_idx", "largest": "i.size DESC, i.node_idx DESC", "smallest": "i.size, i.node_idx"}.items():
    QUERIES[f"resolve_{_name}"] = _resolved(f"prefer-{_name}")
    ORACLE_SQL[f"resolve_{_name}"] = f"WITH {ORACLE_CTES} " + _PICK.format(_order)


@query("SELECT d.path, max(i.node_idx) FILTER (i.pos = 1) AS winner_node, CASE WHEN count(*) <= 1 THEN 'index out of range' END AS error FROM diff d JOIN (SELECT path, node_idx, row_number() OVER (PARTITION BY path ORDER BY node_idx) - 1 AS pos FROM inv) i ON i.path = d.path WHERE d.status = 'conflict' GROUP BY d.path")
def resolve_node_index(spark, d):
    return resolve.resolve(_conflicts(spark, d), "node-by-index", index=1).select("path", "winner_node", "error")


@query("SELECT d.path, max(i.node_idx) FILTER (i.node_idx = 1) AS winner_node, CASE WHEN count(*) FILTER (i.node_idx = 1) = 0 THEN 'unknown node' END AS error FROM diff d JOIN inv i ON i.path = d.path WHERE d.status = 'conflict' GROUP BY d.path")
def resolve_node_name(spark, d):
    return resolve.resolve(_conflicts(spark, d), "node-by-name", name="node_2", node_names=("node_1", "node_2", "node_3")).select("path", "winner_node", "error")


@query("SELECT path, NULL::INT AS winner_node FROM diff WHERE status = 'conflict'")
def resolve_skip(spark, d):
    return resolve.resolve(_conflicts(spark, d), "skip").select("path", "winner_node")


@query("SELECT path, 'conflict' AS error FROM diff WHERE status = 'conflict'")
def resolve_fail(spark, d):
    return resolve.resolve(_conflicts(spark, d), "fail").select("path", "error")


_RULE = "CASE " + " ".join(f"WHEN regexp_matches(d.path, '{to_regex(p)[4:]}', 's') THEN '{s}'" for p, s in RULES) + " ELSE 'prefer-first' END"


@query(
    f"SELECT path, strategy, node_idx AS winner_node FROM (SELECT path, strategy, node_idx, row_number() OVER (PARTITION BY path ORDER BY CASE strategy WHEN 'prefer-newest' THEN -mtime WHEN 'prefer-oldest' THEN mtime WHEN 'prefer-largest' THEN -size ELSE 0 END, CASE WHEN strategy IN ('prefer-newest', 'prefer-largest') THEN -node_idx ELSE node_idx END) AS k FROM (SELECT d.path, {_RULE} AS strategy, i.node_idx, i.mtime, i.size FROM diff d JOIN inv i ON i.path = d.path WHERE d.status = 'conflict')) WHERE k = 1"
)
def resolve_by_rules(spark, d):
    return resolve.resolve_by_rules(_conflicts(spark, d), RULES, "prefer-first").select("path", "strategy", "winner_node")


@query(f"SELECT d.path, {_RULE} AS strategy FROM (SELECT DISTINCT path FROM inv) d")
def strategy_by_rule_table(spark, d):
    rules = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(RULES)], "priority int, pattern string, strategy string")
    return resolve.strategy_by_table(_inv(spark, d).select("path").distinct(), rules, "prefer-first")


@query(
    "SELECT c.path, v.node_idx AS winner_node FROM (SELECT path FROM diff WHERE status = 'conflict') c LEFT JOIN (SELECT path, seq, chosen, row_number() OVER (PARTITION BY path ORDER BY seq) AS k FROM (SELECT r.path, r.seq, r.chosen FROM (SELECT path, doc_id * 10 + j AS seq, (doc_id + j) % 4 AS chosen FROM (SELECT DISTINCT path, doc_id FROM inv), unnest([0, 1, 2]) AS u(j)) r JOIN (SELECT path, count(*) AS n FROM inv GROUP BY path) n ON n.path = r.path WHERE r.chosen < n.n)) f ON f.path = c.path AND f.k = 1 LEFT JOIN (SELECT path, node_idx, row_number() OVER (PARTITION BY path ORDER BY node_idx) - 1 AS pos FROM inv) v ON v.path = c.path AND v.pos = f.chosen"
)
def manual_resolutions(spark, d):
    rows = derived.contents(spark, d).select("path", "doc_id").distinct().withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    choices = rows.select((F.col("doc_id") * 10 + F.col("j")).alias("seq"), "path", ((F.col("doc_id") + F.col("j")) % 4).cast("int").alias("chosen_node"))
    return resolve.manual(_conflicts(spark, d), choices)


@query("SELECT path, node_idx, chr(64 + r::INT) AS letter, r = max(r) OVER (PARTITION BY path) AS newest FROM (SELECT path, node_idx, dense_rank() OVER (PARTITION BY path ORDER BY mtime) AS r FROM inv)")
def version_letters(spark, d):
    return diff.version_letters(_inv(spark, d))


_OPEN = "SELECT path, n_present = 3 AS resolved FROM diff WHERE status = 'conflict'"


@query(f"SELECT count(*) AS n_conflicts, count(*) FILTER (resolved) AS n_resolved, count(*) FILTER (NOT resolved) AS n_unresolved, count(*) FILTER (NOT resolved) = 0 AS ready FROM ({_OPEN})")
def resolution_counts(spark, d):
    return resolve.resolution_counts(_diff(spark, d).filter("status = 'conflict'").select("path", (F.col("n_present") == 3).alias("resolved")))


@query(f"SELECT path, min(CASE WHEN NOT resolved THEN path END) OVER (ORDER BY path ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_path FROM ({_OPEN})")
def next_unresolved(spark, d):
    return resolve.next_unresolved(_diff(spark, d).filter("status = 'conflict'").select("path", (F.col("n_present") == 3).alias("resolved")))


# The plan


@query("SELECT * FROM transfers")
def transfers(spark, d):
    return _transfers(spark, d)


@query("SELECT * FROM missing")
def missing_chunks(spark, d):
    return _missing(spark, d)


@query("SELECT hash, src_node, dst_node, size::BIGINT AS size FROM moves")
def chunk_moves(spark, d):
    return _moves(spark, d)


@query("SELECT c.hash, min(c.node_idx) AS src_node, max(c.len) AS size FROM chunks c GROUP BY c.hash")
def chunk_sources(spark, d):
    return plan.chunk_sources(_inv(spark, d))


@query("SELECT c.hash, CASE WHEN EXISTS (SELECT 1 FROM owned o WHERE o.node_idx = t.dst_node AND o.hash = c.hash) THEN t.dst_node ELSE (SELECT min(o.node_idx) FROM owned o WHERE o.hash = c.hash) END AS src_node, t.dst_node, t.path, c.start AS \"offset\", c.len AS size FROM transfers t JOIN chunks c ON c.path = t.path AND c.node_idx = t.src_node WHERE t.trans_data")
def chunk_targets(spark, d):
    return plan.chunk_targets(_inv(spark, d), _transfers(spark, d))


@query("SELECT src_node, dst_node, sum(size)::BIGINT AS bytes, count(*) AS n_chunks FROM moves GROUP BY ALL")
def transfer_matrix(spark, d):
    return plan.transfer_matrix(_moves(spark, d))


@query("SELECT coalesce(sum(s), 0)::BIGINT AS total_bytes, count(*) AS n_hashes FROM (SELECT hash, max(size) AS s FROM moves GROUP BY hash)")
def bytes_to_transfer(spark, d):
    return plan.bytes_to_transfer(_moves(spark, d))


@query("SELECT count(*) AS files_synced FROM won")
def files_synced(spark, d):
    return _decided(spark, d).agg(F.count_if(F.col("winner_node").isNotNull()).alias("files_synced"))


@query("SELECT m.hash, m.dst_node FROM missing m WHERE m.hash NOT IN (SELECT hash FROM owned)")
def verify_missing(spark, d):
    return plan.unserved(_missing(spark, d), _moves(spark, d))


@query("SELECT path, size FROM winners WHERE tp = 'F' AND size > 0 AND cl = ''")
def verify_empty_chunks(spark, d):
    return plan.empty_files(plan.winners(_inv(spark, d), _decided(spark, d)))


@query("SELECT t.dst_node, min(t.path) AS path FROM transfers t JOIN chunks c ON c.path = t.path AND c.node_idx = t.src_node JOIN missing m ON m.dst_node = t.dst_node AND m.hash = c.hash WHERE t.trans_data GROUP BY t.dst_node")
def affected_files(spark, d):
    return plan.affected_files(_inv(spark, d), _transfers(spark, d), _missing(spark, d))


@query("SELECT n_deletes, n_total, n_deletes * 100 // n_total AS percent, n_deletes <= 1000 AND n_deletes * 100 // n_total <= 3 AS allowed, CASE WHEN n_deletes > 1000 THEN 'count' WHEN n_deletes * 100 // n_total > 3 THEN 'percent' END AS reason FROM (SELECT (SELECT count(*) FROM prev WHERE path NOT IN (SELECT path FROM inv)) AS n_deletes, (SELECT count(*) FROM prev) AS n_total)")
def delete_guard(spark, d):
    prev = derived.prev_state(spark, d)
    return plan.delete_guard(diff.deleted_paths(_inv(spark, d), prev), prev, max_percent=3)


@query("SELECT path, '/backup/' || split_part(path, '/', -1) || '.bak' AS backup, '/trash/' || split_part(path, '/', -1) AS trash FROM prev WHERE path NOT IN (SELECT path FROM inv)")
def backup_paths(spark, d):
    p = F.col("path")
    return diff.deleted_paths(_inv(spark, d), derived.prev_state(spark, d)).select("path", paths.backup_path(p, "/backup", ".bak").alias("backup"), paths.trash_path(p, "/trash").alias("trash"))


@query("SELECT (SELECT count(*) FROM won) AS files_synced, (SELECT count(*) FROM diff WHERE status = 'conflict') AS conflicts_encountered, (SELECT count(*) FROM diff WHERE status = 'conflict') AS conflicts_resolved, (SELECT coalesce(sum(size), 0) FROM moves)::BIGINT AS bytes_transferred, (SELECT count(*) FROM moves) AS chunks_transferred, (SELECT count(*) FROM prev WHERE path NOT IN (SELECT path FROM inv)) AS files_deleted, (SELECT count(*) FROM transfers t JOIN winners w ON w.path = t.path WHERE w.tp = 'D') AS dirs_created")
def sync_result(spark, d):
    # The inventory and the decision are derived once; the counters read them back.
    inv, prev = stored(_inv(spark, d), "inventory"), derived.prev_state(spark, d)
    x = diff.diff(inv, prev, N_NODES)
    decided = stored(plan.with_resolution(x, resolve.resolve(x.filter("status = 'conflict'"), "prefer-newest")), "decided")
    transfers = stored(plan.transfers(inv, decided, N_NODES), "transfers")
    moves = stored(plan.chunk_moves(inv, plan.missing_chunks(inv, transfers)), "moves")
    return plan.sync_result(decided, transfers, moves, diff.deleted_paths(inv, prev), inv)


@query("SELECT path, mtime, size FROM winners UNION ALL SELECT path, mtime, size FROM (SELECT i.path, i.mtime, i.size, row_number() OVER (PARTITION BY i.path ORDER BY i.node_idx) AS k FROM inv i JOIN diff d ON d.path = i.path WHERE d.status = 'none') WHERE k = 1")
def snapshot_next(spark, d):
    return plan.next_snapshot(_inv(spark, d), _decided(spark, d)).select("path", "mtime", "size")


@query("SELECT path, mtime, size FROM winners")
def snapshot_next_compat(spark, d):
    return plan.next_snapshot(_inv(spark, d), _decided(spark, d), compat=True).select("path", "mtime", "size")


@query("SELECT t.dst_node AS node_idx, CASE w.tp WHEN 'D' THEN 'mkdir' WHEN 'L' THEN 'symlink' ELSE CASE WHEN t.trans_data THEN 'write' ELSE 'touch' END END AS op, t.path FROM transfers t JOIN winners w ON w.path = t.path UNION ALL SELECT n, 'delete', path FROM prev, unnest([0, 1, 2]) AS u(n) WHERE path NOT IN (SELECT path FROM inv)")
def actions(spark, d):
    inv = _inv(spark, d)
    return plan.actions(_transfers(spark, d), diff.deleted_paths(inv, derived.prev_state(spark, d)), inv, N_NODES).select("node_idx", "op", "path")


@query("SELECT node_idx, 'delete' AS op, path || '.concordat-tmp' AS path FROM inv WHERE doc_id % 10 = 0")
def orphan_temporaries(spark, d):
    rows = derived.contents(spark, d).withColumn("path", F.when(F.col("doc_id") % 10 == 0, F.concat("path", F.lit(".concordat-tmp"))).otherwise(F.col("path")))
    return plan.orphan_temporaries(rows)


# Metadata reconciliation

_POLICY_SQL = "SELECT {} AS compare_owner, {} AS compare_permissions, true AS compare_timestamps, {} AS compare_xattrs, {} AS tolerance"


@query(_POLICY_SQL.format("false", "true", "false", "2"), tables=False)
def caps_lcd(spark, d):
    return reconcile.least_common(derived.capabilities(spark))


@query(_POLICY_SQL.format("true", "true", "true", "2"), tables=False)
def caps_best_effort(spark, d):
    return reconcile.best_effort(derived.capabilities(spark))


@query(_POLICY_SQL.format("true", "true", "true", "1"), tables=False)
def caps_source_wins(spark, d):
    return reconcile.source_wins(derived.capabilities(spark), 0)


for _preset, _sql in {"strict": "a.mtime <> b.mtime OR a.mode <> b.mode", "smart": "abs(a.mtime - b.mtime) > 1 OR a.mode <> b.mode", "relaxed": "abs(a.mtime - b.mtime) > 2", "content-only": "false"}.items():
    _n = f"metadata_differs_{_preset.replace('-', '_')}"
    QUERIES[_n] = lambda spark, d, p=_preset: reconcile.metadata_differs(_inv(spark, d), 0, 2, reconcile.preset(p))
    ORACLE_SQL[_n] = f"WITH {ORACLE_CTES} SELECT a.path, a.size <> b.size OR a.tp <> b.tp OR ({_sql}) AS differs FROM inv a JOIN inv b ON a.path = b.path AND a.node_idx = 0 AND b.node_idx = 2"


# Deduplication and state


def _sides(spark, d):
    c = diff.chunk_rows(_inv(spark, d))
    return c.filter("node_idx = 0"), c.filter("node_idx <> 0")


@query("SELECT count(*) AS n_unique, count(*) FILTER (l) AS n_local, count(*) FILTER (r) AS n_remote, count(*) FILTER (l AND r) AS n_both FROM (SELECT hash, bool_or(node_idx = 0) AS l, bool_or(node_idx <> 0) AS r FROM chunks GROUP BY hash)")
def dedup_stats(spark, d):
    return dedup.dedup_stats(*_sides(spark, d))


@query("SELECT DISTINCT hash FROM chunks WHERE node_idx = 0 AND hash IN (SELECT hash FROM chunks WHERE node_idx <> 0)")
def chunks_on_both_sides(spark, d):
    return dedup.on_both(*_sides(spark, d))


@query("SELECT DISTINCT hash FROM chunks")
def all_available_chunks(spark, d):
    return dedup.all_available(*_sides(spark, d))


@query("SELECT DISTINCT hash FROM old_chunks WHERE hash NOT IN (SELECT hash FROM chunks)")
def tracker_missing(spark, d):
    wanted = derived.prev_state(spark, d).select(F.explode("chunks.hash").alias("hash"))
    return dedup.missing(wanted, *_sides(spark, d))


@query("SELECT hash, CASE WHEN node_idx = 0 THEN 'local' ELSE 'remote' END AS origin, node_idx, start AS \"offset\" FROM chunks")
def tracker_sources(spark, d):
    return dedup.sources(*_sides(spark, d)).drop("rank")


_CHUNK_EVENTS = "SELECT user_id::VARCHAR AS hash, event_id AS seq, CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'click' THEN 'InProgress' WHEN 'view' THEN 'InProgress' WHEN 'purchase' THEN 'Completed' ELSE 'Failed' END AS status FROM events"


def _chunk_events(spark, d):
    e = _table(spark, d, "events")
    status = F.when(F.col("event_type") == "signup", "Pending").when(F.col("event_type").isin("click", "view"), "InProgress").when(F.col("event_type") == "purchase", "Completed").otherwise("Failed")
    return e.select(F.col("user_id").cast("string").alias("hash"), F.col("event_id").alias("seq"), status.alias("status"))


@query(f"SELECT hash, max_by(status, seq) AS status, CASE WHEN min(seq) FILTER (status = 'Completed') IS NOT NULL AND coalesce(min(seq) FILTER (status = 'InProgress') > min(seq) FILTER (status = 'Completed'), true) THEN 'completed before it began' END AS error FROM ({_CHUNK_EVENTS}) GROUP BY hash", tables=False)
def transfer_states(spark, d):
    return dedup.transfer_states(_chunk_events(spark, d))


@query(f"SELECT count(*) AS n_chunks, count(*) FILTER (s = 'Pending') AS n_pending, count(*) FILTER (s = 'InProgress') AS n_in_progress, count(*) FILTER (s = 'Completed') AS n_completed, count(*) FILTER (s = 'Failed') AS n_failed FROM (SELECT hash, max_by(status, seq) AS s FROM ({_CHUNK_EVENTS}) GROUP BY hash)", tables=False)
def tracker_stats(spark, d):
    return dedup.tracker_stats(dedup.transfer_states(_chunk_events(spark, d)))


@query("SELECT i.node_idx, i.path, i.mtime, p.path IS NOT NULL AND p.mt = i.mtime AS hit FROM inv i LEFT JOIN (SELECT path, 1700000000 + doc_id * 60 AS mt FROM prev) p ON p.path = i.path")
def cache_hits(spark, d):
    return state.cache_hits(_inv(spark, d), derived.prev_state(spark, d)).select("node_idx", "path", "mtime", "hit")


@query("SELECT path, max_by(mtime, k * 10000000000 + mtime) AS mtime FROM (SELECT path, 1700000000 + doc_id * 60 AS mtime, 0 AS k FROM prev UNION ALL SELECT path, mtime, 1 FROM inv) GROUP BY path")
def cache_put(spark, d):
    cols = ["path", "mtime", "chunks"]
    return state.cache_put(derived.prev_state(spark, d).select(cols), _inv(spark, d).select(cols)).select("path", "mtime")


@query(f"SELECT node_idx, path, {NOW} < mtime + 3600 AS valid, {NOW} < mtime + 3600 AND mtime = 1700000000 + doc_id * 60 AS file_valid FROM inv")
def cache_ttl_valid(spark, d):
    rows = derived.contents(spark, d).select("node_idx", "path", F.col("mtime").alias("created"), "mtime", (derived.EPOCH + F.col("doc_id") * 60).alias("current_mtime"))
    return state.cache_valid(rows, NOW, 3600).select("node_idx", "path", "valid", "file_valid")


def _locks(spark, d):
    c = F.col("c_custkey")
    return _table(spark, d, "customer").select(F.concat(F.lit("lock/"), c.cast("string")).alias("path"), (c % 7).alias("pid"), (NOW - c * 1000).alias("started"))


@query(f"SELECT path, pid, pid NOT IN (1, 2, 5) OR {NOW} - started > 86400 AS stale FROM (SELECT 'lock/' || c_custkey AS path, c_custkey % 7 AS pid, {NOW} - c_custkey * 1000 AS started FROM customer)", tables=False)
def stale_locks(spark, d):
    return state.stale_locks(_locks(spark, d), spark.createDataFrame([(1,), (2,), (5,)], "pid long"), NOW).select("path", "pid", "stale")


@query(f"SELECT count(*) AS n_removed FROM customer WHERE c_custkey % 7 NOT IN (1, 2, 5) OR c_custkey * 1000 > 86400", tables=False)
def stale_lock_cleanup(spark, d):
    return state.cleaned_locks(_locks(spark, d), spark.createDataFrame([(1,), (2,), (5,)], "pid long"), NOW)[1]


@query("SELECT 'lock/' || s_suppkey * 3 AS path FROM supplier WHERE s_suppkey * 3 IN (SELECT c_custkey FROM customer)", tables=False)
def lock_conflicts(spark, d):
    wanted = _table(spark, d, "supplier").select(F.concat(F.lit("lock/"), (F.col("s_suppkey") * 3).cast("string")).alias("path"))
    return state.lock_conflicts(wanted, _locks(spark, d))


@query("SELECT max(v) AS version FROM (SELECT v FROM (SELECT DISTINCT n_regionkey AS node_idx, n_nationkey % 4 AS v FROM nation) GROUP BY v HAVING count(*) = (SELECT count(DISTINCT n_regionkey) FROM nation))", tables=False)
def common_version(spark, d):
    return state.common_version(_table(spark, d, "nation").select(F.col("n_regionkey").alias("node_idx"), (F.col("n_nationkey") % 4).alias("version")))


# Text


_SIZES = "CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || 'K' WHEN 1 THEN ' ' || o_orderkey || 'm ' WHEN 2 THEN o_orderkey || 'G' WHEN 3 THEN o_orderkey || '' WHEN 4 THEN o_orderkey || 'x' ELSE '1T' END"


@query(f"SELECT t, CASE WHEN regexp_full_match(upper(trim(t)), '\\d+[KMGT]?') THEN regexp_extract(t, '\\d+')::BIGINT * CASE right(upper(trim(t)), 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 ELSE 1 END END AS bytes FROM (SELECT {_SIZES} AS t FROM orders)", tables=False)
def parse_size(spark, d):
    t = _table(spark, d, "orders").select(F.expr(_SIZES).alias("t"))
    return t.select("t", literals.parse_size(F.col("t")).alias("bytes"))


_DURATIONS = "CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || 's' WHEN 1 THEN o_orderkey || 'M' WHEN 2 THEN o_orderkey || 'h' WHEN 3 THEN o_orderkey || 'd' WHEN 4 THEN o_orderkey || 'ms' ELSE o_orderkey || '' END"


@query(f"SELECT t, CASE WHEN regexp_full_match(lower(t), '\\d+[smhd]?') THEN regexp_extract(t, '\\d+')::BIGINT * CASE right(lower(t), 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END END AS seconds FROM (SELECT {_DURATIONS} AS t FROM orders)", tables=False)
def parse_duration(spark, d):
    t = _table(spark, d, "orders").select(F.expr(_DURATIONS).alias("t"))
    return t.select("t", literals.parse_duration(F.col("t")).alias("seconds"))


_STRATEGY = "CASE n_nationkey % 8 WHEN 0 THEN 'Newest' WHEN 1 THEN 'prefer-oldest' WHEN 2 THEN 'ASK' WHEN 3 THEN 'node:' || n_nationkey WHEN 4 THEN 'node:' || n_name WHEN 5 THEN 'error' WHEN 6 THEN 'skip' ELSE n_name END"


@query(f"SELECT t, CASE n_nationkey % 8 WHEN 0 THEN 'prefer-newest' WHEN 1 THEN 'prefer-oldest' WHEN 2 THEN 'interactive' WHEN 3 THEN 'node-by-index' WHEN 4 THEN 'node-by-name' WHEN 5 THEN 'fail' WHEN 6 THEN 'skip' END AS strategy, CASE WHEN n_nationkey % 8 = 3 THEN n_nationkey END AS node_index, CASE WHEN n_nationkey % 8 = 4 THEN lower(n_name) END AS node_name FROM (SELECT *, {_STRATEGY} AS t FROM nation)", tables=False)
def parse_strategy(spark, d):
    t = _table(spark, d, "nation").select(F.expr(_STRATEGY).alias("t"))
    return t.select("t", literals.parse_strategy(F.col("t")).alias("s")).select("t", "s.*")


_ADDRESS = "CASE c_custkey % 5 WHEN 0 THEN '/srv/' || c_custkey WHEN 1 THEN 'host' || c_custkey || ':/x' WHEN 2 THEN 'me@host.example.org:/x/' || c_custkey WHEN 3 THEN './a:b' ELSE '~/d' END"


@query(f"SELECT a, r AS is_remote, CASE WHEN r AND contains(split_part(a, ':', 1), '@') THEN split_part(a, '@', 1) END AS \"user\", CASE WHEN r THEN regexp_replace(split_part(a, ':', 1), '^[^@]*@', '') ELSE 'local' END AS host, CASE WHEN r THEN a[strpos(a, ':') + 1 :] ELSE a END AS path FROM (SELECT {_ADDRESS} AS a, contains(a, ':') AND NOT regexp_matches(a, '^[/.~]') AS r FROM customer)", tables=False)
def node_components(spark, d):
    a = _table(spark, d, "customer").select(F.expr(_ADDRESS).alias("a"))
    return a.select("a", paths.location_parts(F.col("a")).alias("p")).select("a", "p.*")


@query("SELECT 0 AS node_idx, 'data/alpha' AS label UNION ALL SELECT 1, 'store:…/beta' UNION ALL SELECT 2, 'far:data/alpha'", tables=False)
def node_labels(spark, d):
    return labels.node_labels(derived.nodes(spark)).select("node_idx", "label")


@query("SELECT lang, regexp_replace(CASE WHEN min(p) = max(p) THEN min(p) ELSE left(min(p), (SELECT max(i) FROM unnest(range(0, length(min(p)) + 1)) AS u(i) WHERE left(min(p), i) = left(max(p), i))::INT) END, '[^/]*$', '') AS prefix FROM (SELECT split_part(path, '/', 2) AS lang, split_part(path, '/', 1) || '/' || split_part(path, '/', 3) AS p FROM inv) GROUP BY lang")
def common_prefix(spark, d):
    p = _inv(spark, d).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("lang"), F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(3))).alias("p"))
    return p.groupBy("lang").agg(labels.common_prefix(F.min("p"), F.max("p")).alias("prefix"))


@query("SELECT doc_id, replace(replace(to_base64(unhex(sha256(body))), '+', '-'), '/', '_') AS text, true AS same FROM base")
def base64url_roundtrip(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", codec.digest(F.coalesce("text", F.lit(""))).alias("h"))
    return rows.select("doc_id", codec.to_base64url(F.col("h")).alias("text"), "h").select("doc_id", "text", (codec.from_base64url(F.col("text")) == F.col("h")).alias("same"))


_LINES = "CASE WHEN doc_id % 6 = 0 THEN 'F:' || path || ':x:1:1:1:1:1' WHEN doc_id % 6 = 1 THEN 'F:' || path WHEN tp = 'F' THEN 'F:' || path || ':' || mode || ':1000:1000:' || (mtime + 5) || ':' || mtime || ':' || size WHEN tp = 'D' THEN 'D:' || path || ':' || mode || ':1000:1000:' || (mtime + 5) || ':' || mtime ELSE 'L:' || path || ':' || mode || ':1000:1000:' || (mtime + 5) || ':' || mtime || ':' || target END"


@query("SELECT doc_id, node_idx, CASE doc_id % 6 WHEN 0 THEN 'invalid number' WHEN 1 THEN 'too few fields' END AS error, CASE WHEN doc_id % 6 > 1 THEN tp END AS tp, CASE WHEN doc_id % 6 > 1 THEN path END AS path, CASE WHEN doc_id % 6 > 1 THEN mtime END AS mtime, CASE WHEN doc_id % 6 > 1 THEN size END AS size, CASE WHEN doc_id % 6 > 1 THEN target END AS target FROM inv")
def parse_protocol_lines(spark, d):
    rows = derived.contents(spark, d).select("doc_id", "node_idx", F.expr(_LINES).alias("value"))
    return listing.parse_colon_lines(rows).select("doc_id", "node_idx", "r.error", "r.tp", "r.path", "r.mtime", "r.size", "r.target")


@query("SELECT node_idx, path, '{\"typ\":\"' || CASE tp WHEN 'L' THEN 'S' ELSE tp END || '\",\"pth\":\"' || path || '\",\"mod\":' || mode || ',\"uid\":1000,\"gid\":1000,\"ct\":' || ctime || ',\"mt\":' || mtime || ',\"sz\":' || size || CASE WHEN target IS NULL THEN '' ELSE ',\"tgt\":\"' || target || '\"' END || '}' AS line FROM inv")
def entries_to_json(spark, d):
    return _inv(spark, d).select("node_idx", "path", codec.entry_json().alias("line"))


@query("SELECT 'node' || node_idx AS file, path, tp, mode, mtime, size, target, CASE WHEN cl = '' THEN 0 ELSE len(string_split(cl, ',')) END AS n_chunks FROM inv")
def listing_round_trip(spark, d):
    lines = listing.listing_lines(_inv(spark, d))
    rows = lines.select(F.concat(F.lit("node"), F.col("node_idx").cast("string"), F.lit("/"), "path").alias("file"), F.col("pos").alias("seq"), F.col("line").alias("value"))
    back = listing.parse_listing(rows)
    return back.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("file"), "path", "tp", "mode", "mtime", "size", "target", F.size("chunks").cast("long").alias("n_chunks"))


@query("SELECT n_name AS name, regexp_full_match(n_name, '.*[AEIOU]') AS offered, CASE WHEN n_nationkey % 3 = 0 THEN [3, n_nationkey] WHEN n_nationkey % 3 = 1 THEN [n_nationkey] END AS versions FROM nation", tables=False)
def version_messages(spark, d):
    k = F.col("n_nationkey")
    message = F.when(k % 3 == 0, F.concat(F.lit("INVENTORY:3, "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("INVENTORY:"), k.cast("string"))).otherwise(F.concat(F.lit("INVENTORY:x"), k.cast("string")))
    return _table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_name").rlike("[AEIOU]$").alias("offered"), codec.parse_versions(message, codec.GREETING).alias("versions"))


@query("SELECT path, parts AS sort_key FROM (SELECT DISTINCT path, string_split(path, '/') AS parts FROM inv)")
def component_order(spark, d):
    return _inv(spark, d).select("path").distinct().select("path", paths.sort_key(F.col("path")).alias("sort_key"))


@query("SELECT node_idx, path || repeat('x', (doc_id % 50)::INT) AS path, CASE WHEN length(path) + doc_id % 50 > 45 THEN left(path || repeat('x', (doc_id % 50)::INT), 42) || '...' ELSE rpad(path || repeat('x', (doc_id % 50)::INT), 45, ' ') END AS shown, printf('%.1f', size / 1e6) AS megabytes FROM inv")
def display_formats(spark, d):
    rows = derived.contents(spark, d).select("node_idx", F.concat("path", F.repeat(F.lit("x"), (F.col("doc_id") % 50).cast("int"))).alias("path"), "size")
    return rows.select("node_idx", "path", literals.display_path(F.col("path")).alias("shown"), literals.megabytes(F.col("size")).alias("megabytes"))


# Events

_EVENTS = "SELECT event_id AS seq, ts, (user_id % 3)::INT AS node_idx, 'file/' || user_id AS path, CASE event_type WHEN 'view' THEN 'exists' WHEN 'click' THEN 'pending' WHEN 'signup' THEN 'syncing' WHEN 'purchase' THEN 'synced' WHEN 'error' THEN 'failed' ELSE 'unknown' END AS status, floor(value * 100)::BIGINT AS bytes FROM events"
_LATEST = f"SELECT path, node_idx, max_by(status, seq) AS status, bool_or(status = 'failed') AS ever_failed FROM ({_EVENTS}) GROUP BY ALL"


def _events(spark, d):
    return ev.translate(_table(spark, d, "events"))


@query(_LATEST, tables=False)
def latest_status_per_key(spark, d):
    return ev.latest_status(_events(spark, d))


@query(f"SELECT node_idx, count(*) AS n_events, sum(bytes)::BIGINT AS bytes, count(*) FILTER (status = 'synced') AS n_synced, max(seq) AS last_seq FROM ({_EVENTS}) GROUP BY node_idx", tables=False)
def progress_per_node(spark, d):
    return ev.progress(_events(spark, d))


@query(f"SELECT node_idx, sum(sent)::BIGINT AS sent, sum(received)::BIGINT AS received FROM (SELECT node_idx, bytes AS sent, 0 AS received FROM ({_EVENTS}) WHERE status <> 'failed' AND bytes > 0 UNION ALL SELECT (seq % 3)::INT, 0, bytes FROM ({_EVENTS}) WHERE status <> 'failed' AND bytes > 0) GROUP BY node_idx", tables=False)
def sent_received(spark, d):
    ops = _events(spark, d).select(F.col("node_idx").alias("src_node"), (F.col("seq") % 3).cast("int").alias("dst_node"), F.when(F.col("status") == "failed", "delete").otherwise("write").alias("op"), "bytes")
    return ev.sent_received(ops)


@query(f"SELECT seq, path, status, epoch(lead(ts) OVER (PARTITION BY path ORDER BY ts, seq) - ts)::BIGINT AS seconds FROM (SELECT seq, date_trunc('second', ts) AS ts, path, status FROM ({_EVENTS}))", tables=False)
def phase_durations(spark, d):
    return ev.phase_durations(_events(spark, d).withColumn("ts", F.date_trunc("second", "ts")))


@query(f"SELECT seq, path, status FROM ({_EVENTS}) ORDER BY seq DESC LIMIT 100", tables=False)
def top_100_logs(spark, d):
    return ev.last_logs(_events(spark, d)).select("seq", "path", "status")


@query(f"SELECT node_idx, round(sum(bytes) / 1e6, 6) AS megabytes, round(least(greatest(count(*) FILTER (status = 'synced') / count(*), 0), 1), 9) AS ratio FROM ({_EVENTS}) GROUP BY node_idx", tables=False)
def rate_and_ratio(spark, d):
    p = ev.progress(_events(spark, d))
    return p.select("node_idx", F.round(F.col("bytes") / F.lit(1e6), 6).alias("megabytes"), F.round(literals.ratio(F.col("n_synced"), F.col("n_events")), 9).alias("ratio"))


@query(f"SELECT node_idx, slot, min(seq) AS seq FROM (SELECT *, (epoch_us(ts) // 3600000000)::BIGINT AS slot FROM ({_EVENTS})) GROUP BY ALL", tables=False)
def throttled_progress(spark, d):
    return ev.throttle(_events(spark, d), 3600)


@query(f"SELECT seq, CASE status WHEN 'failed' THEN '!E:' WHEN 'pending' THEN '#W:' ELSE '#I:' END || path AS line FROM ({_EVENTS})", tables=False)
def log_lines(spark, d):
    e = _events(spark, d)
    level = F.when(F.col("status") == "failed", "error").when(F.col("status") == "pending", "warn").otherwise("info")
    return e.select("seq", codec.log_line(level, F.col("path")).alias("line"))


# Streams: run over what is there, equal to the batch result


@query(_LATEST, tables=False)
def stream_latest_status(spark, d):
    return ev.run_available(ev.latest_status(ev.translate(ev.read_stream(spark, d, "events"))), "complete", "stream-status")


@query(f"SELECT node_idx, count(*) AS n_events, sum(bytes)::BIGINT AS bytes, count(*) FILTER (status = 'synced') AS n_synced, max(seq) AS last_seq FROM ({_EVENTS}) GROUP BY node_idx", tables=False)
def stream_progress(spark, d):
    return ev.run_available(ev.progress(ev.translate(ev.read_stream(spark, d, "events"))), "complete", "stream-progress")


@query("SELECT path, status, CASE WHEN status = 'winner' THEN candidate END AS winner_node, n_present FROM diff")
def stream_diff(spark, d):
    folder, out = scratch(spark, "watch-drop"), scratch(spark, "watch-out")
    _inv(spark, d).write.parquet(folder)
    watch.watch(spark, folder, derived.prev_state(spark, d), N_NODES, out, available_now=True).awaitTermination()
    return watch.latest(spark, out).select("path", "status", "winner_node", "n_present")


@query(
    "SELECT path, node_idx AS winner_node FROM (SELECT r.path, v.node_idx, row_number() OVER (PARTITION BY r.path ORDER BY r.seq) AS k FROM (SELECT path, doc_id * 10 + j AS seq, (doc_id + j) % 4 AS chosen FROM (SELECT DISTINCT path, doc_id FROM inv), unnest([0, 1, 2]) AS u(j)) r JOIN diff d ON d.path = r.path AND d.status = 'conflict' JOIN (SELECT path, node_idx, row_number() OVER (PARTITION BY path ORDER BY node_idx) - 1 AS pos FROM inv) v ON v.path = r.path AND v.pos = r.chosen) WHERE k = 1"
)
def stream_resolutions(spark, d):
    folder = scratch(spark, "choices")
    rows = derived.contents(spark, d).select("path", "doc_id").distinct().withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows.select((F.col("doc_id") * 10 + F.col("j")).alias("seq"), "path", ((F.col("doc_id") + F.col("j")) % 4).cast("int").alias("chosen_node")).write.parquet(folder)
    stream = spark.readStream.schema("seq long, path string, chosen_node int").parquet(folder)
    return ev.run_available(ev.resolutions(stream, _conflicts(spark, d)), "complete", "stream-resolutions")


# Bytes


@query()
def cdc_chunks(spark, d):
    files = derived.contents(spark, d).filter("tp = 'F'").select("node_idx", "path", F.col("body").alias("content"))
    c = chunking.cdc_chunks(files, chunking.ChunkConfig(bits=8, most=4))
    return c.select("node_idx", "path", F.size("chunks").alias("n_chunks"), F.coalesce(F.aggregate("chunks", F.lit(0).cast("long"), lambda s, x: s + x["size"]), F.lit(0)).alias("bytes"))


@query("SELECT node_idx, path, sha256(body) AS digest FROM content WHERE body <> ''")
def cdc_verified_reassembly(spark, d):
    """Chunk, damage a replica, read the first whole one, and put the files together again."""
    files = derived.contents(spark, d).filter("tp = 'F'").select("node_idx", "path", F.col("body").cast("binary").alias("content"))
    c = chunking.cdc_chunks(files, chunking.ChunkConfig(bits=8, most=4), payloads=True).select("node_idx", "path", F.explode("chunks").alias("c"))
    places = stored(c.select("node_idx", "path", "c.hash", "c.offset", "c.data"), "cdc-payloads")
    torn = places.select("hash", F.lit(-1).alias("position"), F.lit(-1).alias("node_idx"), F.concat("data", F.lit("?").cast("binary")).alias("data"))
    replicas = places.select("hash", F.col("node_idx").alias("position"), "node_idx", "data").union(torn)
    read = dedup.verified_read(places.select("hash"), replicas)
    return dedup.reassemble(places, read).select("node_idx", "path", F.sha2("content", 256).alias("digest"))


def _payloads(spark, d):
    rows = derived.contents(spark, d).select("node_idx", "path", F.posexplode(derived.slices(F.col("body"))).alias("pos", "data"))
    return rows.select("node_idx", "path", "pos", F.md5("data").alias("hash"), (F.col("pos") * derived.SLICE).cast("long").alias("offset"), F.length("data").cast("long").alias("size"), "data")


@query("SELECT hash, min(node_idx) FILTER (node_idx > 0 OR pos % 2 = 0) AS node_idx FROM chunks GROUP BY hash HAVING count(*) FILTER (node_idx > 0 OR pos % 2 = 0) > 0")
def verified_replica_read(spark, d):
    p = _payloads(spark, d)
    damaged = p.withColumn("data", F.when((F.col("node_idx") == 0) & (F.col("pos") % 2 == 1), F.concat("data", F.lit("?"))).otherwise(F.col("data")))
    replicas = damaged.select("hash", F.col("node_idx").alias("position"), "node_idx", "data")
    return dedup.verified_read(p.select("hash"), replicas, F.md5).select("hash", "node_idx")


@query("SELECT node_idx, path, md5(body) AS digest FROM content WHERE body <> ''")
def reassemble(spark, d):
    p = _payloads(spark, d)
    one = p.select("hash", "data").dropDuplicates(["hash"])
    return dedup.reassemble(p.select("node_idx", "path", "hash", "offset"), one).select("node_idx", "path", F.md5("content").alias("digest"))


@query("SELECT path, tp, mode, mtime, size FROM (SELECT o.*, 1700000000 + doc_id * 60 AS mtime FROM prev o)")
def snapshot_import(spark, d):
    prev = derived.prev_state(spark, d)
    rows = prev.select(F.to_json(F.create_map("path", F.from_json(codec.state_json(), snapshot.ENTRY))).alias("value"))
    return snapshot.from_json_text(rows).select("path", "tp", "mode", "mtime", "size")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The three-way reconciliation: what each path's fate is, and who wins."""
    return _decided(spark, d)


from . import catalog_runs  # noqa: E402, F401  (registers its queries here)
