"""Inventories derived from the documents table, for queries over the driver's data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_NODES = 3
SLICE = 512
EPOCH = 1_700_000_000
NODES = ((0, "/srv/data/alpha"), (1, "backup@store.example.org:/srv/data/beta"), (2, "mirror@far.example.org:/vol/data/alpha"))


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NODES), "node_idx int, location string")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 19 == 0, "D").when(d % 17 == 0, "L").otherwise("F")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("body"), F.concat("source", F.lit("/"), "lang", F.lit("/"), d.cast("string"), F.lit(".txt")).alias("path"), kind.alias("tp")
    )


def slices(body: Column, size: int = SLICE) -> Column:
    """The body in pieces of ``size`` characters; one pass, however long it is."""
    return F.regexp_extract_all(body, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def fixed_chunks(body: Column, size: int = SLICE) -> Column:
    """array of (hash, offset, size) over slices of ``size`` characters."""
    return F.transform(slices(body, size), lambda x, i: F.struct(F.md5(x).alias("hash"), (i * size).cast("long").alias("offset"), F.length(x).cast("long").alias("size")))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_idx, doc_id, path, tp, body and metadata: what each node holds.

    One scan: the node copies of a row come from an exploded array.
    """
    d = F.col("doc_id")
    held = F.array_compact(F.array(F.when(d % 7 != 0, 0), F.when(d % 5 != 0, 1), F.when(d % 3 != 0, 2)))
    rows = _base(spark, sf_dir).withColumn("node_idx", F.explode(held))
    node = F.col("node_idx")
    body = F.when(F.col("tp") != "F", "").when((node == 1) & (d % 11 == 0), F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    mode = F.when(F.col("tp") == "D", 493).when(F.col("tp") == "L", 511).when((node == 2) & (d % 13 == 0), 493).otherwise(420)
    target = F.when(F.col("tp") == "L", F.concat(F.lit("target/"), F.when((node == 1) & (d % 2 == 0), -d).otherwise(d).cast("string")))
    mtime = EPOCH + d * 60 + node * (d % 4)
    return rows.select(
        "node_idx", "doc_id", "path", "tp", body.alias("body"), mode.cast("long").alias("mode"), F.lit(1000).cast("long").alias("uid"),
        F.lit(1000).cast("long").alias("gid"), (mtime + 5).alias("ctime"), mtime.alias("mtime"), F.length(body).cast("long").alias("size"), target.alias("target"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contents(spark, sf_dir)
    return c.select("node_idx", "path", "tp", "mode", "uid", "gid", "ctime", "mtime", "size", fixed_chunks(F.col("body")).alias("chunks"), "target")


def prev_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot before: most paths as node 0 first had them, and some that are gone."""
    d = F.col("doc_id")
    rows = _base(spark, sf_dir).withColumn("path", F.explode(F.array_compact(F.array(F.when(d % 4 != 0, F.col("path")), F.when(d % 20 == 0, F.concat(F.lit("gone/"), d.cast("string")))))))
    gone = F.col("path").startswith("gone/")
    tp = F.when(gone, "F").otherwise(F.col("tp"))
    body = F.when(gone | (F.col("tp") == "F"), F.col("body")).otherwise("")
    mode = F.when(tp == "D", 493).when(tp == "L", 511).otherwise(420)
    mtime = EPOCH + d * 60
    return rows.select(
        "path", tp.alias("tp"), mode.cast("long").alias("mode"), F.lit(1000).cast("long").alias("uid"), F.lit(1000).cast("long").alias("gid"), (mtime + 5).alias("ctime"), mtime.alias("mtime"),
        F.length(body).cast("long").alias("size"), fixed_chunks(body).alias("chunks"), F.when(tp == "L", F.concat(F.lit("target/"), d.cast("string"))).alias("target"),
    )


def capabilities(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    from ..schemas import CAPABILITIES

    rows = [
        (0, True, True, True, True, True, 0, 0, "ext4", True),
        (1, False, True, True, False, True, 1000, 1000, "apfs", False),
        (2, False, True, False, False, True, 1000, 1000, None, True),
    ]
    return spark.createDataFrame(rows, CAPABILITIES)


#: The same tables for the SQL side of the queries.
ORACLE_CTES = """
base AS (
  SELECT doc_id, coalesce(text, '') AS body, source || '/' || lang || '/' || doc_id || '.txt' AS path,
         CASE WHEN doc_id % 19 = 0 THEN 'D' WHEN doc_id % 17 = 0 THEN 'L' ELSE 'F' END AS tp FROM documents),
held AS (
  SELECT 0 AS node_idx, * FROM base WHERE doc_id % 7 <> 0 UNION ALL
  SELECT 1, * FROM base WHERE doc_id % 5 <> 0 UNION ALL
  SELECT 2, * FROM base WHERE doc_id % 3 <> 0),
content AS (
  SELECT node_idx, doc_id, path, tp,
         CASE WHEN tp <> 'F' THEN '' WHEN node_idx = 1 AND doc_id % 11 = 0 THEN body || '!' ELSE body END AS body,
         CASE WHEN tp = 'D' THEN 493 WHEN tp = 'L' THEN 511 WHEN node_idx = 2 AND doc_id % 13 = 0 THEN 493 ELSE 420 END AS mode,
         1700000000 + doc_id * 60 + node_idx * (doc_id % 4) AS mtime,
         CASE WHEN tp = 'L' THEN 'target/' || CASE WHEN node_idx = 1 AND doc_id % 2 = 0 THEN -doc_id ELSE doc_id END END AS target
  FROM held),
chunks AS (
  SELECT node_idx, path, tp, i AS pos, md5(substr(body, 512 * i + 1, 512)) AS hash, 512 * i AS start, least(512, length(body) - 512 * i) AS len
  FROM content, unnest(range((length(body) + 511) // 512)) AS r(i)),
lists AS (SELECT node_idx, path, string_agg(hash || ':' || start || ':' || len, ',' ORDER BY pos) AS cl FROM chunks GROUP BY ALL),
inv AS (
  SELECT c.node_idx, c.path, c.doc_id, c.tp, c.mode, c.mtime, c.mtime + 5 AS ctime, length(c.body) AS size, c.target, coalesce(l.cl, '') AS cl,
         concat_ws('|', c.tp, c.mode, coalesce(l.cl, '')) AS sig,
         concat_ws('|', c.tp, c.mode, coalesce(l.cl, ''), c.mtime, length(c.body), coalesce(c.target, '-')) AS full_sig
  FROM content c LEFT JOIN lists l ON l.node_idx = c.node_idx AND l.path = c.path),
old AS (
  SELECT doc_id, path, tp, CASE WHEN tp = 'F' THEN body ELSE '' END AS body FROM base WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 'gone/' || doc_id, 'F', body FROM base WHERE doc_id % 20 = 0),
old_chunks AS (
  SELECT path, i AS pos, md5(substr(body, 512 * i + 1, 512)) AS hash, 512 * i AS start, least(512, length(body) - 512 * i) AS len
  FROM old, unnest(range((length(body) + 511) // 512)) AS r(i)),
old_lists AS (SELECT path, string_agg(hash || ':' || start || ':' || len, ',' ORDER BY pos) AS cl FROM old_chunks GROUP BY ALL),
prev AS (
  SELECT o.path, o.doc_id, o.tp, CASE WHEN o.tp = 'D' THEN 493 WHEN o.tp = 'L' THEN 511 ELSE 420 END AS mode, length(o.body) AS size,
         concat_ws('|', o.tp, CASE WHEN o.tp = 'D' THEN 493 WHEN o.tp = 'L' THEN 511 ELSE 420 END, coalesce(l.cl, '')) AS sig
  FROM old o LEFT JOIN old_lists l ON l.path = o.path),
marked AS (
  SELECT i.*, p.path IS NOT NULL AS has_prev, p.path IS NOT NULL AND i.sig <> p.sig AS changed FROM inv i LEFT JOIN prev p ON p.path = i.path),
diff AS (
  SELECT path,
    CASE WHEN count(*) = 3 AND count(DISTINCT full_sig) = 1 THEN 'none'
         WHEN bool_or(has_prev) AND count(*) FILTER (changed) = 0 THEN 'none'
         WHEN bool_or(has_prev) AND count(*) FILTER (changed) = 1 THEN 'winner'
         WHEN bool_or(has_prev) THEN 'conflict'
         WHEN count(DISTINCT sig) = 1 THEN 'winner' ELSE 'conflict' END AS status,
    CASE WHEN bool_or(has_prev) THEN min(node_idx) FILTER (changed) ELSE min(node_idx) END AS candidate,
    count(*) AS n_present
  FROM marked GROUP BY path),
newest AS (
  SELECT i.path, i.node_idx AS winner_node, row_number() OVER (PARTITION BY i.path ORDER BY i.mtime DESC, i.node_idx DESC) AS k
  FROM inv i JOIN diff d ON d.path = i.path WHERE d.status = 'conflict'),
won AS (
  SELECT path, candidate AS winner_node FROM diff WHERE status = 'winner'
  UNION ALL SELECT path, winner_node FROM newest WHERE k = 1),
winners AS (SELECT i.* FROM inv i JOIN won w ON w.path = i.path AND w.winner_node = i.node_idx),
transfers AS (
  SELECT w.path, w.node_idx AS src_node, n.node_idx AS dst_node, true AS trans_meta, o.path IS NULL OR o.cl <> w.cl AS trans_data
  FROM winners w JOIN (SELECT unnest([0, 1, 2]) AS node_idx) n ON n.node_idx <> w.node_idx
  LEFT JOIN inv o ON o.path = w.path AND o.node_idx = n.node_idx
  WHERE o.path IS NULL OR o.full_sig <> w.full_sig OR o.cl <> w.cl),
owned AS (SELECT DISTINCT node_idx, hash FROM chunks),
missing AS (
  SELECT DISTINCT t.dst_node, c.hash FROM transfers t JOIN chunks c ON c.path = t.path AND c.node_idx = t.src_node
  WHERE t.trans_data AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.node_idx = t.dst_node AND o.hash = c.hash)),
sizes AS (SELECT hash, max(len) AS len FROM chunks GROUP BY hash),
moves AS (
  SELECT m.hash, min(o.node_idx) AS src_node, m.dst_node, any_value(s.len) AS size
  FROM missing m JOIN owned o ON o.hash = m.hash JOIN sizes s ON s.hash = m.hash GROUP BY m.hash, m.dst_node)
"""
