"""Queries that read: scans and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mvcc, scan
from ..operators.scan import ScanSpec
from ..sources.fixtures import CKPT_TS, NOW_MS, OLDEST_TS, READ_TS, base_orders, ctes, version_log

B, V = ctes("b"), ctes("v")
VIS = f"{V}, vis AS (SELECT * FROM v WHERE commit_ts <= {READ_TS} QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1)"


def _scan(spec, source=base_orders, records=("price", "commit_ts")):
    return lambda s, d: scan.scan(source(s, d), spec, records=list(records))


def _vscan(spec, records):
    return lambda s, d: scan.scan(mvcc.visible_as_of(version_log(s, d, READ_TS).select("key", "commit_ts", "status", "payload", "object_type", "ttl_ms"), READ_TS, keep_deleted=True), spec, records=list(records))


def _probes(s, d):
    return base_orders(s, d).select((F.col("key") + 3).alias("probe"))


def _asked(s):
    return s.range(1, 400, 3).select(F.col("id").alias("key"))


def _latest(s, d):
    return mvcc.visible_as_of(version_log(s, d, READ_TS).select("key", "commit_ts", "status", "payload", "ttl_ms"), READ_TS, keep_deleted=True)


def _read_ttl(s, d):
    return scan.read_ttl(_latest(s, d), NOW_MS).select("key", "read_status", "version_ts")


def _bucketed(s, d):
    return base_orders(s, d).select("key", "price", (F.col("key") % 1024).alias("bucket"))


def _resume(s, d):
    at = s.range(0, 1024).select(F.col("id").alias("bucket"), (F.col("id") + 2048).alias("last_key"), F.lit(7).alias("version"))
    return scan.resume(_bucketed(s, d), at, 3, version=7)


def _archive(s, d):
    return version_log(s, d).join(mvcc.visible_as_of(version_log(s, d), OLDEST_TS, True).select("key", F.col("commit_ts").alias("c")), "key").filter("commit_ts < c").drop("c")


def _miss(s, d):
    per = version_log(s, d).groupBy("key").agg(F.max("commit_ts").alias("current_ts"), F.sort_array(F.collect_list("commit_ts")).alias("a"))
    per = per.select("key", "current_ts", F.element_at("a", F.greatest(F.size("a") - 3, F.lit(1))).alias("oldest_ts"), F.when(F.col("key") % 5 == 0, F.lit(0)).when(F.col("key") % 2 == 0, F.lit(CKPT_TS)).otherwise(F.lit(READ_TS + 1)).cast("long").alias("ckpt_ts"))
    return per.select("key", mvcc.miss_class(READ_TS, F.col("current_ts"), F.col("oldest_ts"), F.col("ckpt_ts")).alias("outcome"))


def _ckpt_ts(s, d):
    locks = version_log(s, d).filter(f"commit_ts > {CKPT_TS}").select(F.col("commit_ts").alias("lock_ts"))
    return mvcc.checkpoint_ts(locks, READ_TS, 200_000_000_000)


def _copy(s, d):
    v = version_log(s, d)
    incoming = v.filter(f"commit_ts > {READ_TS}").select("key").distinct()
    return mvcc.visible_as_of(v, READ_TS, True).join(incoming, "key", "left_semi").select("key", "commit_ts", "payload")


def _merge_archives(s, d):
    v = version_log(s, d).select("key", "commit_ts", "payload")
    return mvcc.merge_archives(v.filter(f"commit_ts <= {READ_TS}"), v.filter(f"commit_ts >= {CKPT_TS}"))


def _snapshots(s, d):
    return version_log(s, d).select(F.col("commit_ts").alias("start_ts"), (F.col("k") % 3 == 0).alias("active"))


def _archivable(s, d):
    v = version_log(s, d)
    status = F.when(F.col("k") % 7 == 0, "Unknown").otherwise(F.col("status"))
    return v.select("key", "commit_ts", mvcc.archive_before_update(status, F.col("commit_ts"), F.lit(OLDEST_TS)).alias("archives"))


QUERIES = {
    "lower_bound_lookup": (lambda s, d: scan.lower_bound(base_orders(s, d).filter("key % 500 = 0"), _probes(s, d)), f"{B} SELECT probe, f.key AS bound FROM (SELECT key + 3 AS probe FROM b) ASOF LEFT JOIN (SELECT key FROM b WHERE key % 500 = 0) f ON probe <= f.key"),
    "scan_gaps": (lambda s, d: scan.gaps(base_orders(s, d), ScanSpec(1000, True, 9000, False)), f"{B} SELECT key, lag(key) OVER (ORDER BY key) AS after FROM b WHERE key >= 1000 AND key < 9000"),
    "set_flushed": (lambda s, d: mvcc.set_flushed(version_log(s, d), CKPT_TS).select("key", "commit_ts", "flushed_ts"), f"{V} SELECT key, commit_ts, CASE WHEN commit_ts <= {CKPT_TS} THEN {CKPT_TS} END AS flushed_ts FROM v"),
    "max_active_ts": (lambda s, d: mvcc.max_active_ts(_snapshots(s, d)), f"{V} SELECT max(commit_ts) AS max_active_ts FROM v WHERE k % 3 = 0"),
    "archive_before_update": (_archivable, f"{V} SELECT key, commit_ts, k % 7 <> 0 AND commit_ts > 1 AND commit_ts <= {OLDEST_TS} AS archives FROM v"),
    "mvcc_visible_as_of": (lambda s, d: mvcc.visible_as_of(version_log(s, d, READ_TS).select("key", "commit_ts", "status", "payload", "object_type"), READ_TS).drop("status"), f"{VIS} SELECT key, commit_ts, payload, object_type FROM vis WHERE status = 'Normal'"),
    "point_read": (lambda s, d: base_orders(s, d).filter("key = 777").select("key", "price", "commit_ts"), f"{B} SELECT key, price, commit_ts FROM b WHERE key = 777"),
    "batch_read": (lambda s, d: base_orders(s, d).join(F.broadcast(_asked(s)), "key").select("key", "price"), f"{B} SELECT key, price FROM b WHERE key IN (SELECT unnest(range(1, 400, 3)))"),
    "batch_read_missing_status": (
        lambda s, d: scan.batch_read(_latest(s, d).select("key", "status", "commit_ts", "payload"), _asked(s)),
        f"{VIS} SELECT q.key, coalesce(status, 'Deleted') AS status, payload, CASE WHEN status IS NULL THEN 1 ELSE commit_ts END AS version_ts FROM (SELECT unnest(range(1, 400, 3)) AS key) q LEFT JOIN vis ON q.key = vis.key",
    ),
    "range_scan_closed": (_scan(ScanSpec(1000, True, 2000, True)), f"{B} SELECT key, price, commit_ts FROM b WHERE key >= 1000 AND key <= 2000"),
    "range_scan_open": (_scan(ScanSpec(1000, False, 2000, False)), f"{B} SELECT key, price, commit_ts FROM b WHERE key > 1000 AND key < 2000"),
    "range_scan_unbounded": (_scan(ScanSpec(end=500, end_inclusive=False)), f"{B} SELECT key, price, commit_ts FROM b WHERE key < 500"),
    "range_scan_backward_limit": (_scan(ScanSpec(end=9000, backward=True, limit=100)), f"{B} SELECT key, price, commit_ts FROM b WHERE key <= 9000 ORDER BY key DESC LIMIT 100"),
    "scan_keys_only": (_scan(ScanSpec(100, end=5000, records=False)), f"{B} SELECT key FROM b WHERE key >= 100 AND key <= 5000"),
    "scan_recs_only": (_scan(ScanSpec(100, end=5000, keys=False, sort=False)), f"{B} SELECT price, commit_ts FROM b WHERE key >= 100 AND key <= 5000"),
    "scan_type_filter": (_vscan(ScanSpec(object_type="click"), ["payload", "object_type"]), f"{VIS} SELECT key, payload, object_type FROM vis WHERE status = 'Normal' AND object_type = 'click'"),
    "scan_pattern_filter": (_vscan(ScanSpec(pattern="1?[0-4]*"), ["payload"]), f"{VIS} SELECT key, payload FROM vis WHERE status = 'Normal' AND regexp_matches(CAST(key AS VARCHAR), '^1.[0-4].*$')"),
    "scan_ttl_filter": (_vscan(ScanSpec(now_ms=NOW_MS), ["payload", "ttl_ms"]), f"{VIS} SELECT key, payload, ttl_ms FROM vis WHERE status = 'Normal' AND (ttl_ms IS NULL OR ttl_ms >= {NOW_MS})"),
    "scan_ckpt_delta": (_vscan(ScanSpec(delta=True), ["status", "commit_ts"]), f"{VIS} SELECT key, status, commit_ts FROM vis"),
    "read_ttl_status": (_read_ttl, f"{VIS} SELECT key, CASE WHEN ttl_ms > 0 AND ttl_ms < {NOW_MS} THEN 'Deleted' ELSE status END AS read_status, CASE WHEN ttl_ms > 0 AND ttl_ms < {NOW_MS} THEN 1 ELSE commit_ts END AS version_ts FROM vis"),
    "floor_lookup": (lambda s, d: scan.floor_lookup(base_orders(s, d).filter("key % 500 = 0"), _probes(s, d)), f"{B} SELECT probe, f.key AS floor FROM (SELECT key + 3 AS probe FROM b) ASOF LEFT JOIN (SELECT key FROM b WHERE key % 500 = 0) f ON probe >= f.key"),
    "scan_page_resume": (_resume, f"{B} SELECT key, price, key % 1024 AS bucket FROM b WHERE key > key % 1024 + 2048 QUALIFY row_number() OVER (PARTITION BY key % 1024 ORDER BY key) <= 3"),
    "bucket_scan": (lambda s, d: _bucketed(s, d).filter("bucket = 17"), f"{B} SELECT key, price, key % 1024 AS bucket FROM b WHERE key % 1024 = 17"),
    "db_size": (lambda s, d: base_orders(s, d).groupBy("priority").agg(F.count(F.lit(1)).alias("n_keys")), f"{B} SELECT priority, count(*) AS n_keys FROM b GROUP BY 1"),
    "last_commit_ts": (lambda s, d: version_log(s, d).groupBy("object_type").agg(F.max("commit_ts").alias("last_ts")), f"{V} SELECT object_type, max(commit_ts) AS last_ts FROM v GROUP BY 1"),
    "mvcc_version_chain": (lambda s, d: mvcc.chain(version_log(s, d)).select("key", "commit_ts", "position"), f"{V} SELECT key, commit_ts, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) - 1 AS position FROM v"),
    "mvcc_prune_archives": (
        lambda s, d: mvcc.prune(version_log(s, d), OLDEST_TS).select("key", "commit_ts"),
        f"{V} SELECT key, commit_ts FROM (SELECT *, max(CASE WHEN commit_ts <= {OLDEST_TS} THEN commit_ts END) OVER (PARTITION BY key) AS f FROM v) WHERE f IS NULL OR commit_ts >= f",
    ),
    "has_visible_version": (lambda s, d: version_log(s, d).groupBy("key").agg((F.min("commit_ts") <= CKPT_TS).alias("visible")), f"{V} SELECT key, min(commit_ts) <= {CKPT_TS} AS visible FROM v GROUP BY 1"),
    "ckpt_export_base": (lambda s, d: mvcc.export(version_log(s, d), READ_TS).filter("target = 'base'").select("key", "commit_ts", "payload"), f"{VIS} SELECT key, commit_ts, payload FROM vis"),
    "ckpt_export_archive": (
        lambda s, d: mvcc.export(version_log(s, d), READ_TS).filter("target = 'archive'").select("key", "commit_ts", "payload"),
        f"{V} SELECT key, commit_ts, payload FROM v WHERE commit_ts <= {READ_TS} QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) > 1",
    ),
    "mvcc_miss_class": (
        _miss,
        f"""{V}, p AS (SELECT key, max(commit_ts) AS cur, list(commit_ts ORDER BY commit_ts) AS a FROM v GROUP BY 1),
 q AS (SELECT key, cur, a[greatest(len(a) - 3, 1)] AS old, CASE WHEN key % 5 = 0 THEN 0 WHEN key % 2 = 0 THEN {CKPT_TS} ELSE {READ_TS + 1} END AS ck FROM p)
 SELECT key, CASE WHEN cur <= {READ_TS} THEN 'Hit' WHEN old <= {READ_TS} THEN 'ArchiveHit' WHEN ck = 0 THEN 'VersionUnknown' WHEN ck <= {READ_TS} THEN 'BaseVersionMiss' ELSE 'ArchiveVersionMiss' END AS outcome FROM q""",
    ),
    "ckpt_ts": (
        _ckpt_ts,
        f"""{V}, m AS (SELECT coalesce(min(commit_ts) - 1, {READ_TS}) AS m FROM v WHERE commit_ts > {CKPT_TS})
 SELECT CASE WHEN m < {READ_TS} - 200000000000 THEN {READ_TS} - 200000000000 WHEN m < {READ_TS} THEN m ELSE {READ_TS} END AS ckpt_ts FROM m""",
    ),
    "oldest_snapshot_ts": (lambda s, d: version_log(s, d).filter("object_type = 'view'").agg(F.min("commit_ts").alias("oldest")), f"{V} SELECT min(commit_ts) AS oldest FROM v WHERE object_type = 'view'"),
    "dirty_scan": (lambda s, d: version_log(s, d).filter(f"commit_ts > {CKPT_TS} AND commit_ts <= {READ_TS}").select("key", "commit_ts", "status"), f"{V} SELECT key, commit_ts, status FROM v WHERE commit_ts > {CKPT_TS} AND commit_ts <= {READ_TS}"),
    "archive_from_ts": (lambda s, d: _archive(s, d).filter(f"commit_ts >= {CKPT_TS}").select("key", "commit_ts", "payload"), f"{V} SELECT key, commit_ts, payload FROM (SELECT *, max(CASE WHEN commit_ts <= {OLDEST_TS} THEN commit_ts END) OVER (PARTITION BY key) AS c FROM v) WHERE commit_ts < c AND commit_ts >= {CKPT_TS}"),
    "copy_base_to_archive": (_copy, f"{VIS} SELECT key, commit_ts, payload FROM vis WHERE key IN (SELECT key FROM v WHERE commit_ts > {READ_TS})"),
    "archive_merge": (_merge_archives, f"{V} SELECT DISTINCT key, commit_ts, payload FROM v"),
}
