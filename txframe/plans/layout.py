"""Queries about layout: runs, indexes, statistics, partitioning, catalog, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, merge, partition, scan, stats
from ..sources.fixtures import READ_TS, base_orders, ctes, table, version_log

B, V = ctes("b"), ctes("v")


def _runs(s, d):
    b = base_orders(s, d).select("key", "price")
    return b.filter("key % 3 <> 1").withColumn("price", F.col("price") + 7), b.filter("key % 3 <> 0")


RUNS_SQL = f"{B}, mem AS (SELECT key, price + 7 AS price FROM b WHERE key % 3 <> 1), kv AS (SELECT key, price FROM b WHERE key % 3 <> 0)"


def _cut(s, d):
    b = base_orders(s, d).select("key", (F.col("key") % 3).alias("run"))
    return merge.batch_cut(b.withColumn("drained", F.col("run") == 0)).select("run", "key")


def _upload(s, d):
    b = base_orders(s, d).select("key", "commit_ts", "price")
    return merge.newest_wins(b, b.filter("key % 4 = 0").select("key", (F.col("commit_ts") + F.when(F.col("key") % 8 == 0, 5).otherwise(-5)).alias("commit_ts"), (F.col("price") * 2).alias("price")))


SCAN_TS = 1_000_000_000_000_000


def _index(s, d):
    return merge.build_index(base_orders(s, d), F.col("priority"), SCAN_TS)


def _multi(s, d):
    li = table(s, d, "lineitem").select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("key"), F.col("l_linenumber").alias("n"), F.lit(1).cast("long").alias("commit_ts"))
    return merge.build_index(li, F.sequence(F.lit(1), F.col("n")), 10, multi=True)


def _stale(s, d):
    b = base_orders(s, d)
    idx = merge.build_index(b, F.col("priority"), SCAN_TS).withColumn("commit_ts", F.col("commit_ts") + F.when(F.col("key") % 9 == 0, 1).otherwise(0))
    return merge.guarded_lookup(idx, b).select("sk", "key", "price", "stale")


def _sample(s, d):
    return stats.hashed_sample(base_orders(s, d))


HIST_SQL = f"""{B}, p AS (SELECT key FROM b ORDER BY key * 2654435761 % 4294967296, key LIMIT 1024), s AS (SELECT key, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM p),
 h AS (SELECT row_number() OVER (ORDER BY key) - 1 AS step, key FROM s WHERE (rn - 1) % (CASE WHEN n > 128 THEN n // 128 ELSE 1 END) = 0 QUALIFY row_number() OVER (ORDER BY key) <= 128)"""


def _prefixes(s, d):
    return stats.records_per_prefix(base_orders(s, d), ["priority", "order_status", "cust"])


def _estimate(s, d):
    v = base_orders(s, d).withColumn("slice", F.expr("key DIV 50")).filter("slice % 10 = 0").agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("slice").alias("n"))
    return stats.estimate(v, F.lit(1000), F.col("n"))


def _ema(s, d):
    return stats.record_size_ema(version_log(s, d).select((F.col("key") % 5).alias("tbl"), F.col("commit_ts").alias("seq"), F.col("payload").alias("size")))


EMA_SQL = f"""{V}, o AS (SELECT key % 5 AS tbl, payload AS size, row_number() OVER (PARTITION BY key % 5 ORDER BY commit_ts) AS rn, count(*) OVER (PARTITION BY key % 5) AS n FROM v),
 f AS (SELECT tbl, rn, n, size AS a FROM o WHERE rn = 1 UNION ALL SELECT o.tbl, o.rn, o.n, (o.size + f.a * 9) // 10 FROM f JOIN o ON o.tbl = f.tbl AND o.rn = f.rn + 1) SELECT tbl, a AS avg_size FROM f WHERE rn = n"""

RING_SQL = """WITH p AS (SELECT (g * 7919 + i * 104729 + (g + 1) * i * 31) % 1024 AS pt, min(g) AS owner FROM (SELECT unnest(range(0, {n})) AS g), (SELECT unnest(range(0, 64)) AS i) GROUP BY 1),
 r AS (SELECT bucket, coalesce((SELECT owner FROM p WHERE pt > bucket ORDER BY pt LIMIT 1), (SELECT owner FROM p ORDER BY pt LIMIT 1)) AS owner FROM (SELECT unnest(range(0, 1024)) AS bucket))"""


def _ring(s, n):
    return partition.ring(s, list(range(n)))


MIGRATE_SQL = RING_SQL.format(n=3) + ", " + RING_SQL.format(n=4).removeprefix("WITH ").replace("p AS", "p2 AS").replace("FROM p ", "FROM p2 ").replace("r AS", "r2 AS") + """
 SELECT r.owner, r2.owner AS new_owner, count(*) AS n_buckets, min(r.bucket) AS first_bucket, CAST(sum(r.bucket) AS BIGINT) AS bucket_sum FROM r JOIN r2 USING (bucket) WHERE r.owner <> r2.owner GROUP BY 1, 2"""


def _ranges(s, d):
    keys = base_orders(s, d).filter("key % 500 = 0").select("key")
    return scan.floor_lookup(keys, base_orders(s, d).select(F.col("key").alias("probe"))).groupBy("floor").agg(F.count(F.lit(1)).alias("n_keys"))


def _slices(s, d):
    b = base_orders(s, d)
    size = (F.length("priority") + F.length("order_status") + 24).cast("long")
    return b.groupBy(F.expr("key DIV 50").alias("slice_id")).agg(F.sum(size).alias("bytes"))


SLICES_SQL = f"{B}, sl AS (SELECT key // 50 AS slice_id, CAST(sum(length(priority) + length(order_status) + 24) AS BIGINT) AS bytes FROM b GROUP BY 1)"


def _deltas(s, d):
    v = version_log(s, d).filter(f"commit_ts > 1 AND commit_ts <= {READ_TS}")
    return partition.slice_deltas(v.select(F.expr("key DIV 10").alias("slice_id"), (F.col("status") == "Normal").alias("live"), F.col("k").alias("row_bytes"), F.col("payload").alias("stored_bytes")))


def _splits(s, d):
    sl = _slices(s, d).select(F.expr("slice_id DIV 40").alias("range_id"), (F.col("slice_id") * 50).alias("start_key"), "bytes")
    return partition.range_splits(sl, 20_000)


SPLITS_SQL = f"""{SLICES_SQL}, x AS (SELECT slice_id // 40 AS range_id, slice_id * 50 AS start_key, bytes, row_number() OVER (PARTITION BY slice_id // 40 ORDER BY slice_id) AS rn, sum(bytes) OVER (PARTITION BY slice_id // 40) AS total FROM sl),
 y AS (SELECT *, CAST(total AS DOUBLE) / ceil(total / 12000.0) AS share FROM x WHERE total > 20000),
 f AS (SELECT range_id, rn, bytes AS acc, false AS new, start_key, share FROM y WHERE rn = 1 UNION ALL SELECT y.range_id, y.rn, CASE WHEN f.acc >= y.share THEN y.bytes ELSE f.acc + y.bytes END, f.acc >= y.share, y.start_key, y.share FROM f JOIN y ON y.range_id = f.range_id AND y.rn = f.rn + 1)
 SELECT range_id, row_number() OVER (PARTITION BY range_id ORDER BY start_key) AS part, start_key FROM f WHERE new"""


def _catalog(s, d):
    return version_log(s, d).select((F.col("key") % 30).alias("tbl"), F.col("commit_ts").alias("version"), F.when(F.col("object_type").isin("error", "view"), "dirty").otherwise("committed").alias("status"), F.col("object_type").alias("ddl"))


CAT_SQL = f"{V}, cat AS (SELECT key % 30 AS tbl, commit_ts AS version, CASE WHEN object_type IN ('error', 'view') THEN 'dirty' ELSE 'committed' END AS status, object_type AS ddl FROM v)"


def _names(s, d):
    n = F.concat(F.lit("t"), F.col("key").cast("string"), F.when(F.col("key") % 3 == 0, "*$$i").when(F.col("key") % 3 == 1, "*~~u").otherwise(""))
    e = version_log(s, d).select(n.alias("name")).distinct()
    return e.select("name", catalog.index_name(F.col("name")).alias("p")).select("name", "p.base", "p.index", "p.kind")


def _samples(s, d):
    return version_log(s, d).select(F.col("object_type").alias("name"), F.lit(1).cast("long").alias("amount"), F.col("commit_ts").alias("ts"), F.col("payload").alias("value"))


BOUNDS = [1000, 5000, 10000, 25000, 40000]


def _labels(s, d):
    e = version_log(s, d)
    return catalog.label_sets(e.select("object_type").distinct(), e.select("status").distinct())


QUERIES = {
    "merge_mem_kv": (lambda s, d: merge.merge_runs(*_runs(s, d)), f"{RUNS_SQL} SELECT key, price, 'mem' AS run FROM mem UNION ALL SELECT key, price, 'kv' FROM kv WHERE key NOT IN (SELECT key FROM mem)"),
    "merge_batch_cut": (_cut, f"{B}, r AS (SELECT key % 3 AS run, key FROM b) SELECT run, key FROM r WHERE key <= (SELECT min(m) FROM (SELECT run, max(key) AS m FROM r WHERE run <> 0 GROUP BY 1))"),
    "upload_batch_newer_wins": (_upload, f"{B} SELECT key, CASE WHEN key % 8 = 0 THEN commit_ts + 5 ELSE commit_ts END AS commit_ts, CASE WHEN key % 8 = 0 THEN price * 2 ELSE price END AS price FROM b"),
    "sk_build": (_index, f"{B} SELECT priority AS sk, key, commit_ts FROM b WHERE commit_ts <= {SCAN_TS}"),
    "sk_build_multikey": (_multi, "SELECT CAST(unnest(range(1, l_linenumber + 1)) AS INTEGER) AS sk, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey AS key, CAST(1 AS BIGINT) AS commit_ts FROM lineitem"),
    "sk_build_partial": (lambda s, d: merge.build_index(base_orders(s, d), F.col("priority"), SCAN_TS, F.col("order_status") == "F"), f"{B} SELECT priority AS sk, key, commit_ts FROM b WHERE commit_ts <= {SCAN_TS} AND order_status = 'F'"),
    "unique_violation": (lambda s, d: merge.violations(merge.build_index(base_orders(s, d), F.col("cust"), SCAN_TS)), f"{B} SELECT cust AS sk, count(*) AS n FROM b WHERE commit_ts <= {SCAN_TS} GROUP BY 1 HAVING count(*) > 1"),
    "sk_lookup_guarded": (_stale, f"{B} SELECT priority AS sk, key, price, key % 9 = 0 AS stale FROM b WHERE commit_ts <= {SCAN_TS}"),
    "multikey_flag": (lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.bool_or(F.col("l_linenumber") > 1).alias("multikey")), "SELECT l_returnflag, bool_or(l_linenumber > 1) AS multikey FROM lineitem GROUP BY 1"),
    "hist_equal_depth": (lambda s, d: stats.equal_depth(_sample(s, d)), f"{HIST_SQL} SELECT step, key FROM h"),
    "selectivity_range": (
        lambda s, d: stats.selectivity(stats.equal_depth(_sample(s, d)), 3001, 20003),
        f"""{HIST_SQL}, x AS (SELECT unnest([3001, 20003]) AS x), f AS (SELECT x, (sum(CASE WHEN key < x THEN 1 ELSE 0 END) + coalesce((x - max(CASE WHEN key < x THEN key END)) / CAST(min(CASE WHEN key >= x THEN key END) - max(CASE WHEN key < x THEN key END) AS DOUBLE), 0.5)) / (count(*) + 1) AS below FROM h, x GROUP BY x)
 SELECT max(CASE WHEN x = 20003 THEN below END) - max(CASE WHEN x = 3001 THEN below END) AS selectivity FROM f""",
    ),
    "records_per_key_prefix": (
        _prefixes,
        f"""{B}, p AS (SELECT * FROM b ORDER BY key * 2654435761 % 4294967296, key LIMIT 1024), c AS (SELECT (SELECT count(*) FROM b) AS t, count(*) AS s, count(DISTINCT priority) AS d1, count(DISTINCT (priority, order_status)) AS d2, count(DISTINCT (priority, order_status, cust)) AS d3 FROM p),
 e AS (SELECT t, s, unnest([1, 2, 3]) :: BIGINT AS prefix_len, unnest([d1, d2, d3]) AS ndv FROM c), g AS (SELECT *, CAST(floor((t - 1) * (ndv - 1) / CAST(s - 1 AS DOUBLE)) AS BIGINT) + 1 AS scaled_ndv FROM e) SELECT prefix_len, ndv, scaled_ndv, t // scaled_ndv AS rec_per_key FROM g""",
    ),
    "analyze_estimate": (_estimate, f"{B}, a AS (SELECT count(*) AS keys, count(DISTINCT key // 50) AS n FROM b WHERE key // 50 % 10 = 0) SELECT CAST(ceil(1000 * keys / n) AS BIGINT) AS records FROM a"),
    "merge_ng_stats": (lambda s, d: base_orders(s, d).groupBy("priority", (F.col("key") % 3).alias("ng")).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("top")).groupBy("priority").agg(F.sum("n").alias("records"), F.max("top").alias("top")), f"{B} SELECT priority, count(*) AS records, max(key) AS top FROM b GROUP BY 1"),
    "avg_record_size_ema": (_ema, EMA_SQL),
    "subrange_split_keys": (lambda s, d: stats.split_keys(_sample(s, d), 4), f"{B}, p AS (SELECT key FROM b ORDER BY key * 2654435761 % 4294967296, key LIMIT 1024), s AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM p) SELECT CAST(i // greatest(1, n // 5) - 1 AS BIGINT) AS part, key FROM s WHERE i > 0 AND i % greatest(1, n // 5) = 0 AND i <= greatest(1, n // 5) * 4"),
    "key_bucket": (lambda s, d: base_orders(s, d).groupBy(partition.key_bucket(F.col("key")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), f"{B} SELECT (key & 16383) % 1024 AS bucket, count(*) AS n FROM b GROUP BY 1"),
    "bucket_core": (lambda s, d: s.range(0, 1024).select(F.col("id").alias("bucket"), partition.bucket_core(F.col("id"), 6).alias("core")), "SELECT unnest(range(0, 1024)) AS bucket, bucket % 6 AS core"),
    "bucket_owner": (lambda s, d: _ring(s, 3), RING_SQL.format(n=3) + " SELECT * FROM r"),
    "bucket_owner_counts": (lambda s, d: _ring(s, 3).groupBy("owner").agg(F.count(F.lit(1)).alias("n")), RING_SQL.format(n=3) + " SELECT owner, count(*) AS n FROM r GROUP BY 1"),
    "migration_plan": (lambda s, d: partition.migration(_ring(s, 3), _ring(s, 4)), MIGRATE_SQL),
    "range_floor_join": (_ranges, f"{B}, r AS (SELECT key AS lo, lead(key) OVER (ORDER BY key) AS hi FROM b WHERE key % 500 = 0) SELECT lo AS floor, count(*) AS n_keys FROM b LEFT JOIN r ON b.key >= lo AND (hi IS NULL OR b.key < hi) GROUP BY 1"),
    "slice_sizes": (_slices, f"{SLICES_SQL} SELECT * FROM sl"),
    "slice_delta_sizes": (_deltas, f"{V} SELECT key // 10 AS slice_id, CAST(sum(CASE WHEN status = 'Normal' THEN k - payload ELSE -payload END) AS BIGINT) AS delta FROM v WHERE commit_ts > 1 AND commit_ts <= {READ_TS} GROUP BY 1"),
    "slice_split_merge_flags": (lambda s, d: partition.slice_flags(_slices(s, d).withColumn("bytes", F.col("bytes") * (F.col("slice_id") % 30))), f"{SLICES_SQL}, m AS (SELECT slice_id, bytes * (slice_id % 30) AS bytes FROM sl) SELECT *, CASE WHEN bytes > 16384 THEN 'split' WHEN bytes < 4096 THEN 'merge' ELSE 'keep' END AS action FROM m"),
    "range_split_keys": (_splits, SPLITS_SQL),
    "shard_code": (lambda s, d: base_orders(s, d).select("key", partition.shard_code(F.col("key") % 3, F.col("key")).alias("code")), f"{B} SELECT key, ((key % 3) << 10) | (key & 1023) AS code FROM b"),
    "purge_deleted": (lambda s, d: version_log(s, d).filter(f"NOT (status = 'Deleted' AND commit_ts <= {READ_TS})").select("key", "commit_ts", "status"), f"{V} SELECT key, commit_ts, status FROM v WHERE NOT (status = 'Deleted' AND commit_ts <= {READ_TS})"),
    "catalog_current_schema": (lambda s, d: catalog.current_schema(_catalog(s, d)), f"{CAT_SQL} SELECT tbl, version, ddl FROM cat WHERE status = 'committed' QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY version DESC) = 1"),
    "catalog_dirty_commit": (
        lambda s, d: catalog.commit_dirty(_catalog(s, d), s.range(0, 30, 2).select(F.col("id").alias("tbl"))),
        f"{CAT_SQL}, t AS (SELECT *, max(version) OVER (PARTITION BY tbl) AS top FROM cat) SELECT tbl, version, CASE WHEN status = 'dirty' AND tbl % 2 = 0 AND version = top THEN 'committed' ELSE status END AS status, ddl FROM t WHERE NOT (status = 'dirty' AND version < top)",
    ),
    "index_name_parse": (
        _names,
        f"""{V}, n AS (SELECT DISTINCT 't' || key || CASE key % 3 WHEN 0 THEN '*$$i' WHEN 1 THEN '*~~u' ELSE '' END AS name FROM v)
 SELECT name, CASE WHEN contains(name, '*') THEN split_part(name, '*', 1) ELSE name END AS base, CASE WHEN contains(name, '*') THEN right(name, 1) END AS index, CASE WHEN contains(name, '*~~') THEN 'unique' WHEN contains(name, '*$$') THEN 'secondary' ELSE 'primary' END AS kind FROM n""",
    ),
    "sequence_alloc": (lambda s, d: catalog.allocate(version_log(s, d).select((F.col("key") % 3).alias("seq"), F.col("event_id").alias("req")), 1, 2), f"{V} SELECT key % 3 AS seq, event_id AS req, 1 + 2 * (row_number() OVER (PARTITION BY key % 3 ORDER BY event_id) - 1) AS id, (row_number() OVER (PARTITION BY key % 3 ORDER BY event_id) - 1) // 256 AS lease FROM v"),
    "sequence_reserved": (lambda s, d: version_log(s, d).select("event_id", catalog.reserved(F.col("k") + 1, F.col("event_id") % 256, F.lit(257), 3).alias("reserved")), f"{V} SELECT event_id, least(k + 1, (257 - event_id % 256 - 1) // 3 + 1) AS reserved FROM v"),
    "backup_manifest": (lambda s, d: catalog.manifest(base_orders(s, d), SCAN_TS), f"{B} SELECT key % 16 AS part, count(*) AS n_rows, max(commit_ts) AS max_commit_ts, CAST(sum(price) AS BIGINT) AS checksum FROM b WHERE commit_ts <= {SCAN_TS} GROUP BY 1"),
    "metric_counter": (lambda s, d: catalog.counters(_samples(s, d)), f"{V} SELECT object_type AS name, count(*) AS value FROM v GROUP BY 1"),
    "metric_gauge": (lambda s, d: catalog.gauges(_samples(s, d)), f"{V} SELECT object_type AS name, arg_max(payload, commit_ts) AS value, max(commit_ts) AS ts FROM v GROUP BY 1"),
    "metric_histogram": (lambda s, d: catalog.histograms(_samples(s, d), BOUNDS), f"{V}, bd AS (SELECT unnest(['1000', '5000', '10000', '25000', '40000', '+Inf']) AS le, unnest([1000, 5000, 10000, 25000, 40000, 9223372036854775807]) AS b), nm AS (SELECT DISTINCT object_type AS name FROM v) SELECT name, le, (SELECT count(*) FROM v WHERE object_type = name AND payload <= b) AS n FROM nm, bd"),
    "label_cartesian": (_labels, f"{V} SELECT * FROM (SELECT DISTINCT object_type FROM v), (SELECT DISTINCT status FROM v)"),
}
