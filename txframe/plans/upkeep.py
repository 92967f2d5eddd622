"""Queries of upkeep: backups, standby copies, kept statistics, samples under deletes, recovery, backfill, built-in metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backup, catalog, mvcc, stats, wal
from ..operators.catalog import METRICS
from ..sources.fixtures import CKPT_TS, READ_TS, base_orders, ctes, version_log
from ..sources.shared import shared_dir
from ..sources.store import Store

B, V = ctes("b"), ctes("v")
STAGES = ("Prepare", "Acquire", "Commit", "Install", "Flush", "Clean")


def _log_store(s, d):
    store = Store(s, shared_dir(s) + "/store")
    store.create_table("app.log", "value long")
    store.put_all("app.log", version_log(s, d).select("key", "commit_ts", "status", "ttl_ms", F.col("payload").alias("value")))
    return store


def _backed_up(s, d):
    store = _log_store(s, d)
    store.create_table("app.empty", "x string")
    kept = backup.Backups(s, shared_dir(s) + "/backups")
    kept.create(store, "first", CKPT_TS)
    kept.create(store, "second", READ_TS)
    kept.terminate("first")
    return kept


def _restored(s, d):
    fresh = Store(s, shared_dir(s) + "/restored")
    _backed_up(s, d).restore("second", fresh)
    return fresh.rows("app.log").select("key", "commit_ts", "value")


def _synced(s, d):
    """A standby copied whole at a checkpoint, brought up to a later one by changes alone."""
    store, standby = _log_store(s, d), Store(s, shared_dir(s) + "/standby")
    sent = [backup.sync_standby(store, standby, "app.log", at) for at in (CKPT_TS, READ_TS)]
    return standby.rows("app.log").select("key", "commit_ts", "status", F.col("value").alias("payload")).withColumn("sent", F.lit(",".join(sent)))


def _kept_stats(s, d):
    store, b = Store(s, shared_dir(s) + "/stats"), base_orders(s, d)
    stats.save(store, "orders", b.filter("key % 250 = 0").select((F.col("key") / 250).cast("long").alias("step"), "key"), 1, 1)
    stats.save(store, "orders", b.filter("key % 500 = 0").select((F.col("key") / 500).cast("long").alias("step"), "key"), b.count(), 2)
    return stats.fetch(store, "orders")


def _sampled(s, d):
    """Inserts and deletes of the version log that change what is live. No lane of a table fills here, so the sample is all that is live."""
    v = version_log(s, d).select("key", "commit_ts", F.when(F.col("status") == "Deleted", "Delete").otherwise("Insert").alias("op"))
    was = F.coalesce(F.lag("op").over(Window.partitionBy("key").orderBy("commit_ts")), F.lit("Delete"))
    ops = v.withColumn("was", was).filter("op <> was").select((F.col("key") % 30).alias("tbl"), F.col("commit_ts").alias("seq"), "key", "op")
    return stats.random_pairing(ops, 8192)


def _broken_off(s, d):
    v = version_log(s, d).filter("event_id % 3 <> 0")
    at = F.col("event_id") % 700 * 13 % 6
    upto = F.least(at, F.floor(F.col("event_id") / 700) % 6)
    rows = v.select((F.col("event_id") % 700).alias("txn"), upto.cast("int").alias("stage_ord"), F.element_at(F.array(*map(F.lit, STAGES)), (upto + 1).cast("int")).alias("stage"), "commit_ts")
    return wal.remaining_stages(rows, STAGES, "Commit")


def _waves(s, d):
    rows = version_log(s, d).select((F.col("key") % 4).alias("ng_id"), F.col("event_id").alias("txn"), "key", "commit_ts", F.when(F.col("k") % 9 == 0, "schema").otherwise("data").alias("class"))
    return wal.replay_waves(rows).select("ng_id", "txn", "key", "class", "wave")


def _backfilled(s, d):
    b = base_orders(s, d)
    cached = b.select(
        "key", F.when(F.col("key") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("commit_ts")).alias("commit_ts"), F.when(F.col("key") % 3 == 0, "Unknown").otherwise("Normal").alias("status"),
        F.when(F.col("key") % 3 != 0, F.col("price")).alias("payload"), F.lit(0).cast("long").alias("ckpt_ts"),
    )
    fetched = b.filter("key % 4 <> 1").select("key", (F.col("commit_ts") - F.col("key") % 2).alias("commit_ts"), F.when(F.col("key") % 5 == 0, "Deleted").otherwise("Normal").alias("status"), F.when(F.col("key") % 5 != 0, F.col("price") - 1).alias("payload"))
    return mvcc.backfill(cached, fetched)


def _observed(s, d):
    name = F.element_at(F.array(*map(F.lit, [*METRICS, "not_built_in"])), (F.col("event_id") % 25 + 1).cast("int"))
    return catalog.observed(version_log(s, d).select(name.alias("name"), F.col("commit_ts").alias("ts"), F.col("payload").alias("value")))


AS_OF = "SELECT key, commit_ts, status, payload FROM v WHERE commit_ts <= {} QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1"
NAMES = ", ".join(f"'{m}'" for m in (*METRICS, "not_built_in"))
ORDER = ", ".join(f"'{x}'" for x in STAGES)

QUERIES = {
    "backup_status": (lambda s, d: _backed_up(s, d).status(), f"SELECT * FROM (VALUES ('first', 'Terminated', CAST(NULL AS BIGINT)), ('second', 'Finished', {READ_TS})) AS t(backup, status, ckpt_ts)"),
    "backup_tables": (
        lambda s, d: _backed_up(s, d).tables("second"),
        f"{V}, x AS ({AS_OF.format(READ_TS)}) SELECT 'app.log' AS \"table\", 'value long' AS columns, count(*) AS n_rows, max(commit_ts) AS max_commit_ts FROM x WHERE status = 'Normal' UNION ALL SELECT 'app.empty', 'x string', 0, NULL",
    ),
    "backup_restore": (_restored, f"{V}, x AS ({AS_OF.format(READ_TS)}) SELECT key, commit_ts, payload AS value FROM x WHERE status = 'Normal'"),
    "standby_sync": (_synced, f"{V} SELECT *, 'whole,changes' AS sent FROM ({AS_OF.format(READ_TS)})"),
    "stats_kept": (_kept_stats, f"{B} SELECT key // 500 AS step, key, (SELECT count(*) FROM b) AS records FROM b WHERE key % 500 = 0"),
    "stats_random_pairing": (_sampled, f"{V} SELECT key % 30 AS tbl, key FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1) WHERE status = 'Normal'"),
    "recovery_remaining": (
        _broken_off,
        f"{V}, f AS (SELECT event_id % 700 AS txn, max(least((event_id % 700) * 13 % 6, (event_id // 700) % 6)) + 1 AS far FROM v WHERE event_id % 3 <> 0 GROUP BY 1),"
        f" t AS (SELECT txn, unnest(range(CASE WHEN far >= 3 THEN far + 1 ELSE 6 END, 7)) AS position FROM f WHERE far < 6) SELECT txn, position, ([{ORDER}])[position] AS stage FROM t",
    ),
    "replay_waves": (
        _waves,
        f"{V}, r AS (SELECT key % 4 AS ng_id, event_id AS txn, key, commit_ts, CASE WHEN k % 9 = 0 THEN 'schema' ELSE 'data' END AS class FROM v) SELECT ng_id, txn, key, class,"
        " CAST(coalesce(sum(CASE WHEN class <> 'data' THEN 1 ELSE 0 END) OVER (PARTITION BY ng_id ORDER BY commit_ts, class DESC, txn, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wave FROM r",
    ),
    "read_outside_backfill": (
        _backfilled,
        f"{B}, c AS (SELECT key, CASE WHEN key % 3 = 0 THEN 1 ELSE commit_ts END AS ts, CASE WHEN key % 3 = 0 THEN 'Unknown' ELSE 'Normal' END AS st, CASE WHEN key % 3 <> 0 THEN price END AS p FROM b),"
        " f AS (SELECT key, commit_ts - key % 2 AS fts, CASE WHEN key % 5 = 0 THEN 'Deleted' ELSE 'Normal' END AS fst, CASE WHEN key % 5 <> 0 THEN price - 1 END AS fp FROM b WHERE key % 4 <> 1), j AS (SELECT * FROM c LEFT JOIN f USING (key)),"
        " u AS (SELECT *, st = 'Unknown' AND fts IS NOT NULL AS fill FROM j) SELECT key, CASE WHEN fill THEN fts ELSE ts END AS commit_ts, CASE WHEN fill THEN fst ELSE st END AS status, CASE WHEN fill THEN fp ELSE p END AS payload,"
        " coalesce(fts, 0) AS ckpt_ts, 'base' AS target FROM u UNION ALL SELECT key, fts, fst, fp, fts, 'archive' FROM u WHERE st <> 'Unknown' AND ts > fts",
    ),
    "metric_built_in": (
        _observed,
        f"{V}, m AS (SELECT ([{NAMES}])[event_id % 25 + 1] AS name, commit_ts AS ts, payload AS value FROM v) SELECT name, CASE WHEN ends_with(name, '_total') THEN 'counter' WHEN ends_with(name, '_duration') THEN 'histogram' ELSE 'gauge' END AS kind,"
        " count(*) AS n, CAST(CASE WHEN ends_with(name, '_total') OR ends_with(name, '_duration') THEN sum(value) ELSE arg_max(value, ts) END AS BIGINT) AS value FROM m WHERE name <> 'not_built_in' GROUP BY name",
    ),
}
