"""Queries that change or order: transactions, locks, logs, command streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as cmd
from ..operators import locks, mvcc, txn, wal
from ..sources.fixtures import CKPT_TS, OLDEST_TS, READ_TS, base_orders, commands, ctes, lock_table, version_log, write_ops, write_set

BW, V, WO, LK, C = ctes("b", "ws"), ctes("v"), ctes("v", "wo"), ctes("lk"), ctes("v", "c")


DAY = 86_400_000_000


def _fold_sql(unique: str) -> str:
    def case(a: str, x: str) -> str:
        return f"""CASE WHEN {a} IN ('Illegal', 'DuplicateKey') THEN {a} WHEN {a} = 'Insert' AND {x} = 'Insert' THEN '{unique}' WHEN {a} = 'Insert' AND {x} = 'Update' THEN 'Insert' WHEN {a} = 'Insert' AND {x} = 'Delete' THEN 'Delete'
 WHEN {a} = 'Update' AND {x} IN ('Update', 'Delete') THEN {x} WHEN {a} = 'Delete' AND {x} = 'Insert' THEN 'Update' WHEN {a} = 'Delete' AND {x} = 'Delete' THEN 'Delete' ELSE 'Illegal' END"""

    return f"""{WO}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn, count(*) OVER (PARTITION BY key) AS n FROM wo WHERE {{where}}),
 f AS (SELECT key, rn, n, op, payload FROM o WHERE rn = 1 UNION ALL SELECT o.key, o.rn, o.n, {case('f.op', 'o.op')}, o.payload FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, op, payload, n AS n_ops FROM f WHERE rn = n"""


def _reads(s, d):
    v = version_log(s, d)
    return v.groupBy((F.col("event_id") % 100).alias("txn"), "key").agg(F.min("commit_ts").alias("version_ts"))


def _validate(s, d):
    v = version_log(s, d)
    current = mvcc.visible_as_of(v, READ_TS, True).select("key", "commit_ts")
    held = v.filter(f"commit_ts > {READ_TS} AND k < 3").select("key", (F.col("event_id") % 100).alias("holder")).distinct()
    return txn.validate(_reads(s, d).filter(f"version_ts > {CKPT_TS}"), current, held)


def _breaks(s, d):
    v = version_log(s, d)
    reads = v.select((F.col("event_id") % 20).alias("txn"), "key", F.col("commit_ts").alias("seq"), F.when(F.col("k") % 4 == 0, F.lit(0)).otherwise(F.col("commit_ts")).alias("version_ts"))
    return txn.repeatable_breaks(reads).select("txn", "key", "seq", "before_ts", "version_ts")


def _commit_times(s, d):
    v = version_log(s, d).withColumn("txn", F.col("event_id") % 100)
    bounds = v.groupBy("txn").agg(F.min("commit_ts").alias("bound"))
    writes = v.filter("object_type = 'purchase'").select("txn", "commit_ts", (F.col("commit_ts") + F.col("k")).alias("last_vali_ts"))
    return txn.commit_times(bounds, writes, v.filter("object_type = 'view'").select("txn", F.col("commit_ts").alias("version_ts")))


def _install(s, d):
    log = txn.install(base_orders(s, d), write_set(s, d), 1_800_000_000_000_000)
    return mvcc.visible_as_of(log, 1_900_000_000_000_000).select("key", "commit_ts", "price")


def _own(s, d):
    keys = s.range(1, 3000).select(F.col("id").alias("key")).unionByName(s.range(1_000_000_000, 1_000_001_000).select(F.col("id").alias("key")))
    return txn.read_own(base_orders(s, d), write_set(s, d), keys)


def _lock_rows(s, d):
    holds, waits = lock_table(s, d)
    kind = lambda n: F.when(F.col("tx") % 3 == n, "WriteLock").when(F.col("tx") % 3 == (n + 1) % 3, "WriteIntent").otherwise("ReadLock")
    return holds.withColumn("lock", kind(0)), waits.withColumn("lock", kind(1)).withColumn("protocol", F.when(F.col("entry") % 2 == 0, "OCC").otherwise("Locking"))


LOCKS_SQL = f"""{LK}, h AS (SELECT *, CASE tx % 3 WHEN 0 THEN 'WriteLock' WHEN 1 THEN 'WriteIntent' ELSE 'ReadLock' END AS lock FROM holds),
 w AS (SELECT *, CASE tx % 3 WHEN 1 THEN 'WriteLock' WHEN 2 THEN 'WriteIntent' ELSE 'ReadLock' END AS lock, CASE WHEN entry % 2 = 0 THEN 'OCC' ELSE 'Locking' END AS protocol FROM waits)"""
GRAPH_SQL = f"{LK}, e AS (SELECT DISTINCT w.tx AS waiter, h.tx AS holder FROM waits w JOIN holds h USING (entry) WHERE w.tx <> h.tx)"
REACH_SQL = f"{GRAPH_SQL}, r AS (SELECT waiter AS src, holder AS dst FROM e UNION SELECT r.src, e.holder FROM r JOIN e ON e.waiter = r.dst), cyc AS (SELECT a.src AS tx, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"


def _deduce(s, d):
    e = version_log(s, d).select("event_id", F.element_at(F.array(*map(F.lit, ["ReadSkIndex", "ReadForWrite", "Write", "Read"])), (F.col("k") % 4 + 1).cast("int")).alias("op"), F.element_at(F.array(*map(F.lit, ["ReadCommitted", "Snapshot", "RepeatableRead", "Serializable"])), (F.col("event_id") % 4 + 1).cast("int")).alias("iso"), F.when(F.col("key") % 2 == 0, "Locking").otherwise("OCC").alias("proto"), (F.col("key") % 3 == 0).alias("cov"))
    return e.select("op", "iso", "proto", "cov", locks.lock_type(F.col("op"), F.col("iso"), F.col("proto"), F.col("cov")).alias("lock")).distinct()


def _errors(s, d):
    return locks.first_error(version_log(s, d).select((F.col("event_id") % 200).alias("req"), F.col("event_id").alias("idx"), F.col("object_type").alias("error"), F.col("object_type").isin("click", "view", "signup", "purchase").alias("is_conflict")))


def _wal(s, d):
    return version_log(s, d).withColumn("ng_id", F.col("key") % 4).withColumn("txn", F.col("event_id")).withColumn("term", F.col("k") % 2)


def _ckpts(s, d):
    return _wal(s, d).filter("object_type = 'signup'").select("ng_id", (F.col("commit_ts") - F.lit(600_000_000_000) * F.col("ng_id")).alias("ckpt_ts"))


def _stages(s, d):
    names = ["Prepare", "Commit", "Clean"]
    o = F.col("k") % 3
    return _wal(s, d).select((F.col("event_id") % 500).alias("txn"), o.alias("stage_ord"), F.element_at(F.array(*map(F.lit, names)), (o + 1).cast("int")).alias("stage"), (F.lit(READ_TS) - F.col("event_id") % 500 * 60_000_000).alias("commit_ts"))


def _wal_apply(s, d):
    w = _wal(s, d)
    return wal.replay_apply(w.filter(f"commit_ts > {OLDEST_TS - 10 * DAY}"), mvcc.visible_as_of(w, OLDEST_TS - 9 * DAY, True).filter("key % 3 <> 0"), OLDEST_TS - 5 * DAY)


def _verdicts(s, d):
    asked = s.range(0, 2000).select(F.col("id").alias("txn"), (F.col("id") % 5).alias("ng_id"), (F.col("id") % 2).alias("term"))
    terms = s.range(0, 4).select(F.col("id").alias("ng_id"), F.lit(1).cast("long").alias("term"))
    return wal.recovery_verdict(asked, terms, _wal(s, d).filter("event_id % 3 = 0"))


def _progress(s, d):
    return version_log(s, d).select((F.col("key") % 4).alias("seq_grp"), F.col("event_id").alias("seq_id"), F.col("commit_ts").alias("consistent_ts"))


def _fanout(s, d):
    m = version_log(s, d).select(F.col("object_type").alias("channel"), F.col("event_id").alias("message"))
    subs = s.range(0, 12).select(F.element_at(F.array(*map(F.lit, ["click", "view", "error", "signup"])), (F.col("id") % 4 + 1).cast("int")).alias("channel"), F.col("id").alias("subscriber"))
    return cmd.fanout(m, F.broadcast(subs))


def _pop(s, d):
    v = version_log(s, d)
    return cmd.pop_match(v.filter("object_type = 'view'").select("key", F.col("commit_ts").alias("waiter")), v.filter("object_type = 'purchase'").select("key", F.col("commit_ts").alias("element")))


def _pop_expiring(s, d):
    v, hour = version_log(s, d), 3_600_000_000
    at = F.col("commit_ts")
    return cmd.pop_expiring(v.filter("object_type = 'view'").select("key", at.alias("waiter"), at.alias("at"), (at + 24 * hour).alias("deadline")), v.filter("object_type = 'purchase'").select("key", at.alias("element"), at.alias("at")), READ_TS)


APPLY_SQL = f"""{C}, o AS (SELECT key, max(new_version) AS f FROM c WHERE overwrite GROUP BY 1),
 k AS (SELECT c.* FROM c LEFT JOIN o USING (key) WHERE f IS NULL OR new_version >= f)"""

QUERIES = {
    "writeset_fold": (lambda s, d: txn.fold(write_ops(s, d)), _fold_sql("Insert").format(where="true")),
    "writeset_duplicate_key": (lambda s, d: txn.fold(write_ops(s, d).filter("op = 'Insert'"), True), _fold_sql("DuplicateKey").format(where="op = 'Insert'")),
    "scan_overlay_writeset": (lambda s, d: txn.overlay(base_orders(s, d), write_set(s, d)), f"{BW} SELECT coalesce(b.key, ws.key) AS key, coalesce(ws.price, b.price) AS price, CASE WHEN op IS NULL THEN 'base' ELSE 'own' END AS origin FROM b FULL JOIN ws ON b.key = ws.key WHERE op IS NULL OR op <> 'Delete'"),
    "read_your_writes": (
        _own,
        f"""{BW}, q AS (SELECT unnest(range(1, 3000)) AS key UNION ALL SELECT unnest(range(1000000000, 1000001000)))
 SELECT q.key, CASE WHEN op = 'Delete' THEN 'Deleted' WHEN op IS NOT NULL OR b.key IS NOT NULL THEN 'Normal' ELSE 'Deleted' END AS status, CASE WHEN op = 'Delete' THEN NULL ELSE coalesce(ws.price, b.price) END AS price,
 CASE WHEN op IS NOT NULL THEN 0 ELSE coalesce(commit_ts, 1) END AS version_ts FROM q LEFT JOIN ws ON q.key = ws.key LEFT JOIN b ON q.key = b.key""",
    ),
    "revert_writes": (lambda s, d: write_set(s, d).join(s.range(0, 5000, 35).select(F.col("id").alias("key")), "key", "left_anti"), f"{BW} SELECT key, op, price FROM ws WHERE key NOT IN (SELECT unnest(range(0, 5000, 35)))"),
    "writeset_size_guard": (lambda s, d: txn.size_guard(write_set(s, d).select((F.col("key") % 7).alias("txn"), (F.length("op") + 16).cast("long").alias("bytes")), 5000), f"{BW} SELECT key % 7 AS txn, CAST(sum(length(op) + 16) AS BIGINT) AS bytes, sum(length(op) + 16) > 5000 AS exceeded FROM ws GROUP BY 1"),
    "occ_validate": (
        _validate,
        f"""{V}, r AS (SELECT event_id % 100 AS txn, key, min(commit_ts) AS version_ts FROM v GROUP BY 1, 2 HAVING min(commit_ts) > {CKPT_TS}), cur AS (SELECT key, max(commit_ts) AS now_ts FROM v WHERE commit_ts <= {READ_TS} GROUP BY 1),
 l AS (SELECT key, min(event_id % 100) AS lo, max(event_id % 100) AS hi FROM v WHERE commit_ts > {READ_TS} AND k < 3 GROUP BY 1),
 j AS (SELECT txn, version_ts > 0 AND version_ts <> coalesce(now_ts, 1) AS stale, coalesce(lo <> txn OR hi <> txn, false) AS other FROM r LEFT JOIN cur USING (key) LEFT JOIN l USING (key)),
 a AS (SELECT txn, CAST(sum(CASE WHEN stale THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, CAST(sum(CASE WHEN NOT stale AND other THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM j GROUP BY 1)
 SELECT *, CASE WHEN mismatches > 0 THEN 'VERSION_MISMATCH' WHEN conflicts > 0 THEN 'CONFLICTED' ELSE 'OK' END AS outcome FROM a""",
    ),
    "repeatable_read_break": (_breaks, f"{V}, r AS (SELECT event_id % 20 AS txn, key, commit_ts AS seq, CASE WHEN k % 4 = 0 THEN 0 ELSE commit_ts END AS version_ts FROM v), p AS (SELECT *, lag(version_ts) OVER (PARTITION BY txn, key ORDER BY seq) AS before_ts FROM r) SELECT txn, key, seq, before_ts, version_ts FROM p WHERE before_ts <> 0 AND version_ts > before_ts"),
    "commit_ts_negotiate": (_commit_times, f"{V} SELECT event_id % 100 AS txn, greatest(min(commit_ts), max(CASE WHEN object_type = 'purchase' THEN commit_ts + k END) + 1, max(CASE WHEN object_type = 'view' THEN commit_ts END) + 1) AS commit_ts FROM v GROUP BY 1"),
    "post_write_apply": (_install, f"{BW}, l AS (SELECT key, commit_ts, 'Normal' AS status, price FROM b UNION ALL SELECT key, 1800000000000000, CASE WHEN op = 'Delete' THEN 'Deleted' ELSE 'Normal' END, price FROM ws) SELECT key, commit_ts, price FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1) WHERE status = 'Normal'"),
    "lock_type_deduce": (
        _deduce,
        f"""{V}, e AS (SELECT (['ReadSkIndex', 'ReadForWrite', 'Write', 'Read'])[k % 4 + 1] AS op, (['ReadCommitted', 'Snapshot', 'RepeatableRead', 'Serializable'])[event_id % 4 + 1] AS iso, CASE WHEN key % 2 = 0 THEN 'Locking' ELSE 'OCC' END AS proto, key % 3 = 0 AS cov FROM v)
 SELECT DISTINCT op, iso, proto, cov, CASE WHEN op = 'Write' THEN 'WriteLock' WHEN op = 'ReadForWrite' THEN 'WriteIntent' WHEN op = 'ReadSkIndex' THEN CASE WHEN iso = 'Snapshot' OR (iso = 'ReadCommitted' AND cov) THEN 'NoLock' ELSE 'ReadLock' END
 WHEN iso IN ('Snapshot', 'ReadCommitted') THEN 'NoLock' WHEN proto = 'Locking' THEN 'ReadLock' ELSE 'ReadIntent' END AS lock FROM e""",
    ),
    "lock_conflicts": (
        lambda s, d: locks.conflicts(s, *_lock_rows(s, d)),
        f"""{LOCKS_SQL} SELECT w.tx, entry, w.lock, h.tx AS holder, h.lock AS held, CASE WHEN protocol = 'OCC' AND w.lock <> 'ReadLock' THEN 'Failed' ELSE 'Blocked' END AS outcome FROM w JOIN h USING (entry)
 WHERE w.tx <> h.tx AND ((h.lock = 'WriteLock') OR (h.lock = 'WriteIntent' AND w.lock IN ('WriteLock', 'WriteIntent')) OR (h.lock = 'ReadLock' AND w.lock = 'WriteLock'))""",
    ),
    "wait_for_graph": (lambda s, d: locks.wait_graph(*lock_table(s, d)), f"{GRAPH_SQL} SELECT * FROM e"),
    "deadlock_cycles": (lambda s, d: locks.on_cycles(locks.wait_graph(*lock_table(s, d))), f"{REACH_SQL} SELECT tx, component FROM cyc"),
    "deadlock_victims": (
        lambda s, d: locks.victims(locks.on_cycles(locks.wait_graph(*lock_table(s, d))), lock_table(s, d)[0]),
        f"{REACH_SQL}, n AS (SELECT component, cyc.tx, (SELECT count(*) FROM holds h WHERE h.tx = cyc.tx) AS n FROM cyc) SELECT component, tx AS victim, n AS n_locks FROM n QUALIFY row_number() OVER (PARTITION BY component ORDER BY n, tx) = 1",
    ),
    "error_precedence": (_errors, f"{V} SELECT event_id % 200 AS req, object_type AS error FROM v QUALIFY row_number() OVER (PARTITION BY event_id % 200 ORDER BY CASE WHEN object_type = 'error' THEN 0 ELSE 1 END, event_id) = 1"),
    "wal_group_of_txn": (lambda s, d: _wal(s, d).select("txn", wal.log_group(F.col("txn"), 3).alias("log_group")), f"{V} SELECT event_id AS txn, event_id % 3 AS log_group FROM v"),
    "wal_group_by_ng": (lambda s, d: wal.by_node_group(_wal(s, d).withColumn("txn", F.col("txn") % 100)), f"{V} SELECT event_id % 100 AS txn, key % 4 AS ng_id, count(*) AS n_records, count(DISTINCT k % 2) AS n_terms, count(DISTINCT k % 2) > 1 AS aborts FROM v GROUP BY 1, 2"),
    "wal_replay_list": (lambda s, d: wal.replay(_wal(s, d), 2, READ_TS).select("commit_ts", "txn", "key", "payload"), f"{V} SELECT commit_ts, event_id AS txn, key, payload FROM v WHERE key % 4 = 2 AND commit_ts > {READ_TS}"),
    "wal_replay_apply": (
        _wal_apply,
        f"""{V}, w AS (SELECT key, commit_ts, payload, status FROM v WHERE commit_ts > {OLDEST_TS - 10 * DAY} AND commit_ts >= {OLDEST_TS - 5 * DAY}), bs AS (SELECT key, commit_ts, payload, status FROM v WHERE commit_ts <= {OLDEST_TS - 9 * DAY} AND key % 3 <> 0)
 SELECT * FROM (SELECT * FROM w UNION SELECT * FROM bs) QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1""",
    ),
    "min_ckpt_ts": (lambda s, d: wal.min_checkpoint(_ckpts(s, d)), f"{V} SELECT min(m) AS min_ckpt_ts FROM (SELECT max(commit_ts - 600000000000 * (key % 4)) AS m FROM v WHERE object_type = 'signup' GROUP BY key % 4)"),
    "wal_truncate": (lambda s, d: wal.truncate(_wal(s, d), _ckpts(s, d)).select("txn", "ng_id", "commit_ts"), f"{V} SELECT event_id AS txn, key % 4 AS ng_id, commit_ts FROM v WHERE commit_ts > (SELECT min(m) FROM (SELECT max(commit_ts - 600000000000 * (key % 4)) AS m FROM v WHERE object_type = 'signup' GROUP BY key % 4))"),
    "stage_latest": (lambda s, d: wal.latest_stage(_stages(s, d)), f"{V} SELECT event_id % 500 AS txn, max(k % 3) AS stage_ord, (['Prepare', 'Commit', 'Clean'])[max(k % 3) + 1] AS stage, {READ_TS} - (event_id % 500) * 60000000 AS commit_ts FROM v GROUP BY event_id % 500"),
    "multistage_cleanup": (lambda s, d: wal.cleaned_stages(_stages(s, d), READ_TS - 3_600_000_000), f"{V}, l AS (SELECT event_id % 500 AS txn, max(k % 3) AS stage_ord, {READ_TS} - (event_id % 500) * 60000000 AS commit_ts FROM v GROUP BY event_id % 500) SELECT txn, stage_ord, 'Clean' AS stage, commit_ts FROM l WHERE stage_ord = 2 AND {READ_TS} - 3600000000 > commit_ts + 3600000000"),
    "term_registry": (lambda s, d: _wal(s, d).groupBy("ng_id").agg(F.max("k").alias("term")), f"{V} SELECT key % 4 AS ng_id, max(k) AS term FROM v GROUP BY 1"),
    "migration_finished": (lambda s, d: _stages(s, d).groupBy((F.col("txn") % 10).alias("cluster")).agg(F.bool_and(F.col("stage") == "Clean").alias("finished")), f"{V} SELECT event_id % 500 % 10 AS cluster, bool_and(k % 3 = 2) AS finished FROM v GROUP BY 1"),
    "recover_tx_verdict": (_verdicts, f"{V}, a AS (SELECT unnest(range(0, 2000)) AS txn) SELECT txn, CASE WHEN txn % 5 = 4 THEN 'RecoverError' WHEN txn % 2 <> 1 THEN 'NotCommitted' WHEN txn IN (SELECT event_id FROM v WHERE event_id % 3 = 0) THEN 'Committed' ELSE 'NotCommitted' END AS verdict FROM a"),
    "command_fold_sum": (lambda s, d: cmd.fold_sum(commands(s, d)), f"{APPLY_SQL} SELECT key, CAST(sum(payload) AS BIGINT) AS value, max(new_version) AS version FROM k GROUP BY 1"),
    "command_overwrite_prune": (lambda s, d: cmd.since_overwrite(commands(s, d)).select("key", "new_version", "payload"), f"{APPLY_SQL} SELECT key, new_version, payload FROM k"),
    "ordered_apply_gap": (
        lambda s, d: cmd.ordered_apply(commands(s, d)),
        f"""{APPLY_SQL}, g AS (SELECT *, CASE WHEN overwrite OR obj_version = coalesce(lag(new_version) OVER (PARTITION BY key ORDER BY new_version), 1) THEN 0 ELSE 1 END AS gap FROM k),
 r AS (SELECT *, sum(gap) OVER (PARTITION BY key ORDER BY new_version) = 0 AS ok FROM g)
 SELECT key, coalesce(max(CASE WHEN ok THEN new_version END), 1) AS version, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS applied, CAST(coalesce(sum(CASE WHEN ok THEN payload END), 0) AS BIGINT) AS value, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS waiting FROM r GROUP BY 1""",
    ),
    "standby_watermark": (lambda s, d: cmd.watermark(_progress(s, d)), f"{V} SELECT min(t) AS watermark FROM (SELECT max(commit_ts) AS t FROM v GROUP BY key % 4)"),
    "standby_progress": (lambda s, d: cmd.progress(_progress(s, d)), f"{V} SELECT key % 4 AS seq_grp, event_id AS seq_id, max(commit_ts) OVER (PARTITION BY key % 4 ORDER BY event_id) AS consistent_ts FROM v"),
    "standby_lag": (lambda s, d: cmd.lag(_progress(s, d), _progress(s, d).filter("seq_id % 97 = 0")), f"{V} SELECT key % 4 AS seq_grp, max(event_id) AS sent, coalesce(max(CASE WHEN event_id % 97 = 0 THEN event_id END), 0) AS acked, max(event_id) - coalesce(max(CASE WHEN event_id % 97 = 0 THEN event_id END), 0) AS lag FROM v GROUP BY 1"),
    "pubsub_fanout": (_fanout, f"{V}, s AS (SELECT i AS subscriber, (['click', 'view', 'error', 'signup'])[i % 4 + 1] AS channel FROM (SELECT unnest(range(0, 12)) AS i)) SELECT channel, event_id AS message, subscriber FROM v JOIN s ON v.object_type = s.channel"),
    "blocking_pop_expiring": (_pop_expiring, None),  # a queue; held against a plain one in tests
    "blocking_pop_match": (_pop, f"{V}, w AS (SELECT key, commit_ts AS waiter, row_number() OVER (PARTITION BY key ORDER BY commit_ts) AS n FROM v WHERE object_type = 'view'), e AS (SELECT key, commit_ts AS element, row_number() OVER (PARTITION BY key ORDER BY commit_ts) AS n FROM v WHERE object_type = 'purchase') SELECT key, waiter, element FROM w JOIN e USING (key, n)"),
}
