"""Queries that write: the store, transactions, object commands, lock queues, standby and log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, engine, locks, objects, partition, stats, wal
from ..operators import commands as cmd
from ..operators.scan import ScanSpec
from ..operators.session import Transaction
from ..sources.fixtures import CKPT_TS, NOW_MS, READ_TS, base_orders, ctes, table, version_log, write_set
from ..sources.shared import shared_dir, staged
from ..sources.store import Store

B, BW, V = ctes("b"), ctes("b", "ws"), ctes("v")
WRITE_TS = 1_800_000_000_000_000


def _orders(s, d):
    return base_orders(s, d).select("key", "commit_ts", F.lit("Normal").alias("status"), F.lit(None).cast("long").alias("ttl_ms"), F.col("price").alias("value"))


def _store(s, d):
    store = Store(s, shared_dir(s) + "/store")
    store.create_table("shop.orders", "value long")
    store.put_all("shop.orders", _orders(s, d))
    return store


def _ws(s, d):
    return write_set(s, d).withColumnRenamed("price", "value")


def _live(store):
    return store.rows("shop.orders").filter("status = 'Normal'").select("key", "commit_ts", "value")


def _write_read(s, d):
    store = _store(s, d)
    store.batch_write("shop.orders", _ws(s, d).withColumn("ttl_ms", F.lit(None).cast("long")), WRITE_TS)
    return _live(store)


def _delete_range(s, d):
    store = _store(s, d)
    store.delete_range("shop.orders", 1000, 5000)
    store.put_all("shop.orders", _orders(s, d).filter("key BETWEEN 2000 AND 2100").withColumn("value", F.col("value") + 1))
    return _live(store)


def _out_of_range(s, d):
    store = _store(s, d)
    store.delete_out_of_range("shop.orders", 1000, 5000)
    store.compact("shop.orders")
    return _live(store)


def _compact(s, d):
    store = Store(s, shared_dir(s) + "/store")
    store.create_table("log", "value long")
    store.put_all("log", version_log(s, d).select("key", "commit_ts", "status", "ttl_ms", F.col("payload").alias("value")))
    store.compact("log", NOW_MS)
    return store.versions("log").select("key", "commit_ts", "value", "ttl_ms")


def _pages(s, d):
    out = None
    for n, page in enumerate(_store(s, d).pages("shop.orders", ScanSpec(100, False, 400, True), 70)):
        page = page.select("key", "value", F.lit(n).cast("long").alias("page"))
        out = page if out is None else out.unionByName(page)
    return out


def _tables(s, d):
    store = _store(s, d)
    store.create_table("shop.by_priority", "sk string", "secondary")
    store.create_table("gone", "x long")
    store.drop_table("gone")
    store.truncate("shop.by_priority")
    return store.tables()


def _begun(s, d):
    store = _store(s, d)
    tx = Transaction(store, "shop.orders")
    keys = s.range(0, 3000).select(F.col("id").alias("key"))
    tx.read(keys, for_write=True)
    tx.upsert(_ws(s, d))
    tx.upsert(s.range(0, 300, 10).select((F.col("id") + 2_000_000_000).alias("key"), F.lit("Insert").alias("op"), F.lit(5).cast("long").alias("value")))
    tx.revert(s.range(0, 100).select((F.col("id") + 2_000_000_000).alias("key")))
    return store, tx


def _commit(s, d):
    store, tx = _begun(s, d)
    outcome, at = tx.commit(WRITE_TS - 1)
    return _live(store).withColumn("outcome", F.lit(outcome)).withColumn("at_ts", F.lit(at).cast("long"))


def _abort(s, d):
    store, tx = _begun(s, d)
    tx.abort()
    return _live(store).withColumn("outcome", F.lit(tx.state))


def _conflict(s, d):
    store, tx = _begun(s, d)
    other = Transaction(store, "shop.orders")
    other.upsert(s.range(10, 11).select(F.col("id").alias("key"), F.lit("Update").alias("op"), F.lit(1).cast("long").alias("value")))
    outcomes = [other.commit(WRITE_TS)[0], tx.commit(WRITE_TS)[0]]
    return s.createDataFrame([("first", outcomes[0]), ("second", outcomes[1])], "tx string, outcome string")


def _own_scan(s, d):
    _, tx = _begun(s, d)
    return tx.scan(ScanSpec(500, True, 1500, False))


#: An object for every other key, and a command for each event.
def _objects(s, d):
    return s.range(0, 100_000, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"), F.when(F.col("id") % 4 == 0, F.lit(NOW_MS)).cast("long").alias("ttl_ms"))


def _cmds(s, d):
    names = F.array(*map(F.lit, ["get", "set", "incr", "raise", "delete", "expire", "setnx", "pop"]))
    return version_log(s, d).select("key", F.col("commit_ts").alias("seq"), F.element_at(names, (F.col("k") % 8 + 1).cast("int")).alias("cmd"), (F.col("payload") % 1000).alias("arg"), F.floor(F.col("commit_ts") / 1000).cast("long").alias("now_ms"))


CMD_SQL = f"""{V}, c AS (SELECT key, commit_ts AS seq, (['get', 'set', 'incr', 'raise', 'delete', 'expire', 'setnx', 'pop'])[k % 8 + 1] AS cmd, payload % 1000 AS arg, commit_ts // 1000 AS now_ms, row_number() OVER (PARTITION BY key ORDER BY commit_ts) AS rn FROM v),
 o AS (SELECT key, CASE WHEN key % 2 = 0 AND key < 100000 THEN key * 10 END AS value, CASE WHEN key % 4 = 0 AND key < 100000 THEN {NOW_MS} END AS ttl FROM (SELECT DISTINCT key FROM v)),
 f AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, '' AS cmd, '' AS status, false AS ran, CAST(NULL AS BIGINT) AS result, CAST(value AS BIGINT) AS value, CAST(ttl AS BIGINT) AS ttl FROM o
 UNION ALL SELECT x.key, x.rn, x.seq, x.cmd,
  CASE WHEN runs THEN CASE WHEN x.cmd IN ('delete', 'pop') THEN 'Deleted' ELSE 'Normal' END WHEN alive THEN 'Normal' ELSE 'Deleted' END, runs,
  CASE WHEN runs THEN CASE x.cmd WHEN 'incr' THEN coalesce(v0, 0) + arg WHEN 'raise' THEN greatest(v0, arg) WHEN 'set' THEN arg WHEN 'setnx' THEN arg ELSE v0 END END,
  CASE WHEN NOT runs THEN CASE WHEN gone AND x.cmd IN ('raise', 'delete', 'pop', 'expire') THEN NULL ELSE old END WHEN x.cmd IN ('delete', 'pop') THEN NULL WHEN x.cmd = 'incr' THEN coalesce(v0, 0) + arg WHEN x.cmd = 'raise' THEN greatest(v0, arg) WHEN x.cmd IN ('set', 'setnx') THEN arg ELSE v0 END,
  CASE WHEN NOT runs THEN CASE WHEN gone AND x.cmd IN ('raise', 'delete', 'pop', 'expire') THEN NULL ELSE ottl END WHEN x.cmd = 'get' THEN ottl WHEN x.cmd = 'expire' THEN now_ms + arg WHEN x.cmd IN ('set', 'setnx', 'delete', 'pop') OR gone THEN NULL ELSE ottl END
 FROM (SELECT c.*, f.value AS old, f.ttl AS ottl, f.value IS NOT NULL AND NOT coalesce(f.ttl < c.now_ms, false) AS alive, f.value IS NOT NULL AND coalesce(f.ttl < c.now_ms, false) AS gone,
  CASE WHEN NOT coalesce(f.ttl < c.now_ms, false) THEN f.value END AS v0,
  CASE WHEN c.cmd IN ('get', 'raise', 'delete', 'pop', 'expire') THEN f.value IS NOT NULL AND NOT coalesce(f.ttl < c.now_ms, false) WHEN c.cmd = 'setnx' THEN f.value IS NULL OR coalesce(f.ttl < c.now_ms, false) ELSE true END AS runs
  FROM f JOIN c ON c.key = f.key AND c.rn = f.rn + 1) x)"""


def _multi(s, d):
    """Moves: in a first step requests take what sources hold, in a second they add it to their targets."""
    asked = s.range(0, 200).select((F.col("id") * 2).alias("src"), (F.col("id") * 2 + 1).alias("dst"))
    take = lambda _: asked.select(F.col("src").alias("key"), F.lit(1).cast("long").alias("seq"), F.lit("pop").alias("cmd"), F.lit(0).cast("long").alias("arg"), F.lit(NOW_MS).cast("long").alias("now_ms"))

    def give(taken):
        got = staged(taken).filter("ran").join(asked, F.col("key") == F.col("src"))
        return got.select(F.col("dst").alias("key"), F.lit(2).cast("long").alias("seq"), F.lit("incr").alias("cmd"), F.col("result").alias("arg"), F.lit(NOW_MS).cast("long").alias("now_ms"))

    _, left = objects.execute_steps(_objects(s, d).filter("key % 3 <> 0"), [take, give])
    return left.select("key", "value")


def _requests(s, d):
    """A request for a lock by each line item's supplier on its part, in the order of orders; every fifth one releases."""
    kind = F.when(F.col("l_orderkey") % 5 == 0, "Release").when(F.col("l_linenumber") % 3 == 0, "WriteLock").when(F.col("l_linenumber") % 3 == 1, "ReadLock").otherwise("WriteIntent")
    li = table(s, d, "lineitem")
    return li.select(F.col("l_partkey").alias("entry"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_suppkey") % 7).alias("tx"), kind.alias("lock"), F.when(F.col("l_partkey") % 2 == 0, "OCC").otherwise("Locking").alias("protocol"))


def _messages(s, d):
    return cmd.capture(version_log(s, d)).withColumn("epoch", F.col("k") % 3)


def _subs(s):
    return s.range(0, 4).select(F.col("id").alias("seq_grp"), (F.col("id") % 3).alias("epoch"))


MSG_SQL = f"{V}, m AS (SELECT *, key % 4 AS seq_grp, k % 3 AS epoch, row_number() OVER (PARTITION BY key % 4 ORDER BY commit_ts, key) AS seq_id FROM v)"


def _standby(s, d):
    now = version_log(s, d).filter(f"commit_ts <= {CKPT_TS}").groupBy("key").agg(F.max(F.struct("commit_ts", "payload", "status")).alias("v")).select("key", "v.*")
    return cmd.standby_apply(_messages(s, d), _subs(s), now)


def _buffer(s, d):
    v = version_log(s, d)
    return v.select("key", F.col("commit_ts").alias("new_version"), (F.col("object_type") == "signup").alias("overwrite"), F.when(F.col("k") % 9 == 0, F.col("ttl_ms")).alias("valid_until"), "payload")


def _log(s, d):
    v = version_log(s, d)
    rows = v.select((F.col("key") % 4).alias("ng_id"), F.col("event_id").alias("txn"), "key", "commit_ts", "payload", F.element_at(F.array(*map(F.lit, ["data", "data", "schema", "split"])), (F.col("k") % 4 + 1).cast("int")).alias("class"))
    path = shared_dir(s) + "/log"
    for half in (0, 1):
        wal.append(rows.filter(F.col("txn") % 2 == half), path)
    wal.append(rows.filter("txn % 10 = 0"), path)  # written twice, after a retry
    return wal.replay_order(s.read.parquet(path), 2, READ_TS).select("position", "txn", "key", "class")


def _stages(s, d):
    o = F.col("k") % 3
    return version_log(s, d).filter("k % 5 <> 0").select((F.col("event_id") % 700).alias("txn"), o.alias("stage_ord"), F.element_at(F.array(*map(F.lit, ["Prepare", "Commit", "Clean"])), (o + 1).cast("int")).alias("stage"), F.col("commit_ts"))


def _status(s, d):
    v = version_log(s, d)
    asked = s.range(0, 3000).select(F.col("id").alias("txn"), F.lit(READ_TS).alias("at_ts"))
    return wal.tx_status(asked, v.filter("event_id % 3 = 0").select(F.col("event_id").alias("txn"), "commit_ts"), v.filter("event_id % 3 = 1").select(F.col("event_id").alias("txn"), F.col("commit_ts").alias("bound")))


def _slice_update(s, d):
    b = base_orders(s, d).groupBy(F.expr("key DIV 50").alias("slice_id")).agg(F.sum(F.length("priority") + 24).cast("long").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return partition.slice_update(b.select("slice_id", "bytes", F.when(F.col("slice_id") % 4 != 0, F.col("bytes") * (F.col("slice_id") % 20)).alias("after_bytes"), (F.col("slice_id") % 3 != 0).alias("exported"), "rows"))


def _split_flush(s, d):
    b = base_orders(s, d).select(F.expr("key DIV 2000").alias("range_id"), "key")
    cuts = b.groupBy("range_id").agg(F.min("key").alias("lo")).select("range_id", F.explode(F.array(F.col("lo") + 500, F.col("lo") + 1500)).alias("start_key"))
    return partition.split_flush(staged(b), cuts.filter("range_id % 2 = 0"))


def _cached(s, d):
    return version_log(s, d).select("key", "commit_ts", "status", (F.col("commit_ts") <= CKPT_TS).alias("flushed"))


def _kick(s, d):
    c = _cached(s, d)
    kinds = {"range": partition.kick_out(c, "range", 10, 90), "bucket": partition.kick_out(c, "bucket", bucket=17), "truncate": partition.kick_out(c, "truncate"), "deleted": partition.kick_out(c, "deleted", upto_ts=READ_TS)}
    out = None
    for name, df in kinds.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("clean", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _metadata(s, d):
    starts = base_orders(s, d).filter("key % 500 = 0").select((F.col("key") / 500).cast("long").alias("range_id"), F.col("key").alias("start_key"), F.lit(1).cast("long").alias("version"))
    return partition.range_metadata(starts)


def _in_bucket(s, d):
    r = s.range(0, 2000).select(F.col("id").alias("range_id"))
    sl = base_orders(s, d).select((F.expr("key DIV 50") % 2000).alias("range_id"), F.expr("key DIV 50").alias("slice_id")).distinct()
    n = partition.ranges_in_bucket(r, sl)
    return n.agg(F.sum("n_ranges").alias("n_ranges"), F.sum("n_slices").alias("n_slices"))


def _owners(s):
    return s.createDataFrame([(0, 2000, 1), (2000, 9000, 2), (9000, None, 1)], "start long, stop long, owner long")


def _catalog(s, d):
    return version_log(s, d).select((F.col("key") % 30).alias("tbl"), F.col("commit_ts").alias("version"), F.when(F.col("object_type").isin("error", "view"), "dirty").otherwise("committed").alias("status"), F.col("object_type").alias("ddl"))


def _fallback(s, d):
    n = base_orders(s, d).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return n.select("priority", stats.fallback(F.col("n"), F.col("priority").startswith("1"), F.col("n") / 2).alias("estimate"))


def _spans(s, d):
    return version_log(s, d).select(F.col("object_type").alias("name"), F.col("commit_ts").alias("started"), F.when(F.col("k") % 6 != 0, F.col("commit_ts") + F.col("payload")).alias("ended"))


def _indexed(s, d):
    store = _store(s, d)
    engine.add_index(store, "shop.orders", "shop.by_price", F.expr("value DIV 10000000"))
    return store


def _index_scan(s, d):
    return engine.index_scan(_indexed(s, d), "shop.by_price", ScanSpec(1, True, 3, False))


def _index_ddl(s, d):
    store = _indexed(s, d)
    engine.add_index(store, "shop.orders", "shop.by_hand", F.col("value"), unique=True)
    return engine.ddl_log(store).groupBy("index").agg(F.max_by("stage", "seq").alias("stage"), F.count(F.lit(1)).alias("n_stages"))


def _engine(s, d):
    store = Store(s, shared_dir(s) + "/engine")
    engine.register_engine(store, engine.Engine("sql", {"sql.users": "name string", "sql.orders": "value long"}))
    engine.register_engine(store, engine.Engine("kv", {"kv.objects": "value long"}))
    engine.register_engine(store, engine.Engine("sql", {"sql.users": "name string", "sql.orders": "value long"}))  # again, after a restart
    return store.tables().select("database", "table", "columns")


TX_SQL = f"""{BW}, w AS (SELECT key, op, price FROM ws UNION ALL SELECT 2000000000 + i, 'Insert', 5 FROM (SELECT unnest(range(100, 300, 10)) AS i))"""
#: Murmur3 of the 4 bytes of x, seed 9001, in 64-bit arithmetic modulo 2**32.
MURMUR_SQL = """WITH a AS (SELECT i AS range_id, (CAST(i AS HUGEINT) * 3432918353) % 4294967296 AS k FROM (SELECT unnest(range(0, 5000)) AS i)),
 b AS (SELECT range_id, ((((k * 32768) % 4294967296) + k // 131072) * 461845907) % 4294967296 AS k FROM a),
 c AS (SELECT range_id, xor(CAST(9001 AS BIGINT), CAST(k AS BIGINT)) AS h FROM b),
 d AS (SELECT range_id, xor(CAST((((h * 8192) % 4294967296 + h // 524288) * 5 + 3864292196) % 4294967296 AS BIGINT), CAST(4 AS BIGINT)) AS h FROM c),
 e AS (SELECT range_id, (CAST(xor(h, h // 65536) AS HUGEINT) * 2246822507) % 4294967296 AS h FROM d),
 f AS (SELECT range_id, (CAST(xor(CAST(h AS BIGINT), CAST(h // 8192 AS BIGINT)) AS HUGEINT) * 3266489909) % 4294967296 AS h FROM e)
 SELECT range_id, xor(CAST(h AS BIGINT), CAST(h // 65536 AS BIGINT)) % 1024 AS bucket FROM f"""

QUERIES = {
    "index_scan": (_index_scan, f"{B} SELECT price // 10000000 AS sk, key, price AS value, false AS stale FROM b WHERE price // 10000000 >= 1 AND price // 10000000 < 3"),
    "index_ddl": (_index_ddl, f"{B}, d AS (SELECT price FROM b GROUP BY price HAVING count(*) > 1) SELECT 'shop.by_price' AS index, 'Clean' AS stage, 3 AS n_stages UNION ALL SELECT 'shop.by_hand', CASE WHEN EXISTS (SELECT * FROM d) THEN 'Abort' ELSE 'Clean' END, CASE WHEN EXISTS (SELECT * FROM d) THEN 2 ELSE 3 END"),
    "engine_tables": (_engine, "SELECT * FROM (VALUES ('sql', 'sql.users', 'name string'), ('sql', 'sql.orders', 'value long'), ('kv', 'kv.objects', 'value long')) AS t(database, \"table\", columns)"),
    "store_write_read": (_write_read, f"{BW} SELECT coalesce(ws.key, b.key) AS key, CASE WHEN op IS NULL THEN commit_ts ELSE {WRITE_TS} END AS commit_ts, CASE WHEN op IS NULL THEN b.price ELSE ws.price END AS value FROM b FULL JOIN ws ON b.key = ws.key WHERE op IS NULL OR op <> 'Delete'"),
    "store_delete_range": (_delete_range, f"{B} SELECT key, commit_ts, CASE WHEN key BETWEEN 2000 AND 2100 THEN price + 1 ELSE price END AS value FROM b WHERE NOT (key >= 1000 AND key < 5000) OR key BETWEEN 2000 AND 2100"),
    "store_delete_out_of_range": (_out_of_range, f"{B} SELECT key, commit_ts, price AS value FROM b WHERE key >= 1000 AND key < 5000"),
    "ttl_compaction": (_compact, f"{V} SELECT key, commit_ts, payload AS value, ttl_ms FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1) WHERE status = 'Normal' AND (ttl_ms IS NULL OR ttl_ms >= {NOW_MS})"),
    "store_paged_scan": (_pages, f"{B} SELECT key, price AS value, (row_number() OVER (ORDER BY key) - 1) // 70 AS page FROM b WHERE key > 100 AND key <= 400"),
    "store_tables": (_tables, "SELECT * FROM (VALUES ('shop', 'shop.orders', 'primary', 'value long'), ('shop', 'shop.by_priority', 'secondary', 'sk string')) AS t(database, \"table\", kind, columns)"),
    "txn_commit": (_commit, f"{TX_SQL} SELECT coalesce(w.key, b.key) AS key, CASE WHEN op IS NULL THEN commit_ts ELSE {WRITE_TS} END AS commit_ts, CASE WHEN op IS NULL THEN b.price ELSE w.price END AS value, 'OK' AS outcome, {WRITE_TS} AS at_ts FROM b FULL JOIN w ON b.key = w.key WHERE op IS NULL OR op <> 'Delete'"),
    "txn_abort": (_abort, f"{B} SELECT key, commit_ts, price AS value, 'aborted' AS outcome FROM b"),
    "txn_conflict": (_conflict, "SELECT * FROM (VALUES ('first', 'OK'), ('second', 'VERSION_MISMATCH')) AS t(tx, outcome)"),
    "txn_scan_own": (_own_scan, f"{BW} SELECT coalesce(b.key, ws.key) AS key, CASE WHEN op = 'Delete' THEN NULL ELSE coalesce(ws.price, b.price) END AS value, CASE WHEN op IS NULL THEN 'base' ELSE 'own' END AS origin, CASE WHEN op = 'Delete' THEN 'Deleted' ELSE 'Normal' END AS status FROM b FULL JOIN ws ON b.key = ws.key WHERE coalesce(b.key, ws.key) >= 500 AND coalesce(b.key, ws.key) < 1500"),
    "command_execute": (lambda s, d: objects.execute(_objects(s, d), _cmds(s, d)), f"{CMD_SQL} SELECT key, seq, cmd, status, ran, result, value, ttl AS ttl_ms FROM f WHERE rn > 0"),
    "objects_after": (lambda s, d: objects.objects_after(_objects(s, d), objects.execute(_objects(s, d), _cmds(s, d))), f"{CMD_SQL}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1) SELECT key, value, ttl AS ttl_ms FROM l WHERE value IS NOT NULL UNION ALL SELECT i, i * 10, CASE WHEN i % 4 = 0 THEN {NOW_MS} END FROM (SELECT unnest(range(0, 100000, 2)) AS i) WHERE i NOT IN (SELECT key FROM l)"),
    "multi_object_command": (_multi, "WITH o AS (SELECT i AS key, i * 10 AS value FROM (SELECT unnest(range(0, 100000, 2)) AS i) WHERE i % 3 <> 0) SELECT key, value FROM o WHERE key >= 400 UNION ALL SELECT key + 1, value FROM o WHERE key < 400"),
    "lock_queue_grant": (lambda s, d: locks.queue_grants(_requests(s, d)), None),  # a queue; held against a plain one in tests
    "standby_capture": (lambda s, d: _messages(s, d).select("seq_grp", "seq_id", "key", "commit_ts"), f"{MSG_SQL} SELECT seq_grp, seq_id, key, commit_ts FROM m"),
    "standby_apply": (_standby, f"{MSG_SQL}, a AS (SELECT key, commit_ts, payload, status FROM m WHERE epoch >= seq_grp % 3 UNION SELECT key, commit_ts, payload, status FROM v WHERE commit_ts <= {CKPT_TS}) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1"),
    "standby_late": (lambda s, d: cmd.late(_messages(s, d), _subs(s)).select("seq_grp", "seq_id", "epoch"), f"{MSG_SQL} SELECT seq_grp, seq_id, epoch FROM m WHERE epoch < seq_grp % 3"),
    "standby_resend": (lambda s, d: cmd.resend(_messages(s, d), _messages(s, d).filter("seq_id % 101 = 0"), 50), f"{MSG_SQL}, a AS (SELECT seq_grp, max(seq_id) AS done FROM m WHERE seq_id % 101 = 0 GROUP BY 1) SELECT seq_grp, min(seq_id) AS from_seq, max(seq_id) AS to_seq, count(*) AS n, count(*) > 50 AS out_of_sync FROM m LEFT JOIN a USING (seq_grp) WHERE done IS NULL OR seq_id > done GROUP BY 1"),
    "command_buffer_expiry": (lambda s, d: cmd.unexpired(_buffer(s, d), NOW_MS).select("key", "new_version", "payload"), f"{V}, u AS (SELECT key, commit_ts AS new_version, payload, max(CASE WHEN object_type = 'signup' OR (k % 9 = 0 AND ttl_ms < {NOW_MS}) THEN commit_ts END) OVER (PARTITION BY key) AS f FROM v) SELECT key, new_version, payload FROM u WHERE f IS NULL OR new_version >= f"),
    "wal_replay_order": (_log, f"{V}, l AS (SELECT event_id AS txn, key, commit_ts, (['data', 'data', 'schema', 'split'])[k % 4 + 1] AS class FROM v WHERE key % 4 = 2 AND commit_ts > {READ_TS}) SELECT row_number() OVER (ORDER BY CASE class WHEN 'schema' THEN 1 WHEN 'split' THEN 2 ELSE 4 END, commit_ts, txn, key) - 1 AS position, txn, key, class FROM l"),
    "multistage_verdict": (lambda s, d: wal.multistage_verdict(s.range(0, 800).select(F.col("id").alias("txn")), _stages(s, d)), f"{V}, t AS (SELECT event_id % 700 AS txn, max(k % 3) AS o FROM v WHERE k % 5 <> 0 GROUP BY 1) SELECT q.txn, CASE WHEN o IS NULL THEN 'Unknown' WHEN o = 0 THEN 'RollBack' WHEN o = 1 THEN 'CarryOn' ELSE 'Done' END AS verdict FROM (SELECT unnest(range(0, 800)) AS txn) q LEFT JOIN t USING (txn)"),
    "tx_status": (_status, f"{V}, q AS (SELECT unnest(range(0, 3000)) AS txn) SELECT txn, CASE WHEN event_id IS NULL OR event_id % 3 = 2 THEN 'Aborted' WHEN event_id % 3 = 0 THEN 'Committed' ELSE 'Ongoing' END AS status, CASE WHEN event_id % 3 = 0 THEN commit_ts WHEN event_id % 3 = 1 THEN greatest(commit_ts, {READ_TS} + 1) END AS commit_ts FROM q LEFT JOIN v ON event_id = txn"),
    "slice_update": (_slice_update, f"""{B}, x AS (SELECT key // 50 AS slice_id, CAST(sum(length(priority) + 24) AS BIGINT) AS bytes, count(*) AS n FROM b GROUP BY 1), y AS (SELECT *, CASE WHEN slice_id % 4 <> 0 THEN bytes * (slice_id % 20) END AS aft, slice_id % 3 <> 0 AS ex FROM x),
 z AS (SELECT *, CASE WHEN ex AND aft > 16384 AND aft > bytes THEN 'split' WHEN ex AND aft IS NOT NULL THEN 'resize' ELSE 'keep' END AS action FROM y) SELECT slice_id, action, CASE WHEN action = 'split' THEN (aft + 8191) // 8192 ELSE 1 END AS parts, CASE WHEN ex THEN coalesce(aft, bytes) // n END AS avg_bytes FROM z"""),
    "split_flush_range": (_split_flush, f"{B}, x AS (SELECT key // 2000 AS range_id, key, min(key) OVER (PARTITION BY key // 2000) AS lo FROM b) SELECT range_id, key, CAST(CASE WHEN range_id % 2 <> 0 OR key < lo + 500 THEN 0 WHEN key < lo + 1500 THEN 1 ELSE 2 END AS BIGINT) AS part FROM x"),
    "kick_out": (_kick, f"""{V}, c AS (SELECT *, commit_ts <= {CKPT_TS} AS fl FROM v) SELECT 'range' AS clean, count(*) AS n FROM c WHERE NOT (fl AND key >= 10 AND key < 90) UNION ALL SELECT 'bucket', count(*) FROM c WHERE NOT (fl AND (key & 16383) % 1024 = 17)
 UNION ALL SELECT 'truncate', count(*) FROM c WHERE NOT fl UNION ALL SELECT 'deleted', count(*) FROM c WHERE NOT (fl AND status = 'Deleted' AND commit_ts <= {READ_TS})"""),
    "range_metadata": (_metadata, f"{B} SELECT key // 500 AS range_id, key AS start_key, lead(key) OVER (ORDER BY key) AS stop_key, CAST(1 AS BIGINT) AS version FROM b WHERE key % 500 = 0"),
    "ranges_in_bucket": (_in_bucket, f"{B} SELECT 2000 AS n_ranges, count(DISTINCT key // 50) AS n_slices FROM b"),
    "range_to_bucket_murmur": (lambda s, d: s.range(0, 5000).select(F.col("id").alias("range_id"), partition.range_bucket(F.col("id")).alias("bucket")), MURMUR_SQL),
    "bucket_partition": (lambda s, d: s.range(0, 1024).groupBy(partition.bucket_partition(F.col("id"), 10).alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_bucket")), "SELECT b % 10 AS \"partition\", count(*) AS n, min(b) AS first_bucket FROM (SELECT unnest(range(0, 1024)) AS b) GROUP BY 1"),
    "shard_code_parts": (lambda s, d: base_orders(s, d).select("key", partition.shard_parts(partition.shard_code(F.col("key") % 3, F.col("key"))).alias("p"), partition.tx_number(F.col("key") % 3, F.col("key")).alias("tx")).select("key", "p.ng", "p.residual", "tx"), f"{B} SELECT key, key % 3 AS ng, key & 1023 AS residual, (key % 3) * 4294967296 + key AS tx FROM b"),
    "stats_on_split": (lambda s, d: stats.split_samples(stats.hashed_sample(base_orders(s, d)), _owners(s)), f"{B}, p AS (SELECT key FROM b ORDER BY key * 2654435761 % 4294967296, key LIMIT 1024) SELECT CAST(CASE WHEN key >= 2000 AND key < 9000 THEN 2 ELSE 1 END AS BIGINT) AS owner, count(*) AS n_sampled, min(key) AS least, max(key) AS most FROM p GROUP BY 1"),
    "stats_merge_samples": (lambda s, d: stats.merged_samples(stats.hashed_sample(base_orders(s, d).filter("key % 2 = 0")).unionByName(stats.hashed_sample(base_orders(s, d).filter("key % 2 = 1")))), f"{B} SELECT key FROM b ORDER BY key * 2654435761 % 4294967296, key LIMIT 1024"),
    "stats_fallback": (_fallback, f"{B} SELECT priority, CASE WHEN starts_with(priority, '1') THEN CAST(floor(count(*) / 2) AS BIGINT) ELSE count(*) // 100 END AS estimate FROM b GROUP BY 1"),
    "sequence_set": (lambda s, d: catalog.set_value(s.range(0, 10).select(F.col("id").alias("seq"), (F.col("id") * 5).alias("next")), s.createDataFrame([(1, 100), (2, 3), (3, None)], "seq long, next long")), "SELECT i AS seq, CASE i WHEN 1 THEN 100 ELSE i * 5 END AS next FROM (SELECT unnest(range(0, 10)) AS i) WHERE i <> 3"),
    "catalog_reject_dirty": (lambda s, d: catalog.reject_dirty(_catalog(s, d), s.range(0, 30, 3).select(F.col("id").alias("tbl"))), f"{V} SELECT key % 30 AS tbl, commit_ts AS version, CASE WHEN object_type IN ('error', 'view') THEN 'dirty' ELSE 'committed' END AS status, object_type AS ddl FROM v WHERE NOT (object_type IN ('error', 'view') AND key % 30 % 3 = 0)"),
    "kv_names": (lambda s, d: version_log(s, d).select("object_type").distinct().select("object_type", catalog.kv_name("kv_", F.when(F.col("object_type") == "click", "secondary").when(F.col("object_type") == "view", "unique").otherwise("primary"), F.col("object_type")).alias("name")), f"{V} SELECT DISTINCT object_type, 'kv_' || CASE object_type WHEN 'click' THEN 'i' WHEN 'view' THEN 'u' ELSE 't' END || object_type AS name FROM v"),
    "metric_duration": (lambda s, d: catalog.durations(_spans(s, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")), f"{V} SELECT object_type AS name, count(*) AS n, max(payload) AS most FROM v WHERE k % 6 <> 0 GROUP BY 1"),
}
