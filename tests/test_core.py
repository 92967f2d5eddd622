import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection, differs
from txframe import registry
from txframe.functions.hashing import murmur3_32
from txframe.operators import backup, commands, locks, mvcc, objects, scan, skew, stats, txn
from txframe.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differs(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


def test_prune_keeps_one_version_at_the_floor(spark):
    log = spark.createDataFrame([(1, t) for t in (10, 8, 4, 3, 1)] + [(2, 3)], "key int, commit_ts long")
    assert sorted(r.commit_ts for r in mvcc.prune(log, 5).filter("key = 1").collect()) == [4, 8, 10]
    assert mvcc.prune(log, 1).filter("key = 2").count() == 1


def test_export(spark):
    log = spark.createDataFrame([(1, t) for t in (10, 8, 7, 5, 4)], "key int, commit_ts long")
    assert {(r.commit_ts, r.target) for r in mvcc.export(log, 9).collect()} == {(8, "base"), (7, "archive"), (5, "archive"), (4, "archive")}


@pytest.mark.parametrize("ops,final", [("Insert Update", "Insert"), ("Insert Delete", "Delete"), ("Delete Insert", "Update"), ("Update Delete", "Delete"), ("Delete Update", "Illegal"), ("Upsert Upsert", "Illegal"), ("Upsert", "Upsert")])
def test_write_set_algebra(spark, ops, final):
    df = spark.createDataFrame([(1, i, o, i) for i, o in enumerate(ops.split())], "key int, seq int, op string, payload int")
    assert txn.fold(df).first().op == final


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([(1, 99), (2, 100), (3, None)], "key int, ttl_ms long")
    assert sorted(r.key for r in df.filter(scan.alive(df.ttl_ms, 100)).collect()) == [2, 3]


def test_gap_waits_and_overwrite_restarts(spark):
    rows = [(1, 2, 1, 5, False), (1, 4, 3, 7, False), (2, 2, 1, 5, False), (2, 9, 7, 1, True), (2, 10, 9, 2, False)]
    got = {r.key: (r.version, r.value, r.waiting) for r in commands.ordered_apply(spark.createDataFrame(rows, "key int, new_version long, obj_version long, payload long, overwrite boolean")).collect()}
    assert got == {1: (2, 5, 1), 2: (10, 3, 0)}


def test_pops_expire(spark):
    waiters = [(1, 1, 10, 20), (1, 2, 11, None), (1, 3, 40, 50), (2, 4, 5, 9), (2, 5, 6, None), (3, 6, 10, 99), (3, 7, 10, 5), (None, 8, 1, None), (3, 9, 200, None)]
    elements = [(1, 101, 20), (1, 102, 30), (2, 103, 9), (4, 104, 1), (1, 105, 41)]
    w = spark.createDataFrame(waiters, "key long, waiter long, at long, deadline long")
    e = spark.createDataFrame(elements, "key long, element long, at long")
    got = {r.waiter: (r.element, r.at, r.outcome) for r in commands.pop_expiring(w, e, 60).collect()}
    assert got == {1: (None, 20, "expired"), 2: (101, 20, "popped"), 3: (102, 40, "popped"), 4: (None, 9, "expired"), 5: (103, 9, "popped"), 6: (None, None, "waiting"), 7: (None, 5, "expired")}
    assert commands.pop_expiring(w.limit(0), e.limit(0), 60).count() == 0


def test_pops_agree_with_a_plain_queue(spark):
    rng = random.Random(3)
    waiters = [(rng.randrange(5), i, t := rng.randrange(400), rng.choice([None, t + rng.randrange(1, 60)])) for i in range(300)]
    elements = [(rng.randrange(5), 1000 + i, rng.randrange(400)) for i in range(250)]
    want, taken = {}, set()
    came = sorted([(t, 0, n, k) for k, n, t in elements] + [(t, 1, n, k) for k, n, t, _ in waiters])
    due, born = {n: d for _, n, _, d in waiters}, {n: (t, k) for k, n, t, _ in waiters}
    for t, kind, n, k in came:
        if kind == 0:
            open_ = sorted((born[x][0], x) for x in born if born[x][1] == k and born[x][0] < t and x not in want and (due[x] is None or due[x] > t))
            if open_:
                want[open_[0][1]] = (n, t, "popped")
                taken.add(n)
        else:
            free = sorted((at, x) for kk, x, at in elements if kk == k and at <= t and x not in taken)
            if free:
                want[n] = (free[0][1], t, "popped")
                taken.add(free[0][1])
    for n, d in due.items():
        want.setdefault(n, (None, d, "expired") if d is not None and d <= 420 else (None, None, "waiting"))
    got = commands.pop_expiring(spark.createDataFrame(waiters, "key long, waiter long, at long, deadline long"), spark.createDataFrame(elements, "key long, element long, at long"), 420).collect()
    assert {r.waiter: (r.element, r.at, r.outcome) for r in got} == want and len(got) == 300


def test_murmur3(spark):
    def plain(x, seed):
        m = 0xFFFFFFFF
        k = x * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h = seed ^ k * 0x1B873593 & m
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
        h ^= 4
        for s, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> s) * c & m
        return h ^ h >> 16

    df = spark.range(0, 3000, 7)
    assert all(r.h == plain(r.id, 9001) for r in df.select("id", murmur3_32(df.id, 9001).alias("h")).collect())


def test_glob():
    assert scan.glob_regex("a?[0-9]*\\*") == r"^a.[0-9].*\*$"


def test_times_do_not_follow_the_session_zone(spark, con):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for name in ("mvcc_visible_as_of", "last_commit_ts", "store_write_read"):
                assert differs(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_hot_joins_and_prefix_sums(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, None, 4]), i, r.randint(0, 9)) for i in range(4000)] + [(None, 4000, 1)]
    left = spark.createDataFrame(rows, "k int, i int, v int").repartition(5)
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, w string")
    for how in ("inner", "left"):
        got = skew.hot_join(left, right, ["k"], how, hot=skew.hot_keys(left, ["k"], rows=700))
        assert sorted((x.i, x.w) for x in got.collect()) == sorted((i, {1: "a", 2: "b"}.get(k)) for k, i, _ in rows if how == "left" or k in (1, 2))
    got = {x.i: (x.before_v, x.before_rows, x.before_m) for x in skew.prefix_sums(left, ["k"], [F.col("i").asc()], {"v": "v"}, greatest={"m": "v"}).collect()}
    sums, counts, most = {}, {}, {}
    for k, i, v in rows:
        most[k] = max(most.get(k, v), v)
        assert got[i] == (sums.get(k, 0), counts.get(k, 0), most[k])
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1


def test_components_of_waits(spark):
    """Cycles of several lengths, chains into and out of them, and bridges, against a plain search."""
    r = random.Random(6)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(75)} | {(i, (i - 99) % 7 + 100) for i in range(100, 107)}
    edges = {(a, b) for a, b in edges if a != b}
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    for _ in range(8):
        reach = {a: s | {z for b in s for z in reach.get(b, ())} for a, s in reach.items()}
    want = {a: min(b for b in s if a in reach.get(b, ())) for a, s in reach.items() if a in s}
    got = locks.on_cycles(spark.createDataFrame(sorted(edges), "waiter long, holder long")).collect()
    assert {x.tx: x.component for x in got} == want and len(set(want.values())) > 1
    assert locks.on_cycles(spark.createDataFrame([(1, 2), (2, 3)], "waiter long, holder long")).count() == 0


def test_lock_queue(spark):
    def run(*rows):
        df = spark.createDataFrame([(1, i, *x, "Locking") if len(x) == 2 else (1, i, *x) for i, x in enumerate(rows)], "entry long, seq long, tx long, lock string, protocol string")
        return {(x.seq): (x.outcome, x.granted_seq) for x in locks.queue_grants(df).collect()}

    # readers share, a writer waits, a reader waits behind it, and both are served in turn
    got = run((1, "ReadLock"), (2, "ReadLock"), (3, "WriteLock"), (4, "ReadLock"), (1, "Release"), (2, "Release"), (3, "Release"))
    assert got == {0: ("Granted", 0), 1: ("Granted", 1), 2: ("Granted", 5), 3: ("Granted", 6)}
    # the holder of an intent goes to the head; writers under OCC fail, readers wait
    got = run((1, "WriteIntent"), (2, "ReadLock"), (3, "WriteLock"), (1, "WriteLock"), (4, "WriteIntent", "OCC"), (5, "ReadLock", "OCC"), (2, "Release"), (1, "Release"))
    assert got[3] == ("Granted", 6) and got[4] == ("Failed", None) and got[2] == ("Granted", 7) and got[5] == ("Blocked", None)
    # who holds as much already is granted at once, and a release takes its waits along
    assert run((1, "WriteLock"), (1, "ReadLock"), (2, "WriteLock"), (2, "Release"), (1, "Release")) == {0: ("Granted", 0), 1: ("Granted", 1)}


def test_commands_of_ones_own(spark):
    objects.register("double", objects.Command(lambda v, a: (2 * v, 2 * v), on_missing=False))
    try:
        o = spark.createDataFrame([(1, 5, None), (2, 6, 50)], "key long, value long, ttl_ms long")
        c = spark.createDataFrame([(1, 1, "double", 0, 100), (2, 1, "get", 0, 100), (2, 2, "incr", 3, 100), (3, 1, "double", 0, 100), (3, 2, "expire", 9, 100)], "key long, seq long, cmd string, arg long, now_ms long")
        got = {(r.key, r.seq): (r.status, r.ran, r.result, r.value) for r in objects.execute(o, c).collect()}
        assert got == {(1, 1): ("Normal", True, 10, 10), (2, 1): ("Deleted", False, None, 6), (2, 2): ("Normal", True, 3, 3), (3, 1): ("Deleted", False, None, None), (3, 2): ("Deleted", False, None, None)}
    finally:
        del objects.REGISTRY["double"]


def test_store_errors_and_empty_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create_table("t", "value long")
    assert store.count("t") == 0 and list(store.pages("t", scan.ScanSpec(), 5)) == [] and store.databases().count() == 1
    with pytest.raises(ValueError):
        store.create_table("t", "value long")
    rows = spark.createDataFrame([(1, 10, "Normal", None, 1), (1, 20, "Deleted", None, 2), (2, 10, "Normal", None, 3), (2, 10, "Normal", None, 3)], "key long, commit_ts long, status string, ttl_ms long, value long")
    store.put_all("t", rows)
    assert store.count("t") == 1 and store.rows("t", 15).filter("status = 'Normal'").count() == 2
    store.compact("t")
    assert store.versions("t").count() == 1 and Store(spark, f"file://{tmp_path}/s").count("t") == 1
    asked = spark.createDataFrame([(1,), (2,)], "key long")
    assert {r.key: r.status for r in store.read("t", asked).collect()} == {1: "Deleted", 2: "Normal"}
    with pytest.raises(ValueError):
        scan.resume(rows.withColumn("bucket", F.lit(0)), spark.createDataFrame([(0, 1, 3)], "bucket int, last_key long, version int"), 2, version=4)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from txframe.sources.shared import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError):
        shared_dir(far)


def test_random_pairing_is_uniform_and_follows_deletes(spark):
    r = random.Random(8)
    rows, live = [], {}
    for t in range(120):  # the same history in many tables, each with draws of its own
        have, seq = [], 0
        for key in range(60):
            rows.append((t, seq := seq + 1, key, "Insert"))
            have.append(key)
            if r.random() < 0.4:
                rows.append((t, seq := seq + 1, x := have.pop(r.randrange(len(have))), "Delete"))
        live[t] = set(have)
    ops = spark.createDataFrame(rows, "tbl long, seq long, key long, op string").repartition(7)
    got = {}
    for x in stats.random_pairing(ops, 12, lanes=1).collect():
        got.setdefault(x.tbl, []).append(x.key)
    assert all(len(set(k)) == len(k) <= 12 and set(k) <= live[t] for t, k in got.items())
    # early and late keys are as likely to be held
    share = lambda keys: sum(len(set(got.get(t, [])) & (live[t] & keys)) for t in live) / sum(len(live[t] & keys) for t in live)
    assert abs(share(set(range(30))) - share(set(range(30, 60)))) < 0.06 and 0.2 < share(set(range(60))) < 0.4
    again = {(x.tbl, x.key) for x in stats.random_pairing(ops.repartition(3), 12, lanes=1).collect()}
    assert again == {(t, k) for t, keys in got.items() for k in keys}
    assert stats.random_pairing(ops.limit(0)).count() == 0


def test_backups_and_standby(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(k, ts, st, None, v) for k, ts, st, v in r], "key long, commit_ts long, status string, ttl_ms long, value long")
    store, standby = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    store.create_table("t", "value long")
    store.put_all("t", rows((1, 10, "Normal", 1), (2, 10, "Normal", 2), (3, 30, "Normal", 3)))
    kept = backup.Backups(spark, f"file://{tmp_path}/k")
    kept.create(store, "x", 20)
    assert [tuple(r) for r in kept.status().collect()] == [("x", "Finished", 20)] and kept.tables("x").first().n_rows == 2
    with pytest.raises(ValueError):
        kept.create(store, "x", 20)
    kept._note(("broken", "Running", 5))  # one that was broken off
    with pytest.raises(ValueError):
        kept.restore("broken", standby)
    kept.terminate("broken")
    with pytest.raises(ValueError):
        kept.terminate("never")
    seen = lambda s: sorted((r.key, r.value) for r in s.rows("t").filter("status = 'Normal'").collect())
    assert backup.sync_standby(store, standby, "t", 20) == "whole" and seen(standby) == [(1, 1), (2, 2)]
    store.put_all("t", rows((1, 40, "Deleted", None)))
    assert backup.sync_standby(store, standby, "t", 50) == "changes" and seen(standby) == [(2, 2), (3, 3)]
    store.delete_range("t", 2, 3)
    assert backup.sync_standby(store, standby, "t", 60) == "whole" and seen(standby) == [(3, 3)]
    store.compact("t")
    store.put_all("t", rows((4, 70, "Normal", 4)))
    assert backup.sync_standby(store, standby, "t", 80) == "whole" and seen(standby) == [(3, 3), (4, 4)]
    store.reload("t")
    store.reload()
    assert store.count("t") == 2
