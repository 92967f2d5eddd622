"""Tables of the shapes the operators read, derived from the given Parquet tables.

Every one is a pure function of (spark, sf_dir), so that SQL can derive the same rows (see
``SQL``). SURVEY 1.4 and FIXTURES C.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times, in microseconds, that queries read, checkpoint and prune at.
READ_TS = 1_705_000_000_000_000
CKPT_TS = 1_704_500_000_000_000
OLDEST_TS = 1_705_500_000_000_000
NOW_MS = 1_705_100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone; whatever the session's zone, it is read as it is written."""
    day, second = F.unix_date(ts.cast("date")).cast("long"), (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return day * 86_400_000_000 + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000 + second


def version_log(spark: SparkSession, sf_dir: str, until: int | None = None) -> DataFrame:
    """key, commit_ts, status, payload, k, object_type, ttl_ms and event_id: one row for each version, of those not after ``until``.

    The bound is one on the stored time, which reaches the Parquet reader.
    """
    e = table(spark, sf_dir, "events")
    if until is not None:
        e = e.filter(F.col("ts") <= F.lit((datetime(1970, 1, 1) + timedelta(microseconds=until)).isoformat(" ")).cast("timestamp_ntz"))
    k = F.get_json_object("props", "$.k").cast("long")
    ts = micros(F.col("ts"))
    return e.select(
        F.col("user_id").alias("key"), ts.alias("commit_ts"), F.when(F.col("event_type") == "error", "Deleted").otherwise("Normal").alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("payload"), k.alias("k"), F.col("event_type").alias("object_type"),
        F.when(k % 3 != 0, F.floor(ts / 1000).cast("long") + k * 3_600_000).alias("ttl_ms"), "event_id",
    )


def base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, cust, price (cents), order_status, priority, commit_ts (unique)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.round(F.col("o_totalprice") * 100).cast("long").alias("price"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("priority"), (micros(F.col("o_orderdate")) + F.col("o_orderkey")).alias("commit_ts"),
    )


def write_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, op, price: updates and deletes of every fifth order, and inserts of new keys."""
    b = base_orders(spark, sf_dir).filter("key % 5 = 0")
    changed = b.select("key", F.when(F.col("key") % 7 == 0, "Delete").otherwise("Update").alias("op"), F.when(F.col("key") % 7 != 0, F.col("price") + 1).alias("price"))
    return changed.unionByName(b.filter("key % 50 = 0").select((F.col("key") + 1_000_000_000).alias("key"), F.lit("Insert").alias("op"), "price"))


def write_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, op, payload: operations in order on few keys."""
    v = version_log(spark, sf_dir)
    op = F.when(F.col("object_type") == "error", "Delete").when(F.col("object_type") == "signup", "Insert").otherwise("Update")
    return v.select((F.col("key") % 40).alias("key"), F.col("commit_ts").alias("seq"), op.alias("op"), "payload")


def lock_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """holds and waits (tx, entry) of all line items."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda n: li.filter(F.col("l_linenumber") == n).select(F.col("l_suppkey").alias("tx"), F.col("l_partkey").alias("entry")).distinct()
    return pick(1), pick(2)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, new_version, obj_version, payload, overwrite, seq, ng: a change stream whose gaps are every 17th event."""
    from pyspark.sql import Window

    v = version_log(spark, sf_dir)
    chain = v.withColumn("obj_version", F.coalesce(F.lag("commit_ts").over(Window.partitionBy("key").orderBy("commit_ts")), F.lit(1).cast("long")))
    return chain.filter("event_id % 17 <> 0").select("key", F.col("commit_ts").alias("new_version"), "obj_version", "payload", (F.col("object_type") == "signup").alias("overwrite"), "event_id")


#: The same tables as DuckDB CTEs.
SQL = {
    "v": """v AS (SELECT user_id AS key, epoch_us(ts) AS commit_ts, CASE WHEN event_type = 'error' THEN 'Deleted' ELSE 'Normal' END AS status,
 CAST(round(value * 100) AS BIGINT) AS payload, CAST(props->>'$.k' AS BIGINT) AS k, event_type AS object_type,
 CASE WHEN CAST(props->>'$.k' AS BIGINT) % 3 <> 0 THEN epoch_us(ts) // 1000 + CAST(props->>'$.k' AS BIGINT) * 3600000 END AS ttl_ms, event_id FROM events)""",
    "b": """b AS (SELECT o_orderkey AS key, o_custkey AS cust, CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_orderstatus AS order_status,
 o_orderpriority AS priority, epoch_us(o_orderdate) + o_orderkey AS commit_ts FROM orders)""",
    "ws": """ws AS (SELECT key, CASE WHEN key % 7 = 0 THEN 'Delete' ELSE 'Update' END AS op, CASE WHEN key % 7 <> 0 THEN price + 1 END AS price FROM b WHERE key % 5 = 0
 UNION ALL SELECT key + 1000000000, 'Insert', price FROM b WHERE key % 50 = 0)""",
    "wo": """wo AS (SELECT key % 40 AS key, commit_ts AS seq, CASE object_type WHEN 'error' THEN 'Delete' WHEN 'signup' THEN 'Insert' ELSE 'Update' END AS op, payload FROM v)""",
    "lk": """li AS (SELECT * FROM lineitem),
 holds AS (SELECT DISTINCT l_suppkey AS tx, l_partkey AS entry FROM li WHERE l_linenumber = 1),
 waits AS (SELECT DISTINCT l_suppkey AS tx, l_partkey AS entry FROM li WHERE l_linenumber = 2)""",
    "c": """c AS (SELECT key, commit_ts AS new_version, obj_version, payload, object_type = 'signup' AS overwrite, event_id FROM
 (SELECT *, coalesce(lag(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts), 1) AS obj_version FROM v) WHERE event_id % 17 <> 0)""",
}


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
