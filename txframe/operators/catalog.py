"""Catalog, sequences, backups and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import prefix_sums


def current_schema(catalog: DataFrame) -> DataFrame:
    """Per table its newest committed schema (tbl, version, status, ddl)."""
    return catalog.filter("status = 'committed'").groupBy("tbl").agg(F.max(F.struct("version", "ddl")).alias("s")).select("tbl", "s.version", "s.ddl")


def commit_dirty(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """The catalog after the dirty schemas of the named tables are committed; older dirty ones are dropped."""
    newest = catalog.groupBy("tbl").agg(F.max("version").alias("top"))
    j = catalog.join(newest, "tbl").join(tables.withColumn("named", F.lit(True)), "tbl", "left")
    status = F.when((F.col("status") == "dirty") & F.col("named") & (F.col("version") == F.col("top")), "committed").otherwise(F.col("status"))
    return j.withColumn("status", status).filter("NOT (status = 'dirty' AND version < top)").select("tbl", "version", "status", "ddl")


def index_name(name: Column) -> Column:
    """base, index and kind of ``base*$$idx`` (secondary) or ``base*~~idx`` (unique); others are primary."""
    unique, second = F.instr(name, "*~~"), F.instr(name, "*$$")
    at = F.when(unique > 0, unique).when(second > 0, second)
    return F.struct(
        F.when(at.isNull(), name).otherwise(F.substring(name, F.lit(1), at - 1)).alias("base"), F.when(at.isNotNull(), F.substring(name, at + 3, F.length(name))).alias("index"),
        F.when(unique > 0, "unique").when(second > 0, "secondary").otherwise("primary").alias("kind"),
    )


def allocate(requests: DataFrame, first: int = 1, step: int = 1, lease: int = 256, group: str = "seq") -> DataFrame:
    """Ids in request order, leased ``lease`` at a time; a sequence may have any number of requests."""
    numbered = prefix_sums(requests.select(group, "req"), [group], [F.col("req").asc()], {}, out="n")
    return numbered.select(group, "req", (F.lit(first) + F.col("n_rows") * step).cast("long").alias("id"), F.floor(F.col("n_rows") / lease).cast("long").alias("lease"))


def set_value(sequences: DataFrame, updates: DataFrame) -> DataFrame:
    """Sequences (seq, next) after manual updates (seq, next): they only move forward. Dropped sequences have a null update."""
    u = updates.select("seq", F.col("next").alias("wanted"), F.lit(True).alias("named"))
    j = sequences.join(u, "seq", "left").filter("named IS NULL OR wanted IS NOT NULL")
    return j.select("seq", F.greatest("next", F.coalesce("wanted", "next")).alias("next"))


def reject_dirty(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """The catalog without the dirty schemas of the named tables."""
    dirty = catalog.filter("status = 'dirty'").join(tables, "tbl", "left_semi")
    return catalog.join(dirty.select("tbl", "version"), ["tbl", "version"], "left_anti").select("tbl", "version", "status", "ddl")


def kv_name(prefix: str, kind: Column, ident: Column) -> Column:
    """The name a table's files go by: a prefix, t, i or u for the kind, and an identifier."""
    return F.concat(F.lit(prefix), F.when(kind == "secondary", "i").when(kind == "unique", "u").otherwise("t"), ident)


def reserved(desired: Column, current: Column, end: Column, inc: int) -> Column:
    """How many of the wanted ids a lease still holds."""
    return F.least(desired, F.floor((end - current - 1) / inc).cast("long") + 1)


def manifest(base: DataFrame, ckpt_ts: int) -> DataFrame:
    """What a backup at ``ckpt_ts`` holds, by bucket: rows, newest commit and a checksum."""
    rows = base.filter(F.col("commit_ts") <= ckpt_ts)
    return rows.groupBy((F.col("key") % 16).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("commit_ts").alias("max_commit_ts"), F.sum("price").alias("checksum"))


def counters(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(F.sum("amount").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    """Per name the value set last."""
    return samples.groupBy("name").agg(F.max(F.struct("ts", "value")).alias("v")).select("name", F.col("v.value").alias("value"), F.col("v.ts").alias("ts"))


def histograms(samples: DataFrame, bounds: list[float]) -> DataFrame:
    """Per name cumulative counts up to each bound, one pass over the samples."""
    sums = samples.groupBy("name").agg(*[F.sum((F.col("value") <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("all"))
    rows = F.array(*[F.struct(F.lit(str(int(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return sums.select("name", F.explode(rows).alias("r")).select("name", "r.le", "r.n")


#: The names that dashboards know measures by.
METRICS = (
    "kv_flush_rows_total", "kv_load_slice_total", "kv_load_slice_duration", "kv_read_total", "kv_read_duration", "memory_limit", "cache_hit_or_miss_total", "memory_usage",
    "memory_fragment_ratio", "busy_round_duration", "busy_round_active_tx_count", "busy_round_processed_cc_request_count", "empty_round_ratio", "tx_duration", "tx_processed_total",
    "remote_request_duration", "remote_request_in_flight_count", "standby_lagging_msgs", "max_standby_lag", "standby_out_of_sync_count", "is_continuous_checkpoint_failures",
    "checkpoint_stall_rounds", "leader_changes_seen_total", "is_leader",
)


def metric_kind(name: Column) -> Column:
    """counter, histogram or gauge, as the end of a built-in name tells; null for any other name."""
    return F.when(name.isin(*METRICS), F.when(name.endswith("_total"), "counter").when(name.endswith("_duration"), "histogram").otherwise("gauge"))


def observed(samples: DataFrame) -> DataFrame:
    """Samples (name, ts, value) of built-in names as (name, kind, n, value): a counter's sum, a gauge's value set last, a histogram's sum. Others are left out."""
    kind = metric_kind(F.col("name"))
    per = samples.filter(kind.isNotNull()).groupBy("name", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max(F.struct("ts", "value")).alias("last"))
    return per.select("name", "kind", "n", F.when(F.col("kind") == "gauge", F.col("last.value")).otherwise(F.col("total")).alias("value"))


def durations(spans: DataFrame) -> DataFrame:
    """Samples (name, ts, value) from spans (name, started, ended), in the units of their times; spans that have not ended give none."""
    return spans.filter("ended IS NOT NULL").select("name", F.col("ended").alias("ts"), (F.col("ended") - F.col("started")).alias("value"))


def label_sets(first: DataFrame, second: DataFrame, most: int = 1000) -> DataFrame:
    """Every combination of two label groups. Label groups are configuration: more than ``most`` values in one are an error."""
    for df in (first, second):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} labels in {df.columns[0]}")
    return first.crossJoin(F.broadcast(second))
