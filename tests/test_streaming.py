import random

from pyspark.sql import functions as F

from txframe.operators import commands as batch
from txframe.streaming import commands as stream

SCHEMA = "key long, new_version long, obj_version long, overwrite boolean, payload long"


def rows():
    r, out = random.Random(4), []
    for key in range(12):
        version = 1
        for i in range(20):
            new = version + r.randint(1, 3)
            if not (key % 3 == 0 and i == 11):  # a gap that never closes, unless an overwrite follows
                out.append((key, new, version, r.random() < 0.05, r.randint(1, 9)))
            version = new
    out += r.sample(out, 20)
    r.shuffle(out)
    return out


def read(spark, path, schema, parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return df.sparkSession.table(name)


def test_ordered_apply_equals_batch(spark, tmp_path):
    every = rows()
    got = drained(stream.ordered_apply(read(spark, f"{tmp_path}/in", SCHEMA, [every[:90], every[90:170], every[170:]])), "update", "applied", tmp_path)
    # versions never fall; at one version, what waits only grows
    last = got.groupBy("key").agg(F.max(F.struct("version", "waiting", "applied", "value")).alias("l")).select("key", "l.version", "l.applied", "l.value", "l.waiting")
    want = batch.ordered_apply(spark.createDataFrame(every, SCHEMA))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert any(r.waiting for r in want.collect())


def test_progress_and_fanout(spark, tmp_path):
    schema = "seq_grp long, seq_id long, consistent_ts long, channel string"
    every = [(i % 3, i, 10 * i, "ab"[i % 2]) for i in range(30)]
    source = read(spark, f"{tmp_path}/in", schema, [every[:10], every[10:]])
    got = drained(stream.watermark_progress(source), "complete", "progress", f"{tmp_path}/p")
    assert sorted(map(tuple, got.collect())) == [(0, 270, 27), (1, 280, 28), (2, 290, 29)]
    subs = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "channel string, subscriber long")
    sent = drained(stream.fanout(source, subs), "append", "sent", f"{tmp_path}/f")
    assert sorted((r.seq_id, r.subscriber) for r in sent.collect()) == [(i, s) for i in range(0, 30, 2) for s in (1, 2)]
