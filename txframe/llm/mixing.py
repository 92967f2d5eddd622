"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) over its quality weight, with u from a hash of
the document itself, so reruns agree. The weight comes from the text alone, so that no join is
needed to draw. Within a source documents are ordered by key and their
sizes prefix-summed. A source whose target is at least its size gives complete epochs first;
the rest of the budget takes documents in key order for as long as that brings the sum nearer
to the target.

Nulls and odd input: a null text has size 0 and a null source is a source of its own, after all
others; rows that repeat (same doc_id, source and text) share one key and are taken together;
an empty table gives an empty one; a source of empty texts has target 0 and is not taken. Other columns are carried along untouched by the stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, let, prefix_sums, split_words, staged, without

#: Source weights by rank, repeating; share of all words that the mix holds; most epochs of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Least quality weight, so that every document can be drawn.
LEAST_WEIGHT = 0.1
#: Sources up to which their cuts go to every executor.
BROADCAST_SOURCES = 20_000


def measured(text: Column) -> Column:
    """size, the number of words, and weight: how varied the words are for their number, less for symbols."""
    symbols = F.octet_length(F.coalesce(text, F.lit(""))) - F.octet_length(without(F.coalesce(text, F.lit("")), "#$%&|<>"))

    def of(words: Column) -> Column:
        n = F.size(words)
        variety = F.when(n > 1, F.log(F.size(F.array_distinct(words)).cast("double")) / F.log(n.cast("double"))).otherwise(F.lit(1.0))
        clean = 1 - symbols / F.greatest(n, F.lit(1))
        return F.struct(n.cast("long").alias("size"), (F.greatest(variety, F.lit(LEAST_WEIGHT)) * F.greatest(clean, F.lit(LEAST_WEIGHT))).alias("weight"))

    return let(split_words(text), of)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): weight and target, the shares capped at max_epochs times the size.

    Resharing the excess of capped sources by weight until none is above its cap ends where each
    target is the smaller of its cap and weight times one level. With sources in the order of
    cap / weight, the level is found from running sums. ``sizes`` has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    out = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    out = out.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
    # If all sources before this one are capped, the level that shares out what they leave:
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first that its own cap does not bind; later ones are smaller, as they cap sources that need not be
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    out = out.withColumn("level", level)
    return out.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def draw_key(weight: Column, *identity: Column) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from a hash of ``identity``."""
    u = (F.pmod(F.xxhash64(*identity, F.lit(20231)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def drawn(docs: DataFrame) -> DataFrame:
    """``docs`` with size, text_hash and draw_key under own names."""
    out = docs.withColumn(OWN + "m", measured(F.col("text"))).withColumn(OWN + "h", F.xxhash64(F.coalesce("text", F.lit(""))))
    return out.withColumns({OWN + "size": F.col(OWN + "m")["size"], OWN + "key": draw_key(F.col(OWN + "m")["weight"], F.col("doc_id"), F.col(OWN + "h"))}).drop(OWN + "m")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, draw_key, taken, epochs, and copies, how often the mix holds it."""
    small = drawn(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col(OWN + "h").alias("text_hash"), F.col(OWN + "size").alias("size"), F.col(OWN + "key").alias("draw_key"))
    rows = staged(small.groupBy("doc_id", "source", "text_hash", "size", "draw_key").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.col("size") * F.col("n")))
    wanted = targets(rows.groupBy("source").agg(F.sum("all").alias("source_size")), weights, share, max_epochs).withColumnRenamed("source", "t_source")
    ordered = prefix_sums(rows, ["source"], [F.col("draw_key").asc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()], {"all": "all"})
    joined = ordered.join(wanted, F.col("source").eqNullSafe(F.col("t_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    # the documents that cross the budget are taken if the sum is then nearer to it
    extra = (F.col("before_all") + F.col("all") / 2.0 <= left) & (F.col("before_all") < left) & (F.col("epochs") < max_epochs)
    out = joined.withColumn("epochs", epochs).withColumn("copies", F.col("epochs") + extra.cast("long")).withColumn(OWN + "i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "draw_key", (F.col("copies") * F.col("size")).alias("taken"), "epochs", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns unchanged.

    A source's last taken key says for each of its documents whether it is taken, so the texts
    are not shuffled: they meet one row for each source.
    """
    cuts = mix(docs).groupBy(F.col("source").alias(OWN + "source")).agg(F.max("epochs").alias(OWN + "epochs"), F.max(F.when(F.col("copies") > F.col("epochs"), F.col("draw_key"))).alias(OWN + "cut"))
    cuts = staged(cuts)
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    joined = drawn(docs).join(side, F.col("source").eqNullSafe(F.col(OWN + "source")))
    copies = F.col(OWN + "epochs") + (F.col(OWN + "key") <= F.col(OWN + "cut")).eqNullSafe(True).cast("long")
    times = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    return joined.select(*docs.columns, F.explode(times).alias(OWN + "i")).drop(OWN + "i")
