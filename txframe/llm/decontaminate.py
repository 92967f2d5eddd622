"""Benchmark decontamination: a prefix-filtered set join of document windows with item windows.

An item window is a set of words to be contained whole, so by the prefix principle a single
word of it, its rarest, is necessary: only document words equal to some window's rarest word
are joined. A match must also leave room for the window on both sides (length and positional
bounds), and what is left is verified word for word over the window's size.

Rarity is how often a word occurs in all documents, counted over whole texts before the join; the
ranking decides only how many candidates are verified, never the result. A window one of whose
words occurs in no document is ranked by that word and so meets nothing.

Nulls and odd input: null and empty texts have no words and match nothing; items without
words, or with a null id, form no window; a window that several items share counts for each of
them; rows that repeat (same doc_id and text) give one row; a null doc_id is kept as a document
of its own text. Other columns are carried along untouched by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, UPPER, let, staged

#: Fixed value: what separates words before lowering; letters, digits and all beyond ASCII make words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 8
#: Distinct windows up to which the windows go to every executor (each is a few hundred bytes at most).
BROADCAST_WINDOWS = 200_000
#: Slots of the word filter, a constant of the plan.
FILTER_BITS = 16


def raw_words(text: Column) -> Column:
    """Words in their own case; lowering A-Z moves no boundary, so positions hold for lowered words too."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(words: Column) -> Column:
    """Words, joined by blanks, with A-Z and nothing else lowered."""
    return F.translate(F.array_join(words, " "), UPPER, UPPER.lower())


def token(word: Column) -> Column:
    """A number that equal lowered words share; lower() also folds beyond A-Z, so a few others may share it."""
    return F.xxhash64(F.lower(word))


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Per distinct (item_id, window): win, its words joined by blanks, and n, their count."""
    words = items.filter(F.col("item_id").isNotNull()).select("item_id", raw_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("x"))
    return cut.select("item_id", lowered(F.col("x")).alias("win"), F.size("x").alias("n")).distinct()


def window_words(windows: DataFrame) -> DataFrame:
    """Per distinct window and word of it: win, n, offset, word and token."""
    wins = windows.select("win", "n").distinct()
    return wins.select("win", "n", F.posexplode(F.split("win", " ")).alias("offset", "word")).withColumn("token", token(F.col("word")))


def occurrences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """How often each token of ``words`` occurs in all of ``docs``; a few other tokens are counted too."""
    slots, mask = word_filter(words), F.lit((1 << FILTER_BITS) - 1)
    known = F.filter(F.transform(raw_words(F.col("text")), token), lambda x: F.get(slots, x.bitwiseAND(mask).cast("int")) == "1")
    return docs.select(F.explode(known).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def prefixes(words: DataFrame, df: DataFrame) -> DataFrame:
    """Per distinct window: the token that ``df`` counts least, its offset and the window."""
    counted = words.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = counted.groupBy("win", "n").agg(F.min_by(F.struct("token", "offset"), F.struct("df", (-F.length("word")).alias("l"), "token", "offset")).alias("p"))
    return ranked.select("win", "n", "p.token", "p.offset")


def word_filter(tokens: DataFrame, bits: int = FILTER_BITS) -> Column:
    """A constant array of "1" and "0" by token modulo its length: "0" means that no row of ``tokens`` has the token."""
    slots = (1 << bits) - 1
    held = tokens.select(F.col("token").bitwiseAND(F.lit(slots)).cast("int").alias("s")).distinct().collect()  # at most 2**bits rows
    on = {r.s for r in held}
    text = "".join("1" if i in on else "0" for i in range(slots + 1))
    return F.split(F.lit(text), "")  # folded into one constant


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, min_items: int = 2, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and text_hash."""
    windows = staged(item_windows(items, size).withColumn("win_id", F.xxhash64("win")))
    words = staged(window_words(windows))
    prefix = staged(prefixes(words, occurrences(docs, words)).withColumn("win_id", F.xxhash64("win")))
    small = prefix.count() <= broadcast_windows
    sent = F.broadcast if small else (lambda df: df)
    slots, mask = word_filter(prefix), F.lit((1 << FILTER_BITS) - 1)

    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), raw_words(F.col("text")).alias("w"))
    found = let(F.transform(F.col("w"), token), lambda t: F.filter(F.transform(t, lambda x, i: F.struct(i.alias("at"), x.alias("token"))), lambda x: F.get(slots, x["token"].bitwiseAND(mask).cast("int")) == "1"))
    # Every document has one marker (at -1) that joins nothing and carries its word count.
    marker = F.array(F.struct(F.lit(-1).alias("at"), F.col("h").alias("token")))
    spread = texts.select("doc_id", "h", "w", F.explode(F.concat(marker, found)).alias("c"))
    # A candidate keeps only the words that a window around it can reach.
    low = F.greatest(F.col("c.at") - (size - 1), F.lit(0))
    near = spread.select("doc_id", "h", F.col("c.at").alias("at"), F.col("c.token").alias("token"), F.when(F.col("c.at") < 0, F.size("w")).alias("n_words"), low.alias("low"), F.when(F.col("c.at") >= 0, F.slice("w", low + 1, 2 * size - 1)).alias("near"))
    side = prefix.select(F.col("token").alias("p_token"), "offset", "n", "win", "win_id")
    joined = near.join(sent(side), F.col("token") == F.col("p_token"), "left")
    at = F.col("at") - F.col("offset")
    fits = (F.col("at") >= 0) & (at >= F.col("low")) & (at - F.col("low") + F.col("n") <= F.size("near"))
    whole = lowered(F.slice("near", F.greatest(at - F.col("low"), F.lit(0)) + 1, F.coalesce(F.col("n"), F.lit(1)))) == F.col("win")
    hit = F.when(fits, whole)
    kept = joined.withColumn("hit", F.coalesce(hit, F.lit(False))).filter((F.col("at") < 0) | F.col("hit"))
    by_doc = kept.groupBy("doc_id", "h").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("hit"), F.struct(at.alias("start"), F.col("n").alias("n")))).alias("spans"),
        F.collect_set(F.when(F.col("hit"), F.col("win_id"))).alias("wins"),
    )
    counted = by_doc.select("doc_id", "h", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), F.explode_outer("wins").alias("win_id"))
    named = counted.join(sent(windows.select("win_id", F.col("item_id").cast("string").alias("item"))), "win_id", "left")
    listed = named.groupBy("doc_id", "h", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return listed.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"), F.col("h").alias("text_hash"),
    )


def _covered(intervals: Column) -> Column:
    """How many positions a list of (start, n) covers together."""
    def step(a: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        return F.struct((a["sum"] + F.greatest(end - F.greatest(a["end"], x["start"]), F.lit(0))).alias("sum"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.array_sort(intervals), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), step, lambda a: a["sum"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any ``benchmark`` item occurs, columns and repeated rows unchanged.

    The report's flag asks for two items or more; here a passage of one item is enough to go.
    """
    found = staged(decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0").select(F.col("doc_id").alias(OWN + "id"), F.col("text_hash").alias(OWN + "h")))
    same = F.col("doc_id").eqNullSafe(F.col(OWN + "id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(OWN + "h"))
    return docs.join(found, same, "left_anti")
