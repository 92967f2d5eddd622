"""Quality rules: decision lists learned by sequential covering, applied as Spark conditions.

``text_stats`` measures every text with built-in functions only. ``learn`` grows and prunes
ordered rules, each a conjunction of thresholds, from the statistics of labelled documents;
``verdict`` turns them into one ordered conditional expression.

Nulls and odd input: a null text counts as empty, has no words and fails the base rules; labels
that are null or name no document are left out; a document labelled several times counts once,
with its lowest quality; without labels of both kinds no rule is learned and only the base rules
hold. Repeated rows are judged one by one. Other columns are carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, SPACES, let, split_words, without

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Most labelled documents that a list is fitted on; more are thinned by a hash of doc_id.
MAX_LABELLED = 8192


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool


def _repeat_words(words: Column, size: int = 8) -> Column:
    """Words inside windows of ``size`` words that the text holds twice or more, each word once."""
    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))

    def covered(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(ranked, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True)), lambda x: x["i"])))
        spans = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))).cast("long")


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` under own names."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    words = split_words(F.col(text))
    stats = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words")))
    out = df.withColumn(OWN + "s", stats)
    values = {
        "n_words": F.col(OWN + "s")["n_words"],
        "word_chars": F.length(without(body, SPACES)).cast("long"),
        "n_symbols": (F.octet_length(body) - F.octet_length(without(body, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": F.col(OWN + "s")["n_repeat_words"],
        "n_distinct_words": F.col(OWN + "s")["n_distinct_words"],
    }
    return out.withColumns({OWN + k: v for k, v in values.items()}).drop(OWN + "s")


def base_failed() -> Column:
    return (F.col(OWN + "n_words") < 20) | (F.lit(100) * F.col(OWN + "n_repeat_words") > F.lit(30) * F.col(OWN + "n_words"))


def features() -> dict[str, Column]:
    """What conditions may test: sizes, and shares that do not depend on a text's length."""
    words = F.greatest(F.col(OWN + "n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col(OWN + "n_words").cast("double"),
        "mean_word": F.col(OWN + "word_chars") / words,
        "symbols_per_word": F.col(OWN + "n_symbols") / words,
        "repeat_share": F.col(OWN + "n_repeat_words") / words,
        "dup_lines_per_word": F.col(OWN + "n_dup_lines") / words,
        "distinct_share": F.col(OWN + "n_distinct_words") / words,
    }


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Statistics of at most about ``limit`` labelled documents, chosen by a hash of doc_id.

    The limit bounds only what the list is fitted on; every document is judged.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias(OWN + "q"))
    n = marks.count()
    if n > limit:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(limit / n * (1 << 20)))
    # at most about `limit` rows of two numbers: small enough for every executor
    docs = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    return text_stats(docs).select((F.col(OWN + "q") > 0).alias("good"), base_failed().alias("failed"), *[v.alias(k) for k, v in features().items()])


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_covered: int = 8, cuts: int = 64) -> list[Rule]:
    """Sequential covering: rules that reject, grown by FOIL gain on two thirds and pruned on the rest."""
    rules: list[Rule] = []
    if len(x) == 0 or not bad.any() or bad.all():
        return rules
    third = np.arange(len(x)) % 3 == 2
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1))) for j in range(len(names))]
    mids = [(g[1:] + g[:-1]) / 2 for g in grid]
    left = np.ones(len(x), dtype=bool)

    def holds(c: Condition) -> np.ndarray:
        v = x[:, names.index(c.feature)]
        return v > c.threshold if c.above else v <= c.threshold

    def covers(cs: list[Condition]) -> np.ndarray:
        return np.logical_and.reduce([holds(c) for c in cs]) if cs else np.ones(len(x), dtype=bool)

    def smoothed(mask: np.ndarray) -> float:
        return (bad[mask].sum() + 1) / (mask.sum() + 2)

    while len(rules) < max_rules and (bad & left).any():
        chosen: list[Condition] = []
        inside = left & ~third
        while len(chosen) < max_conditions and (bad[inside].mean() if inside.any() else 1) < 1:
            p, n = bad[inside].sum(), (~bad[inside]).sum()
            if not p:
                break
            base, best = np.log2(p / (p + n)), (1e-9, None)
            for j, name in enumerate(names):
                for above in (True, False):
                    for cut in mids[j]:
                        m = inside & (x[:, j] > cut if above else x[:, j] <= cut)
                        pm = bad[m].sum()
                        if pm and (gain := pm * (np.log2(pm / m.sum()) - base)) > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
            if best[1] is None:
                break
            chosen.append(best[1])
            inside &= holds(best[1])
        held = left & third
        while len(chosen) > 1:
            shorter = max(([c for c in chosen if c is not d] for d in chosen), key=lambda cs: smoothed(held & covers(cs)))
            if smoothed(held & covers(shorter)) < smoothed(held & covers(chosen)):
                break
            chosen = shorter
        mask = left & covers(chosen)
        if not chosen or (bad & mask).sum() < min_covered or bad[mask].mean() < min_precision:
            break
        rules.append(Rule(tuple(chosen), keep=False))
        left &= ~mask
    return rules


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labelled documents of ``docs``; those that the base rules fail are not learned from."""
    names = list(features())
    # at most about `limit` rows; failed ones go here, as a filter would move below the join and measure every text
    rows = [r for r in labelled_sample(docs, labels, limit).collect() if not r["failed"]]
    rows.sort(key=tuple)
    data = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(len(rows), len(names))
    order = np.random.default_rng(7).permutation(len(rows))
    return learn(data[order], np.array([not r["good"] for r in rows], dtype=bool)[order], names)


def verdict(rules: list[Rule]) -> Column:
    """One ordered conditional: the first rule whose conditions hold decides, the default keeps."""
    known, out = features(), F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule.conditions:
            test = test & (known[c.feature] > c.threshold if c.above else known[c.feature] <= c.threshold)
        out = F.when(test, F.lit(rule.keep)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with its statistics, ``base_failed`` and ``kept`` under own names."""
    stats = text_stats(docs)
    return stats.withColumn(OWN + "base_failed", base_failed()).withColumn(OWN + "kept", ~F.col(OWN + "base_failed") & verdict(rules))


def describe(rules: list[Rule]) -> list[str]:
    return ["IF " + " AND ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in r.conditions) + f" THEN {'keep' if r.keep else 'reject'}" for r in rules] + ["ELSE keep"]


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the statistics, base_failed and kept."""
    judged = judge(docs.select("doc_id", "text"), fit(spark, docs, labels))
    return judged.select("doc_id", *[F.col(OWN + c).alias(c) for c in (*BASE, "base_failed", "kept")])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the learned list keep, columns unchanged."""
    rules = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).filter(F.col(OWN + "kept")).select(*docs.columns)
