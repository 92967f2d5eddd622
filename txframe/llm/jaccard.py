"""N-gram Jaccard join by MinHash banding, with every candidate pair verified on whole shingle sets.

1. Each text gets the set of its five-word shingles as 64-bit numbers, a digest of the set, and
   one number for each band of MinHash rows. Texts with equal sets are one class.
2. Classes are shuffled on band numbers. Buckets of one class go; buckets with the same members
   are kept once.
3. Members of a bucket are dealt into blocks, and pairs of blocks are compared exactly on the
   full sets, so that a bucket of any size is spread over tasks and no list of pairs is made. A
   pair that meets in several buckets counts in the first of them.
4. Links become connected components by repeated minimum labels.

Words are runs without ASCII white space. A text of one to four words has one shingle, all of
it. Nulls and odd input: a null text, or one without words, links to nothing and is its own
class; a null doc_id takes part like any other, its class is named by the least doc_id that is
not null; repeated rows count as copies of each other. One row is returned for each input row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, SPACES, arrow_batches, discard, hot_join, hot_keys, staged

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
#: Classes, and shingles, in a block of a bucket.
BLOCK = 256
BLOCK_SHINGLES = 250_000
#: Bytes of text that are cut in words at once (or one text), and rows and bytes of a batch for a worker.
PIECE = 1 << 20
BATCH = (2_000, 4 << 20)
#: Classes whose texts are looked up by a broadcast of their rows; more are joined by a shuffle.
BROADCAST_PICKS = 100_000
#: Vocabulary columns that are multiplied at once.
CHUNK = 4096

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int


def choose_banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 192) -> Banding:
    """The most selective banding of at most ``most`` hash rows that finds a pair at the threshold with ``recall``."""
    fits = [Banding(b, r) for r in range(1, 17) for b in range(1, most // r + 1) if 1 - (1 - threshold**r) ** b >= recall]
    r = max(x.rows for x in fits)
    return min((x for x in fits if x.rows == r), key=lambda x: x.bands)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the texts that lie end to end in ``data``, and the index of its text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    # mod 2**64 the sum of (byte + 1) * base**position over a word, shifted to start at position 0
    with np.errstate(over="ignore"):
        powers = np.full(n, _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        back = np.full(n, inverse, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        raw = (sums[ends] - sums[starts]) * back[starts]
        numbers = _mixed(raw + (ends - starts).astype(np.uint64) * _M1)
    return numbers, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle numbers; empty for null texts and those without words."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = pa.concat_arrays([texts.fill_null(b"")])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):  # a piece at a time, so that memory follows the longest text
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        cut = offsets[first : last + 1] - offsets[0]
        numbers, doc = _word_numbers(data[cut[0] : cut[-1]], cut - cut[0])
        bounds = np.searchsorted(doc, np.arange(last - first + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            w = numbers[a:b]
            with np.errstate(over="ignore"):
                size = min(words, len(w))
                s = np.full(max(len(w) - size + 1, 0) if size else 0, size, np.uint64)
                for k in range(size):
                    s = s * _BASE + w[k : k + len(s)]
                yield np.unique(_mixed(s))
        first = last


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of a piece of text, or one row, each."""
    for batch in batches:
        size = np.cumsum(pa.compute.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + PIECE, "right")))
            yield batch.slice(first, last - first)
            first = last


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sketcher(banding: Banding, words: int):
    rng = np.random.default_rng(1729)
    n = banding.bands * banding.rows
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    salt = np.arange(1, banding.bands + 1, dtype=np.uint64)

    def bands(s: np.ndarray) -> np.ndarray:
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(s), 2048):
                np.minimum(least, (a[:, None] * s[None, i : i + 2048] + b[:, None]).min(axis=1), out=least)
            out = salt.copy()
            for k in range(banding.rows):
                out = _mixed(out * _BASE + least.reshape(banding.bands, banding.rows)[:, k])
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            keys, sizes, found = [], [], []
            for s in shingle_sets(part.column("text"), words):
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sizes.append(len(s))
                found.append(bands(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), _lists(found)], ["doc_id", "h", "key", "n", "bands"])

    return run


def _shingler(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), words)]
            yield pa.RecordBatch.from_arrays([part.column("key"), _lists(sets)], ["key", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|A & B| for each pair of ``left`` and ``right`` sets, by products of 0/1 blocks of the shared vocabulary."""
    out = np.zeros((len(left), len(right)), np.float32)
    sizes = [len(s) for s in sets]
    if not sum(sizes):
        return out
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    held = shared[column]
    row, column = row[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for i in range(0, int(shared.sum()), CHUNK):
        a, b = np.searchsorted(column, (i, i + CHUNK))
        block = np.zeros((len(sets), CHUNK), np.float32)
        block[row[a:b], column[a:b] - i] = 1
        out += block[left] @ block[right].T
    return out


def compare(bucket: int, rows: list[tuple], diagonal: bool, threshold: float) -> list[tuple]:
    """Links of one pair of blocks. rows: (side, key, copies, buckets, shingles); gives (key, links, texts, root)."""
    rows.sort(key=lambda r: r[1])
    side = np.array([r[0] for r in rows])
    left = np.arange(len(rows)) if diagonal else np.flatnonzero(side == 0)
    right = left if diagonal else np.flatnonzero(side == 1)
    if len(left) == 0 or len(right) == 0 or len(rows) < 2:
        return []
    sizes = np.array([len(r[4]) for r in rows], np.float64)
    both = _overlaps([r[4] for r in rows], left, right).astype(np.float64)
    linked = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9
    if diagonal:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    earlier = [r[3][r[3] < bucket] for r in rows]
    new = linked & (_overlaps(earlier, left, right) == 0)
    copies = np.array([r[2] for r in rows], np.int64)
    links, texts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    links[left] += new @ copies[right]
    texts[left] += new.sum(axis=1)
    if not diagonal:
        links[right] += new.T @ copies[left]
        texts[right] += new.sum(axis=0)
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    near[np.ix_(left, right)] = linked
    near |= near.T
    np.fill_diagonal(near, True)
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before, label = label, np.where(near, label[None, :], len(rows)).min(axis=1)
    found = near.sum(axis=1) > 1
    return [(rows[i][1], int(links[i]), int(texts[i]), rows[label[i]][1]) for i in np.flatnonzero(found)]


def _comparer(threshold: float):
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("texts", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []

        def flush() -> None:
            if at is not None and len(rows) > 1:
                out.extend(compare(at[0], rows, at[1] == at[2], threshold))
            rows.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(4)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "key", "copies")]
            own, shingles = (batch.column(c) for c in ("buckets", "shingles"))
            own_at, sh_at = own.offsets.to_numpy(), shingles.offsets.to_numpy()
            own_v, sh_v = own.values.to_numpy(), shingles.values.to_numpy()
            for k, (bucket, i, j, block, key, copies) in enumerate(zip(*ids)):
                if (bucket, i, j) != at:
                    flush()
                    at = (bucket, i, j)
                rows.append((int(block == j and i != j), key, copies, own_v[own_at[k] : own_at[k + 1]].copy(), sh_v[sh_at[k] : sh_at[k + 1]].copy()))
            if len(out) > 4096:
                yield batch_of()
        flush()
        yield batch_of()

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): per node the least node it reaches, as (node, label).

    Each round takes the least label among neighbours and then jumps to that label's own label,
    so rounds grow with the logarithm of the longest chain. Every round is a written table. Nodes
    with many neighbours, and labels that many nodes have, are joined apart (see ``hot_join``).
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(both, ["b"])
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = hot_join(both, of, ["b"], hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = staged(labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = staged(hot_join(step, ahead, ["label"]).select("node", "old", F.least("label", "far").alias("label")))
        discard(labels, step)
        labels = after
        if after.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")


def _linked(docs: DataFrame, threshold: float, words: int, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows of ``docs``, and per class of equal sets its numbers, its pick (a row, null doc_id last) and the label of its component."""
    text = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    banding = choose_banding(threshold, recall)
    spark = docs.sparkSession
    with arrow_batches(spark, *BATCH):
        sketches = staged(text.mapInArrow(_sketcher(banding, words), "doc_id long, h long, key binary, n long, bands array<long>"))
    per_key = sketches.filter(F.col("key").isNotNull()).groupBy("key")
    classes = staged(per_key.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("pick"), F.max(F.struct("n", "bands")).alias("s")).select("key", "first_id", "copies", "pick", "s.n", "s.bands"))

    spread = classes.select("key", "n", F.explode("bands").alias("bucket"))
    met = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter("members > 1")
    kept = met.groupBy("members", "total", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "members", "total")
    members = staged(spread.select("key", "bucket").join(kept, "bucket"))
    own = members.groupBy("key").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))  # one for each band at most

    # one row of each class that shares a bucket, and its text
    picks = staged(classes.join(own.select("key"), "key", "left_semi").select("key", F.col("pick.doc_id").alias("p_id"), F.col("pick.h").alias("p_h")))
    few = picks.count() <= BROADCAST_PICKS
    texts = text.join(F.broadcast(picks) if few else picks, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h"))).select("key", "text")
    with arrow_batches(spark, *BATCH):
        sets = staged(texts.mapInArrow(_shingler(words), "key binary, shingles array<long>"))
    whole = staged(own.join(sets.dropDuplicates(["key"]), "key").join(classes.select("key", "copies"), "key"))
    discard(sets)

    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key")
    pairs = dealt.join(whole, "key").select("bucket", "i", "j", "block", "key", "copies", "buckets", "shingles")
    pairs = pairs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    with arrow_batches(spark, *BATCH):
        found = staged(pairs.mapInArrow(_comparer(threshold), "key binary, links long, texts long, root binary"))
    discard(whole, members, picks)

    linked = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    edges = found.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()
    labels = components(edges)
    named = staged(classes.select("key", "first_id", "copies", "pick").join(linked, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")))
    return sketches, named


def ngram_jaccard(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, copy_id, n_copies, n_links, n_texts and text_hash.

    class_id is the least doc_id of all that links reach, copy_id that of the texts with an
    equal shingle set; n_links counts the other rows at the threshold or over, n_texts the other
    classes of equal sets among them.
    """
    sketches, named = _linked(docs, threshold, words, recall, block)
    least = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = hot_join(named, least, ["label"]).select("key", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), "class_id")
    out = hot_join(sketches.select("doc_id", "h", "key"), named, ["key"], "left")
    return out.select(
        "doc_id", F.coalesce("class_id", F.when(F.col("key").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce("first_id", F.when(F.col("key").isNull(), F.col("doc_id"))).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"), F.col("h").alias("text_hash"),
    )


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the least doc_id, then the least text hash; columns unchanged.

    A row with a null doc_id stays only where its class has no other. Repeats of the kept row (same
    doc_id and text) give one row. A text without words is a class of its own: all with a null
    doc_id stay, and repeats of a doc_id and text give one row.
    """
    sketches, named = _linked(docs.select("doc_id", "text"), THRESHOLD, WORDS, RECALL, BLOCK)
    chosen = named.groupBy("label").agg(F.min("pick").alias("pick")).select("pick.doc_id", "pick.h")
    wordless = sketches.filter("key IS NULL AND doc_id IS NOT NULL").select("doc_id", "h").distinct()
    kept = staged(chosen.unionByName(wordless).select(F.col("doc_id").alias(OWN + "id"), F.col("h").alias(OWN + "h")))
    alone = F.col("doc_id").isNull() & (F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))) == 0)
    hashed = docs.filter(~alone).withColumn(OWN + "t", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(OWN + "id")) & (F.col(OWN + "t") == F.col(OWN + "h"))
    joined = hashed.join(kept, same)
    return joined.dropDuplicates(["doc_id", OWN + "t"]).select(*docs.columns).unionByName(docs.filter(alone))
