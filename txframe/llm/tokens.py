"""Token counts by scanning flat token files for end-of-document identifiers.

``write_tokens`` puts the token ids of each task's documents end to end in a file of 16-bit
numbers, an end-of-document id after each, and no index. ``count_tokens`` splits every file into
blocks, finds the separators of each block in one vectorised comparison, and stitches documents
that cross blocks by a prefix scan over the blocks: how many separators, and the last one's
place, before each block.

Nulls and odd input: null and empty texts have 0 tokens and still a separator; special tokens'
strings in a text are ordinary text; repeated rows are counted one by one; an empty table has
no documents. A tokenizer whose ids do not fit 16 bits is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged
from .files import opened, written_whole

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
BLOCK_BYTES = 4 << 20
WIDTH = 2
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _writer(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        if max(end, encode.max_token_value) >= 1 << 8 * WIDTH:
            raise ValueError("token ids do not fit the file's width")
        uri, n = f"{folder}/tokens-{TaskContext.get().partitionId():06d}.bin", 0
        done: list[pa.RecordBatch] = []
        with written_whole(uri) as out:
            for batch in batches:
                texts = batch.column("text")
                for i in range(len(batch)):
                    ids = encode.encode_ordinary(texts[i].as_py() or "")
                    out.write(np.array([*ids, end], dtype="<u2").tobytes())
                k = len(batch)
                made = pa.RecordBatch.from_arrays([pa.array([uri] * k, pa.string()), pa.array(np.arange(n, n + k)), batch.column("doc_id")], ["file", "ordinal", "doc_id"])
                n += k
                done.append(made)  # three small columns
        yield from done

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Writes the flat files; gives (file, ordinal, doc_id), which the files themselves do not hold."""
    return staged(docs.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end), "file string, ordinal long, doc_id long"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uris = batch.column("file").to_pylist()
        sizes = [fs.get_file_info(path).size for fs, path in map(opened, uris)]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], ["file", "bytes"])


def _scanner(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris, starts, sizes = (batch.column(c).to_pylist() for c in ("file", "start", "length"))
            found = []
            for uri, start, length in zip(uris, starts, sizes):
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(length, start), dtype="<u2")
                found.append(np.flatnonzero(ids == end) + start // WIDTH)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), lists], ["file", "start", "ends"])

    return run


def count_tokens(files: DataFrame, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the files named in ``files`` (file): file, ordinal, n_tokens."""
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    sized = files.select("file").distinct().mapInArrow(_sizes, "file string, bytes long")
    blocks = sized.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))).alias("start"))
    blocks = blocks.select("file", "start", F.least(F.lit(block_bytes), F.col("bytes") - F.col("start")).alias("length")).repartition(parts, "file", "start")
    found = staged(blocks.mapInArrow(_scanner(end), "file string, start long, ends array<long>"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "start", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    scanned = summary.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.last("last", ignorenulls=True).over(earlier), F.lit(-1)).alias("before"))
    joined = found.join(scanned, ["file", "start"])
    lengths = F.transform("ends", lambda x, i: F.struct((F.col("base") + i).alias("ordinal"), (x - F.when(i == 0, F.col("before")).otherwise(F.get("ends", i - 1)) - 1).alias("n_tokens")))
    return joined.select("file", F.explode(lengths).alias("d")).select("file", "d.ordinal", "d.n_tokens")


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Per row of ``docs``: doc_id and n_tokens, as found in the flat files."""
    order = write_tokens(docs, shared_dir(spark), tokenizer, end)
    return order.join(count_tokens(order, end), ["file", "ordinal"]).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
