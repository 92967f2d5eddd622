"""Language identification with hyperdimensional profiles.

Every letter, whatever its script, has a random vector of +1 and -1. A trigram's vector binds its letters' vectors,
each permuted by its place; a text's vector is the sum of its trigrams' vectors, and a language's
prototype the sum of its documents' unit vectors. A text gets the language whose prototype has
the largest cosine with it.

Letters are lower-cased; anything else is a blank, and blanks in a row are one. Nulls and odd
input: a null text, one without a letter, or any text where nothing was learned, is ``und`` with
score 0; a negative cosine scores 0; equal cosines go to the language first in order; null
labels are not learned from; repeated rows are judged one by one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN

DIMS = 512
SEED = 97
#: Bits of a code point; a trigram is three of them side by side.
BITS = 21
_BLANK = 0


def letter_vectors(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each code point, drawn from its number and the seed alone, so that all machines agree."""
    blocks = np.arange(-(-dims // 64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + blocks * np.uint64(0xD1342543DE82EF95) + np.uint64(seed + 1) * np.uint64(0xBF58476D1CE4E5B9)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")[:, :dims]
    return bits.astype(np.float32) * 2 - 1


class Space:
    """The letter vectors and what is built from them; every code point has a vector of its own."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        self.dims, self.seed = dims, seed

    def symbols(self, text: str) -> np.ndarray:
        """Letters as their code points, blanks between, one at each end."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        out = np.where(letter, codes, _BLANK).astype(np.int64)
        keep = letter | np.concatenate(([True], letter[:-1]))
        return np.concatenate(([_BLANK], out[keep], [_BLANK]))

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, zero where it has no letter."""
        out = np.zeros((len(texts), self.dims), np.float32)
        counted = []
        for text in texts:
            s = self.symbols(text) if text else np.zeros(0, np.int64)
            if not s.any():
                counted.append(None)
                continue
            grams = (s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:]
            counted.append(np.unique(grams, return_counts=True))
        known = [c[0] for c in counted if c is not None]
        if not known:
            return out
        used = np.unique(np.concatenate(known))
        places = [used >> 2 * BITS, (used >> BITS) & ((1 << BITS) - 1), used & ((1 << BITS) - 1)]
        codes = np.unique(np.concatenate(places))
        drawn = letter_vectors(codes, self.dims, self.seed)
        # the permutation is a rotation, once for the middle letter and twice for the first
        bound = np.ones((len(used), self.dims), np.float32)
        for place, turn in zip(places, (2, 1, 0)):
            bound *= np.roll(drawn, turn, axis=1)[np.searchsorted(codes, place)]
        for i, c in enumerate(counted):
            if c is not None:
                out[i] = c[1].astype(np.float32) @ bound[np.searchsorted(used, c[0])]
        return out


@lru_cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _bundler(dims: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dims, seed), {}
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                v = _unit(space.vectors(part.column("text").to_pylist())).astype(np.float64)
                for lang, row in zip(part.column("lang").to_pylist(), v):
                    sums[lang] = sums.get(lang, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    return run


def learn(docs: DataFrame, dims: int = DIMS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their unit prototypes, from all rows of ``docs`` with a language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums: dict[str, np.ndarray] = {}
    for r in rows.select("lang", "text").mapInArrow(_bundler(dims, seed), "lang string, v array<double>").collect():  # a row for each task and language
        sums[r.lang] = sums.get(r.lang, 0) + np.array(r.v)
    names = sorted(k for k, v in sums.items() if np.any(v))
    return names, _unit(np.array([np.round(sums[k], 6) for k in names], np.float64).reshape(len(names), dims))


def _predictor(names: list[str], prototypes: np.ndarray, dims: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dims, seed)
        for batch in batches:
            langs, scores = [], []
            for i in range(0, len(batch), 256):
                v = space.vectors(batch.column("text").slice(i, 256).to_pylist())
                told = v.any(axis=1) & bool(names)
                cosine = _unit(v).astype(np.float64) @ prototypes.T if names else np.zeros((len(v), 1))
                best = cosine.argmax(axis=1)
                langs += [names[b] if t else "und" for b, t in zip(best, told)]
                scores += [float(min(max(cosine[k, b], 0.0), 1.0)) if t else 0.0 for k, (b, t) in enumerate(zip(best, told))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score; learned from the rows not held out."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    names, prototypes = learn(rows.filter(~F.col("held_out")), dims, seed)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predictor(names, prototypes, dims, seed), "doc_id long, held_out boolean, lang_pred string, score double")
