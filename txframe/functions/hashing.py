"""Murmur3 (32 bits) of one 32-bit number under any seed, in column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def _times(a: Column, k: int) -> Column:
    """a * k mod 2**32 for a in [0, 2**32), without overflow of 64 bits."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
    return (low * k + F.shiftleft((high * k).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _turn(a: Column, r: int) -> Column:
    return F.shiftleft(a, r).bitwiseAND(MASK).bitwiseOR(F.shiftright(a, 32 - r))


def murmur3_32(x: Column, seed: int) -> Column:
    """The public MurmurHash3 x86 32-bit function of a 4-byte little-endian integer, as a BIGINT."""
    k = _times(_turn(_times(x.cast("long").bitwiseAND(MASK), 0xCC9E2D51), 15), 0x1B873593)
    h = (_turn(F.lit(seed).cast("long").bitwiseXOR(k), 13) * 5 + 0xE6546B64).bitwiseAND(MASK).bitwiseXOR(F.lit(4).cast("long"))
    h = _times(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = _times(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))
