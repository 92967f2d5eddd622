"""What the text operators share: staging tables, let-bindings, word splitting, prefix sums."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.skew import hot_join, hot_keys, prefix_sums
from ..sources.shared import arrow_batches, discard, shared_dir, staged

__all__ = ["OWN", "SPACES", "UPPER", "arrow_batches", "discard", "hot_join", "hot_keys", "let", "prefix_sums", "shared_dir", "split_words", "staged", "without"]

#: The white space that ends a word, and the ASCII letters that are lowered.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Columns the operators add while they work start with this, so that they never clash with a caller's.
OWN = "__txf_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """Maximal runs without white space; null text has none."""
    plain = reduce(lambda e, c: F.replace(e, F.lit(c), F.lit(" ")), SPACES[1:], F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(plain, " "), "")


def without(text: Column, chars: str) -> Column:
    """``text`` without the given characters."""
    return reduce(lambda e, c: F.replace(e, F.lit(c), F.lit("")), chars, text)

