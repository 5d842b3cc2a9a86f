"""Code-point spans of regular-expression matches with built-in functions.

Spark has no function that returns match positions. ``split`` gives the gaps
between the matches and ``regexp_extract_all`` the matches, both leftmost and
non-overlapping, so a match starts where the gaps and matches before it end.
The running sum is taken over blocks of 256 matches, then inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def match_lengths(text: Column, regex: str) -> Column:
    """array<struct<gap, hit, length>>: the gap before each match, the match."""
    gaps = F.transform(F.split(text, regex, -1), lambda p: F.length(p))
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return F.filter(
        F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"), F.length(h).alias("length"))),
        lambda x: x["hit"].isNotNull(),
    )


def with_starts(matches: Column) -> Column:
    """array<struct<hit, start, end>> from ``match_lengths``.

    ``matches`` must be a stored column (not an expression): it is read for
    every element.
    """
    n_blocks = F.floor(F.size(matches) / _BLOCK).cast("int")
    sums = F.transform(
        F.sequence(F.lit(0), n_blocks),
        lambda b: _total(F.transform(F.slice(matches, b * _BLOCK + 1, F.lit(_BLOCK)), lambda x: x["gap"] + x["length"])),
    )

    def one(x: Column, i: Column, before: Column) -> Column:
        b = F.floor(i / _BLOCK).cast("int")
        inner = F.transform(F.slice(matches, b * _BLOCK + 1, i - b * _BLOCK), lambda y: y["gap"] + y["length"])
        start = _total(F.slice(before, F.lit(1), b)) + _total(inner) + x["gap"]
        return F.struct(x["hit"].alias("hit"), start.alias("start"), (start + x["length"]).alias("end"))

    # the block sums are computed once per row: bound to a lambda variable
    return F.flatten(F.transform(F.array(sums), lambda before: F.transform(matches, lambda x, i: one(x, i, before))))
