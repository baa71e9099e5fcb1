"""Deterministic pseudo-random columns: a function of key, tag and seed only.

The same row draws the same value in any partitioning, on any retry and in any engine that
has MD5.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(key: Column, tag: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), key.cast("string")))


def _hex(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def _name(tag: str, draw: int) -> str:
    return f"_u_{tag.replace('.', '_')}_{draw}"


def with_draws(df: DataFrame, key: str, seed: int, draws: Mapping[str, int]) -> DataFrame:
    """Adds uniform values in [0, 1) with 32 random bits: up to four per tag, from one digest.

    As columns they are computed once per row, however often an expression uses them.
    """
    digests = {f"_md5_{_name(tag, 0)}": _digest(F.col(key), tag, seed) for tag in draws}
    values = {
        _name(tag, i): _hex(F.col(f"_md5_{_name(tag, 0)}"), 1 + 8 * i, 8) / F.lit(4294967296.0)
        for tag, n in draws.items() for i in range(n)
    }
    return df.withColumns(digests).withColumns(values).drop(*digests)


def drawn(tag: str, draw: int = 0) -> Column:
    """A value added by :func:`with_draws`."""
    return F.col(_name(tag, draw))


def hash60(key: Column, tag: str, seed: int) -> Column:
    """Non-negative 60-bit integer."""
    return _hex(_digest(key, tag, seed), 1, 15)


def pick_index(u: Column, n: int | Column) -> Column:
    """Uniform index 0..n-1."""
    return F.floor(u * n).cast("int" if isinstance(n, int) else "bigint")


def pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), pick_index(u, len(values)) + 1)


def pick_weighted(u: Column, weighted: list[tuple[object, float]]) -> Column:
    """First value whose cumulative weight reaches ``u``; the last one is the remainder."""
    total = sum(w for _, w in weighted)
    chain, reached = F, 0.0
    for value, weight in weighted[:-1]:
        reached += weight
        chain = chain.when(u < F.lit(round(reached / total, 12)), value)
    return chain.otherwise(weighted[-1][0])
