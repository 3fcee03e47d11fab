"""Joins against a lookup table when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a lookup that are broadcast; keys below the share 1 / HOT_KEYS go through the shuffle.
HOT_KEYS = 10_000


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per key) that no hot key can slow down.

    ``weight`` is the lookup column with the number of rows a key has. Keys with at least one 10,000th of all
    rows are at most 10,000, whatever the input, so these are broadcast. The rows they resolve travel through
    the shuffle of the second join under ``spread`` instead of their key and match nothing there. ``keys`` must
    be binary columns. Null keys match nothing.
    """
    values = [c for c in lookup.columns if c not in keys]
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_KEYS >= F.lit(total)
    first = lookup.where(hot).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_found"))
    out = rows.join(F.broadcast(first), keys, "left")
    apart = F.when(F.col("_found"), F.concat(F.lit(b"spread"), spread.cast("string").cast("binary")))
    for k in keys:
        out = out.withColumn(f"_key_{k}", F.coalesce(apart, F.col(k)))
    cold = lookup.where(~hot).select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(c).alias(f"_cold_{c}") for c in values])
    out = out.join(cold, [f"_key_{k}" for k in keys], "left")
    return out.select(*rows.columns, *[F.when(F.col("_found"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values])


SIEVE = 1 << 20


def sieve(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows that can have their ``key`` in ``wanted``: a cheap filter before a join that moves wide rows.

    Keys are hashed to 2**20 cells; the list of used cells has a bounded size and is broadcast. Rows may pass
    without a match, none with a match is lost.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    return rows.join(F.broadcast(wanted.select(cell.alias("_cell")).distinct()), cell == F.col("_cell"), "left_semi")
