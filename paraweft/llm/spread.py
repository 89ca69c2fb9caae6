"""Joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paraweft.scratch import Scratch

#: Rows of one key that one task takes.
MOST = 4_000
#: Hot keys up to which their list (some 40 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_HOT = 500_000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], scratch: Scratch, name: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``one``, which has at most one row for each of ``keys``; ``how`` is inner or left.

    Keys with more than ``MOST`` rows of ``many`` are counted first (with map-side
    sums). Their rows are dealt to as many parts as that needs by a hash of all
    their columns, and the one row is copied to each part. ``counted`` are rows of
    which each key has as many as ``many``, where those are cheaper to make; without
    it ``many`` is evaluated twice, so it should come from files.
    """
    n, parts, salt = "\x01n", "\x01parts", "\x01salt"
    hot = (many if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > MOST)
    hot = scratch.write(hot.select(*keys, F.ceil(F.col(n) / MOST).cast("int").alias(parts)), f"{name}-hot")
    found = hot.count()
    if not found:
        return many.join(one, keys, how)
    hot = F.broadcast(hot) if found <= BROADCAST_HOT else hot
    dealt = many.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    copied = one.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return dealt.join(copied, [*keys, salt], how).drop(salt)
