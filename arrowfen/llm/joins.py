"""Joins with tables of one row for each key, which may be small or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table that is broadcast at most; a larger one is joined by key, each key dealt over so many tasks.
BROADCAST_BYTES, SALTS = 32 << 20, 32


def beside(rows: DataFrame, few: DataFrame, payload: Column, keys: list[str], how: str = "left", most: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``few``, a stored table with distinct ``keys`` that hold no nulls; ``payload`` is a row's bytes.

    Its size is measured: if all is small it is broadcast. Otherwise each of
    its rows is copied to so many salts, and ``rows`` are dealt over them, so a
    key that holds many of them is shared by many tasks.
    """
    size = few.agg(F.sum(payload + 16)).first()[0] or 0
    if size <= most:
        return rows.join(F.broadcast(few), keys, how)
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, "salt"], how).drop("salt")
