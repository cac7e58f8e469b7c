"""Connected components of records that share keys, without any group in one task or on the driver.

Each round hooks every record on the least record that shares a key with it, jumps the pointers (the hook of the hook)
until they reach roots, and contracts: links move to the roots, and keys that hold one root only are dropped with all
that is settled. So rounds run on ever fewer links; the pointers of the rounds are put together backwards, from the
smallest. Steps are cut with ``checkpoint()`` in the shared folder. A key that a third of all records share is one row
after the partial aggregation, and counts as many times as it has different roots; AQE splits its side of the join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import shared_dir


def _shared(links: DataFrame) -> DataFrame:
    """``_k`` and its least record ``_m``, for keys that at least two records have."""
    return links.groupBy("_k").agg(F.min("_r").alias("_m"), F.max("_r").alias("_x")).where("_m <> _x").select("_k", "_m")


def components(edges: DataFrame, record: str, key: str, max_rounds: int = 60) -> DataFrame:
    """``edges``: one row for each record and key; a record without a key has a null key. Rows with a null record
    are left out, repeated rows count once. Result: ``record`` and ``component``, its least record."""
    shared_dir(edges.sparkSession)
    e = edges.where(F.col(record).isNotNull()).select(F.col(record).alias("_r"), F.col(key).alias("_k"))
    links = e.where("_k is not null").distinct()
    rounds: list[DataFrame] = []
    for _ in range(max_rounds):
        # the least of the neighbours, with the links themselves kept to those that can still join anything
        live = links.join(_shared(links), "_k").checkpoint()
        if live.isEmpty():
            break
        hooks = live.groupBy("_r").agg(F.min("_m").alias("_l"))
        for _ in range(max_rounds):
            up = hooks.select(F.col("_r").alias("_t"), F.col("_l").alias("_to"))
            jumped = hooks.join(up, F.col("_l") == F.col("_t")).select("_r", F.col("_l").alias("_was"), F.col("_to").alias("_l")).checkpoint()
            hooks = jumped.select("_r", "_l")
            if jumped.where("_l <> _was").isEmpty():
                break
        rounds.append(hooks)
        links = live.select("_r", "_k").join(hooks, "_r").select(F.col("_l").alias("_r"), "_k").distinct()
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    total = None
    for hooks in reversed(rounds):
        if total is not None:
            up = total.select(F.col("_r").alias("_t"), F.col("_l").alias("_to"))
            hooks = hooks.join(up, F.col("_l") == F.col("_t"), "left").select("_r", F.coalesce("_to", "_l").alias("_l"))
        total = hooks
    every = e.select("_r").distinct()
    if total is None:
        return every.select(F.col("_r").alias(record), F.col("_r").alias("component"))
    return every.join(total, "_r", "left").select(F.col("_r").alias(record), F.coalesce("_l", "_r").alias("component"))
