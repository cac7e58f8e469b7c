"""Problem 6: filling fixed-capacity containers with items, by variable-capacity best fit.

Best fit decreasing needs only how many items there are of each length, and lengths are whole numbers up to the
largest capacity. So the plan is made on that histogram (at most ``max(sizes)`` rows, whatever the corpus) in ranges:
bins that look alike are one entry, and an item is placed by its rank within its length. Items then find their bin by
a join on length; ranks come from bucketed windows, so a length that a third of all items share is spread.

All permitted sizes are planned jointly: where no open bin has room, the size is opened that costs least for each
token it is expected to hold, and in the end every bin is cut down to the smallest size that holds its contents.

The plan is bounded by the capacity, whatever the corpus. A length opens at most one group of bins and splits at most one
into three, so there are at most three groups a length. Filling a group to the full leaves less than half its room, so
that happens to it at most log2(capacity) + 1 times; a group filled in part ends its length, with two placements. So a
plan has at most ``bound(capacity)`` placements and three bins rows a length: broadcasting both has a proven bound.

An item above the largest capacity is divided into full containers and a remainder; no other item is. An item of
length 0 (null or empty text) takes no room and gets a row with a null container. Repeated ids are items of their own.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.ordered import running_count

PLAN = "length bigint, rank_lo bigint, rank_hi bigint, bin_lo bigint, per_bin bigint, offset bigint"
BINS = "bin_lo bigint, bin_hi bigint, used bigint, size bigint"


@dataclass
class Group:
    """Bins ``lo`` to ``hi`` (exclusive) that look alike."""

    lo: int
    hi: int
    size: int
    used: int

    @property
    def room(self) -> int:
        return self.size - self.used


def plan(histogram: dict[int, int], sizes: list[int], cost: Callable[[int], float]) -> tuple[list[tuple], list[tuple]]:
    """Placements (see PLAN) and bins (see BINS) for ``histogram``: length to number of items."""
    sizes = sorted(sizes)
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    rooms: list[int] = []  # the distinct rooms of open groups, in order
    by_room: dict[int, list[Group]] = {}
    closed: list[Group] = []
    places: list[tuple] = []
    bins = 0

    def add(g: Group) -> None:
        if g.hi <= g.lo:
            return
        if not g.room:
            closed.append(g)
        elif g.room in by_room:
            by_room[g.room].append(g)
        else:
            by_room[g.room] = [g]
            insort(rooms, g.room)

    def fill(g: Group, n: int, rank: int, count: int) -> int:
        """Puts up to ``count`` items of length n into the group's bins, each as full as it gets; how many went."""
        per = g.room // n
        full = min(g.hi - g.lo, count // per)
        if full:
            places.append((n, rank, rank + full * per, g.lo, per, g.used))
            add(Group(g.lo, g.lo + full, g.size, g.used + per * n))
        done, lo = full * per, g.lo + full
        if lo < g.hi and done < count:
            rest = count - done
            places.append((n, rank + done, rank + count, lo, rest, g.used))
            add(Group(lo, lo + 1, g.size, g.used + rest * n))
            done, lo = count, lo + 1
        add(Group(lo, g.hi, g.size, g.used))
        return done

    def expected_use(size: int, n: int) -> int:
        """What a bin opened for length n will hold if the longest lengths still to come fill it up."""
        used = size // n * n
        k = bisect_left(lengths, n)
        while True:
            k = min(k, bisect_left(lengths, size - used + 1))
            if k == 0:
                return used
            k -= 1
            used += lengths[k] * min((size - used) // lengths[k], left[lengths[k]])

    for n in reversed(lengths):
        count, rank = left[n], 0
        while rank < count:
            k = bisect_left(rooms, n)
            if k < len(rooms):
                room = rooms[k]
                g = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            else:
                size = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / expected_use(s, n), -s))
                need = -(-(count - rank) // (size // n))
                g = Group(bins, bins + need, size, 0)
                bins += need
            rank += fill(g, n, rank, count - rank)
    closed += [g for gs in by_room.values() for g in gs]
    return places, [(g.lo, g.hi, g.used, next(s for s in sizes if s >= g.used)) for g in sorted(closed, key=lambda g: g.lo)]


def bound(capacity: int) -> int:
    """The most placements that a plan can have: see above."""
    return 3 * capacity * (capacity.bit_length() + 1) + 2 * capacity


def pack(items: DataFrame, id: str, length: str, sizes: list[int], overhead: float = 16.0, rows_per_bucket: int = 200_000) -> DataFrame:
    """``id, piece_no, piece_start, n_tokens, sequence_id, sequence_length, offset``: where every item, or piece of one
    above ``max(sizes)``, lies. ``overhead``: what opening a container costs, in units of length. ``items`` is read
    twice: hand over a stored table."""
    spark = items.sparkSession
    top = max(sizes)
    n = F.coalesce(F.col(length).cast("bigint"), F.lit(0))
    pieces = items.select(
        F.col(id).alias("id"), n.alias("_n"), F.posexplode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(top).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))
    ).select("id", F.col("pos").alias("piece_no"), F.col("col").alias("piece_start"), F.least(F.col("_n") - F.col("col"), F.lit(top)).alias("n_tokens"))
    histogram = {r["n_tokens"]: r["c"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()}
    places, bins = plan(histogram, sizes, lambda s: s + overhead)
    assert len(places) <= bound(top) and len(bins) <= 3 * top + 1
    rows = sum(histogram.values())
    space = 1 << 40
    width = max(1, space // max(1, rows // rows_per_bucket + 1))
    ranked = running_count(
        pieces.where("n_tokens > 0").withColumn("_h", F.pmod(F.xxhash64("id", "piece_no"), F.lit(space))), ["n_tokens"], "_h", F.lit(1), "_rank", width, ["id", "piece_no"]
    ).withColumn("_rank", F.col("_rank") - 1)
    p = F.broadcast(spark.createDataFrame(places, PLAN))
    at = F.col("_rank") - F.col("rank_lo")
    placed = ranked.join(p, (F.col("n_tokens") == F.col("length")) & (F.col("_rank") >= F.col("rank_lo")) & (F.col("_rank") < F.col("rank_hi"))).select(
        "id",
        "piece_no",
        "piece_start",
        "n_tokens",
        (F.col("bin_lo") + F.floor(at / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("offset") + at % F.col("per_bin") * F.col("n_tokens")).alias("offset"),
    )
    # groups of bins that look alike are ranges: the one with the largest start at or below the bin is the bin's own
    ends, size_of = [b[1] for b in bins], [b[3] for b in bins]
    shared = spark.sparkContext.broadcast((ends, size_of))

    @F.pandas_udf("bigint")
    def size(b):
        import numpy as np

        e, s = map(np.asarray, shared.value)
        return type(b)(s[np.searchsorted(e, b.to_numpy(), side="right")])

    none = pieces.where("n_tokens = 0").select(
        "id", "piece_no", "piece_start", "n_tokens", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("sequence_length")
    )
    return placed.withColumn("sequence_length", size("sequence_id")).unionByName(none).withColumnRenamed("id", id)
