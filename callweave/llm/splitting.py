"""Problem 1: splitting oversized items at natural boundaries, by balanced targets.

An item is a list of segments ``[start, end)``; its length is the speech in it, pauses not counted. A segment longer
than the limit is cut on its own into equal pieces with the given overlap. The runs of whole segments between those
are cut like this: the piece count starts at ``ceil(total / limit)``; equal-length targets are placed; each target is
snapped to the strongest boundary (the longest pause) near it among those that leave the rest within the limit; if
the limit fails, a piece is added. A boundary is admissible only if the pieces that remain can hold what remains, so
the count is the least possible.

Nulls: an item whose segment list is null or holds no valid pair gives no piece. Pairs with a null, or an end not
after the start, are left out; repeated pairs count once; ties in start are ordered by end. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("piece_start", T.LongType()),
            T.StructField("piece_end", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("n_segments", T.IntegerType()),
            T.StructField("cut", T.BooleanType()),
        ]
    )
)


def segments_from_json(col: str) -> Column:
    """The valid pairs of a JSON text ``[[start, end], ...]``, distinct, in order of start and end."""
    pairs = F.from_json(F.col(col), "array<array<bigint>>")
    ok = F.filter(pairs, lambda p: (F.size(p) == 2) & F.coalesce(p[1] > p[0], F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(ok, lambda p: F.struct(p[0].alias("s"), p[1].alias("e")))))


def merged(df: DataFrame, key: str, segments: Column) -> DataFrame:
    """``key`` and the ``segments`` of all its rows together, distinct and in order: several rows of one item are one
    item. An item's segments are one row; a null list adds none."""
    rows = F.array_sort(F.array_distinct(F.flatten(F.collect_list(segments))))
    return df.groupBy(key).agg(rows.alias("segments"))


def cut_runs(lengths: list[int], strength: list[int], limit: int) -> list[int]:
    """Where to cut a run of items, each of at most ``limit``: indexes after which a cut falls, as few as possible.
    ``strength[i]`` is that of the boundary after item i."""
    m = len(lengths)
    prefix = [0]
    for x in lengths:
        prefix.append(prefix[-1] + x)
    total = prefix[-1]
    n = max(1, math.ceil(total / limit))
    while True:
        back = [m]  # back[k]: the first item from which k pieces can hold the rest
        for _ in range(n):
            back.append(bisect_left(prefix, prefix[back[-1]] - limit, 0, back[-1] + 1))
        if back[n] == 0:
            break
        n += 1
    cuts: list[int] = []
    at = 0
    for i in range(1, n):
        low, high = max(back[n - i], at + 1), bisect_right(prefix, prefix[at] + limit) - 1
        high = min(high, m - (n - i))
        target = total * i / n
        near = [j for j in range(low, high + 1) if abs(prefix[j] - target) <= limit / 4]
        if near:
            j = max(near, key=lambda j: (strength[j - 1], -abs(prefix[j] - target), -j))
        else:
            j = min(range(low, high + 1), key=lambda j: (abs(prefix[j] - target), j))
        cuts.append(j)
        at = j
    return cuts


def split_segments(segments: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple]:
    """All pieces of one item, in order: (no, start, end, length, segments in it, cut inside a segment)."""
    out: list[tuple] = []

    def flush(run: list[tuple[int, int]]) -> None:
        if not run:
            return
        pause = [max(0, run[i + 1][0] - run[i][1]) for i in range(len(run) - 1)] + [0]
        lengths = [e - s for s, e in run]
        edges = [0, *cut_runs(lengths, pause, limit), len(run)]
        for a, b in zip(edges, edges[1:]):
            out.append((len(out) + 1, run[a][0], max(e for _, e in run[a:b]), sum(lengths[a:b]), b - a, False))

    run: list[tuple[int, int]] = []
    for s, e in segments:
        if e - s <= limit:
            run.append((s, e))
            continue
        flush(run)
        run = []
        n = 1 + math.ceil((e - s - limit) / (limit - overlap))
        each = math.ceil((e - s + (n - 1) * overlap) / n)
        for i in range(n):
            a = s + i * (each - overlap)
            b = min(e, a + each)
            out.append((len(out) + 1, a, b, b - a, 1, True))
    flush(run)
    return out


def pieces(df: DataFrame, key: str, segments: Column, limit: int = 15_000, overlap: int = 1_000) -> DataFrame:
    """``key`` and one row for each piece. ``segments``: an array of structs (s, e). One item is one row, so rows
    spread over tasks as the scan does and nothing is shuffled."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")

    @F.pandas_udf(PIECES)
    def cut(col: pd.Series) -> pd.Series:
        names = [f.name for f in PIECES.elementType]
        return pd.Series(
            [
                [] if x is None else [dict(zip(names, p)) for p in split_segments([(int(y["s"]), int(y["e"])) for y in x], limit, overlap)]
                for x in col
            ],
            dtype=object,
        )

    return df.select(F.col(key), F.explode(cut(segments)).alias("p")).select(key, "p.*")


def piece_counts(df: DataFrame, key: str, segments: Column, limit: int = 15_000, overlap: int = 1_000) -> DataFrame:
    """``key`` and ``n_pieces``, 0 where there is nothing to cut."""
    keys = df.select(key).distinct()
    counted = pieces(df, key, segments, limit, overlap).groupBy(key).agg(F.count(F.lit(1)).alias("n_pieces"))
    return keys.join(counted, key, "left").select(key, F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"))
