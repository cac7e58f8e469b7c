"""Arrays as signals: crop, pad, trim, windows, pre-emphasis; built-in higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop(a: Column, start: Column, end: Column) -> Column:
    """Samples [start, end), clipped to the array; empty if reversed."""
    n = F.size(a)
    s, e = F.least(F.greatest(start, F.lit(0)), n), F.least(F.greatest(end, F.lit(0)), n)
    return F.slice(a, (s + 1).cast("int"), F.greatest(e - s, F.lit(0)).cast("int"))


def pad(a: Column, n: int, where: str = "end") -> Column:
    """Zeros added up to n samples, at the end, the start or both (the odd one at the end)."""
    k = F.greatest(F.lit(n) - F.size(a), F.lit(0))
    before = {"end": F.lit(0), "start": k, "center": F.floor(k / 2).cast("int")}[where]
    zero = F.array_repeat(F.lit(0).cast("float"), before)
    return F.concat(zero, a, F.array_repeat(F.lit(0).cast("float"), k - before))


def trim(a: Column, n: int, where: str = "end") -> Column:
    """The first, last or middle n samples: ``where`` names the side that is cut off."""
    k = F.greatest(F.size(a) - F.lit(n), F.lit(0))
    first = {"end": F.lit(0), "start": k, "center": F.floor(k / 2).cast("int")}[where]
    return F.slice(a, first + 1, F.lit(n))


def pad_or_trim(a: Column, n: int, where: str = "end") -> Column:
    return F.when(F.size(a) < n, pad(a, n, where)).otherwise(trim(a, n, where))


def pre_emphasis(a: Column, c: float = 0.97) -> Column:
    return F.transform(a, lambda x, i: F.when(i == 0, x.cast("double")).otherwise(x - F.lit(c) * F.get(a, i - 1)))


def frame_starts(n: Column, length: int, hop: int) -> Column:
    """Starts of whole frames; a signal shorter than one frame has one."""
    return F.sequence(F.lit(0), F.floor(F.greatest(n - length, F.lit(0)) / hop).cast("int") * hop, F.lit(hop))


def window_starts(n: Column, length: int, stride: int, drop_last: bool = False) -> Column:
    """Starts of sliding windows: stop once the end is reached; the last one is padded, or dropped if too short."""
    whole = F.floor(F.greatest(n - length, F.lit(0)) / stride).cast("int")
    more = F.when(n > whole * stride + length, whole + 1).otherwise(whole)
    last = whole if drop_last else more
    none = F.array().cast("array<int>")
    return F.when((n <= 0) | (F.lit(drop_last) & (n < length)), none).otherwise(F.sequence(F.lit(0), last * stride, F.lit(stride)))


def windows(a: Column, length: int, stride: int, drop_last: bool = False) -> Column:
    """The windows themselves, each of full length."""
    return F.transform(window_starts(F.size(a), length, stride, drop_last), lambda s: pad(F.slice(a, s + 1, F.lit(length)), length))


def pooled(a: Column, bins: int) -> Column:
    """Means of ``bins`` stretches between boundaries rint(i * n / bins); an empty stretch takes its boundary's value."""
    n = F.size(a)
    at = lambda i: F.bround(i * n / F.lit(float(bins))).cast("int")

    def mean(i):
        lo = F.least(at(i), n - 1)
        hi = F.greatest(at(i + 1), lo + 1)
        part = F.slice(a, lo + 1, hi - lo)
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / (hi - lo)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), mean))
