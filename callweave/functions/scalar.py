"""Scalar expressions: functions from columns to a column, all JVM-side except Unicode normalisation."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the target symptoms, the region's names and the words that hint at a speaker's role
SYMPTOMS = ["고열", "구토", "두통", "복통", "어지러움", "열상", "오심", "전신쇠약", "호흡곤란"]
REGION_NAMES = ["서울특별시", "서울시", "서울"]
ADDRESS_KEYS = ["address", "Address", "addr", "주소"]
DISPATCHER_WORDS = ["119입니다", "119상황실", "구급차 보냈습니다", "구급차를 보내", "주소 좀 알려주세요", "의식은 있으세요", "알겠습니다", "출동하겠습니다"]
REPORTER_WORDS = ["여보세요", "살려주세요", "도와주세요", "다쳤어요", "아파요", "숨을 못 쉬어요", "쓰러졌어요", "구급차 좀"]


def nul() -> Column:
    """The NUL character."""
    return F.decode(F.unhex(F.lit("00")), "UTF-8")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC; null stays null."""
    return s.str.normalize("NFC")


def contains_any(text: Column, words: Sequence[str], fold: bool = False) -> Column:
    """Whether the text contains one of the words; null text gives false."""
    t = F.lower(text) if fold else text
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w.lower() if fold else w)
    return F.coalesce(out, F.lit(False))


def squeeze(text: Column) -> Column:
    """Runs of white space of any script as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def prefix_token(text: Column, sep: str = "_") -> Column:
    return F.substring_index(text, sep, 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, r"[/\\]"), F.lit(-2))


def safe_path(path: Column) -> Column:
    """Relative and never upwards."""
    return F.coalesce(~path.startswith("/") & ~F.array_contains(F.split(path, r"[/\\]"), ".."), F.lit(False))


def join_path(root: Column, relative: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(root, "/+$", ""), F.regexp_replace(relative, "^(?:\\./|/)+", ""))


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(text.contains(w).cast("int"), F.lit(0))
    return out


def guess_role(text: Column, first: Sequence[str] = DISPATCHER_WORDS, second: Sequence[str] = REPORTER_WORDS, names=("dispatcher", "reporter")) -> Column:
    """The role with more keyword hits; the first on a tie; null without a hit."""
    a, b = keyword_hits(text, first), keyword_hits(text, second)
    return F.when((a >= b) & (a > 0), names[0]).when(b > 0, names[1])


def salted_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts with NUL between them."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    joined = cols[0]
    for c in cols[1:]:
        joined = F.concat(joined, nul(), c)
    return F.sha2(joined, 256)


def edge_hash(content: Column, n: int = 4096) -> Column:
    """SHA-256 of the first and last n characters or bytes."""
    size = F.length(content)
    return F.sha2(F.concat(F.substring(content, 1, n), F.substr(content, F.greatest(F.lit(1), size - (n - 1)), F.lit(n))), 256)


def list_hash(ids: Column) -> Column:
    """SHA-256 of a list of ids in order, one a line."""
    return F.sha2(F.array_join(F.sort_array(ids), "\n"), 256)


def sample_index(ms: Column, rate: int, size: Column | None = None) -> Column:
    """Milliseconds to a sample index, halves to even, clipped to [0, size]."""
    i = F.bround(ms / F.lit(1000.0) * F.lit(rate)).cast("bigint")
    i = F.greatest(F.lit(0).cast("bigint"), i)
    return i if size is None else F.least(i, size)


def seconds(start_ms: Column, end_ms: Column) -> Column:
    """Subtract in milliseconds, divide after."""
    return (end_ms - start_ms) / F.lit(1000.0)


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b; ``default`` where b is zero or either is missing."""
    r = F.try_divide(a, b)
    return r if default is None else F.coalesce(r, F.lit(default))


def bin_label(value: Column, edges: Sequence[float], last: str = "inf") -> Column:
    """``[lo,hi)`` of the half-open bin that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, [*edges[1:], None]))):
        inside = (value >= lo) if hi is None else (value >= lo) & (value < hi)
        out = F.when(inside, F.lit(f"[{lo:g},{last if hi is None else format(hi, 'g')})")).otherwise(out)
    return out


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def drift(label_end_ms: Column, duration_s: Column) -> Column:
    """Signed seconds by which the label's end lies after the recording's; null where either is missing."""
    return label_end_ms / F.lit(1000.0) - duration_s


def resampled_samples(intervals: Column, rate: int = 8000, factor: int = 2) -> Column:
    """Samples expected after resampling crops ``(s, e)`` in seconds."""
    n = F.aggregate(intervals, F.lit(0).cast("bigint"), lambda a, x: a + (F.bround(x["e"] * rate) - F.bround(x["s"] * rate)).cast("bigint"))
    return n * factor


def decibel(x: Column, floor: float = 1e-10) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(x, F.lit(floor)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def scale_clip(x: Column, shift: float = 80.0, width: float = 80.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + shift) / F.lit(width)))


def quantise(x: Column, levels: int = 255) -> Column:
    return F.bround(x * levels).cast("int")


def head_tail(items: Column, head: int = 255, tail: int = 255) -> Column:
    """The first and last items of a list longer than both together; else the list."""
    return F.when(F.size(items) <= head + tail, items).otherwise(F.concat(F.slice(items, 1, head), F.slice(items, -tail, tail)))


def first_items(items: Column, k: int = 510) -> Column:
    return F.slice(items, 1, k)


def join_token_lists(lists: Column, separator: Column) -> Column:
    """One list, the separator between the parts but not after the last."""
    return F.flatten(F.transform(lists, lambda x, i: F.when(i > 0, F.concat(F.array(separator), x)).otherwise(x)))


def count_value(items: Column, value) -> Column:
    return F.size(F.filter(items, lambda x: x == value))


def argmax_index(xs: Column) -> Column:
    """Zero-based place of the largest value, the first on a tie."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def pick_of_two(p: Column, names=("F", "M")) -> Column:
    """The second name only if its value is strictly greater."""
    return F.when(p[1] > p[0], names[1]).otherwise(names[0])


def one_of(value: Column, allowed: Sequence[str], other: str = "unknown") -> Column:
    return F.when(value.isin(list(allowed)), value).otherwise(other)


def error_type(truth: Column, predicted: Column) -> Column:
    """FN, FP or null where right."""
    return F.when((truth == 1) & (predicted == 0), "FN").when((truth == 0) & (predicted == 1), "FP")
