"""Problem 7: evaluation texts leaking into training text, by suffix arrays of the training text.

Texts are reduced to their letters and digits (NFKC, case folded), so layout, spacing, case, punctuation, markup and
character form do not matter. Documents are gathered into shards of some million characters. For each shard a suffix
array is built, in the order of the first ``seed`` characters and the one before, over the suffixes that can match at
all (each of the four quarters of the seed occurs somewhere in the test texts); every test suffix is looked up in it by
binary search, and each location found at which a match starts is extended to the longest verbatim match. Matches of at least ``seed`` characters whose sum
is too small for a case are dropped; for the rest an exact check chains all common runs of ``fine`` characters, in
order in both texts and with gaps of at most ``gap`` characters in either, which bridges marks, labels, typing errors
and changed words, but not other text. A document is a case if one chain covers ``share`` of the item.

The test set is broadcast in blocks of bounded size, each against all documents. A document is one row; a text above
a window is searched in windows that overlap by more than any item. Items shorter than two seeds are not looked up by
seeds: a table of their runs of ``fine`` characters gives every place in a text where one stands, and the same chain
check decides; an item shorter than ``fine`` counts where it stands whole.

Nulls: null or empty texts (of either side) and null ids give no row. Repeated documents give repeated rows. Empty
tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import durable

FOUND = "doc bigint, item bigint, coverage double, longest int, at bigint"
_MARKS = re.compile(r"[\W_]+")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
# what layouts put before a line: a time or date in brackets or before a bar, a speaker's label
_HEAD = re.compile(r"^\W*(?:\d[\d:.\-]*(?: +\d[\d:.]*)?s?\s*[\])>|]\s*)?(?:\[?\w{1,12}\]?\s?[:>](?=\s))?", re.M)
BITS = 12  # a character id; five fill a key
BLOCK_CHARS = 8 << 20
SHARD_CHARS = 3 << 20
BAND = 256
LOOSE = 0.65  # of the share, that runs of a seed have to cover before the exact check
PAIRS = 4 << 20
_PREPARED: dict[int, tuple] = {}


def bare(text: str) -> str:
    """Letters and digits only, NFKC and case folded; markup and what stands before lines taken out."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _MARKS.sub("", _HEAD.sub(" ", text).casefold())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _keys(ids: np.ndarray, step: int) -> np.ndarray:
    """The key of the ``step`` characters from each position on."""
    n = len(ids) - step + 1
    k = np.zeros(max(n, 0), dtype=np.int64)
    for j in range(step):
        k = (k << BITS) | ids[j : j + n]
    return k


def _slot(k: np.ndarray) -> np.ndarray:
    return ((k * np.int64(0x9E3779B97F4A7C1)) >> np.int64(38)) & np.int64((1 << 22) - 1)


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges [lo, hi), with the index of their range."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class TestSet:
    """The suffixes of a block of test texts, sorted by their first ``4 * step`` characters."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], step: int):
        self.step, self.ids = step, [i for i, _ in items]
        self.texts = [bare(t) for _, t in items]
        if any(len(t) < 8 * step for t in self.texts):
            raise ValueError("an item is too short for this seed")
        self.text = _points("\0".join(self.texts) + "\0")
        chars = np.unique(self.text[self.text > 0])
        self.table = np.zeros(0x110000, dtype=np.int16)  # character to id; 0 for one that no item has
        self.table[chars] = np.arange(len(chars)) % ((1 << BITS) - 1) + 1
        lengths = np.array([len(t) for t in self.texts])
        self.lengths = lengths
        self.start = np.cumsum(lengths + 1) - lengths - 1
        ids = self.table[self.text].astype(np.int64)
        k = _keys(ids, step)
        self.seen = np.zeros(1 << 22, dtype=bool)
        at = np.concatenate([s + np.arange(n - step + 1) for s, n in zip(self.start, lengths)])
        self.seen[_slot(k[at])] = True
        at = np.concatenate([s + np.arange(n - 4 * step + 1) for s, n in zip(self.start, lengths)])
        rows = np.stack([k[at + j * step] for j in range(4)], axis=1)
        before = self.text[at - 1]  # index -1 is the closing separator
        order = np.lexsort([before, *rows.T[::-1]])
        rows, self.suffixes, before = rows[order], at[order], before[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        self.prefixes = rows[new]  # distinct, in order
        # suffixes of one prefix and one character before it lie together
        part = new | np.concatenate([[True], before[1:] != before[:-1]])
        self.lo = np.flatnonzero(part)
        self.hi = np.concatenate([self.lo[1:], [len(rows)]])
        self.before = before[self.lo]
        self.prefix_of = np.cumsum(new)[self.lo] - 1
        self.item_of = np.repeat(np.arange(len(items)), lengths + 1)
        self.fine: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def rolls(self, n: int, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes of an item's runs of ``fine`` characters, in order; their bounds in the places; the places."""
        if n not in self.fine:
            h = rolling(self.text[self.start[n] : self.start[n] + self.lengths[n]], fine)
            at = np.argsort(h, kind="stable")
            u, first = np.unique(h[at], return_index=True)
            self.fine[n] = u, np.append(first, len(h)), at
        return self.fine[n]


def rolling(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` characters from each position on."""
    size = max(len(points) - n + 1, 0)
    h = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[j : j + size]
    return h


def _grams(text: str, n: int) -> dict[str, list[int]]:
    g: dict[str, list[int]] = {}
    for q in range(len(text) - n + 1):
        g.setdefault(text[q : q + n], []).append(q)
    return g


class ShortItems:
    """Test texts shorter than two seeds, found by their runs of ``fine`` characters, or as a whole below that."""

    def __init__(self, items: list[tuple[int, str]], fine: int):
        self.ids, texts = [i for i, _ in items], [bare(t) for _, t in items]
        self.lengths = [len(t) for t in texts]
        self.fine = [min(fine, n) for n in self.lengths]
        self.grams = [_grams(t, n) for t, n in zip(texts, self.fine)]
        self.holders: dict[int, dict[str, list[int]]] = {}  # by length of run: which items hold it
        for i, (n, grams) in enumerate(zip(self.fine, self.grams)):
            for g in grams:
                self.holders.setdefault(n, {}).setdefault(g, []).append(i)

    def search(self, doc: int, text: str, share: float, gap: int) -> list[tuple]:
        """Cases in one bare text."""
        hits: dict[int, list[int]] = {}
        for n, holders in self.holders.items():
            for p in range(len(text) - n + 1):
                for i in holders.get(text[p : p + n], ()):
                    hits.setdefault(i, []).append(p)
        out = []
        for i, at in hits.items():
            n, got, where, most = self.fine[i], 0, 0, 0
            # no chain bridges more than the gap, so what lies farther apart is looked at on its own
            for part in np.split(np.array(at), np.flatnonzero(np.diff(at) > n + gap) + 1):
                a = int(part[0])
                runs = common_runs(self.grams[i], text[a : int(part[-1]) + n], n)
                c, w = best_chain(runs, gap)
                most = max(most, *(r[2] for r in runs))
                if c > got:
                    got, where = c, a + w
            if got >= share * self.lengths[i]:
                out.append((doc, self.ids[i], got / self.lengths[i], most, where))
        return out


def suffix_array(k: np.ndarray, seen: np.ndarray, step: int, before: np.ndarray) -> np.ndarray:
    """Positions in the order of their first ``4 * step`` characters and then of the one before; those that can match no
    test text left out."""
    can = seen[_slot(k)]
    n = len(k) - 3 * step
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(can[:n] & can[step : n + step] & can[2 * step : n + 2 * step] & can[3 * step :])
    return at[np.lexsort([before[at], *[k[at + j * step] for j in (3, 2, 1, 0)]])]


def lower_bound(k: np.ndarray, sa: np.ndarray, queries: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For each query (four keys) the first index of the suffix array whose suffix is not below it, or, with
    ``strict``, above it: a binary search of all queries at once."""
    lo = np.zeros(len(queries), dtype=np.int64)
    hi = np.full(len(queries), len(sa), dtype=np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        pos = sa[np.minimum(mid, len(sa) - 1)]
        less = np.zeros(len(queries), dtype=bool)
        same = np.ones(len(queries), dtype=bool)
        for j in range(4):
            a = k[pos + j * step]
            less |= same & (a < queries[:, j])
            same &= a == queries[:, j]
        up = less | same if strict else less
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def _within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, strict: bool) -> np.ndarray:
    """In each range [lo, hi) of ``values``, sorted there, the first index whose value is not below ``wanted``, or, with
    ``strict``, above it."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = values[np.minimum(mid, len(values) - 1)]
        up = v <= wanted if strict else v < wanted
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def longest_matches(text: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every verbatim match of at least ``4 * step`` characters that can be extended to neither side: its place in the
    shard, its place in the test text, its length. A match starts where the characters before differ, so only suffixes
    of different ones are paired, however often a text repeats itself; they are extended in parts of bounded size."""
    step = tests.step
    k = _keys(tests.table[text].astype(np.int64), step)
    before = np.concatenate([[0], text[:-1]]).astype(np.uint32)
    sa = suffix_array(k, tests.seen, step, before)
    none = np.zeros(0, dtype=np.int64)
    if not len(sa):
        return none, none, none
    lo, hi = (lower_bound(k, sa, tests.prefixes, step, s) for s in (False, True))
    part = np.flatnonzero((hi > lo)[tests.prefix_of])
    lo, hi, mark = lo[tests.prefix_of[part]], hi[tests.prefix_of[part]], tests.before[part]
    # all that lies under the prefix but what the same character precedes; at the start of a text nothing does
    a, b = (_within(before[sa], lo, hi, mark, s) for s in (False, True))
    a, b = np.where(mark == 0, hi, a), np.where(mark == 0, hi, b)
    ranges = np.concatenate([np.stack([lo, a, tests.lo[part], tests.hi[part]], axis=1), np.stack([b, hi, tests.lo[part], tests.hi[part]], axis=1)])
    ranges = ranges[ranges[:, 1] > ranges[:, 0]]
    while (large := (ranges[:, 1] - ranges[:, 0] > 1) & ((ranges[:, 1] - ranges[:, 0]) * (ranges[:, 3] - ranges[:, 2]) > PAIRS)).any():
        left, right = ranges[large].copy(), ranges[large].copy()
        left[:, 1] = right[:, 0] = (left[:, 0] + left[:, 1]) >> 1
        ranges = np.concatenate([ranges[~large], left, right])
    if not len(ranges):
        return none, none, none
    size = (ranges[:, 1] - ranges[:, 0]) * (ranges[:, 3] - ranges[:, 2])
    cut = np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1
    found = [_extended(text, tests, sa, r) for r in np.split(ranges, cut)]
    p, q, n = (np.concatenate(x) for x in zip(*found))
    return p, q, n


def _extended(text: np.ndarray, tests: TestSet, sa: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches of all pairs in the ranges (of the suffix array; of the test suffixes)."""
    which, row = _spans(ranges[:, 0], ranges[:, 1])
    each, suffix = _spans(ranges[which, 2], ranges[which, 3])
    p, q = sa[row][each], tests.suffixes[suffix]
    n = np.zeros(len(p), dtype=np.int64)
    live = np.arange(len(p))
    while len(live):
        a, b = text[p[live] + n[live]], tests.text[q[live] + n[live]]
        live = live[(a == b) & (a != 0)]
        n[live] += 1
    real = n >= 4 * tests.step  # ids may stand for several characters where a block has more than fit
    return p[real], q[real], n[real]


def hashed_runs(item: np.ndarray, rolls: tuple[np.ndarray, np.ndarray, np.ndarray], region: np.ndarray, hashes: np.ndarray, fine: int) -> list[list[int]]:
    """As :func:`common_runs`, from hashes of runs; what hashes alike is compared, so the result is exact."""
    distinct, bounds, places = rolls
    i = np.minimum(np.searchsorted(distinct, hashes), len(distinct) - 1)
    at = np.flatnonzero(distinct[i] == hashes)
    which, k = _spans(bounds[i[at]], bounds[i[at] + 1])
    p, q = at[which], places[k]
    same = np.ones(len(p), dtype=bool)
    for j in range(fine):
        same &= region[p + j] == item[q + j]
    p, q = p[same], q[same]
    order = np.lexsort([p, p - q])
    p, q = p[order], q[order]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)])) if len(p) else p
    n = np.diff(np.concatenate([first, [len(p)]])) + fine - 1
    p, q = p[first], q[first]
    order = np.lexsort([q, p])
    return np.stack([p[order], q[order], n[order]], axis=1).tolist()


def common_runs(grams: dict[str, list[int]], region: str, fine: int) -> list[list[int]]:
    """The runs of at least ``fine`` characters that region and item share, in order of their place in the region."""
    runs: list[list[int]] = []  # place in region, place in item, length
    open_: dict[int, list[int]] = {}
    for p in range(len(region) - fine + 1):
        qs = grams.get(region[p : p + fine])
        if not qs:
            continue
        for q in qs:
            r = open_.get(p - q)
            if r is not None and r[0] + r[2] - fine + 1 == p:
                r[2] += 1
            else:
                r = [p, q, fine]
                open_[p - q] = r
                runs.append(r)
    return runs


def best_chain(runs: list[list[int]], gap: int) -> tuple[int, int]:
    """The most characters that runs (place in region, place in item, length; in order of the first) cover in one
    chain, in order in both and with gaps of at most ``gap`` in either; and where the chain begins."""
    best, where = 0, 0
    score: list[tuple[int, int]] = []
    first = 0
    reach = max((r[2] for r in runs), default=0) + gap
    for i, (p, q, n) in enumerate(runs):
        got, begin = n, p
        while runs[first][0] + reach < p:
            first += 1
        for j in range(first, i):
            a, b, m = runs[j]
            if b >= q or a >= p or p - a - m > gap or q - b - m > gap:
                continue
            shared = max(0, b + m - q, a + m - p)
            if score[j][0] + n - shared > got:
                got, begin = score[j][0] + n - shared, score[j][1]
        score.append((got, begin))
        if got > best:
            best, where = got, begin
    return best, where


def _in_band(pair: np.ndarray, band: np.ndarray, n: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each pair the most matched characters in one band of diagonals. ``pair`` is in order, ``edge`` its starts."""
    order = np.lexsort([band, pair])
    a, b, n = pair[order], band[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    sums = np.add.reduceat(n, first)
    return np.maximum.reduceat(sums, np.searchsorted(first, edge))


def search_shard(docs: list[tuple[int, str, int]], tests: TestSet, share: float, fine: int, gap: int) -> list[tuple]:
    """Cases among ``docs``: (id, bare text, offset of the text in its document)."""
    text = _points("\0".join(t for _, t, _ in docs) + "\0")
    p, q, n = longest_matches(text, tests)
    if not len(p):
        return []
    lengths = np.array([len(t) for _, t, _ in docs])
    starts = np.cumsum(lengths + 1) - lengths - 1
    doc, item = np.searchsorted(starts, p, side="right") - 1, tests.item_of[q]
    pair = doc * len(tests.ids) + item
    order = np.lexsort([p, pair])
    pair, p, q, n = pair[order], p[order], q[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    held = np.maximum(*(_in_band(pair, (p - q + o) // BAND, n, edge) for o in (0, BAND // 2)))
    most = np.maximum.reduceat(n, edge)
    ends = np.concatenate([edge[1:], [len(pair)]])
    out, hashes = [], None
    # one stretch lies in one band of diagonals, shifted only by what stands between its lines, so this drops no case
    # whose runs of a seed make ``LOOSE`` of its share there
    for e in np.flatnonzero(held >= LOOSE * share * tests.lengths[pair[edge] % len(tests.ids)]):
        d, i = divmod(int(pair[edge[e]]), len(tests.ids))
        runs = slice(edge[e], ends[e])
        own = p[runs] - starts[d]
        size, body = int(tests.lengths[i]), docs[d][1]
        seeds = [list(r) for r in zip(own.tolist(), (q[runs] - tests.start[i]).tolist(), n[runs].tolist())]
        if best_chain(seeds, 4 * gap)[0] < LOOSE * share * size:
            continue
        if hashes is None:
            hashes = rolling(text, fine)
        base, item = starts[d], tests.text[tests.start[i] : tests.start[i] + size]
        got, at = 0, 0
        # regions around the matches; far apart ones are looked at on their own
        for part in np.split(own, np.flatnonzero(np.diff(own) > 2 * size + gap) + 1):
            a, b = max(0, int(part[0]) - size), min(len(body), int(part[-1]) + 2 * size)
            c, w = best_chain(hashed_runs(item, tests.rolls(i, fine), text[base + a : base + b], hashes[base + a : max(base + a, base + b - fine + 1)], fine), gap)
            if c > got:
                got, at = c, a + w
        if got >= share * size:
            out.append((docs[d][0], tests.ids[i], got / size, int(most[e]), docs[d][2] + at))
    return out


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, share: float = 0.37, seed: int = 12, fine: int = 8, gap: int = 40) -> DataFrame:
    """``doc, item, coverage, longest, at`` for every document that holds ``share`` of an item as one stretch. The
    share is measured in verbatim runs of ``fine`` characters, so half an item with changes shows as less than half."""
    if seed % 4:
        raise ValueError("the seed must be a multiple of four")
    spark = docs.sparkSession
    tests = items.where(F.col(item_id).isNotNull() & (F.trim(F.coalesce(item_text, F.lit(""))) != "")).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    total = tests.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = total // BLOCK_CHARS + 1
    corpus = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    if blocks > 1:  # the corpus is read once a block: reduced once
        corpus = durable(corpus.mapInPandas(_reduced, "d bigint, t string"), "bare")
    out = None
    for b in range(blocks):
        block = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        rows = [(r["i"], r["t"]) for r in block.collect()]
        rows = [(i, t) for i, t in rows if bare(t)]
        if rows:
            found = corpus.mapInPandas(_searcher(spark.sparkContext.broadcast(rows), seed // 4, share, fine, gap, blocks == 1), FOUND)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"d": b["d"], "t": [bare(t) for t in b["t"]]})


def prepared(items: list[tuple[int, str]], step: int, fine: int) -> tuple[ShortItems | None, TestSet | None]:
    """The test texts made ready, once a worker and broadcast."""
    got = _PREPARED.get(id(items))
    if got is None or got[0] is not items or got[1] != (step, fine):
        short, long = [], []
        for i, t in items:
            (short if len(bare(t)) < 8 * step else long).append((i, t))
        _PREPARED.clear()
        got = _PREPARED[id(items)] = (items, (step, fine), ShortItems(short, fine) if short else None, TestSet(long, step) if long else None)
    return got[2], got[3]


def _searcher(shared, step: int, share: float, fine: int, gap: int, raw: bool):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        brief, tests = prepared(shared.value, step, fine)
        names = [c.split()[0] for c in FOUND.split(", ")]
        overlap = 4 * int(tests.lengths.max()) + gap if tests else 0
        window = max(1 << 20, 4 * overlap)
        held, chars = [], 0
        frame = lambda rows: pd.DataFrame(rows, columns=names)
        for batch in batches:
            for d, t in zip(batch["d"], batch["t"]):
                t = bare(t) if raw else t
                if brief and (found := brief.search(int(d), t, share, gap)):
                    yield frame(found)
                if tests is None or len(t) < 4 * step:
                    continue
                for a in range(0, max(1, len(t) - overlap), window - overlap):
                    part = t[a : a + window]
                    held.append((int(d), part, a))
                    chars += len(part)
                    if chars >= SHARD_CHARS:
                        if found := search_shard(held, tests, share, fine, gap):
                            yield frame(found)
                        held, chars = [], 0
        if held and (found := search_shard(held, tests, share, fine, gap)):
            yield frame(found)

    return search
