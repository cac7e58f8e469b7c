import random
import unicodedata

import numpy as np

from callweave.llm import contamination as ct

R = random.Random(11)
SYL = [chr(0xAC00 + 28 * i + j) for i in range(0, 380, 3) for j in (0, 4)]
WORDS = ["".join(R.choice(SYL) for _ in range(R.randint(2, 4))) for _ in range(3000)]


def passage(n, r=R):
    return [r.choice(WORDS) for _ in range(n)]


def brute_matches(text, items, least):
    """All maximal common runs of at least ``least`` characters."""
    out = set()
    for t, item in enumerate(items):
        for p in range(len(text)):
            for q in range(len(item)):
                if p and q and text[p - 1] == item[q - 1] and text[p - 1] != "\0":
                    continue
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] != "\0":
                    n += 1
                if n >= least:
                    out.add((p, t, q, n))
    return out


def test_longest_matches_equal_brute_force():
    r = random.Random(2)
    for _ in range(12):
        items = ["".join(r.choice("abcd") for _ in range(r.randint(40, 60))) for _ in range(3)]
        text = "".join(r.choice("abcde") for _ in range(150)) + items[0][5:35] + "zz" + items[1] + "\0" + items[2][10:22]
        tests = ct.TestSet(list(enumerate(items)), 2)
        p, q, n = ct.longest_matches(ct._points(text + "\0"), tests)
        got = {(int(a), int(tests.item_of[b]), int(b - tests.start[tests.item_of[b]]), int(c)) for a, b, c in zip(p, q, n)}
        assert got == brute_matches(text, items, 8)


def test_suffix_array_is_in_order():
    text = ct._points("".join(random.Random(1).choice("ab") for _ in range(300)) + "\0")
    k = ct._keys(text.astype(np.int64), 2)
    before = np.concatenate([[0], text[:-1]]).astype(np.uint32)
    sa = ct.suffix_array(k, np.ones(1 << 22, dtype=bool), 2, before)
    s = [(bytes(text[i : i + 8].astype(np.uint8)), int(before[i])) for i in sa]
    assert s == sorted(s) and len(sa) == len(text) - 7


ITEM = passage(60)


def spoil(words, every=9, r=R):
    out = []
    for i, w in enumerate(words):
        if i % every == every - 1:
            out += r.choice([[w[:-1] + r.choice(SYL)], [], [w, "덧붙"]])
        else:
            out.append(w)
    return out


def run(spark, rows, docs, items=None):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, item bigint, d int")
    it = spark.createDataFrame(items or [(7, " ".join(ITEM), "x")], "item_id bigint, text string, doc string")
    return rows(ct.leaks(d, "doc_id", "text", it, "item_id", "text"), "doc", "item")


def test_altered_and_partial_passages(spark, rows):
    noise = lambda n: " ".join(passage(n))
    half, quarter = ITEM[10:44], ITEM[20:32]
    docs = [
        (1, noise(50) + " " + " ".join(ITEM) + ". " + noise(50)),
        (2, noise(30) + "\n".join(f"[00:{i:02d}] 신고자: " + " ".join(half[i : i + 6]) for i in range(0, len(half), 6)) + noise(9)),
        (3, unicodedata.normalize("NFD", "".join(half)).upper()),
        (4, noise(20) + " ".join(spoil(ITEM[5:50])) + noise(20)),
        (5, noise(20) + " ".join(quarter) + noise(20)),
        (6, " ".join(ITEM[:12]) + noise(80) + " ".join(ITEM[24:36]) + noise(80) + " ".join(ITEM[45:57])),
        (8, noise(300)),
        (9, None),
        (10, ""),
        (11, noise(200_000) + " " + " ".join(half)),
        (12, "<p>" + "</b> <b>".join(half) + "</p>"),
        (None, " ".join(ITEM)),
    ]
    assert run(spark, rows, docs) == [(1, 7), (11, 7), (12, 7), (2, 7), (3, 7), (4, 7)]


def test_dense_errors(spark, rows):
    """A whole item with a letter changed every 15, 19 or 25."""
    text = "".join(ITEM)
    docs = []
    for every in (15, 19, 25):
        letters = list(text)
        for i in range(every - 1, len(letters), every):
            letters[i] = "힣"
        docs.append((every, " ".join(passage(30)) + "".join(letters) + " ".join(passage(30))))
    assert run(spark, rows, docs) == [(15, 7), (19, 7), (25, 7)]


def test_a_text_that_repeats_itself_gives_few_pairs(monkeypatch):
    monkeypatch.setattr(ct, "PAIRS", 5_000)
    tests = ct.TestSet([(1, "가" * 200), (2, "가나" * 80)], 3)
    sizes, whole = [], ct._extended
    monkeypatch.setattr(ct, "_extended", lambda text, t, sa, r: (sizes.append(int(((r[:, 1] - r[:, 0]) * (r[:, 3] - r[:, 2])).sum())), whole(text, t, sa, r))[1])
    p, q, n = ct.longest_matches(ct._points("가" * 20_000 + "\0" + "가나" * 3_000 + "\0"), tests)
    assert sum(sizes) < 60_000 and max(sizes) <= 10_000 and n.max() == 200
    assert {(int(a), int(b)) for a, b in zip(p, q)} >= {(0, 0), (19_800, 0), (0, 100)}


def test_hashed_runs_equal_those_of_a_table():
    r = random.Random(4)
    for _ in range(30):
        item = "".join(r.choice("abc") for _ in range(60))
        text = "".join(r.choice("abc") for _ in range(40)) + item[7:33] + "z" + item[30:50]
        tests = ct.TestSet([(1, item)], 2)
        points = ct._points(text)
        got = ct.hashed_runs(ct._points(item), tests.rolls(0, 5), points, ct.rolling(points, 5), 5)
        assert got == ct.common_runs(ct._grams(item, 5), text, 5)


def test_the_test_set_is_made_ready_once():
    items = [(1, "".join(ITEM)), (2, "짧은 글")]
    a, b = ct.prepared(items, 3, 8), ct.prepared(items, 3, 8)
    assert a[0] is b[0] and a[1] is b[1] and ct.prepared(list(items), 3, 8)[1] is not a[1]


def test_empty_sides_and_repeats(spark, rows):
    assert run(spark, rows, [(1, " ".join(ITEM)), (1, " ".join(ITEM))]) == [(1, 7), (1, 7)]
    assert run(spark, rows, [(1, "x")], [(None, "a", "b"), (2, None, "b"), (3, " ", "c")]) == []
    assert run(spark, rows, []) == []


def test_blocks_of_items(spark, rows, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK_CHARS", 300)
    items = [passage(50, random.Random(i)) for i in range(6)]
    docs = [(i, " ".join(passage(20) + w[:40])) for i, w in enumerate(items)]
    assert run(spark, rows, docs, [(i, " ".join(w), "") for i, w in enumerate(items)]) == [(i, i) for i in range(6)]


def test_long_texts_take_linear_time():
    import time

    for text in ("<" * 300_000, " " * 500_000 + "b", "가" * 500_000, "\n" * 300_000, "1" * 300_000, "<br" * 100_000, "1 " * 200_000, "a: " * 100_000):
        began = time.time()
        ct.bare(text)
        assert time.time() - began < 5
