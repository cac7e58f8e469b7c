import random

from callweave.llm import contamination as ct


def _brute(text, item, fine, gap):
    """The most characters of the item that runs of ``fine`` cover in one chain, over all pairs of runs."""
    n = min(fine, len(item))
    runs = []
    for p in range(len(text)):
        for q in range(len(item)):
            if p and q and text[p - 1] == item[q - 1]:
                continue
            m = 0
            while p + m < len(text) and q + m < len(item) and text[p + m] == item[q + m]:
                m += 1
            if m >= n:
                runs.append([p, q, m])
    return ct.best_chain(runs, gap)[0]


def test_short_items_are_searched_beside_long_ones(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(1, word(200)), (2, word(39)), (3, word(20)), (4, word(8)), (5, word(5)), (6, word(1) + "1"), (7, word(30)), (8, "--")]
    text = dict(items)
    docs = [
        (10, word(80) + text[1][20:160] + word(50)),
        (11, word(60) + text[2] + word(60) + text[7][:10] + "zz" + text[7][12:25]),
        (12, text[3][:9]),
        (13, "x " + text[4] + " y " + text[5]),
        (14, word(100)),
        (15, text[6]),
        (16, text[7][:9] + word(41) + text[7][20:]),
        (17, None),
    ]
    i, d = spark.createDataFrame(items, "i bigint, t string"), spark.createDataFrame(docs, "d bigint, t string")
    got = {(x.doc, x.item): x for x in ct.leaks(d, "d", "t", i, "i", "t").collect()}
    want = {}
    for a, t in docs:
        for b, s in items[1:-1]:
            c = _brute(ct.bare(t or ""), s, 8, 40)
            if c >= 0.37 * len(s):
                want[a, b] = c / len(s)
    assert {(11, 2), (11, 7), (12, 3), (13, 4), (13, 5), (15, 6)} <= want.keys()
    assert {k: x.coverage for k, x in got.items() if k[1] != 1} == want and [k for k in got if k[1] == 1] == [(10, 1)]
    assert got[11, 2].longest == 39 and got[11, 2].at == 60
    only = ct.leaks(d, "d", "t", i.where("i between 2 and 7"), "i", "t")
    assert {(x.doc, x.item) for x in only.collect()} == want.keys()
