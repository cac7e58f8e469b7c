import math
import random
from collections import Counter

from callweave.operators import text


def _brute(docs, n, lo, hi, min_df, size):
    tf = {i: Counter(t[a : a + k] for k in range(lo, hi + 1) for a in range(len(t) - k + 1)) for i, t in docs}
    df, cf = Counter(g for c in tf.values() for g in c), sum(tf.values(), Counter())
    kept = sorted((g for g in df if df[g] >= min_df), key=lambda g: (-cf[g], g))[:size]
    out = {}
    for i, c in tf.items():
        w = {g: (1 + math.log(c[g])) * (math.log((1 + n) / (1 + df[g])) + 1) for g in kept if g in c}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(i, g): x / norm for g, x in w.items()}
    return out


def _documents():
    r = random.Random(5)
    return [(i, "".join(r.choice("가나다라abc 😀") for _ in range(n))) for i, n in enumerate([0, 1, 3, 400, 700, 900, 1500])]


def test_document_tfidf_covers_whole_documents(spark, tmp_path):
    from callweave.queries.all import QUERIES

    docs = _documents()
    spark.createDataFrame([*docs, (90, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r[0], r[1]): r[2] for r in QUERIES["document_tfidf"](spark, str(tmp_path)).collect()}
    want = _brute(docs, len(docs) + 1, 2, 5, 2, 150_000)
    assert got.keys() == want.keys() and {len(g) for _, g in got} == {2, 3, 4, 5}
    assert len({g for _, g in got}) == len({g for _, g in want}) and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_char_tfidf_cuts_the_vocabulary_by_count_then_term(spark):
    docs = _documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r[0], r[1]): r[2] for r in text.char_tfidf(df, "doc_id", "text", 2, 4, 2, 100).collect()}
    want = _brute(docs, len(docs), 2, 4, 2, 100)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert text.char_tfidf(df.where("false"), "doc_id", "text").collect() == []


def test_vectors_hold_the_same_weights(spark):
    data = [(1, "가나다 가나라 abc"), (2, "가나다 abcd"), (3, None), (4, ""), (5, "zq")]
    d = spark.createDataFrame(data, "doc_id bigint, text string")
    long = text.char_tfidf(d, "doc_id", "text", 2, 3, 2, 50).collect()
    terms = sorted({r.term for r in long})
    got = {r.doc_id: r.features for r in text.char_tfidf_vectors(d, "doc_id", "text", 2, 3, 2, 50).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and all(v.size == len(terms) for v in got.values())
    for i, v in got.items():
        assert {terms[k]: round(float(x), 9) for k, x in zip(v.indices, v.values)} == {r.term: round(r.weight, 9) for r in long if r.doc_id == i}
    assert text.char_tfidf_vectors(d.limit(0), "doc_id", "text").count() == 0
