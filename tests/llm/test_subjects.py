import random

import pytest

from callweave.llm import subjects as sj

TERMS = {
    "law": ["계약서", "항소심", "판결문", "변호인", "조례안"],
    "food": ["굴무침", "떡볶이", "조리법", "간장통", "미역국"],
    "sport": ["결승전", "감독진", "트랙장", "휘슬음", "준비운동"],
}
EN = {"law": ["ordinance", "verdict", "plaintiff"], "food": ["noodle", "stew", "kitchen"], "sport": ["referee", "marathon", "podium"]}
COMMON = ["회의가 한 번 더 열렸다", "사진을 붙였다고 적혀 있다", "자료를 다시 모았다고 한다"]
NEUTRAL = ["월요일 오후 상가 계단에서 노인이 넘어졌다", "이웃은 맥이 약하다고 했고 산소를 맞췄다", "접수자는 옆으로 눕히라고 안내했다"]


def document(r, subject, english=False):
    if english:
        own = [f"The {r.choice(EN[subject])} and the {r.choice(EN[subject])} came up again" for _ in range(4)]
        rest = [f"A neighbour slipped on the stairs at number {r.randint(1, 99)}" for _ in range(4)]
    else:
        own = [f"{r.choice(TERMS[subject])} {r.choice(TERMS[subject])} {r.choice(COMMON)}" for _ in range(4)]
        rest = [r.choice(NEUTRAL) for _ in range(4)]
    if r.random() < 0.3:
        rest[0] = "모두가 한 팀처럼 움직였다"
    s = own + rest
    r.shuffle(s)
    return ". ".join(s) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    names = sorted(TERMS)
    docs = [(i, names[i % 3]) for i in range(360)]
    rows = [(i, document(r, s, i % 5 == 0), s, "w") for i, s in docs]
    d = spark.createDataFrame([*rows, (1000, None, "", ""), (1001, "", "", ""), (None, "x", "", ""), (1002, " ".join(NEUTRAL * 400), "", ""), (1003, ". ".join(NEUTRAL), "", "")], "doc_id bigint, text string, doc string, w string")
    lab = spark.createDataFrame([(i, s) for i, s in docs[:180]] + [(0, "unheard of"), (None, "law")], "doc_id bigint, subject string")
    return d, lab, dict(docs), names


def test_held_out_accuracy(spark, corpus):
    d, lab, truth, names = corpus
    bag, model = sj.topic_model(d, "doc_id", "text", lab, names, bits=12)
    assert sorted(x for x in model.subject_of if x >= 0) == [0, 1, 2]
    got = {(r.doc, r.subject) for r in sj.assign(bag, model).collect()}
    held = {(i, s) for i, s in truth.items() if i >= 180}
    hit = len({x for x in got if 180 <= x[0] < 1000} & held)
    assert hit / len(held) > 0.95 and hit / len({x for x in got if 180 <= x[0] < 1000}) > 0.95
    assert not {x for x in got if x[0] >= 1000}
    assert {sj.word_id("항소", 12), sj.word_id("verdict", 12)} & set(model.top_terms(names.index("law")).tolist())


def test_no_labels_and_no_documents(spark, corpus):
    d, lab, _, names = corpus
    assert sj.topic_model(d.limit(5), "doc_id", "text", lab.limit(0), names)[1] is None
    bag, model = sj.topic_model(d.where("doc_id >= 1000"), "doc_id", "text", lab.where("doc_id > 1"), names, bits=12)
    assert sj.assign(bag, model).count() == 0
    bag, model = sj.topic_model(d.limit(0), "doc_id", "text", lab, names, bits=12)
    assert sj.assign(bag, model).count() == 0


def test_bags_hold_the_words_of_the_sentences(spark):
    import numpy as np

    text = "비가 왔다. 비가 12 왔다. the wind rose again. no. ab"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = sj.bags(d, "doc_id", "text").first()
    ws = [sj.words(s) for s in sj.sentences(text)]
    ws = [x for x in ws if len(x) >= 3]
    assert np.frombuffer(r.n, np.uint32).tolist() == [len(x) for x in ws] == [3, 3, 4]
    assert np.frombuffer(r.w, np.uint16).tolist() == [sj.word_id(x) for y in ws for x in y]


def test_label_sample_is_bounded_and_stable(spark, corpus):
    _, lab, _, names = corpus
    a = sj.label_sample(lab, "doc_id", "subject", names, 50)
    assert len(a) == 50 and a == sj.label_sample(lab.repartition(7), "doc_id", "subject", names, 50)


def test_sentences():
    assert sj.sentences("출동 보고 12\n비가 왔다.눈이 왔다\n값은 12.5도였다. End.") == ["비가 왔다", "눈이 왔다", "값은 12.5도였다", " end"]
    assert sj.sentences("<p>하나 둘 셋&nbsp;넷<br/>다섯 여섯</p>") == ["하나 둘 셋 넷", "다섯 여섯"]
    assert sj.sentences("문이 열렸다  차가 섰다  법보다 주먹이 가깝다") == ["문이 열렸다", "차가 섰다", "법보다 주먹이 가깝다"]
    long = "skies cleared once the trough moved east and the wind dropped over the bay The kitchen served hot pot"
    assert len(sj.sentences(long)) == 1
    assert sj.sentences(long, frozenset(["The"])) == [long[: long.index(" The")], "the kitchen served hot pot"]
    assert len(sj.sentences(long.upper(), frozenset(["THE"]))) == 1
    text = "비가 왔다. 눈이 왔다. 바람이 불었다. 해가 떴다. 달이 떴다."
    assert sj.sentences("\n".join(text[i : i + 8] for i in range(0, len(text), 8))) == sj.sentences(text)
    assert sj.sentences("비가 왔다\n눈이 왔다\n해가 났다고 한다") == ["비가 왔다", "눈이 왔다", "해가 났다고 한다"]
    assert sj.words("가나 다 ab c") == ["가나", "나다", "ab"]


def test_openers_are_mined(spark):
    """Words that stand after end marks; names inside sentences, and words seen too rarely, are none."""
    t = [("Then we saw Dalbit. Later we went to Noeul. The end",), ("It rained. The wind fell on Dalbit. Once more",), (None,), ("",)] * 6 + [("x. Rarely so",)]
    d = spark.createDataFrame(t, "text string")
    assert sj.mine_openers(d, "text") == {"Later", "The", "Once"}
    assert sj.mine_openers(d.limit(0), "text") == frozenset()


def test_sums_in_two_levels(spark):
    import numpy as np

    r = np.random.default_rng(1)
    tables = [r.random((3, 2 * sj.BLOCK)) for _ in range(12)]
    rows = [(b, t[:, b * sj.BLOCK : (b + 1) * sj.BLOCK].tobytes()) for t in tables for b in (0, 1)]
    d = spark.createDataFrame(rows, "block int, v binary").repartition(6)
    for ways in (2, 64):
        assert np.allclose(sj._summed(d, (3, 2 * sj.BLOCK), ways), sum(tables))


def test_a_dimension_is_taken_whole_or_refused(spark):
    d = spark.range(1001).selectExpr("cast(id as string) as subject")
    with pytest.raises(ValueError):
        sj.closed_set(d, "subject")
    assert len(sj.closed_set(d, "subject", 1001)) == 1001 and sj.closed_set(d.where("id > 998").union(spark.sql("select null")), "subject") == ["1000", "999"]


@pytest.mark.parametrize("text", ["<" * 300_000, "a " * 200_000 + " " * 300_000 + "b", "가" * 500_000, "\n" * 300_000, "1" * 300_000, "<br" * 100_000, "다 " * 200_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.time()
    sj.sentences(text, frozenset(["The"]))
    assert time.time() - began < 5
