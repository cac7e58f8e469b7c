import datetime

from callweave.llm import transcripts as tr

S = "call_id string, id string, startAt bigint, endAt bigint, text string, speaker string, loaded_at timestamp, role string, spoken string"
T = datetime.datetime(2031, 1, 1)


def frame(spark, data):
    return spark.createDataFrame([(c, i, a, b, t, s, T, "x", "y") for c, i, a, b, t, s in data], S)


def test_roles_words_and_turns(spark, rows):
    d = frame(
        spark,
        [
            ("c", "1", 0, 10, "[00:00] 상담원: 네", None),
            ("c", "2", 20, 30, "음~ 아아...", "1"),
            ("c", "3", 40, 50, "(경적) 어, 여기 {쿵} 맞아요 ㅠㅠ", " 1 "),
            ("c", "4", 60, 70, "00:00:00 민원인 -  *음악* 빨리요", "?"),
            ("c", "5", 80, 90, "몰라요", "unknown"),
            ("c", "6", 100, 110, "119>   [침묵 3초]", "0"),
            ("c", "7", 120, 130, "신고자： 도와 주세요", "0"),
            ("c", "7", 120, 130, " 신고자： 도와 주세요 ", "0"),
            ("c", "8", 140, 135, "뒤집힘", "1"),
            ("c", "9", None, 150, "시간 없음", "1"),
            ("c", "10", 160, 170, None, "1"),
            ("e", "11", 0, 5, "네", "SPK0"),
        ],
    )
    assert rows(tr.turn_starts(d)) == [("c", "1", "dispatcher"), ("c", "3", "reporter"), ("c", "5", "unknown"), ("c", "7", "dispatcher"), ("e", "11", "dispatcher")]
    t = rows(tr.turns(d), "call_id", "turn_no", "n_lines", "turn_text")
    assert t == [("c", 1, 1, "네"), ("c", 2, 2, "여기 맞아요 빨리요"), ("c", 3, 1, "몰라요"), ("c", 4, 1, "도와 주세요"), ("e", 1, 1, "네")]


def known(spark, lines):
    """Lines with units, as mining takes them."""
    d = frame(spark, lines)
    return tr.with_units(d.selectExpr("startAt", "trim(text) as _text", "speaker").withColumn("_side", tr.side_of("speaker")))


def roles(d, call):
    return [r[0] for r in tr.turn_starts(d).where(f"call_id = '{call}'").orderBy("first_id").select("role").collect()]


def unseen(n=400):
    """Lines in layouts whose times and labels no list holds."""
    out = []
    for i in range(n):
        side = i % 2
        mark = ("{%ds}" % i, f"~{i}.0~", "", "")[i // 2 % 4]
        label = (("op#", "zz#"), ("창구 )", "민원 )"), ("", ""))[i % 3][side]
        out.append(("c", f"{i:04d}", i * 1000, i * 1000 + 900, f"{mark} {label} 말씀 드려요", str(side)))
    return out


def test_layouts_are_mined(spark, rows):
    """Label and time forms that no list names are found from the lines' own sides and times."""
    lines = unseen()
    tails = [("{12s} op# 네", None), ("zz# 네", "?"), ("창구 ) 네", ""), ("{77s} 민원 ) 네", "-1"), ("{9s} 네", "1"), ("~3.0~ zz#", "0")]
    lines += [("d", f"{i}", 100_000 * i, 100_000 * i + 50, t, s) for i, (t, s) in enumerate(tails)]
    d = frame(spark, lines)
    assert roles(d, "d") == ["dispatcher", "reporter", "dispatcher", "reporter"]  # of the last two one goes on, one has no word
    texts = rows(tr.clean_lines(d).where("call_id = 'd'"), "id", "spoken")
    assert texts == [(str(i), "네") for i in range(5)]
    found = {r["_keys"][0]: r["kinds"][0] for r in tr.mine_layouts(known(spark, lines)).collect()}
    assert found["{0s}"] == found["~0.0~"] == "time" and found["op#"] == "dispatcher" and found["민원)"] == "reporter"


def test_without_mining_unseen_labels_are_lost(spark, monkeypatch):
    monkeypatch.setattr(tr, "mine_layouts", lambda lines: lines.sparkSession.createDataFrame([], "_keys array<string>, kinds array<string>"))
    d = frame(spark, unseen() + [("d", "0", 5, 9, "op# 네", None)])
    assert roles(d, "d") == ["unknown"]


def test_a_layout_is_a_path_with_wildcards_for_rare_units(spark):
    lines = [("c", f"{i:04d}", i * 1000, i * 1000 + 900, f"[{i // 60:02d}:{i % 60:02d}] 상담원: 네", "0") for i in range(60)]
    lines += [("c", f"x{i}", i * 1000 + 500, i * 1000 + 900, f"[{i // 60:02d}:{i % 60:02d}] w{i}: 네", "01"[i % 2]) for i in range(10)]
    got = {r["_keys"][1]: r["layout"] for r in tr.mine_layouts(known(spark, lines)).collect() if len(r["_keys"]) > 1}
    assert got["상담원:"] == "\x01[0:0]\x01상담원:" and got["w3:"] == "\x01[0:0]\x01*"


def test_words_that_only_one_side_says_are_no_labels(spark, rows):
    lines = [("c", f"{i:04d}", i * 1000, i * 1000 + 900, ("알겠습니다.", "맞아요! 네")[i % 2], str(i % 2)) for i in range(300)]
    assert tr.clean_lines(frame(spark, lines)).count() == 300


def test_rare_forms(spark, rows):
    """One line of a shape: its value agrees with its own start; a label's word may name a side."""
    d = frame(spark, [("c", "1", 41_200, 42_000, "<41.6s> 신고자= 네", None), ("c", "2", 90_000, 91_000, "[접수자] 12.5 킬로요", "x"), ("c", "3", 95_000, 96_000, "민원인 -", "1"), ("c", "4", 96_500, 97_000, "주소: 달빛동", None)])
    assert rows(tr.clean_lines(d), "id", "role", "spoken") == [("1", "reporter", "네"), ("2", "dispatcher", "12.5 킬로요"), ("4", "unknown", "주소: 달빛동")]


def test_empty_long_and_one_hot_call(spark):
    assert tr.turn_starts(frame(spark, [])).count() == 0
    many = [("hot", f"{i:05d}", i * 700_000, i * 700_000 + 5, {7: "말 " * 20_000, 8: "(" * 100_000 + " 말", 9: "*" * 50_001 + " 말"}.get(i, "말"), "01"[i % 2]) for i in range(300)]
    assert tr.turn_starts(frame(spark, many)).count() == 300
