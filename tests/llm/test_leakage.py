import random

from wardloom.llm.leakage import Searcher, find_leaks, plain, words


def brute(passage, text, m):
    there = {tuple(text[i : i + m]) for i in range(len(text) - m + 1)}
    return {i + j for i in range(len(passage) - m + 1) if tuple(passage[i : i + m]) in there for j in range(m)}


def test_search_equals_brute_force():
    rng = random.Random(1)
    for size in (2, 3, 6, 40):
        for m in (1, 2, 3, 8, 12):
            passages = [[str(rng.randrange(size)) for _ in range(rng.randint(0, 30))] for _ in range(6)]
            text = [str(rng.randrange(size + 2)) for _ in range(60)]
            for _ in range(4):
                p = rng.choice(passages)
                a = rng.randrange(len(p) + 1)
                at = rng.randrange(len(text))
                text[at:at] = p[a : a + rng.randint(0, 20)]
            got = Searcher(passages, m).marks(text)
            for k, p in enumerate(passages):
                assert {i for i in range(len(p)) if got.get(k, 0) >> i & 1} == brute(p, text, m)


def test_plain():
    assert words(plain("Das _Ortungsprotokoll_ ISN’T **24.5**\r\n<b>Über</b>")) == ["das", "ortungsprotokoll", "isnt", "245", "uber"]


def test_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    zh = "考生应发现定位日志在交班时缺失而夜班护士在护士站"
    items = spark.createDataFrame(
        [(1, "en", passage, "q"), (2, "zh", zh, "q"), (3, None, None, "q"), (4, "en", "too short", "q")], "item_id long, lang string, passage string, text string"
    )
    docs = spark.createDataFrame(
        [
            (10, "x " * 20_000 + "One, two\nTHREE four *five* six seven eight nine", 1),
            (11, "one two three four five six seven", 1),
            (12, "先，" + "考生应发现定位，日志在交班时缺失。", 1),
            (13, None, 1),
            (14, "", 1),
            (15, "it is too short", 1),
            (10, passage, 1),
        ],
        "doc_id long, text string, item_id int",
    )
    want = [(1, 10, 9, 16), (1, 10, 16, 16), (2, 12, 15, 24), (4, 15, 2, 2)]
    for block in (4_000_000, 60):
        assert sorted(tuple(r) for r in find_leaks(docs, items, block_chars=block).collect()) == want
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_every_script_and_short_passages(spark):
    passages = {
        1: ("en", "alpha beta gamma delta"),
        2: ("ja", "患者は夜間に病棟を離れたため位置記録が途切れている"),
        3: (None, "ผู้ป่วยออกจากหอผู้ป่วยในเวลากลางคืนโดยไม่มีบันทึก"),
        4: ("en", "定位日志在交班时缺失而夜班护士"),
        5: ("hi", "मरीज रात में वार्ड से बाहर चला गया था"),
        6: ("ar", "غادر المريض الجناح ليلا دون تسجيل في السجل"),
        7: ("zh", "the label of this item is wrong here today"),
        8: ("ja", "短い文"),
    }
    items = spark.createDataFrame([(i, x, p) for i, (x, p) in passages.items()], "item_id long, lang string, passage string")
    docs = spark.createDataFrame([(100 + i, f"前 before, {p}؟ after 後") for i, (_, p) in passages.items()] + [(200, "前 before after 後")], "doc_id long, text string")
    got = sorted((r.item_id, r.doc_id, r.found == r.length) for r in find_leaks(docs, items).collect())
    assert got == [(i, 100 + i, True) for i in passages]


def test_parts_below_the_share(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, passage)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, passage[:40] + " x"), (2, "w1 w2 w3 w4 w5 w6 w7"), (3, "a " + passage)], "doc_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(docs, items).collect()) == [3]
    assert sorted((r.doc_id, r.found) for r in find_leaks(docs, items, min_share=0.0).collect()) == [(1, 12), (3, 40)]
