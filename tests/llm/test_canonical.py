import random

import pytest

from wardloom.llm import canonical
from wardloom.llm.canonical import NOTHING, Names, allowed, distance, known_strings, map_to_list, rank, repairs, tokens_of

NAMES = {
    "cardiology": ["heart team"],
    "nephrology": ["kidney medicine"],
    "renal": ["dialysis unit", "renal team"],
    "icu": ["intensive care", "itu"],
    "neurology": ["nerve team"],
    "urology": [],
    "neurosurgery": ["brain surgeons"],
    "palliative_care": ["supportive care"],
    "general_medicine": ["acute med"],
}
MATCHED = [
    ("CARDIOLOGY", "cardiology"),
    ("Carddiolgoy", "cardiology"),
    ("ｃａｒｄｉｏ", "cardiology"),
    ("d/w HAERT TEAM reg", "cardiology"),
    ("ref: nephr0logy​", "nephrology"),
    ("nephro", "nephrology"),
    ("Menal", "renal"),
    ("I.C.U.", "icu"),
    ("?icu o/p", "icu"),
    ("neuro surgery", "neurosurgery"),
    ("palliativec are", "palliative_care"),
    ("GEN. MEDICINE", "general_medicine"),
    ("ward 5E nurology - Tues list", "neurology"),
    ("cards", "cardiology"),
    ("eye clinic", None),
    ("team", None),
    ("?", None),
    ("xx.", None),
]
# Words of their own, as often written as the names that they resemble.
OTHERS = ["radiology", "Radiology", "audiology r/v", "virology"]


def listing(spark, names=NAMES):
    return spark.createDataFrame(list(names.items()), "specialty string, also_known array<string>")


def typed(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "evidence_id long, specialty_text string")


def corpus(rng):
    rows = [n.replace("_", " ") for n in NAMES for _ in range(30)] + [f"{n} {w}" for n in NAMES for w in ("reg", "o/p", "Tues list") for _ in range(3)]
    rows += [t for t, _ in MATCHED] + OTHERS * 8
    rng.shuffle(rows)
    return rows


def test_typed_values(spark):
    rows = corpus(random.Random(1))
    got = {r.text: r.entry for r in map_to_list(typed(spark, rows), listing(spark)).collect()}
    assert {t: got[t] for t, _ in MATCHED} == dict(MATCHED)
    assert {got[t] for t in OTHERS} == {None}


def test_beyond_the_broadcast_the_join_gives_the_same(spark):
    rows = [*corpus(random.Random(2)), None, "", " ", "heart team", "renal " * 40]
    df = typed(spark, rows)
    a = sorted(map(str, map_to_list(df, listing(spark)).collect()))
    assert a == sorted(map(str, map_to_list(df, listing(spark), broadcast_strings=0).collect()))


def test_the_join_finds_all_words_in_reach(spark):
    rng = random.Random(2)
    names = Names({k: [k, *v] for k, v in NAMES.items()})
    words, typos = [w for w in sorted(names.weight) if len(w) >= 6], []
    for _ in range(300):
        w = list(rng.choice(words))
        for _ in range(2):
            i = rng.randrange(len(w))
            rng.choice([lambda: w.insert(i, rng.choice("abcxyz")), lambda: w.pop(i), lambda: w.__setitem__(i, rng.choice("abcxyz"))])()
        typos.append("".join(w))
    texts = spark.createDataFrame([(t, 1) for t in set(typos)], "text string, n long")
    got = {r.s: set(r.words) for r in known_strings(texts, names).collect()}
    for t in set(typos) - names.words:
        if any(w.startswith(x) and len(w) > len(x) + 1 for w in names.words for x in {t, t.removesuffix("s")}):
            continue
        every = {c: distance(t, c, 2) for c in names.words if len(c) >= 4}
        every = {c: d for c, d in every.items() if d <= allowed(max(len(t), len(c))) and d < min(len(t), len(c)) / 2}
        low = min(every.values(), default=0)
        assert got.get(t, set()) == {c for c, d in every.items() if d == low}, t


def test_own_words():
    near = [("cardiology", False, 1000)]
    assert repairs("radiology", 100, near, False) == ([], True)
    assert repairs("radiology", 20, near, False)[0][0][0] == "cardiology"
    assert repairs("cardiolgy", 100, near, False)[0][0][0] == "cardiology"  # few misspell, but many the first letter right
    assert repairs("podiatry", 2, [], False) == ([], False)
    assert repairs("podiatry", 3, [], False) == ([], True)


def test_distance():
    for a, b, d in (("abc", "abc", 0), ("", "ab", 2), ("abcd", "acbd", 1), ("psychiatry", "pshyiatry", 2), ("ca", "abc", 2), ("kitten", "sitting", 3), ("abcdef", "x", 3)):
        assert distance(a, b, 3) == min(d, 4) or (b == "x" and distance(a, b, 3) == 4)
        assert distance(b, a, 3) == distance(a, b, 3)


def test_variants_are_all_deletions():
    from itertools import combinations

    for word in ("", "a", "ab", "abca", "aabbcc", "renal"):
        for most in (0, 1, 2):
            want = {"".join(c for i, c in enumerate(word) if i not in at) for k in range(most + 1) for at in combinations(range(len(word)), k)}
            assert canonical.variants(word, most) == want


def test_tokens():
    assert tokens_of("Re5Piraeory (O/P)") == ["respiraeory", "op"]
    assert tokens_of("ward 5E: i.c.u.") == ["ward", "5e", "icu"]


def test_rows(spark):
    ref = spark.createDataFrame([("icu", ["itu"]), ("renal", None), (None, ["x"])], "specialty string, also_known array<string>")
    rows = [(1, "icu", "a"), (2, None, "a"), (3, "", "a"), (4, "ITU", "a"), (4, "ITU", "a"), (5, "x " * 50_000 + "renall", "a"), (6, "dentist", "a")]
    df = spark.createDataFrame(rows, "evidence_id long, specialty_text string, entry string")
    for limit in (500_000, 0):
        got = sorted((r.id, r.entry) for r in map_to_list(df, ref, broadcast_strings=limit).collect())
        assert got == [(1, "icu"), (2, None), (3, None), (4, "icu"), (4, "icu"), (5, "renal"), (6, None)]
    assert map_to_list(df.limit(0), ref).count() == 0
    assert [r.entry for r in map_to_list(df, ref.limit(0)).collect()] == [None] * 7
    assert {r.entry for r in map_to_list(df.where("evidence_id = 6"), ref, shorthand={"icu": ("dentist",)}).collect()} == {"icu"}
    with pytest.raises(ValueError):
        map_to_list(df, ref, max_entries=1)


def match(names, text):
    """One text against a list, its strings known by trying every word."""
    tokens = tokens_of(text)
    known = {s: (repairs(s, 1, [(w, w.startswith(s) and len(w) > len(s) + 1, 1) for w in names.words], s in names.words)[0], False, False) for s in names.strings(tokens) - names.words}
    return rank(names, tokens, {k: v for k, v in known.items() if v != NOTHING}, 0.6)


def test_long_texts_and_words_are_matched_whole():
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    m = Names({"cardiology": ["cardiology"], "renal": ["renal"], "lungs": [long]})
    filler = "5e " * 40_000
    assert match(m, filler + "cardiology")[0] == "cardiology"
    assert match(m, filler + "cardiolgy")[0] == "cardiology"
    assert match(m, filler + "car diology")[0] == "cardiology"
    assert match(m, "cardiology " + "zebra giraffe " * 10_000)[0] is None
    assert match(m, long[:-2] + "s")[0] == match(m, long[:-6] + "x" + long[-6:])[0] == "lungs"
    assert match(m, "x" * 1_000_000 + " cardiology") == match(m, "x" * 60 + " cardiology")


def test_names_in_any_script(spark):
    ref = spark.createDataFrame([("東京", None), ("मुंबई", ["बंबई"]), ("Zürich", None)], "specialty string, also_known array<string>")
    got = {r.text: r.entry for r in map_to_list(typed(spark, ["東京", " 東京 ", "ZURICH", "zuerich", "बंबई", "大阪"]), ref).collect()}
    assert (got[" 東京 "], got["ZURICH"], got["बंबई"], got["大阪"]) == ("東京", "Zürich", "मुंबई", None)
    assert canonical.tokens_of("東京") == ["東京"]
