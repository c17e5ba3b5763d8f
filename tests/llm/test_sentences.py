import random
import re

import numpy as np
import pytest

from wardloom.llm import sentences
from wardloom.llm.sentences import ACTS, CLASSES, MOVES, N_STATES, PAD, functions_of, compose, cuts, pair, places, sentence_units, spread_units, units, units_of


def split(text):
    return [text[a:b] for a, b in units(text)]


CASES = [
    'Dr. Vaskell left at 3 p.m. Mr. Drusset Jr. stayed, e.g. in ward 5E. Then rest.|Dr. Vaskell left at 3 p.m.|Mr. Drusset Jr. stayed, e.g. in ward 5E.|Then rest.',
    'No. 4 on the list waited ... and left. Was it stopped? No. The clerk restarted it.|No. 4 on the list waited ... and left.|Was it stopped?|No.|The clerk restarted it.',
    '"Stop!" called the nurse. "Why?" "The chart is missing."|"Stop!" called the nurse.|"Why?"|"The chart is missing."',
    'She wrote, "Please repeat it. Call urology," and left.The team stayed. pH was 7.1 then.|She wrote, "Please repeat it. Call urology," and left.|The team stayed.|pH was 7.1 then.',
    "[Verified by the clerk.] He noted (twice!) that it was 2.5 m (see fig. 3, vol. 1.2). Fine.|[Verified by the clerk.]|He noted (twice!) that it was 2.5 m (see fig. 3, vol. 1.2).|Fine.",
    "Am 5. März war alles gut. Nr. 7 der Liste, Dr. med. Kest, kam z. B. am 4. Mai usw. auch, d. h. spät.|Am 5. März war alles gut.|Nr. 7 der Liste, Dr. med. Kest, kam z. B. am 4. Mai usw. auch, d. h. spät.",
    "„Ist es fertig?“, fragte sie. Er sagte: „Bitte warten.“ „Nein.“|„Ist es fertig?“, fragte sie.|Er sagte: „Bitte warten.“|„Nein.“",
    "« Où est-il ? » demanda M. Vask. Il a répondu : « C'est fini. » Le trajet ajoute 3,4 m… mais passe.|« Où est-il ? » demanda M. Vask.|Il a répondu : « C'est fini. »|Le trajet ajoute 3,4 m… mais passe.",
    "—¿Dónde está? —preguntó la Sra. Olla. A las 9 p. m. el celador salió. ¡No está!|—¿Dónde está? —preguntó la Sra. Olla.|A las 9 p. m. el celador salió.|¡No está!",
    "“患者很平稳。”药师说。药师问：“在哪里？”药师（见第6页。）签了……会再核对。共3.5米！|“患者很平稳。”药师说。|药师问：“在哪里？”|药师（见第6页。）签了……会再核对。|共3.5米！",
    "「どこですか。」と当直医は尋ねた。薬剤師（第2版。）は歩いた！|「どこですか。」と当直医は尋ねた。|薬剤師（第2版。）は歩いた！",
    'डॉ. Drusset ने कहा। "पट्टी कहाँ है?" नर्स ने\nरात में पूछा। नर्स ने कहा, "सब ठीक है।" टीम आई।|डॉ. Drusset ने कहा।|"पट्टी कहाँ है?" नर्स ने\nरात में पूछा।|नर्स ने कहा, "सब ठीक है।"|टीम आई।',
    '"أين الورقة؟" سأل الصيدلي. طلب د. Kest مراجعة 4.5 مل. هل وقع؟|"أين الورقة؟" سأل الصيدلي.|طلب د. Kest مراجعة 4.5 مل.|هل وقع؟',
    "ให้ยา 6.09 กรัม ตามคำสั่งของแพทย์ แพทย์ถามว่าอยู่ที่ไหน ดร.Vaskขอให้ดู|ให้ยา 6.09 กรัม ตามคำสั่งของแพทย์|แพทย์ถามว่าอยู่ที่ไหน|ดร.Vaskขอให้ดู",
    "# 4.9 Findings. Of note\nOne line\nbreak. Two.\n\n- see Dr. A, bay 1. Then go.\n- two\n\n1. x. Y\n \nEnd|# 4.9 Findings. Of note|One line\nbreak.|Two.|- see Dr. A, bay 1. Then go.|- two|1. x. Y|End",
    "wrapped on\n5. März here.\r\n\r\n… at its start. Next|wrapped on\n5. März here.|… at its start.|Next",
    "|",
    " \n\t|",
    "An open \"quote. It is never closed. Ever|An open \"quote.|It is never closed.|Ever",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    text, *want = case.split("|")
    assert split(text) == [w for w in want if w]


def corpus(seed, n):
    rng = random.Random(seed)
    bits = [c.split("|")[0] for c in CASES]
    return rng.choice([" ", "\n\n", "\n"]).join(rng.choice(bits) + rng.choice([" ", "\n\n", "\r\n", ""]) for _ in range(n))


def test_units_hold_every_character():
    rng = random.Random(8)
    for seed in range(40):
        text = corpus(seed, 20) if seed % 2 else "".join(rng.choice("aB .!?\"“”„«»()[]\n#-1。「」…ก ") for _ in range(400))
        got = units(text)
        assert all(a < b <= c for (a, b), (c, _) in zip(got, got[1:]))
        assert all(text[a:b] == text[a:b].strip() for a, b in got)
        assert re.sub(r"\s", "", "".join(text[a:b] for a, b in got)) == re.sub(r"\s", "", text)


def one_pass(text):
    return pair(places(text, 0, len(text), 0, 0, True, True))


def test_prefix_scan_equals_composition():
    rng = np.random.default_rng(1)
    f = rng.integers(0, N_STATES, (200, N_STATES)).astype(np.int16)
    owner = np.sort(rng.integers(0, 9, 200))
    state, want = 0, []
    for i, g in enumerate(f):
        state = 0 if i and owner[i] != owner[i - 1] else state
        want.append(state)
        state = int(g[state])
    assert compose(f, owner).tolist() == want


def test_scan_over_chunks_equals_one_pass():
    rng = random.Random(4)
    texts = ["", " \n", "x", *(corpus(s, rng.randint(1, 60)) for s in range(30)), "", "a" * 3000]
    texts += ["".join(rng.choice("aB .!?\"“”„«»()[]\n#-1。「」…ก ") for _ in range(rng.randint(0, 900))) for _ in range(40)]
    who, a, z = units_of(texts)
    assert list(zip(who.tolist(), a.tolist(), z.tolist())) == [(i, x, y) for i, t in enumerate(texts) for x, y in one_pass(t)]


def test_states_go_on_over_batches():
    import pandas as pd

    rng = np.random.default_rng(2)
    f = rng.integers(0, N_STATES, (60, N_STATES)).astype(np.int16)
    pdf = pd.DataFrame({"copy": np.sort(rng.integers(0, 4, 60)), "no": range(60), "f": f.tolist()})
    for size in (1, 7, 60):
        got = pd.concat(sentences._compose(pdf.iloc[i : i + size] for i in range(0, 60, size)))
        assert got["state"].tolist() == compose(f, pdf["copy"].to_numpy()).tolist()


def test_empty_parts_change_no_state():
    assert functions_of([("x", 1, 1, False), ("a b. C", 0, 6, True)])[0].tolist() == list(range(N_STATES))


def test_table_is_complete():
    assert MOVES.shape == ACTS.shape == (N_STATES, PAD + 1) and len(CLASSES) == PAD
    assert (MOVES[:, PAD] == np.arange(N_STATES)).all() and not ACTS[:, PAD].any()


def test_long_quotes_and_many_open_ones():
    long = "“" + "One went. " * 1500 + "” she said. Then more."
    assert len(split(long)) == 2
    assert len(split("( “ « " * 30_000)) == 1


def test_chunk_function_is_the_transducer():
    text = corpus(3, 60)
    for c in (1, 2):
        edge = cuts(text, 300 * c)
        for start in range(N_STATES):
            state = start
            for no, (a, z) in enumerate(zip(edge, edge[1:])):
                state = int(functions_of([(text, a, z, no == 0)])[0][state])
            assert state == functions_of([(text, 0, len(text), True)])[0][start]
    assert MOVES.shape[0] == N_STATES and places("", 0, 0, 0, 0, True, True)


def test_long_documents_equal_short_ones(spark):
    texts = [corpus(s, 50) for s in range(4)] + ["", None, " \n", "x" * 9000, corpus(9, 900)]
    rows = [(i if i != 2 else None, t, "d") for i, t in enumerate(texts)] + [(0, texts[0], "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_char string")
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.start_char, r.end_char, r.text)
    want = sorted((d if d is not None else -1, a, b, t[a:b]) for d, t, _ in rows if t for a, b in one_pass(t))
    assert sorted(map(key, sentence_units(df).collect())) == want
    assert sorted(map(key, spread_units(df, chunk_chars=700).collect())) == want
    assert sentence_units(df.limit(0)).count() == 0 == spread_units(df.limit(0)).count()
