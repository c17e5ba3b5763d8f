import random
import re

import pytest

from wardloom.llm.split import NATURAL, cut_points, pieces_of, split_oversized, strengths

TOKEN = re.compile(r"[^ \t\r\n]+")


def random_text(rng, n):
    out = []
    for _ in range(n):
        word = "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8)))
        out.append(word + rng.choice(["", "", "", ".", ",", "。", "!"]))
        out.append(rng.choice([" ", " ", "  ", "\n", "\r\n", "\n\n", "\t", "\n# ", "\n- "]))
    return "".join(out)


@pytest.mark.parametrize("limit,overlap", [(400, 60), (10, 3), (5, 0), (2, 1)])
def test_pieces_hold_the_limit_and_lose_nothing(limit, overlap):
    rng = random.Random(7)
    for n in (0, 1, limit - 1, limit, limit + 1, 3 * limit + 1, 977):
        text = random_text(rng, n)
        got = pieces_of(text, limit, overlap)
        assert "".join(text[core:end] for _, core, end, *_ in got) == text
        tokens = [len(TOKEN.findall(text[a:end])) for a, _, end, *_ in got]
        assert all(k <= limit for k in tokens) and tokens == [x[3] for x in got]
        assert all(x[4] <= overlap for x in got)
        assert (len(got) > 1) == (len(TOKEN.findall(text)) > limit)


def test_cuts_fall_on_paragraphs_where_there_are_some():
    text = "\n\n".join(" ".join(["word"] * 40) + "." for _ in range(20))
    spans = [m.span() for m in TOKEN.finditer(text)]
    force = strengths(text, spans)
    for _, core, *_ in pieces_of(text, 400, 60)[1:]:
        token = next(i for i, s in enumerate(spans) if s[0] == core)
        assert force[token] >= NATURAL


def test_no_break_at_all_and_one_huge_token():
    assert len(pieces_of("x " * 1000, 400, 60)) == 3
    assert pieces_of("x" * 1_000_000, 400, 60)[0][3] == 1


def test_time_is_linear_without_breaks():
    import time

    took = []
    for n in (50_000, 400_000):
        began = time.perf_counter()
        assert len(pieces_of("word " * n, 400, 60)) == -(-(n - 60) // 340)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 1


def test_fewest_unnatural_cuts():
    """Against every number of pieces: none up to twice the least has fewer cuts between words."""
    rng = random.Random(3)
    for _ in range(200):
        n, limit = rng.randint(20, 120), rng.randint(6, 15)
        overlap = rng.randint(0, limit // 3)
        force = [6] + [rng.choice([0, 0, 0, 0, 1, 2, 5]) for _ in range(n - 1)]
        got = cut_points(n, force, limit, overlap)
        ends = [c for _, c in got[1:]] + [n]
        assert all(z - a <= limit and c - a <= overlap for (a, c), z in zip(got, ends))
        gaps = [i for i, f in enumerate(force) if not i or f >= NATURAL] + [n]
        assert sum(force[c] < NATURAL for _, c in got[1:]) >= sum((b - a - 1) // limit for a, b in zip(gaps, gaps[1:]))


def test_scripts_without_blanks():
    zh = "患者夜间离开病房，护士记录了时间。" * 900
    got = pieces_of(zh, 400, 60, by_script=True)
    assert "".join(zh[core:z] for _, core, z, *_ in got) == zh
    assert len(got) > 30 and all(n <= 400 for _, _, _, n, _, _ in got)
    assert all(zh[core - 1] == "。" for _, core, *_ in got[1:])
    assert len(pieces_of(zh, 400, 60)) == 1


def test_rows_nulls_and_lines(spark):
    text = "\r\n".join(f"line {i} of the note." for i in range(200))
    df = spark.createDataFrame(
        [("a", text, 11, None, 1), ("b", None, None, "h > k", 2), ("c", "", 5, "", 3), ("a", "short", 1, "x", 4)],
        "id string, text string, start_line int, heading_path string, n_tokens int",
    )
    rows = split_oversized(df).orderBy("id", "piece_no").collect()
    long = [r for r in rows if r.id == "a" and r.n_pieces > 1]
    assert long[0].start_line == 11 and long[-1].end_line == 210
    for r in long:
        lines = r.text.strip("\r\n").split("\r\n")
        assert lines[0] == f"line {r.start_line - 11} of the note." and lines[-1] == f"line {r.end_line - 11} of the note."
    assert "".join(r.text[r.overlap_chars :] for r in long) == text
    assert [(r.id, r.n_tokens, r.text) for r in rows if r.n_pieces == 1] == [("a", 1, "short"), ("b", 0, None), ("c", 0, "")]
    assert {r.id for r in split_oversized(df, only_split=True).collect()} == {"a"}
    assert split_oversized(df.limit(0)).count() == 0
