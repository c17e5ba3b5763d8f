import random
from itertools import product
from pathlib import Path

import pytest

from wardloom.llm.mixing import TOKENIZERS, VOCABULARY, fit_lengths, mix_sources

needs_vocabulary = pytest.mark.skipif(not (Path(TOKENIZERS) / VOCABULARY).exists(), reason="no vocabulary files here")


def test_fit_is_nearest():
    rng = random.Random(6)
    for _ in range(400):
        lengths = sorted(rng.sample(range(1, 30), rng.randint(1, 4)))
        if rng.random() < 0.3:
            lengths = [x * 4 for x in lengths]
        counts = [rng.randint(1, 4) for _ in lengths]
        total = sum(a * n for a, n in zip(lengths, counts))
        budget = rng.randint(0, total + 5)
        got = fit_lengths(lengths, counts, budget)
        assert all(0 <= k <= n for k, n in zip(got, counts))
        sums = {sum(a * k for a, k in zip(lengths, ks)) for ks in product(*(range(n + 1) for n in counts))}
        assert sum(a * k for a, k in zip(lengths, got)) == min(sums, key=lambda x: (abs(x - budget), x))


def test_fit_of_many_records_is_exact_and_spread():
    lengths, counts = list(range(50, 1000, 7)), [300] * len(range(50, 1000, 7))
    budget = sum(a * n for a, n in zip(lengths, counts)) // 3 + 1
    got = fit_lengths(lengths, counts, budget)
    assert sum(a * k for a, k in zip(lengths, got)) == budget
    assert all(90 <= k <= 110 for k in got[:100])


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["word"] * rng.randint(5, 60)), rng.choice("aaaab"), 1) for i in range(600)]
    docs += [(1000 + i, "tiny text here", "c", 1) for i in range(4)] + [(2000, None, "a", 1), (2001, "", "a", 1), (2002, "x", None, 1), (2003, "y", "d", 1), (3, "twice", "b", 1), (3, "twice", "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_uses int")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 4), ("c", 0.05, 3), ("e", 0.05, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix_sources(df, targets, total_tokens=9000)
    rows = chosen.collect()
    caps = {"a": 2, "b": 4, "c": 3}
    assert all(1 <= r.n_uses <= caps[r.source] for r in rows)
    for s in "abc":
        uses = {r.n_uses for r in rows if r.source == s}
        assert max(uses) - min(uses) <= 1
    by = {r.source: r for r in shares.collect()}
    assert by["a"].mixed_tokens == by["a"].budget_tokens == round(9000 * 0.6 / 0.95)
    assert by["c"].note == "short" and by["c"].mixed_tokens == 3 * by["c"].available_tokens
    assert by["d"].note == "no target" and by["e"].note == "no records"
    assert abs(sum(r.reached_share for r in by.values()) - 1) < 1e-9
    again = mix_sources(df.repartition(7), targets, total_tokens=9000)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    whole = {r.source: r for r in mix_sources(df, targets)[1].collect()}
    assert all(abs(whole[s].reached_share - t / 0.95) < 0.01 for s, t in (("a", 0.6), ("b", 0.3), ("c", 0.05)))
    for empty in (mix_sources(df.limit(0), targets), mix_sources(df, targets.limit(0))):
        assert empty[0].count() == 0 and all(r.mixed_tokens == 0 for r in empty[1].collect())


def test_a_huge_record_among_many_lengths_needs_little_memory():
    import random
    import resource

    rng = random.Random(6)
    lengths = [*range(20, 1520), 1_000_000]
    counts = [rng.randint(1, 4) for _ in lengths[:-1]] + [1]
    total = sum(a * n for a, n in zip(lengths, counts))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for budget in (total // 2, total - 1_000_000, 700_001, total - 3):
        take = fit_lengths(lengths, counts, budget)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        assert abs(sum(a * k for a, k in zip(lengths, take)) - budget) <= 17 * (budget == total - 3)
    many = [1_000_000 + 7 * i for i in range(1500)]
    take = fit_lengths(many, [3] * 1500, sum(many))
    assert sum(a * k for a, k in zip(many, take)) == sum(many)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 250_000
