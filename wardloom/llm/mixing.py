"""Mixing sources to target shares of all tokens, with capped repeats, by subset-sum budget fitting."""

from __future__ import annotations

import base64
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.session import bounded_rows, cut

#: Place of the public tokenizers' vocabulary files, and the one used by default.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to these byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Hash cells by which the records of one source and length are drawn.
CELLS = 1024
#: Budget left to the subset-sum, in lengths of the longest record that takes part; less where its bits
#: would be more than WIDTH. Of the sums reached, one in SAVED stages is kept for the way back.
SLACK, WIDTH, SAVED = 16, 1 << 23, 48


def token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row; a null text has none.

    One pass without exchange; each worker loads the vocabulary file from ``path`` once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(Path(path) / vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            counts = pa.array([None if t is None else len(encode(t)) for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], counts], names=[*keep, "n_tokens"])

    rows = df.select(F.col(text).cast("string").alias("_text"), *keep)
    ddl = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{ddl}, n_tokens bigint")


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many records of each length to take so that their tokens come nearest to ``budget``.

    Never more than there are. A first part is taken in proportion to what there is, so that the
    drawn records are spread over lengths as the source is; the budget that remains, SLACK to
    2 * SLACK times a typical length, is met by bounded subset-sum over the records left that
    aren't longer. Typical is the median length, or a higher quantile where records up to it can't
    meet the budget. At equal distance the smaller sum is taken.
    """
    total = sum(a * n for a, n in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(counts)
    upto = list(accumulate(n for _, n in sorted(zip(lengths, counts))))
    best: list[int] = []
    for quantile in (0.5, 0.9, 0.99, 1.0):
        typical = sorted(lengths)[bisect_left(upto, quantile * upto[-1])]
        take = _fit_up_to(lengths, counts, budget, typical)
        off = [abs(sum(a * k for a, k in zip(lengths, x)) - budget) for x in (take, best) if x]
        if take and off[0] == min(off):
            best = take
        if best and min(off) == 0:
            break
    return best


def _fit_up_to(lengths: list[int], counts: list[int], budget: int, typical: int) -> list[int]:
    """A fit whose last part has no record longer than ``typical``; empty if such records can't be the last part."""
    total = sum(a * n for a, n in zip(lengths, counts))
    take, spent = [0] * len(counts), 0
    # Longer records in proportion, rounded down over the running count from the longest on.
    seen = used = 0
    for i in sorted((i for i, a in enumerate(lengths) if a > typical), key=lambda i: -lengths[i]):
        seen += counts[i]
        take[i] = min(counts[i], int(seen * (budget / total)) - used)
        used, spent = used + take[i], spent + take[i] * lengths[i]
    short = [i for i, a in enumerate(lengths) if a <= typical]
    mine = sum(lengths[i] * counts[i] for i in short)
    if not 0 <= budget - spent <= mine:
        return []
    for i, k in zip(short, _fill([lengths[i] for i in short], [counts[i] for i in short], budget - spent)):
        take[i] = k
    return take


def _fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    total, longest = sum(a * n for a, n in zip(lengths, counts)), max(lengths)
    slack = max(2, min(SLACK, WIDTH // (2 * longest)))
    share = max(0.0, (budget - slack * longest) / total)
    # Rounded over the running count, so that lengths of few records get their part too.
    upto = [0, *accumulate(counts)]
    take = [int(b * share) - int(a * share) for a, b in zip(upto, upto[1:])]
    rest = budget - sum(a * k for a, k in zip(lengths, take))
    left = [n - k for n, k in zip(counts, take)]
    # Lengths in an order that is spread over their range from the start.
    order = sorted(range(len(lengths)), key=lambda i: (i * 0.6180339887498949) % 1.0)
    for i in order:
        if rest <= 2 * slack * longest:
            break
        k = min(left[i], max(0, rest - slack * longest) // lengths[i])
        take[i], left[i], rest = take[i] + k, left[i] - k, rest - k * lengths[i]
    # Bits of ``reach`` are the sums that can be made, item by item.
    unit = math.gcd(*(a for a, k in zip(lengths, left) if k)) or 1
    lengths, (rest, odd), longest = [a // unit for a in lengths], divmod(rest, unit), longest // unit
    limit = rest + longest
    full = (1 << (limit + 1)) - 1
    items: list[tuple[int, int]] = []  # position, how many records
    reach, saved = 1, [1]  # saved: before every SAVED-th item
    # One record of each length first, then the rest of them.
    for i, most in [*((i, min(1, left[i])) for i in order), *((i, left[i] - 1) for i in order)]:
        part, have = 1, max(0, min(most, limit // lengths[i]))
        while have:
            k = min(part, have)
            items.append((i, k))
            reach |= (reach << (k * lengths[i])) & full
            if len(items) % SAVED == 0:
                saved.append(reach)
            have, part = have - k, part * 2
            if not odd and reach >> rest & 1:
                break
        if reach >> rest & 1 and (not odd or reach >> rest & 2):
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    goal = below
    if above:
        up = rest + 1 + (above & -above).bit_length() - 1
        if (up - rest) * unit - odd < (rest - below) * unit + odd:
            goal = up
    # Walk back from the goal; the sums before each item are made again, one stage at a time.
    for stage in range((len(items) - 1) // SAVED, -1, -1):
        part = items[stage * SAVED : (stage + 1) * SAVED]
        before = [saved[stage]]
        for i, k in part[:-1]:
            before.append(before[-1] | (before[-1] << (k * lengths[i])) & full)
        for (i, k), reached in zip(reversed(part), reversed(before)):
            if not reached >> goal & 1:
                take[i], goal = take[i] + k, goal - k * lengths[i]
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n_tokens")
    take = fit_lengths(pdf["n_tokens"].tolist(), pdf["n"].tolist(), int(pdf["rest"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "extra": pd.Series(take, index=pdf.index, dtype="int64")})


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: str = "target_share",
    repeats: str = "max_repeats",
    total_tokens: int | str | None = None,
    seed: int = 17,
    path: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    max_sources: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """Records drawn so that each source gives its target share of all tokens, and the shares reached.

    First: ``doc_id, source, n_tokens, n_uses`` of every chosen record. Second, a row for each
    source of either table: ``source, target_share, max_repeats, n_records, available_tokens,
    budget_tokens, mixed_tokens, reached_share, note``.

    Shares are those of the targets whose source has tokens, scaled to sum to 1 (a source without
    any can't be had: note ``no records``; one that isn't a target, has no share or no repeats is
    left out: note ``no target``). Without ``total_tokens`` the mix is as large as it can be with
    every share met: the least of repeats x tokens / share. With it (``"all"`` stands for all tokens
    of the target sources), a source that can't give its part gives all it may (note ``short``), and
    the others give theirs, so that reached shares differ from the targets. A record's uses differ by at most one within a source:
    all records are used budget // tokens times, and some once more.

    Records with null, or no, tokens or a null source are never drawn. Source names are compared
    exactly. Repeated rows are records of their own. Ties in the draw go by id. The same seed
    gives the same mix whatever the partitioning. Empty tables give no records.

    Token counts are written once to the shared checkpoint folder. Only counts by source and
    length are gathered, and fitted for each source on its own; records of one source and length
    are drawn by hash cells, so only one cell in a group is ranked, however many records it has.
    """
    rows = [r for r in bounded_rows(targets.select(source, share, repeats), max_sources, "the list of targets") if r[0] is not None]
    keys = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_t"))
    counted = cut(token_counts(keys, "_t", ["source", "doc_id"], path, vocabulary).where("n_tokens > 0 and source is not null"))
    hist = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    sums = counted.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("available_tokens"))
    have = {r["source"]: r for r in bounded_rows(sums, max_sources, "the list of sources")}
    usable = {r[0]: (float(r[1]), int(r[2])) for r in rows if r[0] in have and (r[1] or 0) > 0 and (r[2] or 0) > 0}
    scale = sum(s for s, _ in usable.values())
    most = {k: n * have[k]["available_tokens"] for k, (_, n) in usable.items()}
    if total_tokens == "all":
        total_tokens = sum(have[k]["available_tokens"] for k in usable)
    total = total_tokens if total_tokens is not None else min((int(most[k] / (s / scale)) for k, (s, _) in usable.items()), default=0)
    plan = []
    for k, (s, _) in sorted(usable.items()):
        budget = min(round(total * s / scale), most[k])
        base = budget // have[k]["available_tokens"]
        plan.append((k, budget, base, budget - base * have[k]["available_tokens"]))
    spark = docs.sparkSession
    plans = F.broadcast(spark.createDataFrame(plan, "source string, budget bigint, base bigint, rest bigint"))
    fitted = hist.join(plans.select("source", "rest"), "source").groupBy("source").applyInPandas(_fit, "source string, n_tokens bigint, extra bigint")

    # Draw ``extra`` records of each source and length: whole cells up to the one that holds the last.
    cell = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(CELLS)).cast("int")
    rank = F.xxhash64(F.lit(seed + 1), "doc_id")
    tagged = counted.join(plans.select("source", "base"), "source").withColumn("cell", cell)
    cells = tagged.groupBy("source", "n_tokens", "cell").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "n_tokens").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.join(fitted, ["source", "n_tokens"]).withColumn("due", F.col("extra") - F.col("upto") + F.col("n")).where("due > 0")
    drawn = tagged.join(cells.select("source", "n_tokens", "cell", "n", "due"), ["source", "n_tokens", "cell"], "left")
    split = F.col("due").isNotNull() & (F.col("due") < F.col("n"))
    inner = Window.partitionBy("source", "n_tokens", "cell").orderBy(rank, "doc_id")
    whole = drawn.where(~split).withColumn("extra", F.when(F.col("due").isNotNull(), 1).otherwise(0))
    parted = drawn.where(split).withColumn("extra", F.when(F.row_number().over(inner) <= F.col("due"), 1).otherwise(0))
    chosen = whole.unionByName(parted).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("extra")).alias("n_uses")).where("n_uses > 0")

    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("mixed_tokens"))
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy())  # over one row for each source
    budgets = {k: b for k, b, _, _ in plan}
    want = {r[0]: r for r in rows}
    listed = []
    for k in sorted({*want, *have}):
        note = "no records" if k not in have else "no target" if k not in usable else "short" if budgets[k] < round(total * usable[k][0] / scale) else None
        r, h = want.get(k), have.get(k)
        listed.append((k, float(r[1]) if r and r[1] is not None else None, int(r[2]) if r and r[2] is not None else None, h["n_records"] if h else 0, h["available_tokens"] if h else 0, budgets.get(k, 0), note))
    shares = spark.createDataFrame(
        listed, "source string, target_share double, max_repeats int, n_records bigint, available_tokens bigint, budget_tokens bigint, note string"
    )
    report = shares.join(used, "source", "left")
    return chosen, report.select(
        "source", "target_share", "max_repeats", "n_records", "available_tokens", "budget_tokens",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.col("mixed_tokens") / all_tokens, F.lit(0.0)).alias("reached_share"),
        "note",
    )
