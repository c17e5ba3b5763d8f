"""Overlapping and gapped intervals by compressed run bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time units in one word of a bitmap (below 63, so that masks stay positive BIGINTs).
WORD = 60


def _mask(lo: Column, hi: Column) -> Column:
    """Bits lo to hi - 1 set, 0 <= lo < hi <= WORD."""
    return _shift(hi) - _shift(lo)


def _shift(by: Column) -> Column:
    """2 to the power ``by`` as a BIGINT."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), by.cast("int"))


def covered_runs(df: DataFrame, entity: list[str], start: str, length: str) -> DataFrame:
    """Set runs of each entity's bitmap: ``entity..., run_from, run_to`` in whole time units.

    ``df`` has integer starts and lengths. Each interval sets bits of at most two words of WORD
    units and, if it is longer, one run of full words; words are united by ``bit_or`` and full
    runs by their longest, both with partial aggregation before the exchange. So what an entity
    sends on is bounded by the units it spans, not by how many intervals it has, and an interval
    of any length costs three records.
    """
    s, e = F.col("_s"), F.col("_s") + F.col("_n")
    base = (
        df.select(*entity, F.col(start).cast("bigint").alias("_s"), F.col(length).cast("bigint").alias("_n"))
        .where("_s is not null and _n >= 1")
        .withColumns({"_w0": F.expr(f"(_s - pmod(_s, {WORD})) div {WORD}"), "_w1": F.expr(f"(_s + _n - 1 - pmod(_s + _n - 1, {WORD})) div {WORD}")})
    )
    lo, hi = s - F.col("_w0") * WORD, e - F.col("_w1") * WORD
    zero, full = F.lit(0).cast("bigint"), F.lit(WORD).cast("bigint")
    null = F.lit(None).cast("bigint")

    def piece(word: Column, mask: Column, last: Column) -> Column:
        return F.struct(word.cast("bigint").alias("word"), mask.cast("bigint").alias("mask"), last.cast("bigint").alias("last"))

    one = F.col("_w0") == F.col("_w1")
    pieces = F.when(one, F.array(piece(F.col("_w0"), _mask(lo, hi), null))).otherwise(
        F.concat(
            F.array(piece(F.col("_w0"), _mask(lo, full), null), piece(F.col("_w1"), _mask(zero, hi), null)),
            F.when(F.col("_w1") - F.col("_w0") > 1, F.array(piece(F.col("_w0") + 1, F.lit(0), F.col("_w1") - 1))).otherwise(
                F.array().cast("array<struct<word:bigint,mask:bigint,last:bigint>>")
            ),
        )
    )
    words = (
        base.select(*entity, F.explode(pieces).alias("p"))
        .groupBy(*entity, F.col("p.word").alias("word"))
        .agg(F.bit_or("p.mask").alias("mask"), F.max("p.last").alias("last"))
    )
    # Set runs of a word: a run starts at a set bit whose lower neighbour is clear.
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))

    def bit(i: Column) -> Column:
        return F.call_function("shiftright", F.col("mask"), i.cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1

    starts = F.filter(bits, lambda i: bit(i) & ((i == 0) | ~bit(F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(bits, lambda i: bit(i) & ((i == WORD - 1) | ~bit(F.least(i + 1, F.lit(WORD - 1)))))
    runs = F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct((F.col("word") * WORD + a).alias("run_from"), (F.col("word") * WORD + b + 1).alias("run_to")),
    )
    fill = F.when(
        F.col("last").isNotNull(),
        F.array(F.struct((F.col("word") * WORD).alias("run_from"), ((F.col("last") + 1) * WORD).alias("run_to"))),
    ).otherwise(F.array().cast("array<struct<run_from:bigint,run_to:bigint>>"))
    return words.select(*entity, F.explode(F.concat(runs, fill)).alias("r")).select(*entity, "r.run_from", "r.run_to")


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, length: str) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    Returns ``span_kind ('period' or 'gap'), entity..., from_unit, to_unit`` (exclusive end).

    Intervals that overlap, nest or touch make one period; a gap is the free units between two
    consecutive periods. Rows with a null start or a length that is null or below 1 don't count.
    Null entity columns group together. Repeated rows change nothing. An empty table gives no
    rows. Columns other than those named aren't read.

    The set runs of one entity (bounded by the units it spans, see :func:`covered_runs`) are
    joined across word borders by a running maximum; clear runs are the differences.
    """
    runs = covered_runs(df, entity, start, length)
    w = Window.partitionBy(*entity).orderBy("run_from", "run_to")
    reach = F.max("run_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_reach", reach)
    runs = runs.withColumn("_g", F.sum(F.when(F.col("run_from") <= F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    periods = runs.groupBy(*entity, "_g").agg(F.min("run_from").alias("_a"), F.max("run_to").alias("_b"), F.min_by("_reach", "run_from").alias("_before"))
    # The reach before a period's first run is the end of the period before.
    spans = F.array(
        F.struct(F.lit("period").alias("span_kind"), F.col("_a").alias("from_unit"), F.col("_b").alias("to_unit")),
        F.struct(F.lit("gap").alias("span_kind"), F.col("_before").alias("from_unit"), F.col("_a").alias("to_unit")),
    )
    return (
        periods.select(*entity, F.explode(spans).alias("x"))
        .where("x.from_unit is not null")
        .select("x.span_kind", *entity, "x.from_unit", "x.to_unit")
    )
