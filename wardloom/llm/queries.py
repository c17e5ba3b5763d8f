"""Queries of the training-data operators (p1, p2, p4, p6, p8, p9, p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.keys import kind_key, trim_blanks
from wardloom.llm.canonical import map_to_list
from wardloom.llm.leakage import find_leaks
from wardloom.llm.mixing import mix_sources
from wardloom.llm.nearest import match_nearest, place_keys
from wardloom.llm.runs import collapse_runs
from wardloom.llm.sentences import sentence_units, spread_units
from wardloom.llm.split import split_oversized
from wardloom.llm.sql import SQL
from wardloom.session import Query, table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "ward_event"), min_events=2).select("first_seq", "n_events")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collapse_runs(table(spark, sf_dir, "ward_event"))
    return runs.drop("last_seq").withColumn("duration_s", F.round("duration_s", 6))


def p1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of near-identical events: a stray read or two inside a run stays in it."""
    runs = collapse_runs(table(spark, sf_dir, "ward_event"), w_activity=0.4, w_place=0.6)
    return runs.drop("last_seq").withColumn("duration_s", F.round("duration_s", 6))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    ward = table(spark, sf_dir, "ward_event").where(kind_key("subject_kind") == "clinician")
    return match_nearest(
        table(spark, sf_dir, "chart_event"), ward, place_keys(), place_keys(), "chart_id", "charted_at", "seq", "event_ts"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(F.col("left_id").alias("chart_id"), F.col("right_id").alias("seq"))


def p2_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(F.col("left_id").alias("chart_id"), F.col("right_id").alias("seq"), F.round("lag_s", 6).alias("lag_s"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf_dir, "doc_chunk"), only_split=True, texts=False)
    return pieces.where("piece_no = 1").select("id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "doc_chunk"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item put together again from its pieces, and whether they keep to the limits."""
    pieces = split_oversized(table(spark, sf_dir, "doc_chunk")).withColumn("rest", F.expr("substring(text, overlap_chars + 1)"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "rest"))), lambda x: x["rest"])
    return pieces.groupBy("id").agg(
        F.sum(F.col("n_tokens") - F.col("overlap_tokens")).alias("n_tokens"),
        F.bool_and((F.col("n_tokens") <= 400) & (F.col("overlap_tokens") <= 60)).alias("within"),
        F.when(F.count("text") > 0, F.md5(F.array_join(whole, ""))).alias("text_md5"),
    )


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the nine languages' documents, characters counting where a script has no blanks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("start_line"), F.col("source").alias("heading_path"))
    return split_oversized(docs, by_script=True).select(F.col("id").cast("bigint").alias("doc_id"), "piece_no", "n_pieces", "n_tokens", "overlap_tokens", "start_line", "end_line", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = map_to_list(table(spark, sf_dir, "specialty_evidence"), table(spark, sf_dir, "specialty_ref"))
    got = got.where((trim_blanks("text") != "") & ~F.col("entry").eqNullSafe(F.col("text")))
    return got.select(F.col("id").alias("evidence_id"), F.coalesce("entry", F.lit("unmatched")).alias("specialty"))


def p6_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_list(table(spark, sf_dir, "specialty_evidence"), table(spark, sf_dir, "specialty_ref"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("item_id", "doc_id")


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with a leaked stretch, however small a part of the passage it is."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), min_share=0.0)
    return leaks.select("item_id", "doc_id", "found", "length", (F.col("found") == F.col("length")).alias("whole"))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    held = F.array_sort(F.collect_list(F.struct("item_id", F.round(F.col("found") / F.col("length"), 4).alias("share"))))
    return leaks.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.to_json(held).alias("items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1].withColumn("reached_share", F.round("reached_share", 9))


def p9_full_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), total_tokens="all")[0]


def p9_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), total_tokens="all")[1]
    return got.withColumn("reached_share", F.round("reached_share", 9))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"), texts=False)


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


def p10_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same units with chunks spread over tasks, small enough that most documents have several."""
    return spread_units(table(spark, sf_dir, "documents"), chunk_chars=1000, texts=False)


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_runs": p1_runs,
    "p1_near": p1_near,
    "p2_found": p2_found,
    "p2_lags": p2_lags,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_restored": p4_restored,
    "p4_documents": p4_documents,
    "p6_found": p6_found,
    "p6_mapped": p6_mapped,
    "p8_found": p8_found,
    "p8_stretches": p8_stretches,
    "p8_documents": p8_documents,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_full_mix": p9_full_mix,
    "p9_full_shares": p9_full_shares,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
    "p10_spread": p10_spread,
}
