"""Queries of schedule search, sources and streaming, over generated instances and the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.operators import episodes as E
from wardloom.operators import exact as B
from wardloom.operators import features as V
from wardloom.operators import search as X
from wardloom.operators.geometry import Layout, costs
from wardloom.session import Query, cut, shared_folder
from wardloom.sources import synthetic

SEEDS = [17, 41, 99]


def random_search_front(spark: SparkSession, d: str) -> DataFrame:
    return X.run_islands(spark, X.ward_instance(), X.random_search, SEEDS, 300)


def hill_climb_front(spark: SparkSession, d: str) -> DataFrame:
    return X.run_islands(spark, X.ward_instance(), X.hill_climb, SEEDS, 300)


def acs_front(spark: SparkSession, d: str) -> DataFrame:
    return X.run_islands(spark, X.ward_instance(), X.ant_colony, SEEDS, 300)


def nsga2_front(spark: SparkSession, d: str) -> DataFrame:
    return X.run_islands(spark, X.ward_instance(), X.nsga2, SEEDS, 300)


def exact_small_front(spark: SparkSession, d: str) -> DataFrame:
    return X.run_islands(spark, X.tiny_instance(3, 5), X.exact_small, [0], 2_000_000)


def exact_payoff(spark: SparkSession, d: str) -> DataFrame:
    """Proven best of each objective on a small instance, with value, bound and gap."""
    return B.payoff(spark, X.tiny_instance(4, 6))


def epsilon_sweep(spark: SparkSession, d: str) -> DataFrame:
    return B.epsilon_sweep(spark, X.tiny_instance(3, 5), grid=2)


def epsilon_front(spark: SparkSession, d: str) -> DataFrame:
    return B.sweep_front(cut(B.epsilon_sweep(spark, X.tiny_instance(3, 5), grid=2)))


def anchor_front(spark: SparkSession, d: str) -> DataFrame:
    """The genetic search on 30 beds, eight clinicians and 36 slots."""
    return X.run_islands(spark, X.anchor_instance(), X.nsga2, SEEDS, 300)


def synthetic_recall(spark: SparkSession, d: str) -> DataFrame:
    """Episodes found in a clean generated log against its true visits."""
    events, truth = synthetic.event_log(spark, Layout(), synthetic.LogConfig(n_days=3))
    eps = E.episodes(events.withColumn("place", F.col("location")))
    return eps.agg(F.count("*").alias("n_episodes")).withColumn("n_visits", F.lit(truth.count()))


def day_type_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of clustered generated ward-days against their types."""
    layout = Layout()
    eps, types = synthetic.ward_days(spark, layout)
    f = V.standardise(cut(V.ward_day_features(eps, layout, costs(spark, layout), None)))
    labels = V.kmeans(cut(V.vectors(f).select("day", "ward", "v")), ["day", "ward"], 4)[0]
    return V.adjusted_rand(labels.join(types, ["day", "ward"]), "label", "day_type").withColumn("ari", F.round("ari", 6))


def stream_place_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windowed counts of the event table read as a stream, run to its end."""
    from wardloom.streaming.episodes import stream_counts

    schema = spark.read.parquet(f"{d}/ward_event.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/ward_event.parquet*")
    counts = stream_counts(stream.withColumn("place", F.col("source")), "1 day", "30 days")
    to = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    # The last batch holds the complete result; it is written to the shared folder, none of it comes to the driver.
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{to}/counts")
    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{to}/counts").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("place").alias("source"), "n_events")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (random_search_front, hill_climb_front, acs_front, nsga2_front, exact_small_front, exact_payoff, epsilon_sweep, epsilon_front, anchor_front, synthetic_recall, day_type_agreement, stream_place_counts)
}
SQL: dict[str, str] = {
    "stream_place_counts": "select date_trunc('day', event_ts)::timestamp as window_start, source, count(*) as n_events from ward_event where event_ts is not null group by 1, 2",
}
