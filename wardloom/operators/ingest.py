"""Event ingest: typed events, place mapping with quarantine, pseudonyms, the ingestion report, moves."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.keys import id_key, kind_key, name_key
from wardloom.operators.ordered import micros
from wardloom.operators.sharded import neighbour, number_block
from wardloom.session import small_side

#: Prefix of a place that no mapping tier knows, and the confidence of the three tiers.
QUARANTINE = "QUARANTINE:"
EXACT, FUZZY, UNKNOWN = 1.0, 0.85, 0.0


def typed_events(df: DataFrame) -> DataFrame:
    """Events with ids and kind keyed, activity in lower case with ``_``, confidence 1.0 where it is missing.

    Rows without subject or time are kept; later operators say what they do with them.
    """
    flat = F.translate(F.lower(F.trim("activity")), " \t/-", "____")
    activity = F.when(F.contains(flat, F.lit("__")), F.regexp_replace(flat, "_+", "_")).otherwise(flat)
    confidence = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 1.0).otherwise(F.col("confidence"))
    return df.select(
        "seq", "event_ts", kind_key("subject_kind").alias("subject_kind"), id_key("subject").alias("subject"),
        activity.alias("activity"), "location", "source", confidence.alias("confidence"),
    )


def bay_alias_key(raw: str | Column) -> Column:
    """``bay<n>`` of a free spelling of a bay ("Bay 03", "b3"), null for anything else."""
    n = F.regexp_extract(raw if isinstance(raw, Column) else F.col(raw), r"(?i)^\s*b(?:ay)?\s*0*([0-9]+)\s*$", 1)
    return F.when(n != "", F.concat(F.lit("bay"), n))


def map_places(df: DataFrame, places: DataFrame, aliases: DataFrame | None = None, location: str = "location") -> DataFrame:
    """``df`` with ``place`` and ``place_confidence`` of its raw location. No row is dropped.

    Tiers: the spelling of ``places(place)`` itself (1.0); the same key, or a bay alias of
    ``aliases(alias, place)`` (0.85); else ``QUARANTINE:`` and the raw text (0.0). A null location
    has a null place and confidence 0. Of two places with the same key the first by name wins.
    """
    exact = places.select(F.col("place").alias("_exact")).where("_exact is not null").distinct()
    keyed = places.select(name_key("place").alias("_key"), "place").groupBy("_key").agg(F.min("place").alias("_fuzzy")).where("_key is not null")
    out = df.withColumn("_key", name_key(location)).join(small_side(exact), F.col(location) == F.col("_exact"), "left")
    out = out.join(small_side(keyed), "_key", "left")
    fuzzy = F.col("_fuzzy")
    if aliases is not None:
        given = aliases.select(bay_alias_key("alias").alias("_alias"), F.col("place").alias("_given")).where("_alias is not null").dropDuplicates(["_alias"])
        out = out.withColumn("_bay", bay_alias_key(location)).join(small_side(given), F.col("_bay") == F.col("_alias"), "left")
        fuzzy = F.coalesce(fuzzy, F.col("_given"))
    place = F.coalesce(F.col("_exact"), fuzzy, F.concat(F.lit(QUARANTINE), F.col(location)))
    sure = F.when(F.col("_exact").isNotNull(), EXACT).when(fuzzy.isNotNull(), FUZZY).otherwise(UNKNOWN)
    return out.select(*df.columns, place.alias("place"), sure.alias("place_confidence"))


def is_quarantined(place: str) -> Column:
    return F.col(place).startswith(QUARANTINE)


def quarantined_raw(place: str) -> Column:
    """The raw text of a quarantined place, null for any other."""
    return F.when(is_quarantined(place), F.substring(F.col(place), len(QUARANTINE) + 1, 1 << 30))


def quarantined_places(events: DataFrame) -> DataFrame:
    """``raw, n_events, n_subjects`` of every text that no tier knows, as it was written."""
    raw = quarantined_raw("place").alias("raw")
    return events.select(raw, "subject").where("raw is not null").groupBy("raw").agg(F.count("*").alias("n_events"), F.count_distinct("subject").alias("n_subjects"))


def pseudonym(c: str | Column, salt: bytes) -> Column:
    """First 16 hex digits of HMAC-SHA256(salt, value), in built-in expressions. Null stays null."""
    key = salt if len(salt) <= 64 else hashlib.sha256(salt).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in key).hex())) for p in (0x36, 0x5C))
    value = F.encode(c if isinstance(c, Column) else F.col(c), "utf-8")
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value), 256))), 256), 1, 16)


def pseudonym_of(value: str, salt: bytes) -> str:
    """The same of one value on the driver."""
    return hmac.new(salt, value.encode(), hashlib.sha256).hexdigest()[:16]


def pseudonymise(df: DataFrame, salt: bytes, column: str = "subject") -> DataFrame:
    return df.withColumn(column, pseudonym(column, salt))


def ingestion_report(events: DataFrame, duplicate_window_s: float = 10, block_width: int = 100_000) -> DataFrame:
    """Per subject: rows, rows earlier than the one before them, and repeats; nothing is repaired.

    Needs ``seq, event_ts, subject_kind, subject, activity, place``; order is that of arrival. A
    row out of order isn't counted as a repeat. A repeat has the activity and place of the row
    before and at most ``duplicate_window_s`` seconds between. ``n_quarantined`` counts places that
    no tier knows. Rows without subject group under null.
    """
    x = events.select("seq", "subject_kind", "subject", "activity", "place", micros("event_ts").alias("_t"))
    take = {"_pt": "_t", "_pa": "activity", "_pp": "place"}
    x = neighbour(x, ["subject_kind", "subject"], ["seq"], number_block("seq", block_width), take)
    late = F.col("_t") < F.col("_pt")
    again = ~late & (F.col("activity") == F.col("_pa")) & (F.col("place") == F.col("_pp")) & (F.col("_t") - F.col("_pt") <= round(duplicate_window_s * 1_000_000))
    return x.groupBy("subject_kind", "subject").agg(
        F.count("*").alias("n_events"),
        F.count_if(late).alias("n_out_of_order"),
        F.count_if(again).alias("n_duplicates"),
        F.count_if(is_quarantined("place")).alias("n_quarantined"),
    )


def transitions(events: DataFrame, block_width: int = 100_000) -> DataFrame:
    """Consecutive rows of a subject, in order of arrival, at different places.

    ``subject_kind, subject, origin, destination, departed_at, arrived_at, seconds``; rows without
    subject or place are passed over. ``seconds`` may be negative where rows arrived late.
    """
    x = events.where("subject is not null and place is not null").select("seq", "event_ts", "subject_kind", "subject", "place")
    x = neighbour(x, ["subject_kind", "subject"], ["seq"], number_block("seq", block_width), {"origin": "place", "departed_at": "event_ts"})
    return x.where("origin is not null and origin <> place").select(
        "subject_kind", "subject", "seq", "origin", F.col("place").alias("destination"), "departed_at", F.col("event_ts").alias("arrived_at"),
        ((micros("event_ts") - micros("departed_at")) / 1_000_000).alias("seconds"),
    )


def event_log(events: DataFrame) -> DataFrame:
    """Process log of events: ``case_id, activity, event_ts, seq, resource``; rows without case, activity or time are left out."""
    return events.where("subject is not null and activity is not null and event_ts is not null").select(
        F.col("subject").alias("case_id"), "activity", "event_ts", "seq", F.col("place").alias("resource")
    )
