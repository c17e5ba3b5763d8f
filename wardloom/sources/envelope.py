"""Artefact envelopes: JSON with all five strategies' payloads, refused where provenance is incomplete."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.operators.evidence import STRATEGIES

# Names of an envelope, calibrations, and parts of names that mark embeddings.
KEYS = ("kind", "schema_version", "method_version", "strategy", "available_strategies", "calibration", "payload")
CALIBRATIONS = ("synthetic", "measured")
EMBEDDING_MARKS = ("embedding", "vector", "latent", "encoding", "representation", "neuron")


class ArtefactError(ValueError):
    pass


class UnknownStrategy(ArtefactError):
    pass


class MissingProvenance(ArtefactError):
    pass


class EmbeddingLeak(ArtefactError):
    pass


def reject_embeddings(payload: Any, path: str = "payload") -> None:
    """Refuses a payload with a field name that marks an embedding, at any depth of maps and lists."""
    if isinstance(payload, dict):
        for k, v in payload.items():
            if any(m in str(k).lower() for m in EMBEDDING_MARKS):
                raise EmbeddingLeak(f"{path}.{k} looks like an embedding")
            reject_embeddings(v, f"{path}.{k}")
    elif isinstance(payload, (list, tuple)):
        for i, v in enumerate(payload):
            reject_embeddings(v, f"{path}[{i}]")


def reject_embedding_columns(df: DataFrame) -> None:
    """The same over a DataFrame's schema."""
    reject_embeddings(json.loads(df.schema.json()).get("fields") and _names(df.schema.jsonValue()), "schema")


def _names(t: Any) -> Any:
    if isinstance(t, dict) and t.get("type") == "struct":
        return {f["name"]: _names(f["type"]) for f in t["fields"]}
    if isinstance(t, dict) and t.get("type") == "array":
        return [_names(t["elementType"])]
    return _names(t["valueType"]) if isinstance(t, dict) and t.get("type") == "map" else None


@dataclass(frozen=True)
class Envelope:
    kind: str
    method_version: str
    strategy: str
    payload: dict[str, Any]
    calibration: str = "synthetic"
    schema_version: int = 1
    available_strategies: tuple[str, ...] = STRATEGIES

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise UnknownStrategy(self.strategy)
        if set(self.available_strategies) != set(STRATEGIES):
            raise MissingProvenance("an artefact holds all five strategies")
        if self.calibration not in CALIBRATIONS:
            raise MissingProvenance(f"unknown calibration {self.calibration!r}")
        if not self.kind or not self.method_version or not set(STRATEGIES) <= set(self.payload):
            raise MissingProvenance("kind, method version and a payload for each strategy are needed")
        reject_embeddings(self.payload)

    def with_strategy(self, strategy: str) -> Envelope:
        """Another strategy selected; nothing is computed again."""
        return replace(self, strategy=strategy)

    def selected(self) -> Any:
        return self.payload[self.strategy]

    def to_mapping(self) -> dict[str, Any]:
        return {k: list(v) if isinstance(v := getattr(self, k), tuple) else v for k in KEYS}

    @classmethod
    def from_mapping(cls, m: dict[str, Any]) -> Envelope:
        missing = [k for k in KEYS if k not in m]
        if missing:
            raise MissingProvenance(f"missing {missing}")
        return cls(**{k: tuple(m[k]) if k == "available_strategies" else m[k] for k in KEYS})


def write_json(envelope: Envelope, path: str) -> None:
    Path(path).write_text(json.dumps(envelope.to_mapping(), ensure_ascii=False, indent=1), encoding="utf-8")


def read_json(path: str) -> Envelope:
    return Envelope.from_mapping(json.loads(Path(path).read_text(encoding="utf-8")))


def write_claims(claims: DataFrame, path: str) -> None:
    """Claims (``patient, specialty, strategy`` and per-source recognition) as Parquet, a directory for each strategy."""
    claims.write.mode("overwrite").partitionBy("strategy").parquet(path)


def read_claims(spark: SparkSession, path: str, sources: tuple[str, ...] = ("referral", "consult_note", "problem_list")) -> DataFrame:
    """Claims back, with confidence made anew from the recognitions: a stored one is never trusted."""
    x = spark.read.parquet(path)
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in sources[1:]), F.coalesce(F.col(sources[0]), F.lit(0.0)))
    return x.withColumn("confidence", total / float(len(sources)))


def envelope_of(rows_by_strategy: DataFrame, kind: str, method_version: str, strategy: str, max_rows: int = 100_000) -> Envelope:
    """An envelope of a small report with a ``strategy`` column; refuses more than ``max_rows`` rows."""
    reject_embedding_columns(rows_by_strategy)
    rows = rows_by_strategy.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ArtefactError("too many rows for one artefact")
    payload: dict[str, Any] = {s: [] for s in STRATEGIES}
    for r in rows:
        d = r.asDict(recursive=True)
        payload.setdefault(d.pop("strategy"), []).append({k: str(v) if hasattr(v, "isoformat") else v for k, v in d.items()})
    return Envelope(kind, method_version, strategy, payload)
