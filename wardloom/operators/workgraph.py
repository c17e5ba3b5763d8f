"""A dependency graph of work items (item, depends_on): loading, checks, a drawing, budgets and the audit table."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.session import cut, local_table

_ITEM = "item string, title string, agent string, gate string, budget_tokens bigint, status string, spec string, condition string, rationale string"


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``items`` and ``edges(item, depends_on)`` of a YAML or JSON file with a list ``nodes``.

    A node has ``id`` and may have ``title, agent, gate, budget_tokens, status, spec, condition,
    rationale, depends_on``; without them it is an autonomous pending item of the builder.
    """
    raw = Path(path).read_text(encoding="utf-8")
    try:
        doc = json.loads(raw)
    except ValueError:
        import yaml  # only needed for YAML

        doc = yaml.safe_load(raw)
    given = {"title": "", "agent": "builder", "gate": "autonomous", "budget_tokens": 0, "status": "pending"}
    nodes = [{**given, **n} for n in (doc or {}).get("nodes") or []]
    names = [x.split()[0] for x in _ITEM.split(", ")]
    items = [tuple(n["id"] if c == "item" else int(n[c]) if c == "budget_tokens" else n.get(c) for c in names) for n in nodes]
    edges = [(n["id"], d) for n in nodes for d in n.get("depends_on") or ()]
    return local_table(spark, items, _ITEM), local_table(spark, edges, "item string, depends_on string")


def flowchart(items: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as lines of a Mermaid flowchart: ``no, line``, items before arrows, each by name."""
    box = F.concat(F.lit("  "), "item", F.lit('["'), "item", F.when(F.col("title") != "", F.concat(F.lit("<br/>"), "title")).otherwise(""), F.lit('"]:::'), F.replace("gate", F.lit("-"), F.lit("_")))
    arrow = F.concat(F.lit("  "), "depends_on", F.lit(" --> "), "item")
    lines = items.select(F.lit(1).alias("part"), box.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), arrow.alias("line")))
    head = local_table(items.sparkSession, [(0, "flowchart TD")], "part int, line string")
    return head.unionByName(lines).orderBy("part", "line").select("part", "line")


def assess(usage: DataFrame, hard_limit: int, thresholds: list[tuple[float, str]]) -> DataFrame:
    """``billable, fraction, remaining, action`` of all usage: the action of the highest share of the limit that is reached, else ``ok``."""
    total = F.coalesce(F.sum("billable"), F.lit(0.0))
    x = usage.agg(total.alias("billable")).withColumn("fraction", F.col("billable") / F.lit(float(max(1, hard_limit))))
    action = F.lit("ok")
    for share, name in sorted(thresholds):
        action = F.when(F.col("fraction") >= share, name).otherwise(action)
    return x.select("billable", "fraction", F.greatest(F.lit(0.0), F.lit(float(hard_limit)) - F.col("billable")).alias("remaining"), action.alias("action"))


_ENTRY = ("action", "why", "authority", "node", "model", "artefacts", "evidence", "actor")


def append_audit(entries: DataFrame, path: str) -> None:
    """Adds entries to the audit table below ``path``, stamped with the time; nothing there is changed.

    Columns ``action, why, authority`` are needed, ``node, model, artefacts, evidence, actor`` may be
    missing; an entry without one of the needed ones is refused as a whole batch.
    """
    if entries.where("action is null or why is null or authority is null").limit(1).count():
        raise ValueError("an audit entry needs action, why and authority")
    kinds = {"artefacts": "array<string>"}
    cols = [(F.col(c) if c in entries.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in _ENTRY]
    entries.select(F.current_timestamp().alias("at"), *cols).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the audit table."""
    ddl = ", ".join(f"{c} {'array<string>' if c == 'artefacts' else 'string'}" for c in _ENTRY)
    return spark.read.schema(f"at timestamp, {ddl}").json(path)


def missing_dependencies(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to items that don't exist."""
    return edges.join(items.select(F.col("item").alias("depends_on")), "depends_on", "left_anti")


def on_cycles(edges: DataFrame, cut_every: int = 8) -> DataFrame:
    """Items on a cycle or between two: what is left after taking away, round by round, items without dependencies and items nobody needs.

    Rounds go on until nothing changes, as many as the longest chain asks for; lineage is cut every
    few rounds. Edges with a null on either side and repeated ones count for nothing.
    """
    left = cut(edges.where("item is not null and depends_on is not null").select("item", "depends_on").distinct())
    n, turn = left.count(), 0
    while n:
        has_in = left.select(F.col("depends_on").alias("item")).distinct()
        has_out = left.select(F.col("item").alias("depends_on")).distinct()
        left, turn = left.join(has_in, "item", "left_semi").join(has_out, "depends_on", "left_semi"), turn + 1
        left = cut(left) if turn % cut_every == 0 else left
        m = left.count()
        if m == n:
            break
        n = m
    return left.select("item").unionByName(left.select(F.col("depends_on").alias("item"))).distinct()


def runnable(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items not done whose dependencies all are (``items(item, done)``)."""
    open_ = edges.join(items.where("done").select(F.col("item").alias("depends_on")), "depends_on", "left_anti").select("item").distinct()
    return items.where("not done").join(open_, "item", "left_anti").select("item")
