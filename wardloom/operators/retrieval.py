"""Text chunks, BM25, vector search, rank fusion and retrieval scores."""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import xor
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardloom.session import local_table, small_side

# BM25 parameters, fusion constant and depth.
K1, B, RRF_K, DEPTH = 1.5, 0.75, 60, 50
TOKEN = "[a-z0-9]+"


# Chunkers: (start line, end line, heading path, text), lines from 1.
def heading_sections(lines: list[str]) -> list[tuple[int, int, str]]:
    """Line ranges under each heading with the path ``a > b > c``; text before the first heading has an empty path.

    Each heading fills the slot of its level and empties the deeper ones; the filled slots are its path.
    """
    inside = accumulate((x.lstrip().startswith("```") for x in lines), xor)
    heads = [(0, 0, "")] + [
        (at, len(m[1]), m[2]) for at, (line, fenced) in enumerate(zip(lines, inside)) if not fenced and (m := re.match(r"(#{1,6})\s+(.*\S)\s*$", line))
    ]
    slots = accumulate(heads, lambda held, head: {**{k: v for k, v in held.items() if k < head[1]}, head[1]: head[2]}, initial={})
    ends = [at for at, _, _ in heads[1:]] + [len(lines)]
    return [(at + 1, end, " > ".join(v for k, v in sorted(held.items()) if k)) for (at, _, _), end, held in zip(heads, ends, list(slots)[1:]) if end > at]


def line_windows(lines: list[str], first: int, last: int, max_tokens: int = 400, overlap: int = 60) -> list[tuple[int, int]]:
    """Greedy windows of whole lines by running token counts: as many as fit in ``max_tokens``, and the first line with tokens in any case.

    The next window goes back by whole lines until it shares at least ``overlap`` tokens, but begins
    later than this one.
    """
    upto = [0, *accumulate(len(x.split()) for x in lines[first - 1 : last])]  # tokens before each line
    out, a, n = [], 0, len(upto) - 1
    while a < n:
        b = min(n, max(bisect_right(upto, upto[a] + max_tokens) - 1, bisect_right(upto, upto[a])))
        out.append((first + a, first + b - 1))
        if b == n:
            break
        a = max(a + 1, bisect_right(upto, upto[b] - overlap) - 1) if overlap else b
    return out


def markdown_chunks(text: str, max_tokens: int = 400, overlap: int = 60) -> list[tuple[int, int, str, str]]:
    lines = text.split("\n")
    out = []
    for a, b, path in heading_sections(lines):
        if "".join(lines[a - 1 : b]).strip():
            out += [(x, y, path, "\n".join(lines[x - 1 : y])) for x, y in line_windows(lines, a, b, max_tokens, overlap)]
    return out


def audit_chunks(text: str) -> list[tuple[int, int, str, str]]:
    """One chunk for each ``## `` entry."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines, 1) if x.startswith("## ")]
    return [(a, b, lines[a - 1][3:].strip(), "\n".join(lines[a - 1 : b])) for a, b in zip(at, [x - 1 for x in at[1:]] + [len(lines)])]


def paged_chunks(text: str, marker: str = r"<!--\s*page\s+(\d+)\s*-->") -> list[tuple[int, int, str, str, int | None]]:
    """Markdown chunks that never cross a page marker, with their page; without markers plain markdown chunks."""
    lines, page, start, out = text.split("\n"), None, 1, []

    def close(end: int) -> None:
        part = "\n".join(lines[start - 1 : end])
        out.extend((a + start - 1, b + start - 1, p, t, page) for a, b, p, t in markdown_chunks(part))

    for i, line in enumerate(lines, 1):
        m = re.search(marker, line)
        if m:
            close(i - 1)
            page, start = int(m[1]), i + 1
    close(len(lines))
    return out


def python_chunks(text: str, module: str) -> list[tuple[int, int, str, str]]:
    """Module docstring, classes and functions as signature with docstring only; a file that doesn't parse is one chunk."""
    lines = text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [(1, len(lines), module, text)] if text.strip() else []
    out = []

    def head(node: ast.AST) -> tuple[int, int]:
        """Lines from the first decorator to the docstring's end, or to the end of the signature."""
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        body = node.body[0]
        doc = isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str)
        return start, body.end_lineno if doc else max(start, body.lineno - 1)

    def add(node: ast.AST, path: str) -> None:
        a, b = head(node)
        out.append((a, b, path, "\n".join(lines[a - 1 : b])))

    if ast.get_docstring(tree):
        b = tree.body[0].end_lineno
        out.append((1, b, module, "\n".join(lines[:b])))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            add(node, f"{module}.{node.name}")
        if isinstance(node, ast.ClassDef):
            for sub in node.body:
                if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    add(sub, f"{module}.{node.name}.{sub.name}")
    return out


def chunk_texts(df: DataFrame, path: str, text: str, max_tokens: int = 400, overlap: int = 60) -> DataFrame:
    """Chunks of each row's text by the kind of its path: ``id, path, start_line, end_line, page_anchor, heading_path, text, sha256``.

    ``.py`` files by their syntax, paths with ``audit`` by entries, others as Markdown, by pages where
    there are page markers. Null texts have none; a null path counts as Markdown.
    """
    schema = pa.schema([("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("page_anchor", pa.int32()), ("heading_path", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = p or ""
                if name.endswith(".py"):
                    got = [(*c, None) for c in python_chunks(t, name.rpartition("/")[2][:-3])]
                elif "audit" in name.lower():
                    got = [(*c, None) for c in audit_chunks(t)]
                elif "<!--" in t:
                    got = paged_chunks(t)
                else:
                    got = [(*c, None) for c in markdown_chunks(t, max_tokens, overlap)]
                rows += [(p, a, z, page, h, x) for a, z, h, x, page in got]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    x = df.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = x.mapInArrow(run, "path string, start_line int, end_line int, page_anchor int, heading_path string, text string")
    ident = F.concat(F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"))
    return out.select(ident.alias("id"), "path", "start_line", "end_line", "page_anchor", "heading_path", "text", F.sha2("text", 256).alias("sha256"))


# BM25.
def tokens(c) -> F.Column:  # noqa: ANN001
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str, heading: str | None, text: str, query_id: str, query: str) -> DataFrame:
    """``query_id, doc_id, score`` of every document that shares a term with the query.

    Terms are runs of ASCII letters and digits of the lower-case heading and text. A term that a
    query holds twice counts twice. Documents with null text have length 0 but count. Only terms
    that some query holds leave the tokeniser; document frequencies are counted over all documents.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = body if heading is None else F.concat(F.coalesce(F.col(heading), F.lit("")), F.lit("\n"), body)
    d = docs.select(F.col(doc_id).alias("doc_id"), tokens(whole).alias("t")).withColumn("dl", F.size("t"))
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.coalesce(F.col(query), F.lit("")))).alias("term"))
    q = q.groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    terms = small_side(q.select("term").distinct())
    post = d.select("doc_id", "dl", F.explode("t").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    want = q.join(df, "term").select("query_id", "term", "qf", idf.alias("idf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return post.join(small_side(want), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best k of each query with ``rank``, by score (to nine places), then id; cut down before the exchange."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf_fuse(first: DataFrame, second: DataFrame, k: int = 8, rrf_k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of two rankings (``query_id, doc_id, rank``): ``query_id, doc_id, score, rank``."""
    a = first.where(F.col("rank") <= depth).select("query_id", "doc_id", F.col("rank").alias("ra"))
    b = second.where(F.col("rank") <= depth).select("query_id", "doc_id", F.col("rank").alias("rb"))
    one = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    return top_k(a.join(b, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", (one("ra") + one("rb")).alias("score")), k)


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, search_k: int = 20) -> DataFrame:
    """One row: recall at k and mean reciprocal rank over all ``queries(query_id)``.

    A hit is a ranked chunk (``doc_id``) of a relevant path whose lines overlap a relevant span
    (``query_id, path, start_line, end_line``). A query without a hit counts 0.
    """
    place = chunks.select(F.col("doc_id"), F.col("path").alias("p"), F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    hits = ranked.where(F.col("rank") <= search_k).join(place, "doc_id").join(relevant, "query_id")
    hits = hits.where((F.col("p") == F.col("path")) & (F.col("a") <= F.col("end_line")) & (F.col("z") >= F.col("start_line")))
    best = hits.groupBy("query_id").agg(F.min("rank").alias("best"))
    x = queries.select("query_id").distinct().join(best, "query_id", "left")
    return x.agg(F.count("*").alias("n_queries"), F.avg((F.coalesce(F.col("best"), F.lit(search_k + 1)) <= k).cast("double")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"))


def hashed_vectors(df: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """``key, v``: unit vectors of hashed token counts weighted by inverse document frequency, in built-in expressions."""
    t = df.select(F.col(key), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = df.count()
    idf = t.groupBy("term").agg(F.log(F.lit(n + 1.0) / (F.count("*") + 0.5)).alias("idf"))
    t = t.join(idf, "term").withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(width)).cast("int"))
    s = t.groupBy(key, "slot").agg(F.sum(F.col("tf") * F.col("idf")).alias("w"))
    m = s.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest(F.col("norm"), F.lit(1e-12))).alias("v"))


# Stored index, search and evaluation.
def write_index(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Chunks as Parquet below ``path``, one row of statistics beside them and, if given, vectors (``id, v``)."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    stats = chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("path").alias("n_files"), F.coalesce(F.sum(F.size(tokens(F.coalesce(F.col("text"), F.lit(""))))), F.lit(0)).alias("n_tokens"))
    stats.withColumn("version", F.lit(1)).write.mode("overwrite").parquet(f"{path}/stats")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Chunks, statistics and vectors (None where there are none) of a stored index."""
    try:
        vectors = spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        vectors = None
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/stats"), vectors


def search(chunks: DataFrame, queries: DataFrame, k: int = 8, dense: DataFrame | None = None) -> DataFrame:
    """Ranking of ``chunks(id, heading_path, text)`` for ``queries(query_id, query)``: fused with ``dense(query_id, doc_id, rank)`` if given, else lexical only."""
    lexical = top_k(bm25_scores(chunks, queries, "id", "heading_path", "text", "query_id", "query"), k if dense is None else DEPTH)
    return lexical if dense is None else rrf_fuse(lexical, dense, k)


def evaluate(chunks: DataFrame, queries: DataFrame, relevant: DataFrame, dense: DataFrame | None = None, k: int = 5, search_k: int = 20) -> DataFrame:
    """Recall and reciprocal rank of the lexical ranking and, with ``dense``, of the vector and the fused one: a row each."""
    place = chunks.select(F.col("id").alias("doc_id"), "path", "start_line", "end_line")
    found = {"lexical": search(chunks, queries, search_k)}
    if dense is not None:
        found |= {"vector": dense, "hybrid": search(chunks, queries, search_k, dense)}
    out = None
    for name, ranked in found.items():
        row = retrieval_scores(ranked, relevant, place, queries, k, search_k).withColumn("retriever", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("retriever", "n_queries", "recall", "mrr")


def load_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled queries of a YAML (or JSON) file: ``queries(query_id, query, note)`` and ``relevant(query_id, path, start_line, end_line)``.

    The file holds a list of entries, or a map with one under ``queries``: id, query, note and relevant spans.
    """
    raw = Path(path).read_text(encoding="utf-8")
    try:
        entries = json.loads(raw)
    except ValueError:
        import yaml  # only needed for YAML

        entries = yaml.safe_load(raw)
    entries = entries["queries"] if isinstance(entries, dict) else entries
    q = [(str(e["id"]), e["query"], e.get("note")) for e in entries]
    spans = [(str(e["id"]), r["path"], int(r["start_line"]), int(r["end_line"])) for e in entries for r in e.get("relevant", [])]
    return local_table(spark, q, "query_id string, query string, note string"), local_table(spark, spans, "query_id string, path string, start_line int, end_line int")
