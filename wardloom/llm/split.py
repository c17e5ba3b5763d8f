"""Splitting oversized texts at natural boundaries: balanced targets snapped to the strongest break.

A token is a longest run of characters other than blank, tab, CR and LF; with ``by_script`` also each
character of a script without blanks between words, with the marks that follow it. For a text of n
tokens, a limit L and an overlap v, the least number of pieces is k = ceil((n - v) / (L - v)).
k - 1 targets part the text evenly; each is snapped to the strongest boundary near it that leaves
both the piece before and all pieces after within the limit, or, where none near it is natural, to
one anywhere within these limits. Where cuts fall between words although the text has breaks
enough, pieces are added: k + 1, k + 2, k + 4 and so on up to 2 k are tried, and the fewest
unnatural cuts win, then the fewest pieces. A text in one long line is known to have no breaks and
is tried once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a boundary before a token; NATURAL and above are breaks of the text itself.
WORD, CLAUSE, LINE, SENTENCE, ITEM, PARAGRAPH, HEADING = range(7)
NATURAL = LINE

_TOKEN = re.compile(r"[^ \t\r\n]+")
#: The same with a token for each character of scripts without blanks between words.
_DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_BY_SCRIPT = regex.compile(rf"[{_DENSE}][\p{{M}}\p{{P}}]*|[^ \t\r\n{_DENSE}]+")
_FENCE = re.compile(r"(?:```|~~~)")
_ITEM = re.compile(r"(?:[-*+]|\d+[.)]|\|)")
_END = re.compile(r"[.!?…。！？।؟][\"'”’»)\]」』]*$")
_CLAUSE = re.compile(r"[,;:、，；：،–—][\"'”’»)\]]*$")


def strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before each token; the first has HEADING."""
    out, fenced = [HEADING], False
    if spans and _FENCE.match(text, spans[0][0]):
        fenced = True
    for i in range(1, len(spans)):
        a, b = spans[i - 1][1], spans[i][0]
        breaks = text.count("\n", a, b)
        if not breaks:
            word = text[spans[i - 1][0] : a]
            if fenced:
                out.append(WORD)
            elif len(word) < 200 and _END.search(word) and not text[b].islower() and not text[b].isdigit():
                out.append(SENTENCE)
            else:
                out.append(CLAUSE if len(word) < 200 and _CLAUSE.search(word) else WORD)
            continue
        fence = _FENCE.match(text, b)
        if fenced:
            out.append(LINE)  # also before the closing fence, which belongs to its block
            if fence:
                fenced = False
            continue
        fenced = bool(fence)
        if text[b] == "#":
            out.append(HEADING)
        elif breaks > 1 or fence:
            out.append(PARAGRAPH)
        elif _ITEM.match(text, b):
            out.append(ITEM)
        elif _END.search(text[max(spans[i - 1][0], a - 8) : a]):
            out.append(SENTENCE)
        else:
            out.append(LINE)
    return out


def _snap(n: int, force: list[int], natural: list[int], k: int, limit: int, overlap: int) -> tuple[list[tuple[int, int]], int] | None:
    """(piece start with overlap, core start) of k pieces in tokens, and how many cuts aren't natural; None if there can't be so many."""
    step = limit - overlap
    each = (n + (k - 1) * overlap) / k  # length of a piece
    reach = max(1, int(each / 4))
    pieces, forced = [(0, 0)], 0

    def strongest(a: int, b: int, target: int) -> int | None:
        """The strongest natural boundary from a to b, at equal strength the nearest to the target."""
        at = natural[bisect_left(natural, a) : bisect_left(natural, b + 1)]
        return min(at, key=lambda c: (-force[c], abs(c - target), c)) if at else None

    for i in range(1, k):
        start = pieces[-1][0]
        target = round(i * (each - overlap) + overlap)
        low = max(pieces[-1][1] + 1, n - (k - i) * step)
        high = min(start + limit, n - (k - i))
        if low > high:
            return None
        a, b = max(low, target - reach), min(high, target + reach)
        if a > b:
            a, b = low, high
        cut = strongest(a, b, target)
        if cut is None and (a, b) != (low, high):
            cut = strongest(low, high, target)
        if cut is None:
            forced += 1
            near = min(max(target, a), b)
            clause = range(max(a, near - reach // 2), min(b, near + reach // 2) + 1)
            cut = min(clause, key=lambda c: (-force[c], abs(c - near), c))
        back = cut
        if overlap:
            # Overlap of the full length, or a little less where that begins at a natural break.
            first = max(cut - overlap, pieces[-1][1] + 1)
            if first < cut:
                back = strongest(first, max(first, cut - overlap // 2 - 1), first) or first
        pieces.append((back, cut))
    return pieces, forced


def cut_points(n: int, force: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start with overlap, core start) of every piece, in tokens."""
    if n <= limit:
        return [(0, 0)]
    natural = [i for i, f in enumerate(force) if i and f >= NATURAL]
    # A stretch without a natural boundary forces a cut after every ``limit`` tokens.
    edges = [0, *natural, n]
    least_forced = sum((b - a - 1) // limit for a, b in zip(edges, edges[1:]))
    least = -(-(n - overlap) // (limit - overlap))
    best, more = None, 0
    while more <= least:
        got = _snap(n, force, natural, least + more, limit, overlap)
        if got and (best is None or got[1] < best[1]):
            best = got
        if best[1] <= least_forced:
            break
        more = more * 2 or 1
    return best[0]


def pieces_of(text: str, limit: int, overlap: int, by_script: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces of a text: (from char, core from char, to char, tokens, overlap tokens, last char of the last token)."""
    spans = [m.span() for m in (_BY_SCRIPT if by_script else _TOKEN).finditer(text)]
    if len(spans) <= limit:
        return [(0, 0, len(text), len(spans), 0, spans[-1][1] if spans else 0)]
    points = cut_points(len(spans), strengths(text, spans), limit, overlap)

    def at(token: int) -> int:
        """Where a piece that begins with this token begins: after the line break before it, if any."""
        if not token:
            return 0
        nl = text.rfind("\n", spans[token - 1][1], spans[token][0])
        return nl + 1 if nl >= 0 else spans[token][0]

    out = []
    for i, (start, core) in enumerate(points):
        end = points[i + 1][1] if i + 1 < len(points) else len(spans)
        out.append((at(start), at(core), at(end) if end < len(spans) else len(text), end - start, core - start, spans[end - 1][1]))
    return out


_DDL = (
    "id string, piece_no int, n_pieces int, n_tokens bigint, overlap_tokens bigint, overlap_chars bigint, start_line int, end_line int,"
    " heading_path string, text string"
)
_SCHEMA = pa.schema(
    [("id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32())]
    + [(c, pa.int64()) for c in ("n_tokens", "overlap_tokens", "overlap_chars")]
    + [("start_line", pa.int32()), ("end_line", pa.int32()), ("heading_path", pa.string()), ("text", pa.string())]
)


def _run(limit: int, overlap: int, texts: bool, by_script: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for key, text, line, path in zip(*(c.to_pylist() for c in b.columns)):
                if text is None:
                    rows.append((key, 1, 1, 0, 0, 0, line, line, path, None))
                    continue
                got = pieces_of(text, limit, overlap, by_script)
                lines, at = 0, 0  # line breaks before ``at``
                for i, (a, core, z, n, shared, last) in enumerate(got):
                    lines += text.count("\n", at, a) if a >= at else -text.count("\n", a, at)
                    at = a
                    top = None if line is None else line + lines
                    foot = None if line is None else top + text.count("\n", a, last)
                    rows.append((key, i + 1, len(got), n, shared, core - a, top, foot, path, text[a:z] if texts else None))
                    held += z - a
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def split_oversized(
    df: DataFrame,
    limit: int = 400,
    overlap: int = 60,
    id: str = "id",
    text: str = "text",
    start_line: str = "start_line",
    heading_path: str = "heading_path",
    only_split: bool = False,
    texts: bool = True,
    by_script: bool = False,
) -> DataFrame:
    """Pieces of every item, each within ``limit`` tokens, consecutive ones sharing up to ``overlap``.

    Returns ``id, piece_no, n_pieces, n_tokens, overlap_tokens, overlap_chars, start_line,
    end_line, heading_path, text``. Texts are slices of the item: dropping the first
    ``overlap_chars`` of each piece and joining the rest gives the item back, every character.
    ``start_line`` is the line where the piece begins, ``end_line`` that of its last token.

    An item within the limit is one piece. A null text is one piece without text; an empty or
    blank text one piece of no tokens. Null start_line stays null, so does heading_path. Items
    with the same id each come out. A token of any length counts as one; with ``by_script``, for
    texts in scripts without blanks between words, each of their characters is a token. ``only_split``
    leaves out items within the limit, ``texts=False`` the pieces' texts. Needs 0 <= overlap < limit.
    An empty table gives no rows; columns other than those named aren't read.

    One pass without exchange, an item at a time; ``only_split`` skips items too short to hold
    ``limit`` + 1 tokens before they leave the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    rows = df.select(
        F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(start_line).cast("int").alias("line"), F.col(heading_path).cast("string").alias("path")
    )
    if only_split:
        rows = rows.where(F.length("text") > (limit if by_script else 2 * limit))
    out = rows.mapInArrow(_run(limit, overlap, texts, by_script), _DDL)
    return out.where("n_pieces > 1") if only_split else out
