"""Loading event CSV records and setting apart those that fail to parse, with the reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.operators.ordered import from_micros

#: Fields of an event record, in order.
FIELDS = ("timestamp", "subject_kind", "subject", "activity", "location", "source", "confidence")
#: Reasons in the order in which the checks run.
REASONS = ("broken_quoting", "column_count", "invalid_timestamp", "invalid_subject_kind", "invalid_confidence")
QUOTING, COLUMNS, STAMP, KIND, CONFIDENCE, LOADED = range(6)

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_QUOTED_WELL = rf"(?s)\A{_FIELD}(?:,{_FIELD})*\z"
_STAMP = (
    r"\A(?P<y>[0-9]{4})-(?P<mo>[0-9]{2})-(?P<d>[0-9]{2})[T ](?P<h>[0-9]{2}):(?P<mi>[0-9]{2})"
    r"(?::(?P<s>[0-9]{2}))?(?P<f>\.[0-9]{1,6})?(?P<z>Z|[+-][0-9]{2}:[0-9]{2})?\z"
)
_NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_TRIM = " \t\r\n\u00a0\u200b\u3000"
_OUT = [
    ("line_id", pa.int64()),
    ("reason", pa.string()),
    ("failing_cell", pa.string()),
    ("event_us", pa.int64()),
    *((c, pa.string()) for c in FIELDS[1:6]),
    ("confidence", pa.float64()),
]
_DDL = (
    "line_id bigint, reason string, failing_cell string, event_us bigint, subject_kind string, subject string, activity string,"
    " location string, source string, confidence double"
)


def _split(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Positions that the reader's callback rejects for their number of fields, positions read, and their fields.

    Each record gets its position as a field before it, so that the rejects' text names it.
    """
    if not len(lines):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [pa.array([], pa.string()) for _ in FIELDS]
    wrong: list[int] = []

    def reject(row: pv.InvalidRow) -> str:
        wrong.append(int(row.text.partition(",")[0]))
        return "skip"

    numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(lines))), pa.string()), lines, ",")
    text = pa.concat_arrays([pc.binary_join(pa.ListArray.from_arrays([0, len(numbered)], numbered), "\n"), pa.array(["\n"])])
    data = pc.binary_join(pa.ListArray.from_arrays([0, 2], text), "").cast(pa.binary())[0].as_buffer()
    names = ["at", *FIELDS]
    got = pv.read_csv(
        pa.BufferReader(data),
        read_options=pv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, data.size + 1)),
        parse_options=pv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=pv.ConvertOptions(column_types={"at": pa.int64(), **{c: pa.string() for c in FIELDS}}, strings_can_be_null=False, check_utf8=False),
    ).combine_chunks()
    return np.array(wrong, dtype=np.int64), got.column("at").to_numpy(), [got.column(c).combine_chunks() for c in FIELDS]


def _stamps(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Validity and UTC microseconds of timestamp cells; a stamp without a zone keeps its wall clock."""
    parts = pc.extract_regex(cells, _STAMP)
    hit = parts.is_valid()

    def number(field: str, empty: str = "0") -> np.ndarray:
        x = pc.fill_null(pc.struct_field(parts, field), empty)
        return pc.cast(pc.if_else(pc.equal(x, ""), empty, x), pa.int64()).to_numpy(zero_copy_only=False)

    y, mo, d = number("y", "1"), number("mo", "1"), number("d", "1")
    h, mi, s = number("h"), number("mi"), number("s")
    seconds = pc.fill_null(pc.struct_field(parts, "s"), "")
    frac = pc.fill_null(pc.struct_field(parts, "f"), "")
    us = pc.cast(pc.utf8_rpad(pc.utf8_ltrim(frac, "."), 6, "0"), pa.int64()).to_numpy(zero_copy_only=False)
    # A fraction without seconds isn't allowed.
    lone = pc.and_(pc.equal(seconds, ""), pc.not_equal(frac, "")).to_numpy(zero_copy_only=False)
    zone = pc.fill_null(pc.struct_field(parts, "z"), "")
    signed = pc.if_else(pc.or_(pc.equal(zone, ""), pc.equal(zone, "Z")), "+00:00", zone)
    zh = pc.cast(pc.utf8_slice_codeunits(signed, 1, 3), pa.int64()).to_numpy(zero_copy_only=False)
    zm = pc.cast(pc.utf8_slice_codeunits(signed, 4, 6), pa.int64()).to_numpy(zero_copy_only=False)
    sign = np.where(pc.starts_with(signed, "-").to_numpy(zero_copy_only=False), -1, 1)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(mo, 1, 12) - 1] + (leap & (mo == 2))
    good = hit.to_numpy(zero_copy_only=False) & (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= longest)
    good &= (h <= 23) & (mi <= 59) & (s <= 59) & (zh <= 23) & (zm <= 59) & ~lone
    y, mo, d = np.where(good, y, 1970), np.where(good, mo, 1), np.where(good, d, 1)
    days = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (mo - 1)
    day = days.astype("datetime64[D]").astype(np.int64) + d - 1
    total = ((day * 24 + h) * 60 + mi - sign * (zh * 60 + zm)) * 60 + s
    return good, total * 1_000_000 + us


def _fractions(cells: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Validity and value of confidence cells; an empty cell is valid and counts as 1.0."""
    empty = pc.equal(cells, "")
    bare = pc.utf8_trim(cells, _TRIM)
    hit = pc.match_substring_regex(bare, _NUMBER)
    # The vector cast wants a digit on both sides of the point and no plus sign.
    plain = pc.replace_substring_regex(pc.if_else(hit, bare, "0"), r"\A\+", "")
    plain = pc.replace_substring_regex(pc.replace_substring_regex(plain, r"\A(-?)\.", r"\10."), r"\.(\z|[eE])", r".0\1")
    value = pc.cast(plain, pa.float64())
    within = pc.and_(hit, pc.and_(pc.greater_equal(value, 0), pc.less_equal(value, 1)))
    return pc.or_(empty, within).to_numpy(zero_copy_only=False), pc.if_else(empty, 1.0, value)


def classify(ids: pa.Array, lines: pa.Array) -> pa.RecordBatch:
    """One row for each record: loaded fields, or the first reason for failure and the cell at fault."""
    n = len(lines)
    # A line end that closes the record isn't part of its last field.
    lines = pc.replace_substring_regex(pc.fill_null(lines.cast(pa.string()), ""), r"\r?\n\z", "")
    well = pc.match_substring_regex(lines, _QUOTED_WELL).to_numpy(zero_copy_only=False)
    # An unquoted line break would end the record early: more than one record isn't seven fields.
    bare = pc.replace_substring_regex(lines, r'"(?:[^"]|"")*"', "")
    torn = pc.match_substring_regex(bare, r"[\r\n]").to_numpy(zero_copy_only=False)
    reason = np.where(well, COLUMNS, QUOTING)
    loaded = np.full(n, -1)  # row among the fields of a record that loads
    faulty = np.full(n, -1)  # cell at fault, counted over the three columns that can be
    at = np.flatnonzero(well & ~torn)
    wrong, read, cells = _split(lines.take(pa.array(at)))
    if len(wrong) + len(read) != len(at):
        raise ValueError("the reader neither read nor rejected some records")
    reason[at[wrong]] = COLUMNS
    at = at[read]
    ok_t, us = _stamps(cells[0])
    kinds = pc.utf8_lower(pc.utf8_trim(cells[1], _TRIM))
    ok_k = pc.is_in(kinds, pa.array(["clinician", "patient"])).to_numpy(zero_copy_only=False)
    ok_c, confidence = _fractions(cells[6])
    code = np.where(~ok_t, STAMP, np.where(~ok_k, KIND, np.where(~ok_c, CONFIDENCE, LOADED)))
    reason[at] = code
    rows = np.arange(len(at))
    loaded[at] = np.where(code == LOADED, rows, -1)
    faulty[at] = np.where(code == LOADED, -1, (code - STAMP) * len(at) + rows)

    def spread(values: pa.Array, where: np.ndarray) -> pa.Array:
        """Values at the places given, null where there is none (-1)."""
        return values.take(pa.array(where, mask=where < 0))

    texts = [pc.if_else(pc.equal(cells[k], ""), None, cells[k]) for k in (2, 3, 4, 5)]
    cols = [
        ids,
        pa.array([*REASONS, None]).take(pa.array(reason)),
        spread(pa.concat_arrays([cells[0], cells[1], cells[6]]), faulty),
        *(spread(x, loaded) for x in (pa.array(us), kinds, *texts, confidence)),
    ]
    return pa.RecordBatch.from_arrays(cols, schema=pa.schema(_OUT))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield classify(b.column(0).cast(pa.int64()), b.column(1))


def parse_event_lines(df: DataFrame, line_id: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """Every record of ``df`` with its fields if it loads, else with the reason why it doesn't.

    Returns ``line_id, reason, failing_cell, event_ts, subject_kind, subject, activity, location,
    source, confidence``. ``reason`` is null for a loaded row, else the first check of ``REASONS``
    that fails; ``failing_cell`` is the text of the cell at fault, if one cell is.

    A null record, an empty one, and one that an unquoted line break tears in two fail with
    ``column_count``. A null line_id stays null. An empty confidence loads as 1.0, other empty
    fields as null. Times with a zone load as UTC. Repeated records come out as often as they
    come in. Other columns of ``df`` aren't read.

    Quoting is checked by one regular expression over the batch; the well-quoted records of a
    batch then go through one CSV reader whose invalid-row callback takes those with another
    number of fields and names them; fields are read as strings and cast as vectors. No exchange.
    """
    got = df.select(F.col(line_id).cast("bigint").alias("line_id"), F.col(raw).cast("string").alias("raw")).mapInArrow(_read, _DDL)
    return got.select(
        "line_id", "reason", "failing_cell", from_micros("event_us").alias("event_ts"), *FIELDS[1:6], "confidence"
    )
