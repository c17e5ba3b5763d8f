"""Keys of freely written ids and names, as Spark columns and as the same rule in SQL.

An id is the same however its letters are cased and whatever blanks surround it. A place or an
activity is the same when two spellings differ only in case, blanks, separators (``/ - _``) or
zeros before a number. A null or blank value has a null key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as a character class: ASCII ones, no-break and typographic spaces, zero-width marks.
BLANKS = r"\s\u00A0\u2000-\u200B\u202F\u2060\u3000\uFEFF"

#: The same one by one.
_BLANK_CHARS = " \t\n\x0b\f\r\u00a0\u202f\u2060\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c: str | Column) -> Column:
    """``c`` without blanks of any kind at its ends."""
    return F.btrim(_col(c), F.lit(_BLANK_CHARS))


def id_key(c: str | Column) -> Column:
    """Upper-case id without outer blanks; null for a null or blank id."""
    return F.nullif(F.upper(trim_blanks(c)), F.lit(""))


def kind_key(c: str | Column) -> Column:
    """Lower-case kind without outer blanks; null for a null or blank one."""
    return F.nullif(F.lower(trim_blanks(c)), F.lit(""))


def name_key(c: str | Column) -> Column:
    """Key of a place or an activity; null for a null or blank one.

    Zeros are looked for before separators go, since those may stand between two numbers; only a
    text with a zero pays for the regular expression.
    """
    c = _col(c)
    t = F.when(F.contains(c, F.lit("0")), F.regexp_replace(c, "(?<![0-9])0+(?=[0-9])", "")).otherwise(c)
    return F.nullif(F.lower(F.translate(t, _BLANK_CHARS + "/_-", "")), F.lit(""))


# The same rules as SQL text for DuckDB (RE2 has no look-behind: the digit before is captured).
def sql_id(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def sql_kind(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def sql_name(c: str) -> str:
    return (
        f"nullif(lower(regexp_replace(regexp_replace({c}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'),"
        f" '[\\s/_-]+', '', 'g')), '')"
    )
