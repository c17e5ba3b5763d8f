"""Mapping freely typed values to the entries of a reference list.

Token-level repair as a join: the distinct strings of all texts (tokens, and neighbouring tokens
written together) meet the words of the reference list in an equi-join on deletion variants, which
finds every word within two edits (insertions, deletions, substitutions, swaps), and on prefixes,
which finds words cut off. Soft TF-IDF over the repaired tokens then ranks whole entries: token
weights come from the reference list, a token that was repaired counts by its closeness.

No list of words of the trade is built in. What a token is that the reference list doesn't hold
is told from the texts themselves: one that often stands beside names of the list is wording
around them and counts for nothing; one that is spelt alike so often, measured by the word it
resembles, that no misspelling would be, is a word of its own and counts against a match.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import bounded_rows, cut

_LEET = str.maketrans("0134578@$", "oieastbas")
_ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
_WORD = re.compile(r"(?:[^\W_]|[@$])+")
_DOTTED = re.compile(r"\b[a-z](?:\.[a-z])+\b")
_SLASHED = re.compile(r"\b([a-z])/([a-z])\b")
_NUMBERED = re.compile(r"\d+[a-z]?")

#: A string spelt alike in at least so many rows, and in so many for each row that holds the word it
#: resembles, is a word of its own; the second share holds where their first letters differ, as
#: few misspell the first letter.
OWN_ROWS, OWN_SHARE, OWN_SHARE_FIRST = 3, 0.5, 0.05
#: A token that stands beside a name of the list in at least this share of its texts is wording.
WORDING_SHARE = 0.2
#: Neighbouring tokens tried as one string.
RUN = 4


def tokens_of(text: str) -> list[str]:
    """Lower-case words without accents; letters typed as digits restored, dotted initials joined."""
    t = unicodedata.normalize("NFKC", text).translate(_ZERO_WIDTH).casefold()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = _DOTTED.sub(lambda m: m[0].replace(".", ""), t)
    t = _SLASHED.sub(r"\1\2", t)
    out: list[str] = []
    for w in _WORD.findall(t):
        if any(c.isalpha() for c in w) and not re.fullmatch(r"\d+[a-z]", w):
            w = w.translate(_LEET)
        out.append(w)
    return out


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (letters may come or go between swapped ones), or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    row_of: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k = row_of.get(y, 0)
            swap = d[k][last] + (i - k - 1) + 1 + (j - last - 1)
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, swap)
            if x == y:
                last = j
        row_of[x] = i
    return min(d[-1][-1], most + 1)


def allowed(n: int) -> int:
    """Edits allowed in a word of n letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


def variants(word: str, most: int) -> set[str]:
    """``word`` and what is left of it without up to ``most`` letters, two at most."""
    out, n = {word}, len(word)
    if most > 0:
        out.update(word[:i] + word[i + 1 :] for i in range(n))
    if most > 1:
        for i in range(n):
            head, tail = word[:i], word[i + 1 :]
            out.update([head + tail[:j] + tail[j + 1 :] for j in range(len(tail))])
    return out


def _forms(name: str) -> Iterable[str]:
    """A name and the words formed from it: practitioners, adjectives, other spellings."""
    yield name
    for old, new in (
        ("ology", ("ologist", "ologists", "ological", "ac", "al", "e")),
        ("iatry", ("iatrist", "iatrists", "iatric")),
        ("iatrics", ("iatrician", "iatricians", "iatric")),
        ("etrics", ("etrician", "etricians")),
        ("surgery", ("surgeon", "surgeons", "surgical")),
        ("therapy", ("therapist", "therapists")),
        ("paedics", ("paedic",)),
        ("etics", ("itian", "itians", "ician", "icians")),
    ):
        if name.endswith(old):
            yield from (name[: -len(old)] + n for n in new)


class Names:
    """The reference list: names, their words and weights. Linear in the list's size."""

    def __init__(self, table: dict[str, list[str]], wording: Iterable[str] = ()) -> None:
        seen: dict[tuple[str, ...], str] = {}
        for entry, given in table.items():
            for name in given:
                for form in _forms(" ".join(tokens_of(name.replace("_", " ")))):
                    for spelt in {form, form.replace("ae", "e").replace("oe", "e") if len(form) > 6 else form}:
                        if spelt:
                            seen.setdefault(tuple(spelt.split()), entry)
        self.names = list(seen.items())
        count: dict[str, set[str]] = defaultdict(set)
        self.holding: dict[str, list[int]] = defaultdict(list)
        for i, (words, entry) in enumerate(self.names):
            for w in set(words):
                count[w].add(entry)
                self.holding[w].append(i)
        n, idle = len(table), set(wording)
        self.entries = dict(count)
        self.weight = {w: math.log(1 + n / len(e)) * (0.35 if w in idle else 1.0) for w, e in count.items()}
        self.norm = [math.sqrt(sum(self.weight[w] ** 2 for w in words)) for words, _ in self.names]
        self.unknown = 0.45 * math.log(1 + n)
        self.joined = {"".join(words): i for i, (words, _) in reversed(list(enumerate(self.names)))}
        self.words = {*self.weight, *self.joined}
        self.longest = 2 + max(map(len, self.words), default=0)  # longer strings are more than two edits from any word

    def strings(self, tokens: list[str]) -> set[str]:
        """Tokens and runs of neighbouring tokens that may stand for a word of the list."""
        out = {t for t in tokens if len(t) <= self.longest}
        for size in range(2, RUN + 1):
            for i in range(len(tokens) - size + 1):
                if 6 <= sum(map(len, tokens[i : i + size])) <= self.longest:
                    out.add("".join(tokens[i : i + size]))
        return out

    def telling(self, token: str) -> set[str]:
        """Entries that a token points to by itself."""
        e = self.entries.get(token, ())
        return set(e) if len(e) == 1 and len(token) >= 4 else set()


#: What is known of a string: repairs as (word, closeness), whether it is wording, whether a word of its own.
Known = tuple[list[tuple[str, float]], bool, bool]
NOTHING: Known = ([], False, False)


def repairs(string: str, n_rows: int, near: list[tuple[str, bool, int]], listed: bool) -> tuple[list[tuple[str, float]], bool]:
    """Words that a string stands for, with closeness, and whether it is a word of its own.

    ``near``: the words that share a variant with it: word, whether it begins with the string, the
    number of rows that hold the word. A ``listed`` string is a word of the list, which may still
    be short for a longer one.
    """
    begun = [(w, 0.95 if len(string) >= 4 and w.startswith(string) else 0.85) for w, prefix, _ in near if prefix]
    if begun or listed:
        return sorted(begun), False
    most, found = allowed(len(string)), []
    for c, _, n in near:
        if len(c) < 4:
            continue
        d = distance(string, c, min(2, max(most, allowed(len(c)))))
        if d <= allowed(max(len(string), len(c))) and d < min(len(string), len(c)) / 2:
            found.append((d, c, n))
    if not found:
        return [], n_rows >= OWN_ROWS
    low = min(found)[0]
    best = [x for x in sorted(found) if x[0] == low]
    like = max((n, c[0] == string[0]) for _, c, n in found)
    if n_rows >= OWN_ROWS and n_rows >= (OWN_SHARE if like[1] else OWN_SHARE_FIRST) * like[0]:
        return [], True
    # The nearest words; one with another first letter counts a little less.
    return [(c, 1 - low / (max(len(c), len(string)) + 2) - 0.03 * (c[0] != string[0])) for _, c, _ in best], False


def rank(names: Names, tokens: list[str], known: dict[str, Known], threshold: float) -> tuple[str | None, str | None, float]:
    """(entry, name that matched, score) of a text's tokens; entry None if no entry is meant."""
    if not tokens:
        return None, None, 0.0
    weight, n_tokens = names.weight, len(tokens)

    def meant(s: str) -> list[tuple[str, float]]:
        got = known.get(s, NOTHING)[0]
        return [(s, 1.0), *got] if s in names.words else got

    best: tuple = (0.0, 0, "", None)
    close: dict[str, tuple[float, int]] = {}  # word -> closeness, token
    plain = []
    for i, t in enumerate(tokens):
        words = meant(t)
        for w, s in words:
            if w in weight and s > close.get(w, (0, 0))[0]:
                close[w] = (s, i)
        _, wording, own = known.get(t, NOTHING)
        listed = max((weight[w] for w, _ in words if w in weight), default=0.0)
        if wording or len(t) == 1 or _NUMBERED.fullmatch(t):
            plain.append(0.0)
        else:
            plain.append(listed or (2.2 if own else 1.0) * names.unknown)
    total = math.fsum(p * p for p in plain)
    for a in {i for w in close for i in names.holding[w]}:
        words, entry = names.names[a]
        dot, used, single = 0.0, {}, len(words) == 1
        for w in set(words):
            s, at = close.get(w, (0.0, -1))
            if s and not (single and s < 1 and len(w) < 5):
                dot += weight[w] ** 2 * s
                used[at] = weight[w]
        rest = max(0.0, total - math.fsum(plain[i] ** 2 for i in used))
        norm = math.sqrt(rest + sum(v * v for v in used.values()))
        if norm:
            best = max(best, (round(dot / (names.norm[a] * norm), 9), len(words), entry, " ".join(words)))
    # Words run together or parted at the wrong place.
    for size in range(1, RUN + 1):
        for i in range(n_tokens - size + 1):
            if not 6 <= sum(map(len, tokens[i : i + size])) <= names.longest:
                continue
            for w, s in meant("".join(tokens[i : i + size])):
                if w in names.joined and (size > 1 or w not in weight):
                    words, entry = names.names[names.joined[w]]
                    rest = max(0.0, total - math.fsum(p * p for p in plain[i : i + size]))
                    n = names.norm[names.joined[w]]
                    best = max(best, (round(n * s / math.sqrt(n * n + rest), 9), len(words), entry, " ".join(words)))
    score, _, entry, name = best
    return (entry, name, score) if score >= threshold else (None, name, score)


_DDL = "id bigint, text string, entry string, matched_name string, score double"
_SCHEMA = pa.schema([("id", pa.int64()), ("text", pa.string()), ("entry", pa.string()), ("matched_name", pa.string()), ("score", pa.float64())])


def _tell(names: Names):
    """For each distinct text its strings: whether it is a token, whether another token of the text names an entry."""
    schema = pa.schema([("s", pa.string()), ("rows", pa.int64()), ("token", pa.int32()), ("named", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, int, int, int]] = []
            for text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = tokens_of(text)
                told = {t: names.telling(t) for t in set(tokens)}
                count: dict[str, int] = defaultdict(int)  # how many tokens point to an entry
                for e in told.values():
                    for x in e:
                        count[x] += 1
                for s in names.strings(tokens):
                    own = names.entries.get(s, ())
                    rows.append((s, n, int(s in told), int(s in told and any(x not in own for x in count))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    return run


def _keys(prefixes: bool):
    """Join keys of strings: deletion variants, and prefixes (of words) or the string as one."""
    schema = pa.schema([("key", pa.string()), ("w", pa.string()), ("prefix", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            for i in range(0, len(words), 500):
                rows = []
                for w in words[i : i + 500]:
                    rows += [("d" + v, w, False) for v in variants(w, allowed(len(w)))]
                    if prefixes:
                        rows += [("p" + w[:k], w, True) for k in range(3, len(w) - 1)]
                    else:  # a word cut off, or cut off and given a plural's s
                        rows += [("p" + x, w, True) for x in {w, w[:-1] if w.endswith("s") and len(w) > 4 else w} if len(x) >= 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    return run


_KNOWN = "s string, words array<string>, close array<double>, wording boolean, own boolean"
_KNOWN_SCHEMA = pa.schema(
    [("s", pa.string()), ("words", pa.list_(pa.string())), ("close", pa.list_(pa.float64())), ("wording", pa.bool_()), ("own", pa.bool_())]
)


def _judge(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, n, n_texts, token, named, near in zip(*(c.to_pylist() for c in b.columns)):
                wording = bool(token) and named >= max(2, WORDING_SHARE * n_texts)
                got, own = repairs(s, n, [(x["w"], x["prefix"], x["n"] or 0) for x in near or []], s in names.words)
                if got or wording or own:
                    rows.append((s, [w for w, _ in got], [c for _, c in got], wording, own and not wording))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _KNOWN_SCHEMA)], schema=_KNOWN_SCHEMA)

    return run


def known_strings(texts: DataFrame, names: Names) -> DataFrame:
    """What is known of each distinct string of ``texts(text, n)``: ``s, words, close, wording, own``.

    Only strings of which something is known come out. The join is on single variants and
    prefixes, both sides hashed.
    """
    spark = texts.sparkSession
    told = texts.mapInArrow(_tell(names), "s string, rows bigint, token int, named int")
    stats = cut(told.groupBy("s").agg(F.sum("rows").alias("n"), F.count("*").alias("texts"), F.sum("named").alias("named"), F.max("token").alias("token")))
    words = spark.createDataFrame(pa.table({"w": pa.array(sorted(names.words), pa.string())}), "w string")
    index = words.mapInArrow(_keys(True), "key string, w string, prefix boolean")
    keyed = stats.select("s").mapInArrow(_keys(False), "key string, w string, prefix boolean").select("key", F.col("w").alias("s"))
    pairs = keyed.join(index, "key").where("s <> w").select("s", "w", "prefix").distinct()
    pairs = pairs.join(stats.select(F.col("s").alias("w"), F.col("n").alias("n_w")), "w", "left")
    near = pairs.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("w", "prefix", F.col("n_w").alias("n")))).alias("near"))
    return stats.join(near, "s", "left").select("s", "n", "texts", "token", "named", "near").mapInArrow(_judge(names), _KNOWN)


def _as_known(words: list, close: list, wording: bool, own: bool) -> Known:
    return list(zip(words, close)), wording, own


def map_to_list(
    df: DataFrame,
    reference: DataFrame,
    id: str = "evidence_id",
    text: str = "specialty_text",
    entry: str = "specialty",
    names: str = "also_known",
    shorthand: dict[str, tuple[str, ...]] | None = None,
    threshold: float = 0.6,
    max_entries: int = 100_000,
    broadcast_strings: int = 500_000,
) -> DataFrame:
    """Each row's free text with the reference entry it means, or none.

    Returns ``id, text, entry, matched_name, score``; ``entry`` is null where no entry reaches
    ``threshold`` (``matched_name`` is then the nearest name, if any). A null, empty or blank text
    has entry null and score 0; a text that is letter for letter an entry maps to it. At equal
    score the name of more words wins, then the later entry by alphabet. Repeated rows each come
    out. ``names`` may be null or empty; null entries are skipped. An empty reference list maps
    nothing, an empty table gives no rows. Texts and words of any length are matched whole. Only
    the named columns are read. ``shorthand`` adds names of entries from outside; it is empty by
    default.

    The reference list is fixed by nature and bounded: above ``max_entries`` the operator refuses.
    The distinct strings of all texts are counted, joined to the list's words and written once to
    the shared checkpoint folder. Up to ``broadcast_strings`` strings of which something is known
    are broadcast, and rows are ranked in one pass without exchange, each distinct text of a batch
    once. Beyond that, distinct texts meet their strings in a join and rows meet their text's
    result in another, with the same result.
    """
    spark = df.sparkSession
    table: dict[str, list[str]] = {}
    for r in bounded_rows(reference.select(F.col(entry).alias("e"), F.col(names).alias("n")), max_entries, "the reference list"):
        if r.e is not None:
            table.setdefault(r.e, []).extend([r.e, *(x for x in r.n or [] if x)])
    for e, more in (shorthand or {}).items():
        if e in table:
            table[e].extend(more)
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    if not table:
        return rows.select("id", "text", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("matched_name"), F.lit(0.0).alias("score"))
    listed = Names(table)
    texts = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    known = cut(known_strings(texts, listed))
    wording = [r.s for r in known.where("wording").join(F.broadcast(_words(spark, listed)), F.col("s") == F.col("w"), "left_semi").select("s").collect()]  # words of the list

    if known.count() > broadcast_strings:
        return _ranked_by_join(rows, texts, known, table, wording, threshold)
    told = {r.s: _as_known(r.words, r["close"], r.wording, r.own) for r in known.collect()}
    shared = spark.sparkContext.broadcast((table, wording, told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wording, told = shared.value
        ranked, memo = Names(table, wording), {}
        for b in batches:
            coded = b.column(1).dictionary_encode()
            got = []
            for t in coded.dictionary.to_pylist():
                if t not in memo:
                    if len(memo) >= 200_000:
                        memo.clear()
                    memo[t] = (t, t, 1.0) if t in table else rank(ranked, tokens_of(t), told, threshold)
                got.append(memo[t])
            at = [None if i is None else got[i] for i in coded.indices.to_pylist()]
            cols = [pa.array([x and x[k] for x in at], f.type) for k, f in enumerate(list(_SCHEMA)[2:4])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.array([x[2] if x else 0.0 for x in at], pa.float64())], schema=_SCHEMA)

    return rows.mapInArrow(run, _DDL)


def _words(spark, names: Names) -> DataFrame:
    return spark.createDataFrame(pa.table({"w": pa.array(sorted(names.words), pa.string())}), "w string")


def _ranked_by_join(rows: DataFrame, texts: DataFrame, known: DataFrame, table: dict, wording: list[str], threshold: float) -> DataFrame:
    """The same ranking where what is known of strings is too much to broadcast.

    Rows meet their text's result in a join on the text; adaptive execution splits a text that
    very many rows hold.
    """
    ranked = Names(table, wording)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                s = sorted(ranked.strings(tokens_of(t))) or [""]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(s), pa.string()), pa.array(s, pa.string())], names=["text", "s"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have = {x["s"]: _as_known(x["words"], x["close"], x["wording"], x["own"]) for x in told}
                out.append((t, *((t, t, 1.0) if t in table else rank(ranked, tokens_of(t), have, threshold))))
            fields = list(_SCHEMA)[1:]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, fields)], schema=pa.schema(fields))

    told = texts.mapInArrow(strings, "text string, s string").join(known, "s", "left")
    told = told.groupBy("text").agg(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("s", "words", "close", "wording", "own"))).alias("told"))
    scored = told.mapInArrow(score, "text string, entry string, matched_name string, score double")
    out = rows.join(scored, "text", "left")
    return out.select("id", "text", "entry", "matched_name", F.coalesce("score", F.lit(0.0)).alias("score"))
