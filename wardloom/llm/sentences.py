"""Sentence units of documents in many languages by a compiled finite-state transducer.

A text is read as a sequence of marks: runs of ordinary text, terminators, quotes, brackets, line
breaks, blanks between Thai letters. A mark's class says what stands at and next to it (which
terminator, whether glued, the kind of the word before and of what comes after); the classes are
the transducer's alphabet. The boundary rules are compiled into a table state x class -> state,
action; the actions place starts and ends of units.

Because the transducer is finite, a chunk of a document is a function from state to state. Every
document is cut into chunks of marks; the functions of all chunks of a batch are worked out side by
side, composed in order within each document by a doubling scan, which gives each chunk its first
state, and then all chunks place their units side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.session import cut

# Abbreviations, in lower case without their last point.
#: A name or a number follows: the point never ends a sentence.
BEFORE_NAME = frozenset(
    "dr mr mrs ms messrs prof st fig figs vol pp cf vs approx e.g i.e eg ie incl viz ca vgl bzw z.b d.h u.a s.o s.u med hr fr env art"
    " núm num pág pag págs aprox sr sra srta dr dra drs p.ex p.ej ex ej mme mlle mm av bd cap ed eds rev gen col capt lt sgt hon resp evtl ggf inkl exkl tel"
    " डॉ श्री د ดร นพ พญ".split()
)
#: Ends a sentence only if no number follows.
BEFORE_NUMBER = frozenset("no nos nr n p s pp abs kap bd z sec ch ref op ext tab abb seite art núm".split())
#: Ends a sentence if a capital follows (as after any word), but is common inside one.
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember"
    " january february march may june july october december".split()
)
BEFORE_ORDINAL = frozenset("am im vom zum beim der die das den dem des bis ab seit nach vor zur jeden nr".split())
# Verbs of speech, of scripts without capitals.
SPEECH_END = re.compile(r"(?:说|說|问|問|道|喊|叫|答|写道|表示|回答|पूछा|पूछी|कहा|कही|बोला|बोली|बोले|बताया|चिल्लाया)\s*$")
SPEECH_START = re.compile(r"(?:و?(?:سأل|سألت|قال|قالت|صاح|صاحت|أجاب|أجابت|أضاف|أضافت|كتب|كتبت|هتف|هتفت)|ถาม|กล่าว|พูด|บอก)")
PARTICLES = "とはのをがにでも"
#: Thai words that go on with the sentence after a blank.
THAI_ON = re.compile(r"(?:ตาม|และ|หรือ|โดย|เพราะ|ซึ่ง|เพื่อ|แต่|จึง|เมื่อ|ของ|จาก|ที่)")

TERMS = ".!?…。！？｡।॥؟۔．"
LOOK = 20_000  # how far a closing quote or bracket is looked for
CONTEXT = 24_576  # characters around a chunk sent elsewhere that its marks may look at; above LOOK
_CLOSERS = "\"'”’»)]}」』）］】“"
_QUOTES = "\"“”„«»「」『』"
_OPEN_B, _CLOSE_B = "([（［【", ")]）］】"
_PAIR = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "(": ")", "[": "]", "（": "）", "［": "］", "【": "】"}
_SPECIAL = re.escape(TERMS + _QUOTES + _OPEN_B + _CLOSE_B) + r"\r\n"
_THAI = "฀-໿"
_LINES = r"(?P<nl>[ \t]*(?:\r?\n|\r)\s*)"
_TERM = rf"(?P<t>[{re.escape(TERMS)}]+)"
_Q = rf"(?P<q>[{re.escape(_QUOTES)}])|(?P<b>[{re.escape(_OPEN_B + _CLOSE_B)}])"
_LEX = re.compile(rf"{_LINES}|{_TERM}|{_Q}|(?P<w>[^\s{_SPECIAL}](?:[^{_SPECIAL}]*[^\s{_SPECIAL}])?)")
_LEX_THAI = re.compile(rf"{_LINES}|{_TERM}|{_Q}|(?P<th>(?<=\S)[^\S\r\n]+(?=\S))|(?P<w>[^\s{_SPECIAL}]+)")
_HAS_THAI = re.compile(f"[{_THAI}]")
_HEAD = re.compile(r"#{1,6}(?=[ \t]|\S)[^\r\n]")
_ITEM = re.compile(r"(?:[-*+•‣][ \t]+|(\d{1,3})[.)][ \t]+)(\w*)")
_WORD_BEFORE = re.compile(r"[\w.’'ऀ-ॿ฀-໿]+$")
_BLANKS = re.compile(r"\s*")
_POINTED = re.compile(r"\w\.")
_CLAUSE = re.compile(r"(?:[^。！？।?!.\n\"“”「」«»:：]|\n(?![ \t\r]*\n)){0,120}")
_TERMINAL = frozenset("。！？｡।॥؟۔")

END, CONT, REPORT = "end", "cont", "report"


def _kind(text: str, i: int) -> str:
    """What comes at i: lower, upper, digit, letter (without case), dash-lower, comma, other or nothing."""
    if i >= len(text):
        return "nothing"
    c = text[i]
    if c in "—–-" and i + 1 < len(text):
        j = _BLANKS.match(text, i + 1).end()
        return "dash-lower" if j < len(text) and text[j].islower() else "other"
    if c in "_*`":
        j = i
        while j < len(text) and text[j] in "_*`":
            j += 1
        return _kind(text, j) if j < len(text) and text[j] not in "—–-" else "other"
    if c.islower():
        # A word such as pH, mRNA or eGFR may begin a sentence.
        if i + 1 < len(text) and text[i + 1].isupper():
            return "upper"
        return "lower"
    if c.isupper() or c.istitle():
        return "upper"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "letter"
    return "comma" if c in ",;:，；：、،؛%" else "other"


# What the class of a terminator says. FULL marks of scripts with their own stop, dots (an ellipsis),
# LOUD ones (! and ?), a plain stop; the word before a plain stop; what comes after.
FULL, DOTS, LOUD, STOP = "full", "dots", "loud", "stop"
KINDS = ("lower", "upper", "digit", "letter", "dash-lower", "comma", "other", "nothing")
WORDS = ("word", "name", "number", "initial", "dated", "ordinal", "letters", "letters-m", "glued", "glued-word", "glued-open")


def _may_end(run: str, glued: bool, kind: str, word: str) -> bool:
    """Whether a terminator may end a sentence, outside quotes and brackets."""
    if kind == "nothing":
        return True
    if run == FULL:
        return kind != "comma"
    if run == DOTS:
        return kind == "upper" and not glued
    if run == LOUD:
        return kind not in ("lower", "comma", "dash-lower") and not (glued and kind == "digit")
    if glued:
        return word == "glued-word" and kind == "upper" or word == "glued-open" and kind == "other"
    if kind in ("lower", "comma", "dash-lower"):
        return False
    never = word in ("name", "initial", "dated", "letters")
    unless = {"number": "digit", "ordinal": "upper", "letters-m": "digit"}
    return not never and unless.get(word) != kind


_MONTH_AFTER = re.compile(r"\w+")
_WORD_TWO_BEFORE = re.compile(r"(\w+)\s+$")
_LETTER_BEFORE = re.compile(r"\b\w\.\s+$")


def _word(text: str, a: int, j: int, glued: bool, kind: str) -> str:
    """Kind of the word that the stop text[a] follows; text[j] is what comes after."""
    before = _WORD_BEFORE.search(text, max(0, a - 40), a)
    word = before.group(0) if before else ""
    low = word.lower().lstrip("'’")
    named = low in BEFORE_NAME
    if glued:
        if kind == "upper" and text[j].isupper():
            after = text[j + 1 : j + 2]
            whole = len(word) > 2 and word.isalpha() and word[-1].islower() and not named
            return "glued-word" if whole and (after.islower() or not after.strip()) else "glued"
        opens = text[j] in "\"“„«([—" and len(word) > 1 and not word[-1].isdigit() and not named
        return "glued-open" if opens else "glued"
    if named or "." in low and low.rpartition(".")[2] in BEFORE_NAME:
        return "name"
    if kind == "digit" and low in BEFORE_NUMBER:
        return "number"
    if len(word) == 1 and (word.isupper() or word.isalpha() and _POINTED.match(text, j)):
        return "initial"  # also the first of letters parted by blanks: "z. B.", "p. m."
    if word.isdigit() and len(word) <= 2:
        after = _MONTH_AFTER.match(text, j)
        if after and after.group(0).lower() in MONTHS:
            return "dated"
        prior = _WORD_TWO_BEFORE.search(text, max(0, before.start() - 20), before.start())
        if prior and prior.group(1).lower() in BEFORE_ORDINAL:
            return "ordinal"
    if len(low) == 1 and low.isalpha() and _LETTER_BEFORE.search(text, max(0, a - 6), a - 1):
        return "letters-m" if low == "m" else "letters"  # the last of such letters: "p. m." may end a sentence
    return "word"


def _terminator(text: str, a: int, b: int) -> int:
    """Class of the terminator text[a:b]."""
    run, c = text[a:b], text[a]
    how = "TE" if c == "…" or b - a > 2 and run == "." * (b - a) else "TC" if a and text[a - 1] in _CLOSERS else "T"
    j = _BLANKS.match(text, b).end()
    if j - b > 1 and "\n\n" in text[b:j].replace("\r", "").replace(" ", "").replace("\t", ""):
        kind = "nothing"
    else:
        while j < len(text) and text[j] in _CLOSERS and not (text[j] in "\"“" and j + 1 < len(text) and not text[j + 1].isspace() and text[j + 1] not in TERMS + ",;:"):
            j = _BLANKS.match(text, j + 1).end()
        kind = _kind(text, j)
    glued, word = j == b, "word"
    if run[-1] in _TERMINAL or c in _TERMINAL:
        sort = FULL
    elif c == "…" or "..." in run or run == "..":
        sort = DOTS
    elif "!" in run or "?" in run:
        sort = LOUD
    else:
        sort = STOP
        if kind not in ("nothing", "lower", "comma", "dash-lower") or glued and kind != "nothing":
            word = _word(text, a, j, glued, kind)
    return CLASSES[how, sort, glued, kind, word]


# How a sentence goes on after a closing quote. Hints: a particle glued to it, a clause of speech, a terminator.
HINTS = ("", "particle", "speech", "term")


def _goes_on(stopped: bool, gap: bool, kind: str, hint: str) -> str:
    """END, CONT, or REPORT by the next clause."""
    if not stopped:
        return CONT
    if gap:
        return END
    if kind in ("lower", "comma", "dash-lower") or hint in ("particle", "term"):
        return CONT
    return REPORT if hint == "speech" else END


_GOES_ON = {x: _goes_on(*x) for x in product((False, True), (False, True), KINDS, HINTS)}


def _follow(text: str, a: int, b: int) -> str:
    """How the sentence goes on after a closing quote text[a:b]."""
    i = a - 1
    while i >= 0 and text[i] in " \t\r\n  ":
        i -= 1
    if i < 0 or text[i] not in TERMS:
        return CONT
    j = _BLANKS.match(text, b).end()
    kind, hint = _kind(text, j), ""
    if kind == "letter":
        if j == b and text[j] in PARTICLES:
            hint = "particle"
        elif SPEECH_START.match(text, j):
            hint = "speech"
        else:
            clause = _CLAUSE.match(text, j)
            k = clause.end()
            if k < len(text) and text[k] in "。！？।!." and SPEECH_END.search(clause.group(0)):
                hint = "speech"
    elif kind == "other" and j < len(text) and text[j] in TERMS:
        hint = "term"
    return _GOES_ON[True, text.count("\n", b, j) > 1, kind, hint]


_SHUT = {c: re.compile(f"[{re.escape(p)}]|\\n[ \\t\\r]*\\n") for c, p in _PAIR.items()}


def _closer(text: str):
    """Whether the quote or bracket opened at a place is closed before a blank line, within LOOK characters.

    What was found for one place holds for all later ones before it, so a text is read once for
    each kind of opener however many stay open.
    """
    found: dict[str, tuple[int, bool]] = {}

    def closes(i: int) -> bool:
        c = text[i]
        at, shut = found.get(c, (-1, False))
        if at <= i:
            m = _SHUT[c].search(text, i + 1)
            at, shut = found[c] = (m.start(), m.group(0)[0] != "\n") if m else (len(text) + 1, False)
        return shut and at < i + LOOK

    return closes


def _line(text: str, i: int) -> str:
    if _HEAD.match(text, i):
        return "head"
    m = _ITEM.match(text, i)
    if m and not (m.group(1) and m.group(2).lower() in MONTHS):
        return "item"
    return "text"


def marks(text: str, start: int, stop: int, first: bool) -> Iterator[tuple[int, int, int]]:
    """(class, from, to) of the marks that begin in text[start:stop]."""
    if first:
        yield CLASSES["P", _line(text, _BLANKS.match(text, 0).end())], start, start
    thai, _closes = bool(_HAS_THAI.search(text)), _closer(text)
    for m in (_LEX_THAI if thai else _LEX).finditer(text, start):
        a, b = m.span()
        if a >= stop:
            return
        kind = m.lastgroup
        if kind == "w":
            yield W, a, min(b, stop)
        elif kind == "t":
            yield _terminator(text, a, b), a, b
        elif kind == "nl":
            breaks = m.group(0).replace("\r\n", "\n").replace("\r", "\n").count("\n")
            if b >= len(text):
                yield CLASSES["P", "text"], a, b
            elif breaks > 1:
                yield CLASSES["P", _line(text, b)], a, b
            else:
                yield CLASSES["N", _line(text, b)], a, b
                if thai and a and _thai_break(text, a, b):
                    yield TH, b, b
        elif kind == "th":
            if _thai_break(text, a, b):
                yield TH, a, a
        elif kind == "q":
            c = text[a]
            if c == '"':
                left = a and not text[a - 1].isspace() and text[a - 1] not in _OPEN_B
                right = b < len(text) and not text[b].isspace() and text[b] not in TERMS + ",;:" + _CLOSE_B
                if not left or (right and text[a - 1] in TERMS + "，：、,:"):
                    shape = "open" if right else "both"
                else:
                    shape = "both" if right else "close"
                if left and text[a - 1].isdigit() and not right and shape == "close":
                    shape = "close"
                yield CLASSES['"', shape, shape != "close" and _closes(a), _follow(text, a, b)], a, b
            elif c in "„«「『":
                yield CLASSES[c if c != "『" else "「", _closes(a)], a, b
            elif c == "“":
                yield CLASSES["“", _closes(a), _follow(text, a, b)], a, b
            else:
                yield CLASSES[c if c != "』" else "」", _follow(text, a, b)], a, b
        else:
            c = text[a]
            if c in _OPEN_B:
                yield CLASSES["(", _closes(a)], a, b
            else:
                yield CLASSES[")", _follow(text, a, b)], a, b


def _thai_break(text: str, a: int, b: int) -> bool:
    """Whether the blanks text[a:b] part sentences where the script has no sentence mark."""
    if a < 1 or b >= len(text):
        return False
    x, y = text[a - 1], text[b]
    if not ("฀" <= x <= "໿"):
        return False
    if y.isdigit() or THAI_ON.match(text, b) or y in "ๆฯ":
        return False
    return "฀" <= y <= "໿" or y.isupper() or y in _QUOTES + "("


# Classes of marks.
_ALL = [("W",), ("TH",)]
_ALL += list(product(("T", "TE", "TC"), (FULL, DOTS, LOUD), (False, True), KINDS, ("word",)))
_ALL += list(product(("T", "TE", "TC"), (STOP,), (False, True), KINDS, WORDS))
_ALL += list(product("PN", ("head", "item", "text")))
_ALL += list(product('"', ("open", "both", "close"), (False, True), (END, CONT, REPORT)))
_ALL += list(product("„«「(", (False, True)))
_ALL += list(product("“", (False, True), (END, CONT, REPORT)))
_ALL += list(product("”»」)", (END, CONT, REPORT)))
CLASSES = {c: i for i, c in enumerate(_ALL)}
W, TH = (CLASSES[k,] for k in ("W", "TH"))

# Actions, as bits: the unit before ends where its last mark ended; a unit starts at this mark; the unit ends after it.
END_BEFORE, START, END_AFTER = 1, 2, 4


def _step(s: tuple, c: tuple) -> tuple[tuple, int]:
    """One rule application. State: line unit, unit (0 none, 1 open, 2 just ended), quote kind, quote at unit's start, bracket, fresh line."""
    line, unit, quote, at_start, bracket, fresh = s
    k = c[0] if c[0][0] != "T" or c[0] == "TH" or _may_end(*c[1:]) else "W"
    if k in "PN" and len(c) == 2 and c[1] in ("head", "item", "text"):
        if k == "N" and not line and (c[1] == "text" or c[1] == "item" and not fresh):
            return s, 0
        return (c[1] != "text", 0, "", 0, 0, 1), END_BEFORE if unit == 1 else 0
    begin = START if unit != 1 else 0
    fresh = fresh if line else 0
    if line:
        return (line, 1, "", 0, 0, fresh), begin
    if k == "TH":
        if unit == 1 and not quote and not bracket:
            return (line, 0, "", 0, 0, fresh), END_BEFORE
        return s, 0
    if k == "TC" and unit == 2:
        return s, END_AFTER  # after the closing quote that has just ended the sentence
    if k in ("T", "TE", "TC"):
        if quote or bracket or k == "TE" and unit != 1:
            return (line, 1, quote, at_start, bracket, fresh), begin
        return (line, 2, "", 0, 0, fresh), begin | END_AFTER
    if k == "(":
        if not bracket and c[1]:
            return (line, 1, quote, at_start, 2 if unit == 1 else 1, fresh), begin
        return (line, 1, quote, at_start, bracket, fresh), begin
    if k == ")":
        if unit == 2:
            return s, END_AFTER  # belongs to the sentence that has just ended
        if bracket == 1 and not quote and c[1] == END:
            return (line, 2, "", 0, 0, fresh), END_AFTER
        return (line, 1, quote, at_start, 0, fresh), begin
    if k in '"“”„«»「」':
        opens = {'"': '"', "“": "“", "„": "„", "«": "«", "「": "「"}.get(k)
        shuts = {'"': '"', "“": "„", "”": "“", "»": "«", "」": "「"}.get(k)
        also = k == "”" and quote == "„"
        if quote and (quote == shuts or also):
            how = c[-1]
            if bracket or how == CONT or how == REPORT and at_start:
                return (line, 1, "", 0, bracket, fresh), begin
            return (line, 2, "", 0, 0, fresh), begin | END_AFTER
        can = opens and not quote and (c[1] if k in "„«「“" else k == '"' and c[1] != "close" and c[2])
        if can:
            return (line, 1, k, 0 if unit == 1 else 1, bracket, fresh), begin
        if unit == 2 and (k in "”»」" or k == '"' and c[1] == "close"):
            return s, END_AFTER
        return (line, 1, quote, at_start, bracket, fresh), begin
    return (line, 1, quote, at_start, bracket, fresh), begin


def _compile() -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    first = (False, 0, "", 0, 0, 1)
    number, rows, todo = {first: 0}, [], [first]
    while todo:
        s = todo.pop(0)
        row = []
        for c in _ALL:
            nxt, act = _step(s, c)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append((number[nxt], act))
        rows.append(row)
    return rows, np.array([[n for n, _ in r] for r in rows], dtype=np.int16)


TABLE, MOVES = _compile()
N_STATES = len(TABLE)
PAD = len(_ALL)  # a class that moves no state, to fill up chunks
MOVES = np.column_stack([MOVES, np.arange(N_STATES, dtype=np.int16)])
ACTS = np.column_stack([np.array([[a for _, a in r] for r in TABLE], dtype=np.int8), np.zeros(N_STATES, dtype=np.int8)])


def places(text: str, start: int, stop: int, state: int, last: int, first: bool, final: bool, offset: int = 0) -> list[tuple[int, int]]:
    """(position, 1 for a start and 0 for an end) that the transducer places over one chunk.

    ``last`` is where the last mark before the chunk that isn't blank ends; ``final`` closes the text.
    """
    out: list[tuple[int, int]] = []
    table = TABLE
    for c, a, b in marks(text, start, stop, first):
        state, act = table[state][c]
        if act:
            if act & END_BEFORE:
                out.append((last, 0))
            if act & START:
                out.append((a + offset, 1))
            if act & END_AFTER:
                out.append((b + offset, 0))
        if c not in _NO_TEXT:
            last = b + offset
    if final:
        out.append((last, 0))
    return out


_NO_TEXT = frozenset(i for c, i in CLASSES.items() if c[0] in ("P", "N", "TH"))
_WITHOUT_TEXT = np.array([i in _NO_TEXT or i == PAD for i in range(PAD + 1)])


def pair(events: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Units of a text's places: from each start to the last end before the next start."""
    out, start, stop = [], None, 0
    for at, is_start in events:
        if is_start:
            if start is not None:
                out.append((start, stop))
            start = at
        stop = at
    if start is not None:
        out.append((start, stop))
    return out


CHUNK = 32  # marks in a chunk


def scan(functions: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Functions of each owner's chunks composed in order, up to and with every chunk, by a doubling scan."""
    f, step = functions.copy(), 1
    while step < len(f):
        same = np.flatnonzero(owner[step:] == owner[:-step])
        if not len(same):
            break
        f[same + step] = np.take_along_axis(f[same + step], f[same], axis=1)
        step *= 2
    return f


def compose(functions: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """First state of every chunk."""
    f = scan(functions, owner)
    first = np.append(True, owner[1:] != owner[:-1])
    return np.where(first, 0, np.append([0], f[:-1, 0]))


def chunk_functions(chunks: np.ndarray) -> np.ndarray:
    """Each row of mark classes as a function: last state for each first state."""
    f = np.broadcast_to(np.arange(N_STATES, dtype=np.int16), (len(chunks), N_STATES))
    for k in range(chunks.shape[1]):
        f = MOVES[f, chunks[:, k, None]]
    return f


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence units of many texts: number of the text, start and end in code points."""
    cls, begin, end, chunk_owner, size = [], [], [], [], []
    for i, t in enumerate(texts):
        n = 0
        for c, a, b in marks(t, 0, len(t), True):
            cls.append(c)
            begin.append(a)
            end.append(b)
            n += 1
        short = -n % CHUNK
        cls += [PAD] * short
        begin += [0] * short
        end += [0] * short
        chunk_owner += [i] * ((n + short) // CHUNK)
        size.append(n + short)
    if not cls:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    c, owner = np.array(cls, dtype=np.int16), np.array(chunk_owner)
    chunks = c.reshape(-1, CHUNK)
    # Each chunk as a function of its first state, then the first states by the scan, then all actions.
    state, acts = compose(chunk_functions(chunks), owner), np.empty_like(chunks, dtype=np.int8)
    for k in range(CHUNK):
        acts[:, k] = ACTS[state, chunks[:, k]]
        state = MOVES[state, chunks[:, k]]
    acts, begin, end = acts.ravel(), np.array(begin), np.array(end)
    owner = np.repeat(np.arange(len(texts)), size)
    # Where the last mark with text before each mark ends, and the last of the whole text.
    where = np.arange(len(c))
    heads = np.searchsorted(owner, owner, side="left")
    held = np.maximum.accumulate(np.where(_WITHOUT_TEXT[c], -1, where))
    last_upto = np.where(held >= heads, end[held], 0)
    last = np.where(where > heads, np.append([0], last_upto[:-1]), 0)
    tails = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    on = np.column_stack([acts & END_BEFORE, acts & START, acts & END_AFTER, np.zeros(len(c), dtype=np.int8)]) > 0
    on[tails, 3] = True  # the end of the text
    at = np.column_stack([last, begin, end, last_upto])[on]
    is_start = np.broadcast_to([False, True, False, False], on.shape)[on]
    whose = np.broadcast_to(owner[:, None], on.shape)[on]
    # Units: from each start to the last place before the next start.
    starts = np.flatnonzero(is_start)
    before_next = np.append(starts[1:] - 1, len(at) - 1)
    stops = np.minimum(before_next, np.searchsorted(whose, whose[starts], side="right") - 1)
    return whose[starts], at[starts], at[stops]


def units(text: str) -> list[tuple[int, int]]:
    """Sentence units of one text in code points."""
    _, a, z = units_of([text])
    return list(zip(a.tolist(), z.tolist()))


def functions_of(parts: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Parts of texts (text, from, to, whether it is the first) as functions."""
    cls, owner = [], []
    for i, part in enumerate(parts):
        mine = [c for c, _, _ in marks(*part)]
        mine += [PAD] * (-len(mine) % CHUNK or (0 if mine else CHUNK))
        cls += mine
        owner += [i] * (len(mine) // CHUNK)
    owner = np.array(owner)
    whole = scan(chunk_functions(np.array(cls, dtype=np.int16).reshape(-1, CHUNK)), owner)
    return whole[np.append(owner[1:] != owner[:-1], True)]


def cuts(text: str, size: int) -> list[int]:
    """Chunk borders inside words, about ``size`` apart, so that no mark but a run of text is cut."""
    out, at = [0], size
    while at < len(text):
        p = at
        while p < len(text) and not (text[p - 1].isalpha() and text[p].isalpha()):
            p += 1
        if p < len(text):
            out.append(p)
        at = p + size
    return [*out, len(text)]


_CHUNK = [("copy", "bigint"), ("no", "int"), ("n", "int"), ("base", "bigint"), ("start", "bigint"), ("stop", "bigint"), ("last", "bigint"), ("text", "string")]
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_CHUNK_SCHEMA = pa.schema([(c, _TYPES[t]) for c, t in _CHUNK])


def _chunks(size: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _CHUNK_SCHEMA)], schema=_CHUNK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for copy, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                edge = cuts(text, size)
                for no, (a, z) in enumerate(zip(edge, edge[1:])):
                    lo = max(0, a - CONTEXT)
                    rows.append((copy, no, len(edge) - 1, lo, a - lo, z - lo, lo + len(text[lo:a].rstrip()), text[lo : z + CONTEXT]))
                    held += len(rows[-1][-1])
                    if held > 2_000_000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            f = functions_of([(t, a, z, no == 0) for t, a, z, no in zip(pdf.text, pdf.start, pdf.stop, pdf.no)])
            yield pd.DataFrame({"copy": pdf["copy"], "no": pdf["no"], "f": f.tolist()})


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First state of every chunk of a partition sorted by document and number; one document's state is held between batches."""
    copy, held = None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        owner = pdf["copy"].to_numpy()
        f = scan(np.array(pdf["f"].tolist(), dtype=np.int16), owner)
        begin = np.where(owner == copy, held, 0) if copy is not None else np.zeros(len(owner), dtype=np.int64)
        upto = f[np.arange(len(f)), begin]
        first = np.append(True, owner[1:] != owner[:-1])
        yield pd.DataFrame({"copy": owner, "no": pdf["no"].to_numpy(), "state": np.where(first, begin, np.append([0], upto[:-1])).astype(np.int64)})
        copy, held = owner[-1], int(upto[-1])


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (copy, no, i, at, kind)
            for copy, no, n, base, a, z, last, text, state in pdf[[*(c for c, _ in _CHUNK), "state"]].itertuples(index=False, name=None)
            for i, (at, kind) in enumerate(places(text, a, z, state, last, no == 0, no == n - 1, base))
        ]
        yield pd.DataFrame(rows, columns=["copy", "no", "i", "at", "kind"])


def _schema(texts: bool) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())] + [("text", pa.string())] * texts)


def _emit(texts: bool):
    """Unit rows of whole texts, some megabytes of text at a time."""
    schema = _schema(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, whole = b.column(0), b.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in whole]) // 2_000_000
            for part in np.unique(ends):
                rows = np.flatnonzero(ends == part)
                mine = whole[rows[0] : rows[-1] + 1]
                who, a, z = units_of(mine)
                cols = [ids.take(pa.array(who + rows[0])), pa.array(a), pa.array(z)]
                if texts:
                    cols.append(pa.array([mine[i][x:y] for i, x, y in zip(who.tolist(), a.tolist(), z.tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _slice(texts: bool):
    """Unit rows of texts whose units are given in a third column."""
    schema = _schema(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, given in zip(*(c.to_pylist() for c in b.columns)):
                cols = [pa.array([doc] * len(given), pa.int64()), pa.array([u["a"] for u in given], pa.int64()), pa.array([u["z"] for u in given], pa.int64())]
                if texts:
                    cols.append(pa.array([text[u["a"] : u["z"]] for u in given], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Sentence units of every document: ``doc_id, start_char, end_char`` and, with ``texts``, ``text``.

    Positions count code points from 0, the end is exclusive. Units have no blanks at their ends,
    don't overlap, and hold every character but blanks and line breaks. A heading line and a list
    item are one unit each with their markers; a blank line ends a unit, a single line break in
    running text doesn't. Quotes and brackets stay with their sentence, quoted speech with the
    clause that reports it; one that isn't closed within 20 000 characters of its paragraph counts
    as open. The language column isn't needed: the rules go by script and by words.

    Null, empty and blank texts have no units. Documents with the same id each give theirs. Empty
    tables give no rows; only the two named columns are read.

    One read without exchange. A task puts the chunks of all its documents through the scan side
    by side; a document is read by the task that holds its row, in time linear in its length. For
    single documents of hundreds of megabytes see :func:`spread_units`.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return d.mapInArrow(_emit(texts), "doc_id bigint, start_char bigint, end_char bigint" + ", text string" * texts)


def spread_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = 200_000, texts: bool = True) -> DataFrame:
    """The same units as :func:`sentence_units`, each document's chunks spread over the cluster.

    Documents are written once to the shared checkpoint folder under a key of their own (their id
    may be null or shared, and a key drawn anew by a second evaluation would mix texts up), cut into
    chunks that carry some context, and exchanged. Each chunk's state function is worked out, a
    document's functions are composed (some numbers for each chunk), and chunks then place their
    units in parallel.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    big = cut(d.withColumn("copy", F.monotonically_increasing_id()))
    chunks = big.select("copy", "text").mapInArrow(_chunks(chunk_chars), ", ".join(f"{c} {t}" for c, t in _CHUNK)).repartition("copy", "no")
    made = chunks.mapInPandas(_functions, "copy bigint, no int, f array<int>")
    states = made.repartition("copy").sortWithinPartitions("copy", "no").mapInPandas(_compose, "copy bigint, no int, state bigint")
    placed = chunks.join(states, ["copy", "no"]).mapInPandas(_places, "copy bigint, no int, i bigint, at bigint, kind int")
    w = Window.partitionBy("copy").orderBy("no", "i")
    placed = placed.withColumn("g", F.sum("kind").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("g > 0")
    bounds = (
        placed.groupBy("copy", "g")
        .agg(F.min_by("at", F.struct("no", "i")).alias("a"), F.max_by("at", F.struct("no", "i")).alias("z"))
        .groupBy("copy")
        .agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("units"))
    )
    ddl = "doc_id bigint, start_char bigint, end_char bigint" + ", text string" * texts
    return big.join(bounds, "copy").select("doc_id", "text", "units").mapInArrow(_slice(texts), ddl)
