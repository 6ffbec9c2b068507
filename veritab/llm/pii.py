"""Personal data, also disguised: offset-preserving deobfuscation.

A transducer rewrites disguises (look-alike letters, full-width forms, invisible characters, spelled digits, "(at)", "dot")
and keeps for every character of the result where it came from. The same detectors run over the plain text and over the
rewritten stretches; what they find there is mapped back to characters of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import quoted

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Each takes a whole run of its first class, then the rest if it follows, so that a run without the rest
# is passed over in one step; matches are the same as those of the plain patterns, in time proportional to the text.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters that look like Latin ones, and words for digits.
LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι",
        "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXoavi",
    )
)
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
DIGIT_WORDS |= {unicodedata.normalize("NFD", w): d for w, d in DIGIT_WORDS.items()}  # accents as letters of their own
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _any_case(word: str) -> str:
    """Just the two cases of each letter: re.IGNORECASE would also take dotless i, long s and the like."""
    return "".join(f"[{c}{c.upper()}]" for c in word)


# by first letter, longest first, so that most words fail on one character
_DIGIT = "|".join(
    f"{_any_case(a)}(?:{'|'.join(_any_case(w[1:]) for w in sorted(DIGIT_WORDS, key=len, reverse=True) if w[0] == a)})"
    for a in sorted({w[0] for w in DIGIT_WORDS})
)
# what can be rewritten, in this order
AT = r"\s*[\[({<]\s*(?:at|arroba|ät)\s*[\])}>]\s*|\s+(?:at|arroba)\s+(?=[A-Za-z0-9-]+(?:\s+(?:dot|punkt|punto|point)\s+|\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]))"
DOT = r"\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|(?<=[A-Za-z0-9])\s+(?:dot|punkt|punto|point)\s+(?=[A-Za-z0-9])"
SPELLED = rf"(?<![^\W_])(?:{_DIGIT})(?:[\s,-]{{1,3}}(?:{_DIGIT}))*(?![^\W_])"
CHARS = f"[{''.join(LOOK_ALIKES)}{INVISIBLE}！-～]"  # in this case only: the other case of a look-alike need not be one
REWRITE = re.compile(rf"(?P<at>(?i:{AT}))|(?P<dot>(?i:{DOT}))|(?P<plus>(?<![^\W_]){_any_case('plus')}\s+(?=[0-9]|{_DIGIT}))|(?P<spelled>{SPELLED})|(?P<char>{CHARS})")
SPELLED_WORD = re.compile(_DIGIT)
# cheap looks for anything worth rewriting: a disguise character, a bracketed at or dot, dot words,
# a digit word or plus beside a digit or another digit word
HINT_CHARS = re.compile(CHARS)
HINT_BRACKETS = re.compile(r"[\[({<]\s{0,3}(?:at|arroba|ät|dot|punkt|punto|point|\.)\s{0,3}[\])}>]", re.IGNORECASE)
HINT_WORDS = re.compile(r"\s(?i:dot|punkt|punto|point)\s")
_BESIDE = r"[\s,().-]{1,3}"
HINT_DIGITS = re.compile(
    rf"(?<![^\W_])(?:{_DIGIT})(?={_BESIDE}(?:[0-9+]|{_DIGIT}))|[0-9+](?={_BESIDE}(?:{_DIGIT})(?![^\W_]))|\+(?={_DIGIT})"
    rf"|(?<![^\W_]){_any_case('plus')}(?=\s+(?:[0-9]|{_DIGIT}))"
)
WINDOW = 80  # characters on either side of a rewritten place that can belong to one identifier


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost, not overlapping within a kind; matches that fail their test are dropped."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text) if m[1]]
    for m in IP.finditer(text) if "." in text else ():
        if m[1] and all(_small(p) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def rewrite(text: str) -> tuple[str, list[tuple[int, int]], list[bool]]:
    """The text without disguises; for each of its characters the source characters it stands for, and if it was changed."""
    out: list[str] = []
    source: list[tuple[int, int]] = []
    changed: list[bool] = []

    def put(s: str, lo: int, hi: int):
        out.append(s)
        source.append((lo, hi))
        changed.append(True)

    at = 0
    for m in REWRITE.finditer(text):
        lo, hi = m.span()
        out.extend(text[at:lo])
        source.extend((i, i + 1) for i in range(at, lo))
        changed.extend([False] * (lo - at))
        kind = m.lastgroup
        if kind == "at":
            put("@", lo, hi)
        elif kind == "dot":
            put(".", lo, hi)
        elif kind == "plus":
            put("+", lo, hi)
        elif kind == "spelled":
            for w in SPELLED_WORD.finditer(m[0]):
                put(DIGIT_WORDS[w[0].lower()], lo + w.start(), lo + w.end())
        elif m[0] in LOOK_ALIKES:
            put(LOOK_ALIKES[m[0]], lo, hi)
        elif "！" <= m[0] <= "～":
            put(chr(ord(m[0]) - 0xFEE0), lo, hi)
        at = hi
    out.extend(text[at:])
    source.extend((i, i + 1) for i in range(at, len(text)))
    changed.extend([False] * (len(text) - at))
    return "".join(out), source, changed


def _hints(text: str) -> list[tuple[int, int]]:
    found = [] if text.isascii() else [m.span() for m in HINT_CHARS.finditer(text)]
    for pattern in (HINT_BRACKETS, HINT_WORDS, HINT_DIGITS):
        found += [m.span() for m in pattern.finditer(text)]
    return sorted(found)


def disguised(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only show once disguises are taken off; a wider span may stand beside a plain one."""
    places: list[list[int]] = []
    for lo, hi in _hints(text):
        lo, hi = max(0, lo - WINDOW), min(len(text), hi + WINDOW)
        # windows start and end between words, so none cuts an identifier in two
        before = places[-1][1] if places else 0
        if hi > before:
            while hi < len(text) and not text[hi].isspace():
                hi += 1
        while lo > before and not text[lo - 1].isspace():
            lo -= 1
        if places and lo <= before:
            places[-1][1] = max(hi, before)
        else:
            places.append([lo, hi])
    known = [[(s, e) for s, k, e in plain if k == kind] for kind in range(len(KINDS))]
    found = []
    for lo, hi in places:
        text_, source, changed = rewrite(text[lo:hi])
        marks = [0]
        for c in changed:
            marks.append(marks[-1] + c)
        for s, k, e in find(text_):
            a, b = lo + source[s][0], lo + source[e - 1][1]
            if marks[e] == marks[s] and b - a == e - s:
                continue  # nothing in it was disguised or left out
            if k == 0 and len(text_[s:e].rpartition(".")[2]) < 2:
                continue
            if k == 2 and not NOT_DIGIT.sub("", text_[s:e]).strip("0"):
                continue  # a row of null, null, null is no card
            # a plain span within it is a part of what was disguised, any other overlap is the plain span seen again
            if all(x >= b or a >= y or (a <= x and y <= b) for x, y in known[k]):
                found.append((a, k, b))
    return found


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_hidden_email long, n_hidden_ip long, n_hidden_card long, n_hidden_phone long"
)
ADDED = [x.split()[0] for x in SCHEMA.split(", ")] + ["redacted"]


def _scan(batches: Iterator[pa.RecordBatch], redact: bool) -> Iterator[pa.RecordBatch]:
    types = {"long": pa.int64(), "string": pa.string()}
    names = [tuple(x.split()) for x in SCHEMA.split(", ")]
    for batch in batches:
        rows, clean = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            plain = find(text)
            hidden = disguised(text, plain)
            every = sorted(plain + hidden)
            per = lambda spans: [sum(k == i for _, k, _ in spans) for i in range(4)]
            rows.append((*per(plain), hashlib.sha256(_written(plain).encode()).hexdigest(), _written(every), *per(hidden)))
            if redact:
                clean.append(_redacted(text, every) if every else text)
        arrays = [pa.array(col, types[t]) for col, (_, t) in zip(zip(*rows) if rows else [()] * len(names), names)]
        out = dict(zip(batch.schema.names, batch.columns)) | dict(zip((n for n, _ in names), arrays))
        if redact:
            out["redacted"] = pa.array(clean, pa.string())
        else:
            out.pop("text")
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _redacted(text: str, spans) -> str:
    """Each stretch covered by spans becomes the name of the kind that begins it."""
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with counts and spans of every whole text.

    n_* count what the fixed patterns find in the plain text and base_sha256 is over those spans; ``spans`` also has what
    was disguised, counted by n_hidden_*. Spans are kind:start:end in characters, end exclusive. A null or empty text has
    none. Repeated rows give repeated results.
    """
    rows = docs.select(*keep, "text")
    kept = [f for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(lambda batches: _scan(batches, False), StructType([*kept, *StructType.fromDDL(SCHEMA)]))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind; a column n_chars, if there is one, follows the text.

    A null text stays null; other columns stay.
    """
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_all"), "text")
    schema = StructType([packed.schema["_all"], *StructType.fromDDL(f"text string, {SCHEMA}, redacted string")])
    out = packed.mapInArrow(lambda batches: _scan(batches, True), schema)
    clean = F.when(F.col("text").isNotNull(), F.col("redacted"))
    cols = {c: F.col(f"_all.`{c}`") for c in docs.columns} | {"text": clean}
    if "n_chars" in cols:
        number = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(F.col("redacted") == F.col("text"), cols["n_chars"]).otherwise(F.char_length(clean).cast(number))
    return out.select(*[x.alias(c) for c, x in cols.items()])
