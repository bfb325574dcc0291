"""The costly functions of ``functions.text`` for whole texts, as Arrow UDFs.

The Column functions stay what defines a result, and are what short passages and lambdas use.  Over a whole text
their patterns are tried at every character; here a plain search finds the few places where a pattern can match.
Batches are worked on in slices, so that a worker holds few texts as Python objects.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtrail.functions import text as X

#: Rows of a batch that are Python objects at a time.
SLICE = 256


def in_slices(kind: pa.DataType, one: Callable, *columns: pa.Array) -> pa.Array:
    """``one`` of each row, of type ``kind``."""
    n = len(columns[0])
    done = [pa.array([one(*row) for row in zip(*[c.slice(at, SLICE).to_pylist() for c in columns], strict=True)], kind) for at in range(0, n, SLICE)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


# ---- words -----------------------------------------------------------------------------------------------

#: What Python takes for white space and the engine does not, or the other way round.
_OTHER_SPACES = "\x1c\x1d\x1e\x1f\x85\ufeff"
_SPACES = re.compile(f"{X.WS}+")


def same_spaces(text: str) -> bool:
    """Whether Python's own idea of white space is right for a text."""
    return not any(c in text for c in _OTHER_SPACES)


_SPACE_OR_NOT = bytes(32 if chr(c) in "\t\n\x0b\f\r " else 120 for c in range(256))


def number_of_words(text: str) -> int:
    """As ``text.count_words``."""
    if text.isascii():
        marked = text.encode().translate(_SPACE_OR_NOT)
        return marked.count(b" x") + marked.startswith(b"x")
    if same_spaces(text):
        return len(text.split())
    text = text.strip(X.WS_CHARS)
    return len(_SPACES.split(text)) if text else 0


# ---- punctuation -----------------------------------------------------------------------------------------

_FOLD = {**dict(zip(X._TYPOGRAPHIC, X._PLAIN, strict=False)), **dict.fromkeys(X.INVISIBLE, ""), "\u2026": "..."}
_TYPOGRAPHIC = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]")
_BEFORE_MARK = re.compile(f"{X.WS}+([,;:.])")


def normal_punctuation(text: str) -> str:
    """As ``text.punctuation_normalize``."""
    if "`" in text or not text.isascii():
        text = _TYPOGRAPHIC.sub(lambda m: _FOLD[m[0]], text)
    if not same_spaces(text):
        return _SPACES.sub(" ", _BEFORE_MARK.sub(r"\1", text)).strip(X.WS_CHARS)
    text = " ".join(text.split())
    for mark in ",;:.":
        text = text.replace(f" {mark}", mark)
    return text


@F.arrow_udf(T.StringType())
def punctuation_normalize(c: pa.Array) -> pa.Array:
    return in_slices(pa.string(), lambda t: None if t is None else normal_punctuation(t), c)


# ---- dates -----------------------------------------------------------------------------------------------

_DATES = [re.compile(p, re.ASCII) for p in X.DATE_PATTERNS]
_DIGITS = re.compile("[0-9]+")
_MONTHS = frozenset(X.MONTHS.split("|"))
#: A word between white space that is none of a date unless it names a month: what is matched on one side of its end
#: does not depend on the other side.
_WORD = re.compile(r"(?<=[ \t\n\r])[A-Za-z]+(?=[ \t\n\r])")


def _cut_before(text: str, start: int, end: int) -> int:
    """The last place in text[start:end] that no date spans, else ``start``."""
    width = 64
    while True:
        at = max(start, end - width)
        found = [m.end() for m in _WORD.finditer(text[at:end]) if m[0].lower() not in _MONTHS]
        if found or at == start:
            return at + found[-1] if found else start
        width *= 4


def _cut_after(text: str, start: int) -> int:
    return next((m.end() for m in _WORD.finditer(text, start) if m[0].lower() not in _MONTHS), len(text))


def normal_dates(text: str) -> str:
    """As ``text.date_normalize``: only what lies around digits is looked at."""
    out, done = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        first, last = _cut_before(text, done, m.start()), _cut_after(text, m.end())
        near = text[first:last]
        for pattern in _DATES:
            near = pattern.sub("@date", near)
        out += [text[done:first], near]
        done = last
    return "".join([*out, text[done:]]) if out else text


@F.arrow_udf(T.StringType())
def date_normalize(c: pa.Array) -> pa.Array:
    return in_slices(pa.string(), lambda t: None if t is None else normal_dates(t), c)


# ---- negations -------------------------------------------------------------------------------------------

_NEGATIONS = {w.encode(): kind for w, kind in X.NEGATIONS.items()}
_NO_LETTER = bytes(c for c in range(256) if not (chr(c).isascii() and (chr(c).islower() or chr(c) in "\t\n\x0b\f\r ")))
_NO_LETTERS = re.compile(f"(?:(?!{X.WS})[^a-z])+")
#: First bytes of white space beyond ASCII, and characters beyond it whose lower case has an ASCII letter.
_FAR = [c.encode() for c in ("\u00a0", "\u1680", "\u205f", "\u3000", "\ufeff", "\u0130", "\u212a")] + [b"\xe2\x80"]


def find_negations(text: bytes) -> list[str]:
    """As ``text.negations``, of UTF-8."""
    if not text.isascii() and any(x in text for x in _FAR):
        found = [_NEGATIONS.get(w.encode()) for w in _SPACES.split(_NO_LETTERS.sub("", text.decode().lower()))]
    else:
        found = map(_NEGATIONS.get, text.lower().translate(None, _NO_LETTER).split())
    return sorted(x for x in found if x)


@F.arrow_udf(T.ArrayType(T.StringType()))
def negations(c: pa.Array) -> pa.Array:
    return in_slices(pa.list_(pa.string()), lambda t: None if t is None else find_negations(t), as_bytes(c))
