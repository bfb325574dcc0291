"""Text functions as Column expressions with the string semantics the engine promises.

White space is the ECMAScript set, word boundaries and digits are ASCII, and lengths are UTF-16 units where a
threshold is defined on them; Java's defaults differ on each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, tables and patterns that results depend on.
WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_WS = "[^" + WS[1:]
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
SINGLE_QUOTES = "\u2018\u2019\u201A\u201B\u2032\u00B4`"
DOUBLE_QUOTES = "\u201C\u201D\u201E\u201F\u2033\u00AB\u00BB"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
BULLETS = "\u2022\u00B7\u25CF\u25AA"
SPACES = "\u00A0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
INVISIBLE = "\u200B\u200C\u200D\uFEFF\u00AD"
NEGATIONS = {
    "not": "not", "cannot": "not", "cant": "not", "wont": "not", "dont": "not", "doesnt": "not", "didnt": "not",
    "isnt": "not", "arent": "not", "wasnt": "not", "werent": "not", "shant": "not", "shouldnt": "not",
    "wouldnt": "not", "couldnt": "not", "havent": "not", "hasnt": "not", "hadnt": "not",
    "no": "no", "none": "no", "never": "never", "nor": "nor", "neither": "neither", "without": "without",
    "unless": "unless", "except": "except", "excluding": "except", "prohibited": "prohibited",
    "forbidden": "prohibited", "unable": "unable", "ineligible": "ineligible",
}
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
ORDINAL = "(?:st|nd|rd|th)?"
DATE_PATTERNS = (
    f"{START}[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}{END}",
    f"{START}[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{2,4}}{END}",
    f"(?i){START}(?:{MONTHS})\\.?{WS}+[0-9]{{1,2}}{ORDINAL},?{WS}+[0-9]{{4}}{END}",
    f"(?i){START}[0-9]{{1,2}}{ORDINAL}{WS}+(?:{MONTHS})\\.?,?{WS}+[0-9]{{4}}{END}",
    f"(?i){START}(?:{MONTHS})\\.?{WS}+[0-9]{{4}}{END}",
)
ABBREVIATIONS = "e\\.g|i\\.e|etc|vs|no|inc|ltd|llc|co|corp|dept|approx|art|sec|para|cf|al"
UNFINISHED = f"(?i)(?:{START}(?:{ABBREVIATIONS})\\.|{START}[A-Z]\\.|{START}[0-9]+\\.)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    text = trim_ws(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"{WS}+"))


def count_words(c: Column) -> Column:
    return F.size(words(c)).cast("int")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def normalize_blocks(c: Column, separator: str = "\u0000") -> Column:
    """Each stretch between separators with white space collapsed, blanks dropped, joined by newlines.  Unicode
    composition is the extraction UDF's part: Spark has no such function."""
    blocks = F.transform(F.split(c, separator), lambda b: trim_ws(F.regexp_replace(b, f"{WS}+", " ")))
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n")


_TYPOGRAPHIC = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + BULLETS + SPACES + INVISIBLE
_PLAIN = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + "*" * len(BULLETS) + " " * len(SPACES)


def punctuation_normalize(c: Column) -> Column:
    """Typographic variants folded to ASCII and white space tidied; case stays.  Each replacement runs only where
    a plain search finds something to replace."""
    fold = lambda x: F.replace(F.translate(x, _TYPOGRAPHIC, _PLAIN), F.lit("\u2026"), F.lit("..."))
    plain = lambda x: ((F.octet_length(x) == F.char_length(x)) & ~F.contains(x, F.lit("`"))) | ~x.rlike(f"[{_TYPOGRAPHIC}\u2026]")
    c = let(c, lambda x: F.when(plain(x), x).otherwise(fold(x)))
    c = let(c, lambda x: F.when(x.rlike(f"{WS}[,;:.]"), F.regexp_replace(x, f"{WS}+([,;:.])", "$1")).otherwise(x))
    uneven = f"{WS}{WS}|[{WS_CHARS.replace(' ', '')}]"
    return trim_ws(let(c, lambda x: F.when(x.rlike(uneven), F.regexp_replace(x, f"{WS}+", " ")).otherwise(x)))


def date_normalize(c: Column) -> Column:
    for pattern in DATE_PATTERNS:
        c = F.regexp_replace(c, pattern, "@date")
    return c


def negations(c: Column) -> Column:
    """Sorted canonical negation words of a text, repeats included."""
    letters = F.regexp_replace(F.lower(c), f"(?:(?!{WS})[^a-z])+", "")
    found = F.filter(F.split(letters, f"{WS}+"), lambda w: w.isin(list(NEGATIONS)))
    canonical = F.create_map(*[F.lit(x) for pair in NEGATIONS.items() for x in pair])
    return F.array_sort(F.transform(found, lambda w: F.element_at(canonical, w)))


def negation_counts(c: Column) -> Column:
    """map<string,int>: canonical negation to its count."""
    found = negations(c)
    kinds = F.array_distinct(found)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(found, lambda x: x == k))))


def negation_changed(before: Column, after: Column) -> Column:
    return negations(before) != negations(after)


def multiset_equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def split_sentences(c: Column) -> Column:
    """Sentences end with . ! ? or ; before white space, unless the part so far ends in an abbreviation, a
    single letter or a bare number with a dot."""
    text = trim_ws(c)
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, part: Column) -> Column:
        now = F.when(s["open"] == "", part).otherwise(F.concat_ws(" ", s["open"], part))
        more = now.rlike(UNFINISHED)
        return F.struct(F.when(more, s["done"]).otherwise(F.concat(s["done"], F.array(now))).alias("done"), F.when(more, now).otherwise(F.lit("")).alias("open"))

    folded = F.aggregate(F.split(text, f"(?<=[.!?;]){WS}+"), state, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(folded)


def last_sentences(c: Column, count: int) -> Column:
    last = F.reverse(F.slice(F.reverse(split_sentences(c)), 1, count))
    return trim_ws(F.array_join(last, " "))


def first_sentences(c: Column, count: int) -> Column:
    return trim_ws(F.array_join(F.slice(split_sentences(c), 1, count), " "))
