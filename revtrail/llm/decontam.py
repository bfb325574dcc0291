"""Benchmark decontamination with one Aho-Corasick automaton.

Item texts and documents are normalised alike (A-Z lower-cased, words of `[0-9a-z]` and all non-ASCII
characters, joined by one space).  Every window of ``window`` consecutive item words, with a space on either
side, is a pattern; the automaton reads a document once and yields every occurrence.  Word numbers of an
occurrence map back to character offsets of the original text.

The automaton is broadcast.  Its size is bounded by ``max_pattern_bytes``: a larger benchmark is dealt by a hash
of the item into shards, of which the driver holds one at a time, and the documents pass one map stage for each,
adding to the hits so far.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, blocks_for, checkpoint, tidy

#: Bytes that are no part of a word become a space; A-Z become a-z.
_WORD_BYTES = bytes(LOWER_ASCII[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def automaton(items: Iterable[tuple[str, str | None]], window: int) -> tuple[ahocorasick.Automaton, list[list[str]]] | None:
    """(automaton over latin-1 decoded normal text, item ids of each pattern number); None without any pattern."""
    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(b" %b " % b" ".join(w[i : i + window]), set()).add(item_id)
    if not owners:
        return None
    auto, known = ahocorasick.Automaton(), []
    for pattern, ids in owners.items():
        auto.add_word(pattern.decode("latin-1"), (len(known), len(pattern), pattern.count(b" ") - 1))
        known.append(sorted(ids))
    auto.make_automaton()
    return auto, known


def scan(w: list[bytes], auto: ahocorasick.Automaton, known: list[list[str]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Hit ranges of word numbers, and ids of the items met."""
    text = (b" %b " % b" ".join(w)).decode("latin-1")
    found = list(auto.iter(text))
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    starts = np.searchsorted(spaces, [end - size + 1 for end, (_, size, _) in found])
    return [(int(s), int(s) + n) for s, (_, (_, _, n)) in zip(starts, found, strict=True)], {x for number in {v[0] for _, v in found} for x in known[number]}


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets of the words that ``words`` yields, in the original text."""
    return [m.span() for m in _WORD.finditer(text)]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 8, min_items: int = 2, max_pattern_bytes: int = 2 << 20, spans: bool = False) -> DataFrame:
    """``docs`` without ``text_col`` (with it and ``hit_spans`` if ``spans``), plus n_words, n_hit, n_items,
    items_sha256, contaminated.  Those names replace columns of the same name.

    Null or wordless texts have no words and no hits; repeated documents stay repeated.  Items with a null id are
    no items; repeated items count once; the order of items is that of their ids as strings, so there are no ties.
    ``hit_spans`` are merged [start, end) character offsets of hit words in the original text.  An empty benchmark
    yields no hits, an empty table of documents no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col(item_id_col).isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * window  # a word is in ``window`` windows
    count = blocks_for(size, max_pattern_bytes)
    taken = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "_ranges", "_items"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    keep = [f for f in docs.schema if spans or f.name != text_col]
    state = docs.withColumn("_ranges", F.lit(None).cast("array<array<int>>")).withColumn("_items", F.lit(None).cast("array<string>"))
    names = [f.name for f in state.schema]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"] + ["hit_spans array<array<int>>"] * spans)

    def shared(shard: int):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == shard)
        return spark.sparkContext.broadcast(automaton(((r[0], r[1]) for r in some.toLocalIterator()), window))

    for shard in range(count - 1):
        known = shared(shard)
        state = checkpoint(state.mapInArrow(tidy(_pass(known, text_col, None, names, min_items, spans)), state.schema))
        known.destroy()
    return state.mapInArrow(tidy(_pass(shared(count - 1), text_col, [f.name for f in keep], names, min_items, spans)), ddl)


def _pass(shard, text_col: str, final: list[str] | None, names: list[str], min_items: int, spans: bool):
    def run(batches):
        auto, known = shard.value or (None, [])
        for batch in batches:
            cols = dict(zip(names, batch.columns, strict=True))
            out: dict[str, list] = {x: [] for x in ("ranges", "items", "n_words", "n_hit", "n_items", "sha", "spans")}
            for text, ranges, items in zip(cols[text_col].to_pylist(), cols["_ranges"].to_pylist(), cols["_items"].to_pylist(), strict=True):
                w = words(text)
                found, ids = scan(w, auto, known) if w and auto is not None else ([], set())
                merged = _merge([*map(tuple, ranges or []), *found])
                ids |= set(items or [])
                if final is None:
                    out["ranges"].append([list(x) for x in merged])
                    out["items"].append(sorted(ids))
                    continue
                out["n_words"].append(len(w))
                out["n_hit"].append(sum(b - a for a, b in merged))
                out["n_items"].append(len(ids))
                out["sha"].append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
                if spans:
                    at = word_spans(text) if merged else []
                    out["spans"].append([[at[a][0], at[b - 1][1]] for a, b in merged])
            if final is None:
                cols["_ranges"], cols["_items"] = pa.array(out["ranges"], pa.list_(pa.list_(pa.int32()))), pa.array(out["items"], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)
                continue
            n_items = np.array(out["n_items"], np.int64)
            arrays = [cols[n] for n in final] + [pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(n_items), pa.array(out["sha"], pa.string()), pa.array(n_items >= min_items)]
            more = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if spans:
                arrays.append(pa.array(out["spans"], pa.list_(pa.list_(pa.int32()))))
                more.append("hit_spans")
            yield pa.RecordBatch.from_arrays(arrays, names=[*final, *more])

    return run
