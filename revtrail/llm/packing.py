"""Packing of tokenised documents into sequences: best fit, then swap-based local search.

Documents become token ids plus an end id; only those longer than a sequence are cut.  Pieces are dealt at
random into groups of bounded size, so that a group is a fair mix of lengths and fits one task; a full piece is
a sequence by itself.  Within a group the pieces are placed best-fit in decreasing length.  Then the emptiest
bin is attacked: its documents move to other bins, or are exchanged one-for-one, two-for-one or one-for-two
with shorter contents of underfull bins.  Every step raises the sum of squared fills, so the search ends: at
the lower bound on bins, or when no step is left.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, free_name, tidy

_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Fixed value: the pre-tokenizer whose rule ``_LATIN`` restates for lower-case Latin-1 text.
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable in
    Latin-1, else the next one from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Latin(dict):
    """Ids of pieces of lower-case Latin-1 text, split by the tokenizer's own rule; each new part goes to the BPE
    model alone, which is several times as fast as the whole pipeline."""

    def __init__(self, model):
        super().__init__()
        self.model, self.parts, self.letters = model, {}, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        parts = self.parts
        self[word] = ids = b"".join([parts.get(p) or self._part(p) for p in _LATIN.findall(word)])
        return ids

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        self.parts[part] = ids = _packed([t.id for t in tokens])
        return ids


class _Any(dict):
    """Ids of pieces by the whole pipeline."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return ids


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


class WordEncoder:
    """Ids of texts under a tokenizer to which white space is a mere boundary: each white-space delimited piece
    is encoded once and kept, until a cache holds more than ``kept`` (some 200 bytes each) and starts anew."""

    def __init__(self, path: str, kept: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.kept, self.specials = kept, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        setup = json.loads(tokenizer.to_str())
        steps = [x["type"] for x in (setup["normalizer"] or {}).get("normalizers", [])]
        rule = ((setup["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.fits = steps == ["NFC", "Replace", "Lowercase"] and rule == _SPLIT_RULE
        self.latin, self.any = _Latin(tokenizer.model), _Any(tokenizer)

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        known: dict = self.any
        if self.fits and not any(x in text for x in self.specials):
            try:  # folding case first is what the tokenizer does within Latin-1
                text.encode("latin-1")
                text, known = text.lower(), self.latin
            except UnicodeEncodeError:
                pass
        words = [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()
        return b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        for cache in (self.latin, self.latin.parts, self.any):
            if len(cache) > self.kept:
                cache.clear()
        return list(map(self._one, texts))

    def forget(self) -> None:
        for cache in (self.latin, self.latin.parts, self.any):
            cache.clear()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder per worker process: the vocabulary is read once, the caches are emptied with each task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items of each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        rooms = open_rooms >> n
        if rooms:
            room = n + (rooms & -rooms).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins


class _Search:
    """Bins with room, and which of them hold an item of a given length."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int, effort: int):
        self.n, self.capacity, self.bins, self.effort = lengths.tolist(), capacity, bins, effort
        self.fill = [sum(self.n[i] for i in b) for b in bins]
        self.holds: dict[int, set[int]] = defaultdict(set)
        self.roomy: dict[int, set[int]] = defaultdict(set)
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        if room := self.capacity - self.fill[b]:
            self.roomy[room].add(b)
            for i in self.bins[b]:
                self.holds[self.n[i]].add(b)

    def _leave(self, b: int) -> None:
        self.roomy[self.capacity - self.fill[b]].discard(b)
        for i in self.bins[b]:
            self.holds[self.n[i]].discard(b)

    def exchange(self, v: int, out: list[int], b: int, back: list[int]) -> None:
        for x in (v, b):
            self._leave(x)
        self.bins[v] = [i for i in self.bins[v] if i not in out] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + out
        for x in (v, b):
            self.fill[x] = sum(self.n[i] for i in self.bins[x])
            self._enter(x)
        self.touched = v, b

    def _raises(self, v: int, b: int, gain: int) -> bool:
        """Squared fill grows when ``gain`` goes from v to b."""
        self.effort -= 1
        return 0 < gain <= self.capacity - self.fill[b] and b != v and self.fill[b] + gain > self.fill[v]

    def _partner(self, v: int, size: int) -> tuple[int, list[int]] | None:
        """A bin that can take ``size`` for nothing, for one shorter item or for two: largest gain first."""
        for room in range(size, self.capacity + 1):
            for b in self.roomy.get(room, ()):
                if self._raises(v, b, size):
                    return b, []
        most = max((r for r, x in self.roomy.items() if x), default=0)
        for give in range(max(1, size - most), size if self.effort > 0 else 0):
            for b in self.holds.get(give, ()):
                if self._raises(v, b, size - give):
                    return b, [next(i for i in self.bins[b] if self.n[i] == give)]
        for room in sorted((r for r, x in self.roomy.items() if x), reverse=True):
            for b in self.roomy[room] if self.effort > 0 else ():
                items = self.bins[b]
                for x, i in enumerate(items):
                    for j in items[x + 1 :]:
                        if self._raises(v, b, size - self.n[i] - self.n[j]):
                            return b, [i, j]
        return None

    def step(self, v: int) -> bool:
        items = sorted(self.bins[v], key=lambda i: -self.n[i])
        for out in [[i] for i in items] + [[i, j] for x, i in enumerate(items) for j in items[x + 1 :]]:
            if self.effort <= 0:
                return False
            if found := self._partner(v, sum(self.n[i] for i in out)):
                self.exchange(v, out, *found)
                return True
        return False


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound L2: for each k, items over capacity - k stand alone, items over half stand
    apart, and items from k to half fill what room the latter leave."""
    count = np.bincount(lengths, minlength=capacity + 1)
    many, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    half = capacity // 2
    k = np.arange(0, half + 1)
    apart = many[-1] - many[half + 1]
    middle = many[capacity - k + 1] - many[half + 1]
    room = middle * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    return int((apart + np.maximum(0, -(-(small - room) // capacity))).max())


def pack(lengths: np.ndarray, capacity: int, effort: int = 1000, tries: int = 4) -> list[list[int]]:
    """Bins of item positions; every item (1..capacity long) is in exactly one.  The emptiest bin is attacked first,
    then the next; each try weighs at most about ``effort`` exchanges, and a bin that was changed meanwhile is tried
    again, up to ``tries`` times.  Both bound the time, never what is packed."""
    bins = best_fit(lengths, capacity)
    least = least_bins(lengths, capacity)
    search, live = _Search(lengths, bins, capacity, 0), len(bins)
    tried: Counter[int] = Counter()
    queue = [(f, b) for b, f in enumerate(search.fill) if f < capacity]
    heapq.heapify(queue)
    while live > least and queue:
        fill, v = heapq.heappop(queue)
        if not search.bins[v] or fill != search.fill[v] or tried[v] >= tries:
            continue  # full, emptied, or in the queue anew as it is now
        tried[v] += 1
        search.effort = effort
        while search.bins[v] and search.step(v):
            for b in search.touched:
                if search.fill[b] < capacity:
                    heapq.heappush(queue, (search.fill[b], b))
        if not search.bins[v]:
            search.roomy[capacity].discard(v)
            live -= 1
    return [b for b in search.bins if b]


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, group: int = 40_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``, an array, if
    ``with_ids``).  ``tokenizer`` is the path of a tokenizers file whose pre-tokenizer drops white space.

    A null or empty text is the end id alone.  Repeated rows and null ids are packed as rows of their own;
    other columns are ignored.  Empty input: no rows.  Sequence ids are unique, not consecutive.
    """
    groups = blocks_for(docs.count(), group)

    def pieces(batches):
        encoder = encoder_for(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                rows = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
                for row, coded in enumerate(encoder.encode(batch.column(1).to_pylist())):
                    coded += end
                    for p, start in enumerate(range(0, len(coded) // 4, capacity)):
                        part = coded[4 * start : 4 * (start + capacity)]
                        for k, x in zip(rows, (row, p, start, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                            rows[k].append(x)
                arrays = [batch.column(0).take(pa.array(rows["row"])), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["crc"], pa.int64())]
                if with_ids:
                    arrays.append(pa.array(rows["ids"], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            encoder.forget()

    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    cut = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias(free_name([id_col], "_text"))).mapInArrow(tidy(pieces, 256), ddl)
    salted = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def place(key, table):
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        whole, rest = np.flatnonzero(lengths == capacity), np.flatnonzero(lengths < capacity)
        sequence[whole] = np.arange(len(whole))
        for number, members in enumerate(pack(lengths[rest], capacity), len(whole)):
            at = rest[members]
            sequence[at] = number
            offset[at] = np.concatenate([[0], np.cumsum(lengths[at])[:-1]])
        sequence += key[0].as_py() << 40
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = salted.groupBy("_group").applyInArrow(place, ddl + ", sequence_id long, offset long")
    return packed.withColumn("ids", _as_array(F.col("ids"))) if with_ids else packed


def _as_array(ids):
    """array<long> of little-endian unsigned 32-bit ids."""
    h = F.hex(ids)
    at = lambda i, k: F.substring(h, i * 8 + 2 * k + 1, F.lit(2))
    return F.transform(F.when(F.length(ids) >= 4, F.sequence(F.lit(0), (F.length(ids) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("long"))
