"""Removal of long repeated byte strings with a logarithmic family of (sparse) suffix arrays.

A window is ``window`` bytes long.  Each window is anchored at the position, among its first bytes, whose
``window // 2``-byte string has the smallest hash (leftmost of equals); equal windows have equal anchors, so
only suffixes at anchors need sorting.  Consecutive windows with one anchor form a run, stored as its position.
A suffix array holds runs in the order of (hash of the first ``window // 2`` bytes at the anchor, hash of the
whole run): strings that match share the first and lie next to each other.

1. Each task keeps a family of such arrays (``RunFamily``): a batch of documents gets one, levels of similar size
   merge geometrically, and a run met twice leaves its positions as repeated and one entry with a count.  What a
   hot passage sends on is an entry a task, not a row an occurrence.
2. One shuffle by anchor merges the arrays of all tasks in order, and a scan of neighbours decides: an anchor met
   once holds no repeated window; runs equal as a whole are repeated as a whole.
3. What is left are the edges of repeated passages: runs that share an anchor, yet differ.  Their bytes are
   fetched, and a family of arrays of suffixes (``IndexFamily``) takes them batch by batch: a batch gets a suffix
   array, is merge-scanned against the levels already there for matches of a whole window, and levels of equal
   size merge geometrically.
4. Anchors with more than ``group_limit`` different runs could outgrow a task.  Their windows are compared by
   128-bit hashes in an aggregate instead, which handles any size exactly.

Documents are identified by the MD5 of their text, so identical texts share one set of marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, checkpoint, shuffle_partitions, tidy

_CHUNK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hasher:
    """Polynomial hashes modulo 2^64 of substrings, over random odd byte codes."""

    def __init__(self, length: int, seed: int = 7):
        code = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        self.code = code
        self.power, self.back = (np.cumprod(np.concatenate([[_U(1)], np.full(length, x, np.uint64)]).astype(np.uint64)) for x in (_MULTIPLIER, inverse))

    def prefix(self, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(self.code[t] * self.power[: len(t)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((prefix[end] - prefix[start]) * self.back[start])


def _runs_in(t: np.ndarray, end: np.ndarray, window: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(first window, anchor - first window, last - first window, anchor hash, hash of the whole run) of a buffer of
    texts; ``end`` is, by position, where the text there ends."""
    k = window // 2
    v = window - k + 1  # anchor candidates of a window
    prefix = hasher.prefix(t)
    m, windows = len(t) - k + 1, len(t) - window + 1
    h = hasher.between(prefix, np.arange(m), np.arange(k, m + k))
    rows = -(-m // v)
    key = np.concatenate([h >> _U(16), np.full(rows * v - m, (1 << 48) - 1, np.uint64)]).reshape(rows, v) << _U(16) | np.arange(v, dtype=np.uint64)
    pre = np.minimum.accumulate(key, axis=1).ravel()
    post = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    s = np.arange(windows)
    e = s + v - 1
    a, b = post[:windows], pre[v - 1 : v - 1 + windows]
    low = _U(0xFFFF)
    anchor = np.where((a >> _U(16)) <= (b >> _U(16)), s // v * v + (a & low).astype(np.int64), e // v * v + (b & low).astype(np.int64))
    anchor[s + window > end[:windows]] = -1  # windows across two texts
    change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:] - 1, [windows - 1]])
    inside = anchor[first] >= 0
    first, last = first[inside], last[inside]
    at = anchor[first]
    shape = ((at - first) * (window + 1) + (last - first)).astype(np.uint64)
    return first, at - first, last - first, h[at], _mix(hasher.between(prefix, first, last + window) + shape * _U(0xC2B2AE3D27D4EB4F))


def runs(raws: Sequence[bytes], window: int, hasher: Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, anchor - first window, last - first window, anchor hash, hash of the whole run).
    Short texts share a buffer; long ones are cut at fixed places."""
    group: list[int] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, ...]]:
        nonlocal group, size
        if group:
            lengths = np.array([len(raws[i]) for i in group])
            ends = np.cumsum(lengths)
            t = np.frombuffer(b"".join(raws[i] for i in group), np.uint8)
            first, *rest = _runs_in(t, np.repeat(ends, lengths), window, hasher)
            which = np.searchsorted(ends, first, side="right")
            yield np.array(group)[which], first - (ends - lengths)[which], *rest
        group, size = [], 0

    for i, raw in enumerate(raws):
        if len(raw) < window:
            continue
        if len(raw) > _CHUNK:
            whole = np.frombuffer(raw, np.uint8)
            for base in range(0, len(raw) - window + 1, _CHUNK):
                t = whole[base : base + _CHUNK + window - 1]
                first, *rest = _runs_in(t, np.full(len(t), len(t)), window, hasher)
                yield np.full(len(first), i), base + first, *rest
            continue
        if size + len(raw) > _CHUNK:
            yield from flush()
        group.append(i)
        size += len(raw)
    yield from flush()


def pack_place(first, back, span):
    return first << 24 | back << 12 | span


def unpack_place(place):
    return place >> 24, place >> 12 & 4095, place & 4095


class RunFamily:
    """Levels of suffix arrays: runs in the order of (anchor hash, run hash), each once with a count.  Positions of
    runs met more than once are ``repeated``, (text number, place)."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []  # rows: anchor, whole, count, text number, place
        self.repeated: list[np.ndarray] = []

    def __len__(self) -> int:
        return sum(len(x) for x in self.levels)

    def add(self, anchor: np.ndarray, whole: np.ndarray, text: np.ndarray, place: np.ndarray) -> None:
        level = self._merged(np.stack([anchor.view(np.int64), whole.view(np.int64), np.ones(len(anchor), np.int64), text, place], axis=1))
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self._merged(np.concatenate([self.levels.pop(), level]))
        self.levels.append(level)

    def _merged(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        if len(start) == len(rows):
            return rows
        total = np.add.reduceat(rows[:, 2], start)
        fresh = (rows[:, 2] == 1) & (total[np.cumsum(new) - 1] > 1)  # those counted before are there already
        self.repeated.append(rows[fresh, 3:])
        out = rows[start]
        out[:, 2] = total
        return out

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        """The single array of all levels, and the repeated positions; the family is empty then."""
        none = np.zeros((0, 5), np.int64)
        whole = self._merged(np.concatenate([none, *self.levels]))
        repeated = np.concatenate([none[:, 3:], *self.repeated])
        self.levels, self.repeated = [], []
        return whole, repeated


class IndexFamily:
    """Levels of sorted anchored suffixes; every repeated window of what was added is marked."""

    def __init__(self, window: int, hasher: Hasher):
        self.window, self.hasher = window, hasher
        self.k = window // 2
        self.levels: list[list[int]] = []
        self.key: list[tuple[int, bytes]] = []
        self.left: list[bytes] = []  # bytes before the anchor, nearest first
        self.range: list[tuple[int, int]] = []  # offsets of the anchor in the run's windows
        self.marks: list[np.ndarray] = []
        self.known: set[tuple[int, int]] = set()

    def add(self, batch: list[tuple[int, int, int, int, bytes]]) -> list[int | None]:
        """batch: (anchor hash, run hash, anchor - first, last - first, bytes).  Returns member numbers, None
        for a run already there; then scans and files the batch."""
        numbers: list[int | None] = []
        for anchor, whole, back, span, content in batch:
            if (anchor, whole) in self.known:
                numbers.append(None)
                continue
            self.known.add((anchor, whole))
            numbers.append(len(self.key))
            self.key.append((anchor, content[back:]))
            self.left.append(content[:back][::-1])
            self.range.append((back - span, back))
            self.marks.append(np.zeros(self.window - self.k + 1, bool))
        fresh = sorted((x for x in numbers if x is not None), key=self.key.__getitem__)
        if fresh:
            self._scan(fresh)
            self._file(fresh)
        return numbers

    def _file(self, level: list[int]) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = sorted(self.levels.pop() + level, key=self.key.__getitem__)  # two ordered stretches: one merge
        self.levels.append(level)

    def _scan(self, fresh: list[int]) -> None:
        """Marks windows shared among the fresh suffixes and with those of any level."""
        anchors = {self.key[x][0] for x in fresh}
        near = [x for level in self.levels for x in level if self.key[x][0] in anchors]
        order = sorted(near + fresh, key=self.key.__getitem__)
        heads = [self.key[x][0] for x in order]
        same = np.array([False] + [a == b for a, b in zip(heads, heads[1:], strict=False)])
        starts = np.flatnonzero(~same)
        group: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            if b - a > 1:
                group += order[a:b]
            if len(group) >= 4096:
                self._mark(group)
                group = []
        if group:
            self._mark(group)

    def _mark(self, members: list[int]) -> None:
        """members: in suffix order, all suffixes of an anchor hash that may match together."""
        n, reach = len(members), self.window
        text = np.frombuffer(b"".join(self.key[x][1].ljust(reach, b"\0") for x in members), np.uint8).reshape(n, reach)
        size = np.array([len(self.key[x][1]) for x in members])
        head = np.array([self.key[x][0] for x in members], np.int64)
        differ = text[1:] != text[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
        common = np.minimum(common, np.minimum(size[1:], size[:-1]))
        common[head[1:] != head[:-1]] = -1
        widest = self.window - self.k
        before = np.frombuffer(b"".join(self.left[x].ljust(widest, b"\0") for x in members), np.uint8).reshape(n, widest)
        hashes = np.zeros((n, widest + 1), np.uint64)
        np.cumsum(self.hasher.code[before] * self.hasher.power[1 : widest + 1], axis=1, out=hashes[:, 1:])
        low, high = np.array([self.range[x] for x in members]).T
        marks = np.zeros((n, widest + 1), bool)
        for back in range(widest + 1):
            valid = np.flatnonzero((low <= back) & (back <= high))
            if len(valid) < 2:
                continue
            cluster = np.concatenate([[0], np.cumsum(common < self.window - back)])[valid]
            key = _mix(_mix(cluster.astype(np.uint64) + _U(1)) + hashes[valid, back])
            order = np.argsort(key, kind="stable")
            equal = key[order][1:] == key[order][:-1]
            hit = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
            marks[valid[order[hit]], back] = True
        for row, x in zip(marks, members, strict=True):
            self.marks[x] |= row

    def marked(self, number: int) -> list[tuple[int, int]]:
        """Stretches (first, last) of marked windows, counted from the run's first window."""
        low, high = self.range[number]
        flags = self.marks[number][low : high + 1][::-1]  # window s has offset back - s
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
        return [(int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)]


# ---- Spark ----------------------------------------------------------------------------------------------


_MARKS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: What passes between the stages.  A run: its hashes and, packed, key, place and count.  Spans of a text known to be
#: repeated: no hashes, and packed the key and starts and ends.
_ENTRY = "anchor long, whole long, packed binary"
_FAMILY_ROWS = 1 << 20


def _spans(place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    first, _, span = unpack_place(place)
    return first, first + span + window


def _joined(text: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, list[bytes]]:
    """Text numbers that have repeated positions, and their spans, merged and packed."""
    order = np.lexsort((place, text))
    text, (start, end) = text[order], _spans(place[order], window)
    # ends rise with starts within a text, for runs follow one another
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > end[:-1])]) if len(text) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    pairs = np.stack([start[at], np.maximum.reduceat(end, at) if len(at) else end[:0]], axis=1)
    texts, first = np.unique(text[at], return_index=True)
    return texts, [x.astype("<i8").tobytes() for x in np.split(pairs, first[1:])] if len(texts) else []


def _bytes_of(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * width + 1, width or 1, dtype=np.int32)[: n + 1]), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    """The reverse of _binary."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, width)


def _find_runs(window: int):
    """Entries of the task's family, and spans it found repeated, of texts (key, raw)."""

    def rows(family: RunFamily, keys: list[bytes]) -> Iterator[pa.RecordBatch]:
        whole, repeated = family.drain()
        names = ["anchor", "whole", "packed"]
        known = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        for at in range(0, len(whole), 65536):
            anchor, run, n, text, place = np.ascontiguousarray(whole[at : at + 65536].T)
            packed = np.concatenate([known[text], _bytes_of(place), _bytes_of(n)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(run), _binary(packed)], names=names)
        texts, spans = _joined(repeated[:, 0], repeated[:, 1], window)
        if len(texts):
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([keys[i] + x for i, x in zip(texts, spans, strict=True)], pa.binary())], names=names)

    def run(batches):
        hasher, family = Hasher(_CHUNK + window), RunFamily()
        known: dict[bytes, list[int]] = {}  # number of a text, and how often it was met
        for batch in batches:
            texts, number = batch.column(1).to_pylist(), []
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = known.setdefault(key, [len(known), 0])
                own[1] += 1
                number.append(own[0])
                if own[1] > 2:  # met twice, all of it is repeated
                    texts[i] = b""
            for text, first, back, span, anchor, whole in runs(texts, window, hasher):
                family.add(anchor, whole, np.array(number, np.int64)[text], pack_place(first, back, span))
            if len(family) > _FAMILY_ROWS:
                yield from rows(family, list(known))
                known = {}
        yield from rows(family, list(known))

    return run


def _scan_runs(window: int, group_limit: int):
    """Neighbours in the order of (anchor, whole): spans of runs that are repeated, and runs to be compared with
    others of their anchor (``alone``: met once) by the bytes."""
    names = ["key", "spans", "place", "anchor", "whole", "alone", "large"]

    def decided(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchor, whole, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _rows_of(batch.column(2), 32)
        keys, (place, n) = packed[:, :16], np.ascontiguousarray(packed[:, 16:]).view("<i8").T
        group = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        kind = group | np.concatenate([[True], whole[1:] != whole[:-1]])
        of_group, of_kind = np.cumsum(group) - 1, np.cumsum(kind) - 1
        total = np.bincount(of_kind, n).astype(np.int64)[of_kind]
        kinds = np.bincount(of_group, kind).astype(np.int64)[of_group]
        singles = np.bincount(of_group, total == 1).astype(np.int64)[of_group]
        mark = np.flatnonzero((total > 1) & (n == 1))
        ask = np.flatnonzero((kinds > 1) & (singles > 0) & kind)
        if len(mark):
            start, end = _spans(place[mark], window)
            values = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.arange(len(mark) + 1), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([_binary(keys[mark]), spans, *[pa.nulls(len(mark), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())]], names=names)
        if len(ask):
            yield pa.RecordBatch.from_arrays([_binary(keys[ask]), pa.nulls(len(ask), _MARKS), pa.array(place[ask]), pa.array(anchor[ask]), pa.array(whole[ask]), pa.array(total[ask] == 1), pa.array(kinds[ask] > group_limit)], names=names)

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last anchor, which may go on
        for batch in batches:
            if batch.column(0).null_count:
                packed = batch.filter(batch.column(0).is_null()).column(2).to_pylist()
                spans = [[{"start": a, "end": b} for a, b in np.frombuffer(x, "<i8", offset=16).reshape(-1, 2).tolist()] for x in packed]
                yield pa.RecordBatch.from_arrays([pa.array([x[:16] for x in packed], pa.binary()), pa.array(spans, _MARKS), *[pa.nulls(len(packed), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())]], names=names)
                batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            if held and (anchor == held[-1].column(0)[0].as_py()).all():
                held.append(batch)
                continue
            cut = int(np.searchsorted(anchor, anchor[-1]))
            yield from decided(_one([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from decided(_one(held))

    return run


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if sum(b.num_rows for b in batches) else batches[0]


def _bring_bytes(window: int):
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                rows = []
                for w in wanted:
                    first, _, span = unpack_place(w["place"])
                    rows.append((key, w["place"], w["anchor"], w["whole"], w["alone"], text[first : first + span + window]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["key", "place", "anchor", "whole", "alone", "bytes"])

    return run


def _index(window: int):
    def run(batches):
        family = IndexFamily(window, Hasher(window))
        single: list[tuple[bytes, int, int]] = []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            places = [unpack_place(p) for p in cols[1]]
            numbers = family.add([(a, w, p[1], p[2], b) for a, w, p, b in zip(cols[2], cols[3], places, cols[5], strict=True)])
            single += [(k, p[0], n) for k, p, n, alone in zip(cols[0], places, numbers, cols[4], strict=True) if alone and n is not None]
        found = [(k, first + a, first + b + window) for k, first, n in single for a, b in family.marked(n)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "start", "end"])

    return run


def _window_hashes(window: int):
    """Rows of single windows, for groups too large for one task."""

    def run(batches):
        hashers = Hasher(2 * window), Hasher(2 * window, seed=11)
        for batch in batches:
            for key, place, anchor, _, alone, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, back, span = unpack_place(place)
                s, t = np.arange(span + 1), np.frombuffer(content, np.uint8)
                h = [x.between(x.prefix(t), s, s + window).view(np.int64) for x in hashers]
                n = span + 1
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(first + s), pa.array(np.full(n, anchor)), pa.array(back - s), pa.array(h[0]), pa.array(h[1]), pa.array([alone] * n)], names=["key", "start", "anchor", "back", "h1", "h2", "alone"])

    return run


#: Bytes of keys and positions up to which they are sent to all executors, so that texts need not move.
_SENT = 32 << 20


def repeated_stretches(texts: DataFrame, window: int = 400, group_limit: int = 20_000, per_task: int = 25_000) -> tuple[DataFrame, bool]:
    """(key, stretches array<struct<start, end>>): byte ranges covered by repeated windows, per distinct text
    that has any; and whether they are few enough to be broadcast.  texts: key (MD5), raw (bytes; rows where it is
    null or shorter than a window are left out, repeated rows are repetitions).  Empty input: no rows."""
    long_enough = texts.where(F.length("raw") >= window).select("key", "raw")
    entries = long_enough.mapInArrow(tidy(_find_runs(window), 512), _ENTRY)
    ordered = entries.repartition(shuffle_partitions(texts.sparkSession), F.coalesce("anchor", F.xxhash64("packed"))).sortWithinPartitions("anchor", "whole")
    decided = checkpoint(ordered.mapInArrow(tidy(_scan_runs(window, group_limit), 10_000), "key binary, spans array<struct<start:long,end:long>>, place long, anchor long, whole long, alone boolean, large boolean"))
    open_runs = decided.where(F.col("anchor").isNotNull())
    members, keys, large = open_runs.agg(F.count(F.lit(1)), F.count_distinct("key"), F.coalesce(F.max("large"), F.lit(False))).first()
    asked = checkpoint(open_runs.groupBy("key").agg(F.collect_list(F.struct("place", "anchor", "whole", "alone", "large")).alias("w")))
    if members * 48 + keys * 64 <= _SENT:
        asked = F.broadcast(asked)
    schema = "key binary, place long, anchor long, whole long, alone boolean, bytes binary"
    parts = max(shuffle_partitions(texts.sparkSession), blocks_for(members, per_task))

    def brought(large: bool) -> DataFrame:
        wanted = F.filter("w", lambda x: x["large"] == large)
        return long_enough.join(asked, "key").select("key", "raw", wanted.alias("w")).where(F.size("w") > 0).mapInArrow(tidy(_bring_bytes(window), 512), schema)

    found = brought(False).repartition(parts, "anchor").mapInArrow(tidy(_index(window), 10_000), "key binary, start long, end long")
    if large:
        single = brought(True).dropDuplicates(["anchor", "whole"]).mapInArrow(tidy(_window_hashes(window), 512), "key binary, start long, anchor long, back long, h1 long, h2 long, alone boolean")
        twice = single.groupBy("anchor", "back", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found = found.unionByName(single.where("alone").join(twice, ["anchor", "back", "h1", "h2"]).select("key", "start", (F.col("start") + window).alias("end")))
    marks = decided.where(F.col("spans").isNotNull()).select("key", "spans").unionByName(found.select("key", F.array(F.struct("start", "end")).alias("spans")))
    # Checkpointed, so that the join with texts has a plain exchange on either side and a hot text can be split.
    marks = checkpoint(marks.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("stretches")))
    keys, spans = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("stretches")), F.lit(0))).first()
    return marks, keys * 64 + spans * 24 <= _SENT


def merge(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words, between white space, that lie wholly in a span."""
    words = len(text[start:end].split())
    within = [0 < at < len(text) and not text[at - 1 : at].isspace() and not text[at : at + 1].isspace() for at in (start, end)]
    return max(0, words - sum(within))


def remove_repeats(docs: DataFrame, *, keep: list[str], text_col: str = "text", window: int = 400, min_words: int = 0, with_text: bool = False, group_limit: int = 20_000) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256, and ``kept_text`` if ``with_text``.

    A byte goes if a ``window``-byte string that covers it also starts anywhere else, in the same text too;
    all occurrences go - of ``min_words`` whole words at least, if that is given.  Null and empty texts, and texts shorter than a window, lose nothing.  Repeated rows
    stay repeated (and, if long enough, are wholly removed).  ``kept_text`` drops a character of which a byte
    was removed.  What ``keep`` has under the result's names is replaced.  Empty input: no rows.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    keep = [c for c in keep if c.lower() not in names]
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.unhex(F.md5(raw)).alias("_key"), raw.alias("_raw"))
    marks, few = repeated_stretches(docs.select(F.unhex(F.md5(raw)).alias("key"), raw.alias("raw")), window, group_limit)
    marks = marks.withColumnsRenamed({"key": "_mark", "stretches": "_stretches"})
    marks = F.broadcast(marks) if few else marks
    joined = texts.join(marks, F.col("_key") == F.col("_mark"), "left").select(*[F.col(f"`{c}`") for c in keep], "_raw", "_stretches")

    def run(batches):
        for batch in batches:
            out = []
            for text, stretches in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                spans = merge([(s["start"], s["end"]) for s in stretches or []])
                if min_words:
                    spans = [s for s in spans if whole_words(text, *s) >= min_words]
                edges = [0, *[x for span in spans for x in span], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]], names=[*keep, *names])

    ddl = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + ["kept_text string"] * with_text)
    return joined.mapInArrow(tidy(run), ddl)
