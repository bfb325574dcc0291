"""Language identification with hyperdimensional profiles.

Every letter (and the space between words) has a random vector of +1/-1.  The vector of a trigram binds its
letters, permuted by place, by elementwise product; a text's vector bundles (sums) the vectors of all its
trigrams, and a language's prototype bundles unit vectors of texts of that language.  A text is given the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, free_name, tidy

_NO_LETTERS = regex.compile(r"\P{L}+")


class Encoder:
    def __init__(self, dimensions: int, seed: int = 20240501, chars: int = 1 << 20, docs: int = 256):
        self.d, self.seed, self.chars, self.docs, self._letters = dimensions, seed, chars, docs, {}

    def letter(self, code: int) -> np.ndarray:
        v = self._letters.get(code)
        if v is None:
            v = self._letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.d, dtype=np.int8) * 2 - 1
        return v

    def _segments(self, texts: list[str | None]) -> Iterator[tuple[int, str]]:
        for i, text in enumerate(texts):
            words = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
            if words:
                padded = f" {words} "
                for at in range(0, len(padded) - 2, self.chars):
                    yield i, padded[at : at + self.chars + 2]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bundles (float32, a row a text) and whether there is any letter."""
        out, some = np.zeros((len(texts), self.d), np.float32), np.zeros(len(texts), bool)
        group: list[tuple[int, str]] = []
        size = 0
        for item in self._segments(texts):
            group.append(item)
            size += len(item[1])
            some[item[0]] = True
            if size >= self.chars or len(group) >= self.docs:
                self._add(group, out)
                group, size = [], 0
        if group:
            self._add(group, out)
        return out, some

    def _add(self, group: list[tuple[int, str]], out: np.ndarray) -> None:
        codes = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for _, t in group])
        owner = np.repeat(np.arange(len(group)), lengths)
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        k, at = len(alphabet), place[codes]
        key = (at[:-2] * k + at[1:-1]) * k + at[2:]
        inside = owner[:-2] == owner[2:]
        key, owner = key[inside], owner[:-2][inside]
        if k**3 <= 1 << 22:
            mark = np.zeros(k**3, bool)
            mark[key] = True
            grams = np.flatnonzero(mark)
            column = np.zeros(k**3, np.int64)
            column[grams] = np.arange(len(grams))
            column = column[key]
        else:
            grams, column = np.unique(key, return_inverse=True)
        letters = np.stack([self.letter(int(c)) for c in alphabet])
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        rows = np.array([i for i, _ in group])
        for a in range(0, len(grams), 16384):  # bounded also for scripts with very many trigrams
            g = grams[a : a + 16384]
            vectors = (first[g // (k * k)] * second[g // k % k] * letters[g % k]).astype(np.float32)
            here = slice(None) if len(grams) <= 16384 else (column >= a) & (column < a + len(g))
            counts = np.bincount(owner[here] * len(g) + column[here] - a, minlength=len(group) * len(g)).reshape(len(group), len(g))
            np.add.at(out, rows, counts.astype(np.float32) @ vectors)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def fit_prototypes(rows: DataFrame, text_col: str, lang_col: str, dimensions: int) -> dict[str, np.ndarray]:
    """Unit prototype per language.  Each task sums its texts per language, and few sums of those meet at the driver.  Texts that
    are null or without letters add nothing, repeated rows add as often as they are there, a null language is none;
    empty input gives no prototypes."""

    def sums(batches):
        encoder, total = Encoder(dimensions), {}
        for batch in batches:
            x, some = encoder.encode(batch.column(0).to_pylist())
            for v, any_letter, lang in zip(_unit(x), some, batch.column(1).to_pylist(), strict=True):
                if any_letter and lang is not None:
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    def added(key, table):
        return pa.table({"lang": [key[0].as_py()], "v": [np.sum([np.array(v) for v in table.column("v").to_pylist()], axis=0).tolist()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    schema = "lang string, v array<double>"
    parts = rows.select(text_col, lang_col).mapInArrow(tidy(sums, 256), schema).withColumn("part", F.spark_partition_id() % 16)
    out: dict[str, np.ndarray] = {}
    for lang, v in parts.groupBy("lang", "part").applyInArrow(added, schema).collect():  # sixteen sums a language
        out[lang] = out.get(lang, 0) + np.array(v)
    return {k: _unit(out[k]).astype(np.float32) for k in sorted(out)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, keep: list[str], text_col: str = "text", dimensions: int = 1024) -> DataFrame:
    """``keep`` columns, lang_pred (``und`` for a null text, one without letters, or if nothing was learned) and
    score, the cosine cut to 0..1; what ``keep`` has under those two names is replaced.  Ties go to the language
    first in order; repeated rows stay repeated.  Empty input: no rows."""
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast((list(prototypes), np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dimensions), np.float32)))

    def run(batches):
        encoder = Encoder(dimensions)
        langs, table = shared.value
        names = pa.array([*langs, "und"], pa.string())
        for batch in batches:
            x, some = encoder.encode(batch.column(0).to_pylist())
            cosine = _unit(x) @ table.T if langs else np.zeros((len(x), 1))
            best = np.where(some & bool(langs), cosine.argmax(axis=1), len(langs))
            score = np.where(best < len(langs), np.clip(cosine.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], names.take(pa.array(best)), pa.array(score.astype(np.float64))], names=[*keep, "lang_pred", "score"])

    chosen = docs.select(F.col(f"`{text_col}`").alias(free_name(keep, "_text")), *[F.col(f"`{c}`") for c in keep])
    return chosen.mapInArrow(tidy(run), ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double"]))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, dimensions: int = 1024, sample: int = 50_000) -> DataFrame:
    """id, held_out, lang_pred and score of every row; learned only from rows outside the held-out fold.

    At most about ``sample`` of those rows, chosen by a hash of the id, are learned from; all rows are scored.
    Rows with a null id are not held out and not learned from; rows with a null lang are not learned from.
    Repeated rows stay repeated; other columns are ignored.  Empty input: no rows.
    """
    fold = crc32_mod(id_col, folds)
    learn = docs.where((fold != held_fold) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, sample / max(1, docs.count()))
    prototypes = fit_prototypes(learn.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20))), text_col, lang_col, dimensions)
    marked = docs.select(id_col, F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), text_col)
    return identify(marked, prototypes, keep=[id_col, "held_out"], text_col=text_col, dimensions=dimensions)
