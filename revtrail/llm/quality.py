"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is binned; the model is one lookup table per feature and one per chosen pair, plus a
constant.  Tables are learned by cyclic boosting: round after round, a shallow tree over the bins of one
feature at a time is fitted to the gradient of the log loss and added to that feature's table.  Then the pairs
that explain most of what is left get tables in the same way, from trees with one cut in either feature.  A
score is the logistic function of a sum of table entries: vectorised lookups and additions.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, free_name, tidy

FEATURES = ("log_words", "word_length", "longest_word", "distinct_words", "top_word", "upper", "digit", "space", "letter_like", "period", "comma", "exclaim", "pipe", "bracket", "symbol", "other_mark", "lines", "line_length", "repeated_lines", "repeated_pairs", "capitals_at_start", "short_words")

_CLASS = np.zeros((256, 9), np.int64)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".", b",", b"!?", b"|", b"()[]{}<>", b"#$%&*@~^\\=+_"]):
    _CLASS[list(_chars), _k] = 1


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of FEATURES; zeros for null and empty texts."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, space, period, comma, exclaim, pipe, bracket, symbol = (counts @ _CLASS / len(raw)).tolist()
    letters = float(counts[97:123].sum() + counts[128:].sum()) / len(raw)
    other = max(0.0, 1 - letters - upper - digit - space - period - comma - exclaim - pipe - bracket - symbol)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * 7 + [space] + [0.0] * (len(FEATURES) - 8)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lengths = list(map(len, words))
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), sum(lengths) / n, float(min(200, max(lengths))), len(tally) / n, max(tally.values()) / n,
        upper, digit, space, letters, period, comma, exclaim, pipe, bracket, symbol, other,
        float(np.log1p(len(lines))), float(np.log1p(len(text) / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), 1 - pairs / max(1, n - 1),
        sum(w[:1].isupper() for w in words) / n, sum(x <= 3 for x in lengths) / n,
    ]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    constant: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        total = np.full(len(x), self.constant)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + lam) + (g.sum() - gl) ** 2 / (h.sum() - hl + lam) - g.sum() ** 2 / (h.sum() + lam)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]) if len(gain) else 0.0), at + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float, leaves: int = 3) -> np.ndarray:
    """Leaf values over bins, of a tree grown best-first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, k = max(((*_cut(g[a:b], h[a:b], lam), k) for k, (a, b) in enumerate(parts)), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree with one cut in either feature."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    corner = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    qg, qh = corner(cg), corner(ch)
    gain = sum(a**2 / (b + lam) for a, b in zip(qg, qh, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + lam)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for (rows, cols), a, b in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), qg, qh, strict=True):
        out[rows, cols] = -a[i, j] / (b[i, j] + lam)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, max_bins: int = 48, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, lam: float = 2.0) -> AdditiveModel:
    """Deterministic.  Without rows the score is 0.5; with one class it is that class's smoothed share."""
    if not len(y):
        return AdditiveModel([np.zeros(0)] * len(FEATURES), 0.0, [np.zeros(1)] * len(FEATURES))
    model = AdditiveModel([np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(x.shape[1])])
    p0 = (y.sum() + 1) / (len(y) + 2)
    model.constant = float(np.log(p0 / (1 - p0)))
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.constant)
    slope = lambda: (1 / (1 + np.exp(-logit)) - y, np.maximum(1e-6, (s := 1 / (1 + np.exp(-logit))) * (1 - s)))
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slope()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), lam)
            t += step
            logit += step[b[:, j]]
    g, h = slope()
    grid = lambda i, j, w: np.bincount(b[:, i] * len(model.tables[j]) + b[:, j], w, len(model.tables[i]) * len(model.tables[j])).reshape(len(model.tables[i]), -1)
    ranked = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(grid(*p, g), grid(*p, h), lam)[0])
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slope()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), lam)[1]
            t += step
            logit += step[b[:, i], b[:, j]]
    return model


def _with_features(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=[*keep, "x"])

    chosen = df.select(F.col(f"`{text_col}`").alias(free_name(keep, "_text")), *[F.col(f"`{c}`") for c in keep])
    return chosen.mapInArrow(tidy(run), ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_fold: int = 2, sample: int = 40_000) -> AdditiveModel:
    """Learns from at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id.
    Labels that are null or neither 0 nor 1, or whose id is null, are left out; a repeated label or document counts
    as often as it is there, contradicting ones each.  Without labels or documents every score is 0.5.  Equal gains
    are settled by the order of features and bins."""
    known = labels.where((crc32_mod(id_col, folds) != held_fold) & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_label"))
    bounded = known.orderBy(F.xxhash64(id_col), id_col, "_label").limit(sample)
    rows = _with_features(docs.select(id_col, text_col).join(F.broadcast(bounded), id_col), text_col, [id_col, "_label"]).orderBy(id_col, "_label").select("_label", "x").collect()
    return fit(np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[0] for r in rows], float))


def score_quality(docs: DataFrame, model: AdditiveModel, *, keep: list[str], text_col: str = "text", threshold: float = 0.7, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``keep`` columns, score (0..1) and predicted (1 if score >= threshold, so a tie is accepted); what ``keep`` has
    under those two names is replaced.  Whole texts count; null reads as empty; repeated rows stay repeated.  Empty
    input: no rows."""
    keep = [c for c in keep if c.lower() not in (score_col.lower(), predicted_col.lower())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(np.array([features(t) for t in batch.column(0).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, score_col, predicted_col])

    chosen = docs.select(F.col(f"`{text_col}`").alias(free_name(keep, "_text")), *[F.col(f"`{c}`") for c in keep])
    return chosen.mapInArrow(tidy(run), ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{score_col}` double, `{predicted_col}` int"]))
