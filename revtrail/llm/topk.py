"""Exact top-k inner-product search by a three-phase uniform threshold.

The components of a vector are cut into ``nodes`` ranges; a node's score of a candidate is the inner product over
its range, and a candidate's score is the sum over nodes.

1. Of a share of the candidates (one in ``lead_share``, by a hash of the id) each node lists its ``k`` best for
   every query; the totals of what is listed are gathered, and the k-th best is a cutoff that no member of the
   answer falls below, whatever that share holds.
2. The cutoff ``c`` goes to all candidates.  One whose node scores all lie under ``c / nodes`` sums to less than
   ``c``; as a node's score is at most the product of the lengths of both ranges, many are out before anything is
   multiplied.  The others are scored node by node; what with the lengths of the ranges left cannot reach ``c``
   any more is dropped on the way.
3. The nodes still missing are resolved for the entries collected alone, exactly, and each task hands on its
   ``k`` best of at least ``c`` - which rises with what the task has found; ties go to the smaller id.

Candidates stay where they are read: queries go to them, in waves of at most about ``wave``.  All pairs have to
be looked at, so the work is the number of queries times that of candidates; what is sent is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks_for, checkpoint, tidy

_LOW = np.iinfo(np.int64).min


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id long, v array<double>) of whole vectors: floor(scale * x), x as double.  Vectors that are null or
    hold null, NaN or infinite components, and rows without an id, are left out."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, cut or padded with zeros to ``width`` (zeros add nothing to a product)."""
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    if (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    for row, a, n in zip(out, ends, np.minimum(lengths, width), strict=False):
        row[:n] = flat[a : a + n]
    return out


class Search:
    """The queries of a wave with their cutoffs, and the best candidates found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, nodes: int, cutoffs: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, vectors, k
        self.cuts = np.linspace(0, vectors.shape[1], nodes + 1).astype(int)
        self.cutoff = np.full(len(ids), _LOW) if cutoffs is None else cutoffs.copy()
        self.score, self.found = np.full((len(ids), k), _LOW), np.zeros((len(ids), k), np.int64)
        self.products = 0  # components multiplied
        self.q_node, self.q_rest = self._lengths(vectors)

    def _lengths(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of each node's range, and of all ranges from it on; rounded up."""
        squares = np.stack([(x[:, a:b] * x[:, a:b]).sum(axis=1) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)], axis=1)
        rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(squares) * (1 + 1e-9), np.sqrt(rest) * (1 + 1e-9)

    def _keep(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merges scored candidates into the best; a query with k of them gets their least as its cutoff."""
        rows = np.unique(row)
        old = np.repeat(rows, self.k)
        row, ids, score = np.concatenate([old, row]), np.concatenate([self.found[rows].ravel(), ids]), np.concatenate([self.score[rows].ravel(), score])
        real = score > _LOW
        row, ids, score = row[real], ids[real], score[real]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        best = rank < self.k
        self.score[row[best], rank[best]], self.found[row[best], rank[best]] = score[best], ids[best]
        self.cutoff = np.maximum(self.cutoff, self.score[:, -1])

    def _exact(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sides as doubles where those hold every sum exactly, else as integers."""
        top = [float(np.abs(x).max()) if x.size else 0.0 for x in (self.q, c)]
        return (self.q, c) if top[0] * top[1] * c.shape[1] < 2.0**53 else (self.q.astype(np.int64), c.astype(np.int64))

    def list_nodes(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Phase one over a block: every node's k best, with their totals."""
        q, c = self._exact(c)
        parts = [q[:, a:b] @ c[:, a:b].T for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        total = sum(parts)
        own = ids[None, :] == self.ids[:, None]
        listed = np.zeros(total.shape, bool)
        take = min(self.k + 1, len(ids))  # one more, for the query's own row
        for part in parts:
            listed[np.arange(len(q))[:, None], np.argpartition(-part, take - 1, axis=1)[:, :take]] = True
        row, col = np.nonzero(listed & ~own)
        self._keep(row, ids[col], total[row, col].astype(np.int64))

    def scan(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Phases two and three over a block."""
        nodes = len(self.cuts) - 1
        c_node, c_rest = self._lengths(c)
        cutoff = np.where(self.cutoff == _LOW, -np.inf, self.cutoff.astype(float))[:, None]
        share = cutoff / nodes
        hopeful = np.zeros((len(self.ids), len(ids)), bool)
        for j in range(nodes):
            hopeful |= np.outer(self.q_node[:, j], c_node[:, j]) >= share
        some = hopeful.any(axis=0)
        ids, c, c_rest, hopeful = ids[some], c[some], c_rest[some], hopeful[:, some]
        if not len(ids):
            return
        q, c = self._exact(c)
        own = ids[None, :] == self.ids[:, None]
        total, pairs = np.zeros((len(q), len(ids)), q.dtype), None
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if pairs is None:
                alive = hopeful & ~own & (total + np.outer(self.q_rest[:, j], c_rest[:, j]) >= cutoff)
                if np.count_nonzero(alive) * 8 < alive.size:
                    pairs = np.nonzero(alive)
                    partial = total[pairs]
                else:
                    total += q[:, a:b] @ c[:, a:b].T
                    self.products += total.size * (b - a)
                    continue
            row, col = pairs
            within = partial + self.q_rest[row, j] * c_rest[col, j] >= cutoff[row, 0]
            row, col, partial = row[within], col[within], partial[within]
            for at in range(0, len(row), 1 << 16):
                s = slice(at, at + (1 << 16))
                partial[s] += (q[row[s], a:b] * c[col[s], a:b]).sum(axis=1)
            self.products += len(row) * (b - a)
            pairs = row, col
        row, col = pairs if pairs is not None else np.nonzero(hopeful & ~own & (total >= cutoff))
        partial = partial if pairs is not None else total[row, col]
        score = partial.astype(np.int64)
        enough = score >= self.cutoff[row]
        self._keep(row[enough], ids[col[enough]], score[enough])

    def rows(self) -> pa.RecordBatch:
        at = np.nonzero(self.score > _LOW)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at[0]]), pa.array(self.found[at]), pa.array(self.score[at])], names=["query_id", "vec_id", "score"])


_SCORED = "query_id long, vec_id long, score long"
_BLOCK = 1024


def _searched(candidates: DataFrame, wave, k: int, nodes: int, lists: bool) -> DataFrame:
    """Each task's best candidates (id, v) of every query of a wave, a broadcast of (ids, vectors, cutoffs)."""

    def run(batches):
        ids, vectors, cutoffs = wave.value
        search = Search(ids, vectors, k, nodes, cutoffs)
        for batch in batches:
            (search.list_nodes if lists else search.scan)(batch.column(0).to_numpy(), _matrix(batch.column(1), vectors.shape[1]))
        yield search.rows()

    return candidates.mapInArrow(tidy(run, _BLOCK), _SCORED)


def exact_top_k(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, query_modulus: int = 50, scale: int = 256, nodes: int = 4, wave: int = 4096, lead_share: int = 64, lead_block: int = 8192) -> DataFrame:
    """The k best other vectors of every query (id divisible by ``query_modulus``).

    Returns query_id, rank (from 1), vec_id, score.  A query with fewer than k candidates gets all of them.
    Rows without a usable vector or id take no part.  Repeated rows: a repeated candidate row counts as often
    as it is there; a repeated query row is one query.  Other columns are ignored.  Empty input: no rows.
    """
    spark = df.sparkSession
    vectors = lambda: integer_vectors(df, id_col, vector_col, scale)  # noqa: E731  new column ids for each use
    queries = checkpoint(vectors().where(F.col("id") % query_modulus == 0).dropDuplicates(["id"]))
    waves = blocks_for(queries.count(), wave)
    lead = checkpoint(vectors().where(F.pmod(F.xxhash64("id"), F.lit(lead_share)) == 0))
    blocks = blocks_for(lead.count(), lead_block)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out: DataFrame | None = None
    for number in range(waves):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == number).collect()
        ids = np.array([r[0] for r in rows], np.int64)
        width = max((len(r[1]) for r in rows), default=0)
        q = _matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())), width)
        first = _searched(lead.repartition(blocks), spark.sparkContext.broadcast((ids, q, None)), k, nodes, True)
        least = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", "score").collect()
        known = {r[0]: r[1] for r in least}
        cutoffs = np.array([known.get(i, _LOW) for i in ids.tolist()], np.int64)
        found = _searched(vectors(), spark.sparkContext.broadcast((ids, q, cutoffs)), k, nodes, False)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        ranked = checkpoint(ranked) if waves > 1 else ranked
        out = ranked if out is None else out.unionByName(ranked)
    return out
