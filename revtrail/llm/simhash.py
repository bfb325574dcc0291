"""SimHash fingerprints, linked exactly by vantage-point trees over Hamming distance.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word shingles.  Distinct
fingerprints are dealt out by the top of a vantage-point tree: a node compares distances to its vantage with
a radius ``mu``, the near side holds d <= mu.  By the triangle inequality two fingerprints within ``links``
bits can lie on different sides only if both are within ``links`` of the boundary, so the far side's boundary
band is sent to the near side as visitors, and visitors follow every branch that the bound leaves open.  Each
shard then grows its own tree, of which a node has a branch for every distance to its vantage: linked pairs
differ in that distance by at most ``links``, so a branch is visited from the next ones alone.  Leaves are
compared in blocks and give a spanning forest of the links found - never all pairs.  Connected components over
the forests give the groups.

Fingerprints without near ones lie at 32 +- 4 bits from any vantage, where a band of four bits holds a third of
them: a level of the top sends some 1.4 copies of a row.  So shards are large (``per_shard``) and few.

The top of the tree is fitted on a bounded sample of fingerprints (``sample``); that affects balance only,
as every fingerprint is dealt out and every pair within the bound meets in exactly one shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, blocks_for, checkpoint, free_name, give_back, tidy
from .components import components


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of k words (repeats included), of the whole sequence if there are fewer words, of
    nothing if there are none.  Words: what `[\\x20\\x09-\\x0D]` separates, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= k:
        return np.array([h(joined, seed)], np.uint64)
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits; zero for no hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text_col: str, shingle: int, keep: list[str], out: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint as a long (null text: no words, so zero)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=[*keep, out])

    chosen = df.select(F.col(f"`{text_col}`").alias(free_name(keep, "_text")), *[F.col(f"`{c}`") for c in keep])
    ddl = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out}` long"])
    return chosen.mapInArrow(tidy(run), ddl)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- vantage-point trees -------------------------------------------------------------------------------


def _distance(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int16)


def _split(x: np.ndarray, v: np.uint64, mu: int, home: np.ndarray, visit: np.ndarray, r: int):
    """(home, visitors) of the near and of the far side; home and visit are positions in x."""
    dh, dv = _distance(x[home], v), _distance(x[visit], v)
    near = (home[dh <= mu], np.concatenate([home[(dh > mu) & (dh <= mu + r)], visit[dv <= mu + r]]))
    far = (home[dh > mu], visit[dv > mu - r])
    return near, far


def _cost(home: float, visit: float) -> float:
    return home * (home / 2 + visit)


def _choose(x: np.ndarray, home: np.ndarray, visit: np.ndarray, r: int, rng: np.random.Generator):
    """The best of a few vantages by the comparisons left to do, or None if none saves a tenth."""
    h, v = (p if len(p) <= 2048 else rng.choice(p, 2048, replace=False) for p in (home, visit))
    fh, fv = len(home) / len(h), len(visit) / max(1, len(v))
    best, least = None, 0.9 * _cost(len(home), len(visit))
    for vantage in x[rng.choice(h, min(6, len(h)), replace=False)]:
        mu = int(np.median(_distance(x[h], vantage)))
        dh, dv = _distance(x[h], vantage), _distance(x[v], vantage)
        band = fh * np.count_nonzero((dh > mu) & (dh <= mu + r)) + fv * np.count_nonzero(dv <= mu + r)
        cost = _cost(fh * np.count_nonzero(dh <= mu), band) + _cost(fh * np.count_nonzero(dh > mu), fv * np.count_nonzero(dv > mu - r))
        if cost < least:
            best, least = (vantage, mu), cost
    return best


def fit_top(sample: np.ndarray, shards: int, r: int) -> tuple:
    """Nested (vantage, mu, near, far) tuples; leaves are shard numbers."""
    rng, count = np.random.default_rng(7), [0]

    def grow(home: np.ndarray, visit: np.ndarray, want: int):
        chosen = _choose(sample, home, visit, r, rng) if want > 1 and len(home) >= 8 else None
        if chosen is None:
            count[0] += 1
            return count[0] - 1
        near, far = _split(sample, *chosen, home, visit, r)
        return (*chosen, grow(*near, want // 2), grow(*far, want - want // 2))

    return grow(np.arange(len(sample)), np.arange(0), shards), count[0]


def deal(x: np.ndarray, tree, r: int):
    """Yields (shard, positions, is_home)."""

    def go(node, home, visit):
        if not len(home) and not len(visit):
            return
        if isinstance(node, int):
            yield node, home, True
            yield node, visit, False
            return
        near, far = _split(x, node[0], node[1], home, visit, r)
        yield from go(node[2], *near)
        yield from go(node[3], *far)

    yield from go(tree, np.arange(len(x)), np.arange(0))


def link(x: np.ndarray, n_home: int, r: int, leaf: int = 256) -> np.ndarray:
    """Positions of roots: a spanning forest of links at most r bits apart between the first n_home of the
    distinct x and all of x."""
    parent, rng = np.arange(len(x)), np.random.default_rng(11)

    def roots(at: np.ndarray) -> np.ndarray:
        now = parent[at]
        while True:
            up = parent[now]
            if (up == now).all():
                return now
            now = up

    def compare(home: np.ndarray, visit: np.ndarray) -> None:
        every = np.concatenate([home, visit])
        values = x[every]
        for at in range(0, len(home), 128):
            close = np.bitwise_count(values[at : at + 128, None] ^ values[None, at:]) <= r
            for i in np.flatnonzero(close[: len(home) - at].sum(axis=1) > 1):
                joined = np.unique(roots(every[at + np.flatnonzero(close[i])]))
                if len(joined) > 1:
                    parent[joined] = joined[0]

    def branches(home: np.ndarray, visit: np.ndarray):
        """(home, visitors) by distance to a vantage: a branch meets itself and, above it, the next r distances;
        visitors come from both sides."""
        vantage = x[rng.choice(home)]
        dh, dv = _distance(x[home], vantage), _distance(x[visit], vantage)
        home, visit = home[np.argsort(dh, kind="stable")], visit[np.argsort(dv, kind="stable")]
        dh, dv = np.sort(dh), np.sort(dv)
        for d in np.unique(dh):
            a, b, c = np.searchsorted(dh, [d, d + 1, d + r + 1])
            e, f = np.searchsorted(dv, [d - r, d + r + 1])
            yield home[a:b], np.concatenate([home[b:c], visit[e:f]])

    def grow(home: np.ndarray, visit: np.ndarray, depth: int) -> None:
        if len(home) <= leaf or depth >= 6:
            compare(home, visit)
            return
        for part in branches(home, visit):
            grow(*part, depth + 1)

    if n_home:
        grow(np.arange(n_home), np.arange(n_home, len(x)), 0)
    return roots(np.arange(len(x)))


def fingerprint_links(distinct: DataFrame, links: int = 4, *, per_shard: int = 131072, sample: int = 8192) -> DataFrame:
    """(a, b): spanning forests, one a shard, of the links between the distinct fingerprints (column fp)."""
    spark = distinct.sparkSession
    total = distinct.count()
    shards = 1 << (blocks_for(total, per_shard) - 1).bit_length()
    few = distinct.orderBy(F.xxhash64("fp")).limit(sample) if shards > 1 else distinct.limit(0)
    tree, count = fit_top(np.array([r[0] for r in few.collect()], np.int64).view(np.uint64), shards, links) if shards > 1 else (0, 1)
    shared = spark.sparkContext.broadcast(tree)

    def dealt(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for shard, at, home in deal(x, shared.value, links):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard), pa.int32()), pa.array(x[at].view(np.int64)), pa.array(np.full(len(at), home))], names=["shard", "fp", "home"])

    def linked(t: pa.Table) -> pa.Table:
        home = t.column("home").to_numpy()
        x = t.column("fp").to_numpy().view(np.uint64)
        x = np.concatenate([x[home], x[~home]])
        at = link(x, int(home.sum()), links)
        has = np.flatnonzero(at != np.arange(len(x)))
        return pa.table({"a": x[has].view(np.int64), "b": x[at[has]].view(np.int64)})

    spread = distinct.select("fp").mapInArrow(tidy(dealt), "shard int, fp long, home boolean").repartition(4 * count, "shard")
    return spread.groupBy("shard").applyInArrow(linked, "a long, b long")


def link_fingerprints(distinct: DataFrame, links: int = 4, *, per_shard: int = 131072, sample: int = 8192) -> DataFrame:
    """(node, component) of the distinct fingerprints (column fp) that have a link; component: smallest fp."""
    return components(fingerprint_links(distinct, links, per_shard=per_shard, sample=sample))


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, links: int = 4) -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits), component_id: smallest id in the group of
    rows whose fingerprints chain by at most ``links`` differing bits.

    Null, empty and wordless texts have fingerprint zero and link like any other.  A null id stays a row; it
    never names a component (component_id is null if all ids of the group are).  Repeated rows stay repeated.
    Other columns are ignored.  Empty input: no rows.
    """
    prints = checkpoint(with_fingerprints(docs, text_col, shingle, [id_col]).withColumnsRenamed({id_col: "id"}))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    groups = link_fingerprints(distinct, links)
    named = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = checkpoint(named)
    ids = checkpoint(least.groupBy("group").agg(F.min("least").alias("component_id")))  # a plain exchange of a hot group can be split
    by_print = least.join(ids, "group").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


# ---- near-duplicates by a similarity threshold ------------------------------------------------------------
#
# The fingerprints of all distinct texts go through the vantage-point trees above, with their boundary visitors:
# every pair within _LINKS bits is linked, whatever its texts share.
#
# Not every pair of a similarity of 0.8 is that close: it differs in some 10 of 64 bits, and in up to 32 or so of
# 128.  At that radius the boundary band is everything, as the distances of unrelated texts to any vantage spread by
# only 5.7 around 64 of 128.  Pairs beyond _LINKS bits are added by rare shingles: of the _SAMPLE smallest hashes of a
# text those that no other text has among its own come first, then the rarest; sets that are similar must share one
# of the first few.  A text of which more than that few are its own adds nothing, however many passages it shares.
#
# Links of both kinds chain texts into clusters, and within a cluster the fingerprints choose the pairs whose whole
# sets are compared: the similarity alone decides.

_SKETCH = 128
#: Bits in which fingerprints linked by the trees differ at most.
_LINKS = 4
#: Smallest hashes of a text that candidates are found by, and how many of them, by rarity, are looked up: of 24
#: two sets of similarity 0.8 share 19.2 +- 2, and fewer than 12 less than twice in ten thousand times.  Sets of no
#: more than _SAMPLE have all of theirs, and as many are looked up as similar sets cannot all miss.
_SAMPLE, _LOOKED_UP = 24, 13
#: A pair of at least the wanted similarity is estimated lower by this much once in some ten million times.
_MARGIN = 0.2
#: Shingles in a block whose whole sets are compared.
_BLOCK_SHINGLES = 1 << 22


def _profile(text: str, k: int, most: int | None = None) -> tuple[int, int, int, bytes]:
    """Distinct shingles, two 64-bit fingerprints of them, and the ``most`` smallest hashes (all if None)."""
    h = np.unique(shingle_hashes(text, k))
    if not len(h):
        return 0, 0, 0, b""
    other = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    other ^= other >> np.uint64(32)
    return len(h), *(int(np.uint64(fingerprint(x)).view(np.int64)) for x in (h, other)), h[:most].astype("<u8").tobytes()


def _similarities(sketch: np.ndarray, size: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Jaccard of i with each of others over the range of hashes that both sketches cover: exact where both hold
    whole sets, else an estimate.  Sketches are sorted rows, filled up with the largest number."""
    own = sketch[i, : size[i]]
    covered = np.where(size < _SKETCH, np.uint64(2**64 - 1), sketch[:, -1])
    out = np.empty(len(others))
    for at in range(0, len(others), 2048):
        part = others[at : at + 2048]
        limit = np.minimum(covered[i], covered[part])
        rows = sketch[part]
        within = (rows <= limit[:, None]) & (np.arange(_SKETCH) < size[part, None])
        place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        both = np.count_nonzero((own[place] == rows) & within, axis=1)
        out[at : at + 2048] = both / (np.searchsorted(own, limit, "right") + np.count_nonzero(within, axis=1) - both)
    return out


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return both / (len(a) + len(b) - both)


def link_similar(n: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs between positions left and right, of texts that have words.  ``sets``:
    sorted shingle hashes.  Pairs already connected are not weighed again, so a group of copies costs no more than
    its links.

    Pairs of sets of fewer than _SKETCH hashes are found by those that similar sets must share among their
    smallest.  Of the others those of fitting size within ``bits`` of fingerprint are estimated by their smallest
    hashes, and what is at most _MARGIN lower than wanted is decided on the whole sets.
    """
    if not len(left) or not len(right):
        return []
    size = np.minimum([len(x) for x in sets], _SKETCH)
    rows = np.full((len(sets), _SKETCH), 2**64 - 1, np.uint64)
    for x, own in zip(rows, sets, strict=True):
        x[: min(len(own), _SKETCH)] = own[:_SKETCH]
    whole = n < _SKETCH
    parent = np.arange(len(n))
    out: list[tuple[int, int]] = []

    def roots(at: np.ndarray) -> np.ndarray:
        now = parent[at]
        while (parent[now] != now).any():
            now = parent[now]
        parent[at] = now
        return now

    def similar(i: int, others: np.ndarray) -> np.ndarray:
        found = _similarities(rows, size, i, others)
        exact = whole[i] & whole[others]
        found = np.where(exact, found >= similarity, found >= similarity - _MARGIN)
        for p in np.flatnonzero(found & ~exact):
            found[p] = _jaccard(sets[i], sets[others[p]]) >= similarity
        return found

    def join(i: int, near: np.ndarray) -> None:
        root = roots(near)
        fits = (root != roots(np.array([i]))[0]) & (np.minimum(n[i], n[near]) >= similarity * np.maximum(n[i], n[near]))
        near, root = near[fits], root[fits]
        while len(near):  # the first of every group not yet joined, then the next of those that differ
            _, first = np.unique(root, return_index=True)
            alike = similar(i, near[first])
            for j in near[first[alike]]:
                parent[roots(np.array([j]))[0]] = roots(np.array([i]))[0]
                out.append((int(i), int(j)))
            rest = ~np.isin(root, root[first[alike]])
            rest[first] = False
            if alike.any() or rest.sum() <= 64:
                near, root = near[rest], root[rest]
                continue
            near, root = near[rest], root[rest]
            alike = similar(i, near)  # all that are left, in one go
            near, root = near[alike], root[alike]

    few = right[whole[right]]
    first_hashes = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    among = np.arange(_SKETCH) < first_hashes[few, None]
    hashes, owners = rows[few][among], np.repeat(few, first_hashes[few])
    ascending = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[ascending], owners[ascending]
    for i in left[whole[left]]:
        wanted = rows[i, : first_hashes[i]]
        lo, hi = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        if (hi - lo).sum() > len(few):
            near = few[roots(few) != roots(np.array([i]))[0]]
            if len(near) <= 2048:
                join(i, near)
                continue
        near = np.concatenate([few[:0], *[owners[x:y] for x, y in zip(lo, hi, strict=True) if y > x]])
        near = np.unique(near[roots(near) != roots(np.array([i]))[0]])
        if len(near):
            join(i, near)

    order = right[np.argsort(n[right], kind="stable")]
    sizes, values = n[order], fp[order]
    left = left[np.argsort(n[left], kind="stable")]
    for at in range(0, len(left), 128):
        block = left[at : at + 128]
        if whole[block].all() and whole[order].all():
            continue
        lo, hi = np.searchsorted(sizes, int(n[block[0]] * similarity), "left"), np.searchsorted(sizes, int(n[block[-1]] / similarity) + 1, "right")
        apart = np.bitwise_count(fp[block, None, 0] ^ values[None, lo:hi, 0]) + np.bitwise_count(fp[block, None, 1] ^ values[None, lo:hi, 1])
        for i, found in zip(block, apart <= bits, strict=True):
            near = order[lo + np.flatnonzero(found)]
            near = near[(near != i) & ~(whole[i] & whole[near])]
            if len(near):
                join(i, near)
    return out


def _near_prints(texts: DataFrame) -> DataFrame:
    """(a, b): edges that connect texts with words whose fingerprints chain by at most _LINKS bits.  texts: key, n, fp."""
    worded = texts.where("n > 0").select("key", "fp")
    first = checkpoint(worded.groupBy("fp").agg(F.min("key").alias("first")))
    equal = worded.join(first, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    linked = fingerprint_links(first, _LINKS)
    for end in ("a", "b"):
        name = first.select(F.col("fp").alias("_fp"), F.col("first").alias(f"_{end}"))
        linked = linked.join(name, F.col(end) == F.col("_fp")).drop("_fp")
    return equal.unionByName(linked.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _clusters(texts: DataFrame, similarity: float) -> DataFrame:
    """(key, cluster) of texts that have a near fingerprint or share a looked-up hash with others.  texts: key, n, fp,
    low (smallest hashes)."""
    each = texts.select("key", "n", F.explode("low").alias("h"))
    counts = checkpoint(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    shared = counts.count()
    known = (F.broadcast(counts) if shared * 16 <= _SENT else counts).withColumnRenamed("h", "_h")
    common = each.join(known, F.col("h") == F.col("_h")).groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("common"))
    sample = F.least("n", F.lit(_SAMPLE))
    looked_up = F.when(F.col("n") > _SAMPLE, _LOOKED_UP).otherwise(F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)
    left = (looked_up - (sample - F.size("common"))).cast("int")  # hashes that no other text has come first
    rows = checkpoint(common.where(left > 0).select("key", F.explode(F.slice("common", 1, left)).alias("x")).select("key", F.col("x.h").alias("h")))
    first = checkpoint(rows.groupBy("h").agg(F.min("key").alias("first")).withColumnRenamed("h", "_h"))
    edges = rows.join(first, F.col("h") == F.col("_h")).select(F.col("key").alias("a"), F.col("first").alias("b"))
    return components(_near_prints(texts).unionByName(edges)).select(F.col("node").alias("key"), F.col("component").alias("cluster"))


#: Bytes of narrow rows up to which they are sent to all executors, so that texts need not move.
_SENT = 32 << 20


def _places(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """(key, places array<struct<cluster, band, i, j, home, at>>): the groups in which a text is compared.  members:
    key, n, cluster.  A cluster is one group; one too large for a task is cut into bands of sizes - similar sets
    are at most one apart - and pairs of blocks."""
    sizes = members.groupBy(F.col("cluster").alias("_c")).agg((F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / _BLOCK_SHINGLES)) > 1).alias("large"))
    placed = members.join(checkpoint(sizes), F.col("cluster") == F.col("_c"))
    band = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(similarity)) + 1e-9)).otherwise(0).cast("int")
    own, below = F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band - 1).alias("band"), F.lit(False).alias("home"))
    placed = checkpoint(placed.select("key", "n", "cluster", F.explode(F.when(F.col("large"), F.array(own, below)).otherwise(F.array(own))).alias("in")).select("key", "n", "cluster", "in.*"))
    blocks = placed.groupBy(F.col("cluster").alias("_c"), F.col("band").alias("_b")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / _BLOCK_SHINGLES)).cast("int").alias("blocks"))
    known = placed.join(checkpoint(blocks), (F.col("cluster") == F.col("_c")) & (F.col("band") == F.col("_b"))).withColumn("at", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = known.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    place = F.struct("cluster", "band", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "home", "at")
    return checkpoint(pairs.groupBy("key").agg(F.collect_list(place).alias("places")))


_PLACED = "cluster string, band int, i int, j int, home boolean, at int, key string, n long, f1 long, f2 long, hashes binary"


def _with_sets(shingle: int):
    """Rows of a text in each of its places, with its whole set; a text that a task meets again is left out."""

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            rows = []
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key not in seen:
                    seen.add(key)
                    profile = _profile(text or "", shingle)
                    rows += [(*(p[c] for c in ("cluster", "band", "i", "j", "home", "at")), key, *profile) for p in places]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cluster", "band", "i", "j", "home", "at", "key", "n", "f1", "f2", "hashes"])

    return run


def _linked(similarity: float, bits: int):
    def run(t: pa.Table) -> pa.Table:
        _, first = np.unique(t.column("key").to_numpy(zero_copy_only=False), return_index=True)  # once, whatever the tasks sent
        t = t.take(pa.array(first))
        keys = t.column("key").to_pylist()
        home, at, n = (t.column(c).to_numpy() for c in ("home", "at", "n"))
        fp = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("f1", "f2")], axis=1)
        sets = [np.frombuffer(raw, "<u8") for raw in t.column("hashes").to_pylist()]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        edges = []
        for x, y in ((i, j), (j, i))[: 1 + (i != j)]:
            edges += link_similar(n, fp, sets, np.flatnonzero(home & (at == x)), np.flatnonzero(at == y), similarity, bits)
        out = pa.table({"a": pa.array([keys[x] for x, _ in edges], pa.string()), "b": pa.array([keys[y] for _, y in edges], pa.string())})
        if t.nbytes > 1 << 24:
            give_back()
        return out

    return run


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int = 40, block: int = 16384) -> DataFrame:
    """(text_key, keeper): per distinct text (MD5; null reads as empty) the smallest id of its group, where
    texts chain by a Jaccard similarity of their word shingles of at least ``similarity``.

    Every link is decided on whole sets of shingle hashes.  Pairs within _LINKS bits of fingerprint all get there,
    by vantage-point trees.  What is not exact is which of the others do: see _LOOKED_UP, and by the binomial a pair of 0.8 differs in more than ``bits`` of 128 fingerprint bits less than
    once in a hundred thousand times.  Wordless texts are one group.  Ids that are null never keep.  Empty input:
    no rows.
    """
    key = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))

    def profiled(batches):
        seen: set[str] = set()
        for batch in batches:
            rows = []
            for ident, text_key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                known = (None, None, None)
                if text_key not in seen:
                    seen.add(text_key)
                    low = np.unique(shingle_hashes(text, shingle))
                    known = (len(low), int(np.uint64(fingerprint(low)).view(np.int64)), low[:_SAMPLE].view(np.int64).tolist())
                rows.append((ident, text_key, *known))
            kinds = (batch.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "key", "n", "fp", "low"])

    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    each = keyed.mapInArrow(tidy(profiled), f"id {docs.schema[id_col].dataType.simpleString()}, key string, n long, fp long, low array<long>")
    texts = checkpoint(each.groupBy("key").agg(F.min("id").alias("least"), F.max(F.struct("n", "fp", "low")).alias("p")).select("key", "least", "p.*"))
    clusters = checkpoint(_clusters(texts, similarity))
    members = checkpoint(clusters.withColumnRenamed("key", "_k").join(texts.select("key", "n"), F.col("_k") == F.col("key")).select("key", "n", "cluster"))
    places = _places(members, similarity, block)
    wanted, times = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    asked = (F.broadcast(places) if wanted * 64 + times * 80 <= _SENT else places).withColumnRenamed("key", "_k")
    sets = keyed.select("key", "text").join(asked, F.col("key") == F.col("_k")).select("key", "text", "places").mapInArrow(tidy(_with_sets(shingle), 256), _PLACED)
    edges = sets.groupBy("cluster", "band", "i", "j").applyInArrow(_linked(similarity, bits), "a string, b string")
    wordless = texts.where("n = 0")
    least = wordless.agg(F.min("key")).first()[0]
    groups = components(edges.unionByName(wordless.select(F.col("key").alias("a"), F.lit(least).cast("string").alias("b"))))
    named = checkpoint(texts.select("key", "least").join(groups, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("component", "key").alias("group")))
    keepers = checkpoint(named.groupBy(F.col("group").alias("_g")).agg(F.min("least").alias("keeper")))  # a plain exchange of a hot group can be split
    return named.join(keepers, F.col("group") == F.col("_g")).select(F.col("key").alias("text_key"), "keeper")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id.  Of repeated rows with that id and
    text any one stays; rows whose group has no id all stay.  Null and wordless texts are one group.  Other columns
    are kept as they are.  Empty input: no rows."""
    groups = near_duplicate_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    key = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    keepers = groups.where(F.col("keeper").isNotNull()).select(F.col("keeper").alias("_keeper"), F.col("text_key").alias("_keeper_key"))
    anonymous = groups.where(F.col("keeper").isNull()).select(F.col("text_key").alias("_keeper_key"))
    marked = docs.withColumn("_key", key)
    kept = marked.join(keepers, (F.col("_key") == F.col("_keeper_key")) & (F.col(f"`{id_col}`") == F.col("_keeper"))).dropDuplicates([id_col, "_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(marked.where(F.col(f"`{id_col}`").isNull()).join(anonymous, F.col("_key") == F.col("_keeper_key"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]))
