"""Corpus operators against brute force on cases where a bound or an estimate would decide."""

import hashlib
import random

from revtrail.llm import simhash


def varied(rng, words, n):
    """``words`` with n scattered ones replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"n{rng.randrange(10**9)}"
    return out


def test_near_duplicates_are_decided_on_whole_sets(spark):
    rng = random.Random(3)
    texts = []
    for size, changes in ((600, range(8, 17)), (250, range(3, 8)), (7, [0] * 40)):
        for _ in range(12):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            texts += [" ".join(base)] + [" ".join(varied(rng, base, c)) if c else " ".join(base + ["more"] * (k == 0)) for k, c in enumerate(changes)]
    texts += [" ".join(f"s{g}{x}" for x in range(k)) for g in range(300) for k in (8, 9)]
    texts = sorted(set(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), block=200)
    keeper = {r["text_key"]: r["keeper"] for r in got.collect()}
    assert [keeper[hashlib.md5(t.encode()).hexdigest()] for t in texts] == [find(i) for i in range(len(texts))]


def test_near_duplicates_by_fingerprints_alone(spark):
    """Copies of a long text that lack most of its smallest shingle hashes: of those a search by samples sees too few."""
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
        hashes = simhash.shingle_hashes(" ".join(words), 5)
        edited = list(words)
        for at in hashes.argsort()[:16]:
            edited[at + 2] = f"n{rng.randrange(10**9)}"
        pair = [" ".join(words), " ".join(edited)]
        a, b = (simhash.shingle_hashes(t, 5) for t in pair)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4:
            assert len(set(a.tolist()) & set(b.tolist())) >= 0.95 * len(set(a.tolist()) | set(b.tolist()))
            texts += pair
    assert len(texts) >= 4
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, len(texts), 2))
