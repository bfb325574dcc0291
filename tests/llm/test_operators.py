"""Each operator against brute force on small fixtures, and on awkward rows: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revtrail.llm import components, decontam, html_extract, langid, license_scan, packing, quality, simhash, suffix_dedup, topk, url_filter

WORDS = [f"w{i}" for i in range(300)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    passage = prose(1, 130)
    rows = [prose(s, 200) for s in range(12)]
    rows += [rows[0], rows[0], f"{rows[1]} extra tail", f"start {rows[1]}", f"{prose(50, 80)} {passage} {prose(51, 90)}", f"{prose(52, 80)} {passage} {prose(53, 90)}", f"x{passage}", "ab " * 400, prose(3, 6000), "é" * 500, "short", "", None, None]
    return list(enumerate(rows)) + [(None, rows[2])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With a column for each name an operator uses for itself."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, score int, key string").withColumns({c: F.lit(7) for c in ("n", "piece", "start", "band", "a", "b", "id", "fp", "_text", "_key", "stretches", "n_words", "anchor")}).repartition(3)


def empty(docs):
    return docs.limit(0)


# ---- suffix arrays ---------------------------------------------------------------------------------------


def removed_by_force(texts, window):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(x[p : p + window] for x in raw for p in range(len(x) - window + 1))
    out = Counter()
    for (i, _), x in zip(texts, raw, strict=True):
        mask = np.zeros(len(x), bool)
        for p in range(len(x) - window + 1):
            if seen[x[p : p + window]] > 1:
                mask[p : p + window] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~mask])
        out[(i, len(x), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("limit, sent", [(1, 32 << 20), (20_000, 32 << 20), (20_000, -1)])
def test_suffix_dedup(docs, texts, limit, sent, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SENT", sent)  # nothing is broadcast below zero
    got = suffix_dedup.remove_repeats(docs, keep=["doc_id"], window=400, group_limit=limit).collect()
    assert Counter(map(tuple, got)) == removed_by_force(texts, 400)
    assert suffix_dedup.remove_repeats(empty(docs), keep=["doc_id"]).count() == 0


def test_index_family_levels_merge_geometrically():
    family = suffix_dedup.IndexFamily(40, suffix_dedup.Hasher(40))
    base = bytes(range(65, 65 + 20))
    for i in range(64):
        content = bytes([i, i]) + base + bytes(random.Random(i // 2).choices(range(97, 122), k=20))
        family.add([(5, i, 2, 2, content)])
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 64 and len(sizes) <= 7 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert all(family.marked(i) == [(2, 2)] for i in range(64))  # pairs share 20 + 20 bytes from offset 2


def test_runs_cover_every_window():
    long = random.Random(4).randbytes(3000) + b"ab" * 900
    raws = [long, b"x" * 399, b"", b"y" * 400, long[5:], random.Random(5).randbytes((1 << 18) + 5000), long]
    seen: dict[int, list[int]] = {i: [] for i in range(len(raws))}
    hashes: dict[int, list] = {i: [] for i in range(len(raws))}
    for text, first, back, span, anchor, whole in suffix_dedup.runs(raws, 400, suffix_dedup.Hasher(1 << 19)):
        for i, f, n, *h in zip(text, first, span, back, anchor, whole, strict=True):
            seen[i] += range(f, f + n + 1)
            hashes[i].append(tuple(h))
    assert all(sorted(w) == list(range(max(0, len(raws[i]) - 399))) for i, w in seen.items())
    assert hashes[0] == hashes[6]  # wherever a text lies in a buffer


def test_run_family_counts_and_levels():
    rng = np.random.default_rng(8)
    anchor, whole = rng.integers(0, 60, 3000), rng.integers(0, 9, 3000)
    family = suffix_dedup.RunFamily()
    for at in range(0, 3000, 100):
        s = slice(at, at + 100)
        family.add(anchor[s], whole[s], np.arange(3000)[s], np.arange(3000)[s] * 7)
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    rows, repeated = family.drain()
    seen = Counter(zip(anchor.tolist(), whole.tolist(), strict=True))
    assert [tuple(r) for r in rows[:, :2]] == sorted(seen) and all(seen[a, w] == n for a, w, n, *_ in rows.tolist())
    want = [(i, 7 * i) for i, k in enumerate(zip(anchor.tolist(), whole.tolist(), strict=True)) if seen[k] > 1]
    assert sorted(map(tuple, repeated.tolist())) == want and len(family) == 0


# ---- simhash ---------------------------------------------------------------------------------------------


def print_by_force(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups_by_force(items, links):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if links(items[i], items[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_simhash_groups(docs, texts):
    prints = [print_by_force(t) for _, t in texts]
    roots = groups_by_force(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {r: min((i for (i, _), x in zip(texts, roots, strict=True) if x == r and i is not None), default=None) for r in roots}
    want = Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(texts, prints, roots, strict=True))
    assert Counter(map(tuple, simhash.simhash_groups(docs).collect())) == want
    assert simhash.simhash_groups(empty(docs)).count() == 0


@pytest.mark.parametrize("shards", [1, 8])
def test_trees_find_every_link(shards):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in centers for _ in range(30)]
    x = np.unique(np.concatenate([np.array(near, np.uint64), rng.integers(0, 1 << 63, 1500, dtype=np.uint64)]))
    want = groups_by_force(x.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    tree, count = simhash.fit_top(x[::7], shards, 4) if shards > 1 else (0, 1)
    parts = {s: ([], []) for s in range(count)}
    for shard, at, home in simhash.deal(x, tree, 4):
        parts[shard][0 if home else 1].append(at)
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for homes, visits in parts.values():
        h, v = (np.concatenate(p) if p else np.empty(0, int) for p in (homes, visits))
        at = np.concatenate([h, v]).astype(int)
        for i, r in enumerate(simhash.link(x[at], len(h), 4, leaf=16)):
            parent[find(at[i])] = find(at[r])
    same = lambda roots: {frozenset(np.flatnonzero(np.array(roots) == r).tolist()) for r in set(roots)}
    assert same([find(i) for i in range(len(x))]) == same(want)


@pytest.mark.parametrize("sent", [32 << 20, -1])
def test_near_duplicates(spark, sent, monkeypatch):
    monkeypatch.setattr(simhash, "_SENT", sent)
    rng = random.Random(5)
    base = [prose(s, 220) for s in range(6)]

    def edited(text, n):
        w = text.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = f"new{rng.random()}"
        return " ".join(w)

    rows = [(10 * i + k, t) for i, b in enumerate(base) for k, t in enumerate([b, b, edited(b, 1), edited(b, 3)])] + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (None, base[0]), (None, "lonely one here")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keeper int").repartition(4)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [(False, 0), (False, 10), (False, 20), (False, 30), (False, 40), (False, 50), (False, 900), (False, 903), (True, 0)]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("z", "z"), ("q", None), ("a", "b")] + [("hub", f"n{i}") for i in range(50)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["n7"] == "hub" and got["c040"] == "c000" and "z" not in got and len(got) == 3 + 2 + 51 + 41
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---- decontamination -------------------------------------------------------------------------------------


def test_decontamination(spark, docs):
    item = prose(900, 20)
    marked = item.upper().replace(" ", "-- ").replace("W", "W")
    rows = [(7, "far " * 400_000 + marked + " end" * 400_000), (1, f"lead {marked} tail"), (2, f"{' '.join(item.split()[3:11])} and {prose(901, 3)}!"), (3, "nothing"), (4, None), (5, ""), (6, "a b"), (1, f"lead {marked} tail")]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, n_hit int, _items int")
    bench = spark.createDataFrame([(7, item), (10, prose(901, 3)), (10, prose(901, 3)), (11, None), (12, "?!"), (None, "nothing")], "item_id long, text string")
    for size in (16 << 20, 60):
        got = decontam.find_contamination(frame, bench, spans=True, max_pattern_bytes=size).collect()
        by = {r["doc_id"]: r for r in got}
        assert len(got) == 8 and (by[7]["n_words"], by[7]["n_hit"], by[7]["n_items"]) == (800_020, 20, 1) and by[7]["text"][slice(*by[7]["hit_spans"][0])] == marked
        assert [(by[i]["n_hit"], by[i]["n_items"], by[i]["contaminated"]) for i in (1, 2, 3, 4, 5)] == [(20, 1, False), (11, 2, True), (0, 0, False), (0, 0, False), (0, 0, False)]
        assert by[2]["items_sha256"] == hashlib.sha256(b"10,7").hexdigest() and by[4]["n_words"] == 0 and by[6]["n_words"] == 1
        start, end = by[1]["hit_spans"][0]
        assert by[1]["text"][start:end] == marked
    assert decontam.find_contamination(frame, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.find_contamination(empty(docs), bench).count() == 0


# ---- packing ---------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, group=9, with_ids=True).collect()
    whole = Tokenizer.from_file(path)
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in texts)
    rows: Counter = Counter()
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"]) <= 2048
    cut = [r for r in got if r["piece"] > 0]
    assert cut and all(r["start"] == 2048 * r["piece"] for r in got)
    long = {r["doc_id"] for r in cut}  # one row each: put together again they are the whole document
    assert all(sum(r["doc_id"] == i and r["piece"] == 0 for r in got) == 1 for i in long)
    for i in long:
        rows[(i, tuple(x for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"]) for x in r["ids"]))] += 1
    rows.update((r["doc_id"], tuple(r["ids"])) for r in got if r["doc_id"] not in long)
    assert rows == want
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(empty(docs), path).count() == 0


def test_local_search_saves_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4, 4, 3, 3])  # best fit decreasing needs five bins of ten
    bins = packing.pack(lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(9)) and max(lengths[b].sum() for b in bins) <= 10 and len(bins) == packing.least_bins(lengths, 10) == 4
    assert packing.pack(np.array([], int), 10) == []


def test_local_search_saves_bins_of_sequences():
    """At the production length, where best fit is far from the bound."""
    rng = np.random.default_rng(0)
    for lengths, most in ((np.tile(np.array([6, 6, 5, 5, 4, 4, 4, 3, 3]) * 204, 100), 0.97), (683 + rng.integers(-40, 40, 2000), 0.95), (rng.integers(512, 1024, 2000), 0.97)):
        bins, fit = packing.pack(lengths, 2048), packing.best_fit(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(lengths[b].sum() for b in bins) <= 2048
        assert packing.least_bins(lengths, 2048) <= len(bins) <= most * len(fit)


def test_odd_texts_encode_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = ["Don't we'LL 'S !'s ''s", "a<|endoftext|>b", "ÀÉ²³¼ ½x ÿ×÷ß", "café e", "Σας İ", "\x1ca\x1db c\x85d\xa0e", "日本", "x" * 3000, "­soft", "1234 a1b2 _u_", "", " \t\n", "🙂 ok", "\x00 a"]
    assert packing.WordEncoder(path).encode(odd) == [np.array(whole.encode(o, add_special_tokens=False).ids, "<u4").tobytes() for o in odd]


# ---- top-k -----------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist(), 1, 2) for i in range(300)]
    rows += [(300, rows[0][1], 1, 2), (301, None, 1, 2), (350, [1.0, None], 1, 2), (352, [float("nan")] * 12, 1, 2), (353, [float("inf")] * 12, 1, 2), (None, rows[1][1], 1, 2), (354, [], 1, 2), (355, [1.0], 1, 2), (7, rows[7][1], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, rank int")
    many = [sorted(tuple(r) for r in topk.exact_top_k(df, wave=w, lead_share=s, nodes=n).collect()) for w, s, n in ((3, 2, 4), (4096, 1000, 1), (4096, 1, 12))]
    vec = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in vec if i % 50 == 0}.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vec if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert many == [sorted(want)] * 3
    assert topk.exact_top_k(df.limit(0)).count() == 0 and topk.exact_top_k(df.where("vec_id in (0, 1)")).count() == 1
    exact = [(i, [2**30 + i, -(2**29), 3 * i]) for i in range(200)]  # products that doubles do not hold
    big = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in exact], "vec_id long, embedding array<double>")
    want = [(q, k + 1, i, -s) for q in (0, 100) for k, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(exact[q][1], v)), i) for i, v in exact if i != q)[:5])]
    assert sorted(tuple(r) for r in topk.exact_top_k(big, scale=1, query_modulus=100).collect()) == sorted(want)


def test_cutoffs_save_products():
    """Against scoring all of them: the same answer for less than all components, of ids in any order."""
    rng = np.random.default_rng(2)
    c = np.floor(256 * rng.normal(size=(20_000, 64)) * rng.exponential(size=(20_000, 1)))
    ids, at = rng.permutation(20_000), np.arange(0, 20_000, 400)
    lead = topk.Search(ids[at], c[at], 5, 4)
    lead.list_nodes(ids[::64], c[::64])
    search = topk.Search(ids[at], c[at], 5, 4, lead.cutoff)
    for a in range(0, 20_000, 1024):
        search.scan(ids[a : a + 1024], c[a : a + 1024])
    score = (c[at] @ c.T).astype(np.int64)
    for i, q in enumerate(ids[at]):
        want = [(int(s), int(x)) for s, x in sorted(zip(score[i].tolist(), ids.tolist(), strict=True), key=lambda p: (-p[0], p[1])) if x != q][:5]
        assert list(zip(search.score[i].tolist(), search.found[i].tolist(), strict=True)) == want
    assert search.products < 0.5 * c.size * len(at)


# ---- models ----------------------------------------------------------------------------------------------


def test_quality_model(spark):
    rng = random.Random(2)
    good = [(i, prose(i, rng.randint(30, 120)).capitalize() + ".", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 40).split()), 0) for i in range(100)]
    rows = good + bad + [(5000, None, None), (5001, "", None), (None, "text", 1)]
    df = spark.createDataFrame([(i, t, 5, 5) for i, t, _ in rows], "doc_id long, text string, x int, predicted int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(df, model, keep=["doc_id"]).collect()}
    held = [i for i, *_ in good + bad if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and all(got[i]["predicted"] == (i < 1000) for i in held)
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.train(df, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.score_quality(df.limit(0), model, keep=["doc_id"]).count() == 0
    x = np.array([[i % 2, i // 2 % 2, *[0.0] * 20] for i in range(400)], float)
    y = (x[:, 0] != x[:, 1]).astype(float)  # only a pair's table can tell these apart
    assert ((quality.fit(x, y).score(x) > 0.5) == y).all()


def test_language(spark):
    alphabet = {"aa": "abcde", "bb": "vwxyz"}
    word = lambda r, s: "".join(r.choice(s) for _ in range(r.randint(2, 6)))
    rows = [(i, " ".join(word(random.Random(i * 99 + k), alphabet[lang]) for k in range(30)), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    rows += [(104, "½ ²", "aa"), (105, "Ⅷ ①_", "aa"), (106, "٣ \u0301", "bb"), (107, "ª", None)]
    rows += [(100, None, "aa"), (101, "123 !", "aa"), (102, "abc abc", None), (None, "xyz vw", "bb"), (103, "日本 " * 50, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:80]) and got[0]["held_out"] == (zlib.crc32(b"0") % 3 == 1)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 104, 105, 106)) and got[107]["lang_pred"] in alphabet
    assert got[102]["lang_pred"] == "aa" and got[None]["held_out"] is False
    assert langid.language_id(df.limit(0)).count() == 0
    encoder = langid.Encoder(64, chars=16, docs=3)
    parts, whole = encoder.encode([r[1] for r in rows])[0], langid.Encoder(64).encode([r[1] for r in rows])[0]
    assert np.allclose(parts, whole)  # long texts in segments give the same bundle


def test_language_against_plain_loops(spark):
    """Trigram vectors bound letter by letter, bundled and compared one at a time."""
    rows = [(i, f"{prose(i, 20)} {'äé日ß'[i % 4] * 3}, {i}½", ["x", "y", "z"][i % 3]) for i in range(30)]
    rows += [(30, None, "x"), (31, "12 ½", "y"), (32, rows[0][1], "y"), (33, "ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    encoder = langid.Encoder(128)

    def bundle(text):
        out = np.zeros(128)
        words = "".join(c if unicodedata.category(c).startswith("L") else " " for c in (text or "").lower()).split()
        padded = f" {' '.join(words)} " if words else ""
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            out += np.roll(encoder.letter(ord(a)), 2) * np.roll(encoder.letter(ord(b)), 1) * encoder.letter(ord(c))
        return out

    unit = lambda v: v / (np.linalg.norm(v) or 1)
    want = {lang: unit(sum(unit(bundle(t)) for _, t, x in rows if x == lang)) for lang in "xyz"}
    got = langid.fit_prototypes(df.where("lang is not null"), "text", "lang", 128)
    assert sorted(got) == sorted(want) and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, got, keep=["doc_id"], dimensions=128).collect()}
    for i, text, _ in rows:
        cosine = {k: float(unit(bundle(text)) @ want[k]) for k in sorted(want)}
        best = max(cosine, key=cosine.get) if any(unicodedata.category(c).startswith("L") for c in text or "") else "und"
        assert found[i][0] == best and abs(found[i][1] - min(1, max(0, cosine.get(best, 0)))) < 1e-4


def test_language_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["b", "a", "c", "b", "a", "c", "a", "b", "c"])], "doc_id long, text string, lang string")
    prototypes = langid.fit_prototypes(df, "text", "lang", 64)
    assert {r["lang_pred"] for r in langid.identify(df, prototypes, keep=["doc_id"], dimensions=64).collect()} == {"a"}


def test_quality_against_plain_sums(spark):
    """A score is the logistic function of one entry of each table, looked up a text at a time."""
    rng = np.random.default_rng(4)
    x = np.array([quality.features(prose(i, 5 + i % 40) + "!" * (i % 7)) for i in range(300)])
    model = quality.fit(x, (rng.random(300) < 0.3 + 0.4 * (x[:, 0] > np.median(x[:, 0]))).astype(float), rounds=20, pair_rounds=8)
    texts = [prose(900 + i, 30) + "?" * i for i in range(12)] + [None, "", " \n", "word " * 50_000]
    got = [r["score"] for r in quality.score_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model, keep=["doc_id"]).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        f = quality.features(text)
        at = [sum(e <= v for e in edges) for v, edges in zip(f, model.edges, strict=True)]
        total = model.constant + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12
    assert model.pairs and len(model.tables) == len(quality.FEATURES)


# ---- pages -----------------------------------------------------------------------------------------------


def test_url_filter(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "bad.net/")]
    rows = [(1, "https://a.example.org/es/1", '<link rel="canonical" href="https://b.net/x">'), (2, "http://B.net/x#f", None), (3, "https://b.net/x", ""), (4, "https://c.net/", '<meta http-equiv="refresh" content="0; url=/y">'), (5, "https://c.net/y", "<link rel=canonical href=//bad.net/>"), (6, "https://c.net/y", "<link rel=canonical href='https://ok.org/'>"), (7, None, "x"), (8, "nourl", "x"), (9, "https://d.net", '<!-- <link rel="canonical" href="https://bad.net/"> -->'), (10, "https://notorg/", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key int, component string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow")}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, []).collect()} == {"allow"}
    more = spark.createDataFrame([("https://d.net", "https://bad.net/z")], "source string, target string")
    assert url_filter.judge_urls(df, rules, redirects=more).where("page_id = 9").first()["verdict"] == "block"


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, host int, template string")
    return [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()]


def test_html(spark):
    article = "<html><body><nav>Menu</nav><article><h1>Head &amp; more</h1><p>One  two<p>Three <i>four</i><div class='ad'>Buy</div></article><div id=comments>Nice</div><footer>F</footer>"
    plain = "<body><div class=top><p>Same on all</p></div><div class=story><p>Story {0} goes on for a while here</p></div><ul><li><a href=x>Link {0}</a></ul></body>"
    rows = [(1, "http://h/1", article), (2, "http://h/2", None), (3, None, ""), (1, "http://h/1", article), (4, "http://h/4", "<p>" + "long " * 200_000)] + [(10 + i, f"http://p/{i}", plain.format(i)) for i in range(5)]
    main = "Head & more\nOne two\nThree four"
    assert Counter(extracted(spark, rows)) == Counter([(1, main, len(main))] * 2 + [(2, "", 0), (3, "", 0), (4, ("long " * 200_000).strip(), 999_999)] + [(10 + i, f"Story {i} goes on for a while here", 32) for i in range(5)])
    assert extracted(spark, rows[1:3]) == [(2, "", 0), (3, "", 0)] and extracted(spark, []) == []


def test_names_must_fit_as_a_whole():
    page = "<article><p>Lead</p><div class='share-price'><p>The share price rose.</p></div><section class='comment-on-law'>On law</section><div class='share-buttons'>Share</div><div class='related-posts wide'>Other</div><div id=cookie_notice>Cookies</div><p class=social-contract>Rousseau</p></article>"
    assert html_extract.main_text(page) == "Lead\nThe share price rose.\nOn law\nRousseau"
    linked = "<body><ul><li><a href=a>Elsewhere</a></li></ul><p><a href=b>All of this paragraph is a link</a></p></body>"
    assert html_extract.main_text(linked) == "All of this paragraph is a link"


def site(i, wording="Read more on our site today", lead="p"):
    return f"<body><div class=bar><p>Short {i}</p></div><div class=wrap><div class=text><h2>Title {i}</h2><{lead}>Page number {i} tells a story that no other page of the site tells.</{lead}><p>{wording}</p></div></div><div class=end><p>Words {i} at the end</p></div></body>"


@pytest.mark.parametrize("sent", [32 << 20, -1])
def test_template_decides_regions_and_wording(spark, sent, monkeypatch):
    monkeypatch.setattr(html_extract, "_SENT", sent)
    rows = [(i, f"http://a.test/{i}", site(i)) for i in range(6)]
    text = "Title {0}\nPage number {0} tells a story that no other page of the site tells."
    got = {i: t for i, t, _ in extracted(spark, rows)}
    assert got == {i: text.format(i) for i in range(6)}
    assert html_extract.main_text(rows[0][2]) == "Short 0\n" + text.format(0) + "\nRead more on our site today\nWords 0 at the end"  # without a template
    articles = [(i, u, h.replace("div class=text", "article").replace("</div></div>", "</article></div>", 1)) for i, u, h in rows]
    assert {i: t for i, t, _ in extracted(spark, articles)} == got
    assert html_extract.main_text(articles[0][2]) == text.format(0) + "\nRead more on our site today"
    few = extracted(spark, articles[:3])
    assert sorted(t for _, t, _ in few) == [text.format(i) + "\nRead more on our site today" for i in range(3)]


def test_copies_are_no_template(spark):
    """Equal pages count once; a page that is all wording stays; half the host's pages must share a wording."""
    same = [(i, f"http://b.test/{i}", site(0)) for i in range(9)]
    assert {t for _, t, _ in extracted(spark, same)} == {html_extract.main_text(site(0))}
    mixed = same + [(100 + i, f"http://b.test/x{i}", site(i, wording=f"Own {i}" if i < 5 else "Shared")) for i in range(1, 9)]
    got = {i: t for i, t, _ in extracted(spark, mixed)}
    assert got[0].endswith("Read more on our site today") and got[101].endswith("Own 1") and got[108].endswith("Shared")


def test_templates_against_occurrence_vectors(spark):
    rng = random.Random(6)
    pages = []
    for n in range(40):
        host = rng.choice([1, 1, 2, 3])
        body = "".join(rng.choice(["<p>a</p>", "<p>b</p>", "<div class=x><p>c</p></div>", "<section><h2>d</h2></section>", f"<p>own {n} words</p>"]) for _ in range(rng.randrange(1, 6)))
        pages.append((host, n, f"<body><div class=top>Top {host}</div><main>{body}</main></body>"))
    pages += [(1, pages[0][1], pages[0][2])] * (pages[0][0] == 1)
    got = {r["host"]: (sorted(r["regions"]), sorted(r["wording"])) for r in html_extract.host_templates(spark.createDataFrame(pages, "host long, page long, html string")).collect()}
    want = {}
    for host in (1, 2, 3):
        own = dict((n, h) for o, n, h in pages if o == host)
        vectors: dict = {}
        for n, html in own.items():
            for token, structure, count, prose, total in html_extract.page_tokens(html):
                vectors.setdefault((token, structure), {})[n] = (count, prose, total)
        regions, wording = [], []
        for (token, structure), v in vectors.items():
            if len(v) < 4 or len(v) < len(own) / 2:
                continue
            alike = [s for (_, s), w in vectors.items() if {k: x[0] for k, x in w.items()} == {k: x[0] for k, x in v.items()}]
            if not any(alike):
                continue
            if not structure:
                wording.append(token)
            elif token and all(x[0] == 1 for x in v.values()) and 2 * sum(x[1] for x in v.values()) >= sum(x[2] for x in v.values()):
                regions.append(token)
        if regions or wording:
            want[host] = (sorted(regions), sorted(wording))
    assert got == want and any(w for _, w in want.values())


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License.\nfoo bar"), ("a/b/x.py", "code"), ("a/b/c/y.py", "# header\nLicensed under CC BY-NC 4.0.\nmore words that follow it"), ("z/w", "nothing"), (None, "q"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/e", "t"), ("top", None), ("a/b/x.py", "code"), ("z/long", "word " * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")
    got = Counter((r["path"], r["license"], r["origin"], r["license_dir"]) for r in license_scan.scan_licenses(df).collect())
    assert got == Counter([("a/LICENSE", "MIT", "file", None), ("a/b/x.py", "GPL-3.0", "inherited", "a/b"), ("a/b/x.py", "GPL-3.0", "inherited", "a/b"), ("a/b/c/y.py", "CC-BY-NC-4.0", "statement", None), ("z/w", None, "none", None), (None, None, "none", None), ("a/b/COPYING", "GPL-3.0", "file", None), ("a/b/c/d/e", "GPL-3.0", "inherited", "a/b"), ("top", None, "none", None), ("z/long", None, "none", None)])
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def whole_license(name, words):
    return next(t for n, t in license_scan.TEMPLATES if n == name and len(t.split()) > words)


def wrapped(text, mark=""):
    w = text.split()
    return "\n".join(f"{mark}{' '.join(w[i : i + 11])}" for i in range(0, len(w), 11))


def test_license_files_headers_and_identifiers(spark):
    mit, bsd, gpl = whole_license("MIT", 100), whole_license("BSD-3-Clause", 200), whole_license("GPL-3.0", 80)
    rows = [
        ("m/LICENSE.txt", f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrapped(mit)}", "MIT", "file"),
        ("m/src/a.py", "x = 1", "MIT", "inherited"),
        ("b/x.c", f"/*\n * Copyright 2019 Some One\n *\n{wrapped(bsd, ' * ')}\n */\nint main() {{ return 0; }}\n" + "int f();\n" * 50, "BSD-3-Clause", "statement"),
        ("b/y.c", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0", "statement"),
        ("b/z.c", "# SPDX-License-Identifier: Unheard-1.0\nint x;", None, "none"),
        ("b/w.py", f"{wrapped(gpl, '# ')}\n\nimport os\n" + "class Harbor: lamps, boats, ropes = 1, 2, 3\n" * 9, "GPL-3.0", "statement"),
        ("b/v.py", "the license of this building is on the wall, see the terms of the lease", None, "none"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    got = {r["path"]: (r["license"], r["origin"]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {p: (name, origin) for p, _, name, origin in rows}


def test_license_scores_against_all_cosines(spark):
    """Every passage against every template by dense vectors over all terms."""
    rng = random.Random(7)
    own = [t for _, t in license_scan.TEMPLATES]
    texts = []
    for i in range(60):
        words = rng.choice(own).split()
        kept = [w for w in words if rng.random() > rng.choice([0.0, 0.2, 0.5])]
        texts.append("\n".join([prose(i, 12), " ".join(kept), *(["", prose(i + 1, 30)] * (i % 2))]))
    texts += [None, "", "\n\n", own[0] + "\n" + own[0]]
    count = Counter(t for x in texts if x for t in set(license_scan.terms(x)))
    idf = lambda t, n=len(texts): math.log((1 + n) / (1 + count.get(t, 0))) + 1
    vocabulary = {t for x in own for t in license_scan.terms(x)}
    weight = lambda t: idf(t) if t in vocabulary else idf("")

    def cosine(a, b):
        x, y = ({t: (1 + math.log(n)) * weight(t) for t, n in Counter(license_scan.terms(s)).items()} for s in (a, b))
        return sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    want = {}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        parts = [p for p in [*(p for _, p in license_scan.passages(low)), low] if license_scan.terms(p)]
        score, name = max(((round(cosine(p, t), 9), -k) for p in parts for k, t in enumerate(own)), default=(0, 0))
        want[i] = (license_scan.TEMPLATES[-name][0], score) if score >= 0.75 else (None, 0.0)
    df = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    got = {r["path"]: (r["license"] if r["origin"] != "inherited" else None, round(r["score"], 9)) for r in license_scan.scan_licenses(df, keep=["path"]).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert [(k, got[k], want[k]) for k in got if got[k][0] != want[k][0]] == [] and sum(v[0] is not None for v in got.values()) > 30
