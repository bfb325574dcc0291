"""The pipeline's stages, each against brute force on what the stage before kept, and on awkward tables."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from revtrail.llm import decontam, packing, quality, simhash

SF = "/root/testdata/sf0.001"
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def accepted(spark, rows, docs):
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    return [r for r in rows if model.score(np.array([quality.features(r["text"])]))[0] >= 0.7]


def one_of_each_group(rows):
    texts = sorted({r["text"] or "" for r in rows})
    sets = []
    for t in texts:
        w = low(t).split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    least: dict = {}
    for r in rows:
        g = group[r["text"] or ""]
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    return [r for r in rows if least[group[r["text"] or ""]] == r["doc_id"]]


def without_passages(rows, window=256, words=51):
    raw = [(r["text"] or "").encode() for r in rows]
    seen = Counter(hashlib.md5(x[p : p + window]).digest() for x in raw for p in range(len(x) - window + 1))
    out = []
    for r, x in zip(rows, raw, strict=True):
        gone = np.zeros(len(x) + 2, bool)
        for p in range(len(x) - window + 1):
            if seen[hashlib.md5(x[p : p + window]).digest()] > 1:
                gone[p + 1 : p + 1 + window] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        for a, b in edges.reshape(-1, 2).tolist():
            whole = [m for m in re.finditer(rb"\S+", x) if m.start() >= a and m.end() <= b]
            if len(whole) < words:
                gone[a + 1 : b + 1] = False
        gone = gone[1:-1]
        kept = bytes(np.frombuffer(x, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any():
            out.append((r["doc_id"], r["text"], r["n_chars"]))
        elif kept.strip("".join(map(chr, range(33)))):
            out.append((r["doc_id"], kept, len(kept)))
    return out


def decontaminated(rows, items):
    windows: dict = {}
    for item, text in items:
        w = decontam.words(text)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w, hit, met = decontam.words(r["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    met |= windows[tuple(w[i : i + n])]
                    hit.update(range(i, i + n))
        if len(met) >= 2:
            continue
        text = r["text"]
        spans = decontam.word_spans(text) if hit else []
        cut = set()
        for i in hit:
            cut.update(range(*spans[i]))
            if i + 1 in hit:
                cut.update(range(spans[i][1], spans[i + 1][0]))
        if hit:
            text = "".join(c for k, c in enumerate(text) if k not in cut)
        out.append((r["doc_id"], text, len(text) if hit else r["n_chars"]))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    plain = lambda rows: sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        got = after.collect()
        if name == "quality":
            assert plain(got) == plain(accepted(spark, rows, docs)) and len(got) < len(rows)
        elif name == "near_dedup":
            assert plain(got) == plain(one_of_each_group(rows)) and len(got) < len(rows)
        elif name == "passage_dedup":
            assert plain(got) == sorted(without_passages(rows))
        elif name == "decontaminate":
            assert plain(got) == sorted(decontaminated(rows, items))
            first = spark.read.parquet(f"{SF}/documents.parquet")
            cut = plain(stage(spark, first, SF).collect())
            assert cut == sorted(decontaminated(first.collect(), items)) and cut != plain(first.collect())
        else:
            whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = Counter({r["doc_id"]: len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows})
            length: Counter = Counter()
            ends: Counter = Counter()
            for r in got:
                length[r["doc_id"]] += r["length"]
                ends[r["sequence_id"]] += r["length"]
            assert length == want and max(ends.values()) <= 2048
            filled = {s: sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s) for s in ends}
            assert all(a + n == b for f in filled.values() for (a, n), (b, _) in zip(f, f[1:], strict=False)) and all(f[0][0] == 0 for f in filled.values())
            assert len(ends) <= packing.least_bins(np.array([r["length"] for r in got]), 2048) + 1
        docs, rows = after, got


def tables(spark, folder, benchmark=True, labels=True):
    good = [(i, " ".join(f"word{(i * k) % 97} and then" for k in range(1, 40 + i % 9)).capitalize() + ".", "en", "s", 1) for i in range(40)]
    bad = [(100 + i, "BUY!! NOW!! " * (20 + i), "en", "s", 1) for i in range(40)]
    odd = [good[0], good[0], (200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n\t", "en", "s", 3), (None, good[1][1], "en", "s", 1), (None, None, None, None, None), (203, good[2][1] + " " + "tail " * 100_000, "de", None, None)]
    docs = spark.createDataFrame(good + bad + odd, TYPES)
    marks = [(r[0], int(r[0] < 100), 0) for r in good + bad] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(marks if labels else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, good[3][1]), (2, None), (None, "x")] if benchmark else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_take_awkward_rows(spark, tmp_path):
    docs = tables(spark, tmp_path)
    more = docs.selectExpr("*", "1 as score", "'x' as predicted", "2 as _score", "'k' as key", "3 as n_hit", "4 as n_removed", "5 as kept_text")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, more):
            got = stage(spark, frame.repartition(3), str(tmp_path))
            assert name == "packing" or got.columns == corpus_pipeline.COLUMNS
            ids = Counter(r["doc_id"] for r in got.collect())
            assert sum(ids.values()) > 0
        if name == "quality":
            assert ids[0] == 3 and set(range(40)) <= set(ids) and not set(range(100, 140)) & set(ids)
        if name == "near_dedup":
            assert ids[0] == 1 and ids[200] == 1 and ids[201] == ids[202] == 0 and ids[None] == 0
        if name == "passage_dedup":
            assert ids[0] == 0 and ids[200] == ids[201] == ids[202] == 1
        if name == "decontaminate":
            assert ids[0] == 3 and ids[200] == 1 and ids[None] == 2
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_take_empty_models(spark, tmp_path):
    docs = tables(spark, tmp_path, benchmark=False, labels=False)
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == docs.count()


def test_whole_run_on_an_empty_table(spark, tmp_path):
    docs = tables(spark, tmp_path)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_profile_has_whole_sets():
    n, *_, raw = simhash._profile("a b c d e f a b c d e", 5)
    assert n == 6 and len(raw) == 48
