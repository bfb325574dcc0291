"""Queries against brute force over their whole input."""

import html
import os

import pytest

from revtrail.plans import catalog, derived

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_recipients_of_every_change(spark):
    t = derived.tables(spark, SF)
    docs = {r["id"]: r for r in t.documents.collect()}
    names = {r["id"]: r["name"] for r in t.companies.collect()}
    active = [r for r in t.subscriptions.collect() if r["unsubscribed_at"] is None]
    want = []
    for c in t.changes.collect():
        if c["published"] and c["notified_at"] is None and c["detected_at"] % 17:
            d = docs[c["document_id"]]
            said = [html.escape(c["headline"] or "A change was detected", quote=False), html.escape(c["summary"] or "", quote=False)]
            want += [(c["id"], s["email"], s["unsubscribe_token"], names[d["company_id"]], d["type"], *said) for s in active if s["company_id"] == d["company_id"]]
    assert len({w[0] for w in want}) > 50
    assert sorted(map(tuple, catalog.QUERIES["recipients"](spark, SF).collect())) == sorted(want)


@tables
@pytest.mark.parametrize("name", ["diff_hunks", "cosmetic_verdict", "heuristic_summary", "summary_prompt", "diff_segments"])
def test_every_changed_revision_is_diffed(spark, name):
    texts = {(r["document_id"], r["rev"]): r["extracted_text"] for r in derived.relation(spark, SF, "revisions").collect()}
    changed = {(d, k) for (d, k), text in texts.items() if k > 1 and text != texts[d, k - 1]}
    got = {(r["document_id"], r["rev"]) for r in catalog.QUERIES[name](spark, SF).collect()}
    if name in ("heuristic_summary", "summary_prompt"):  # only of changes that are not cosmetic
        changed = {(r["document_id"], r["rev"]) for r in catalog.QUERIES["cosmetic_verdict"](spark, SF).collect() if not r["cosmetic"]}
    assert {k for _, k in changed} == {2, 3}
    assert got == changed


@tables
def test_revisions_of_every_document_with_a_text(spark, tmp_path):
    rows = [(1, "short", "a", 5), (2, "long " * 60, "a", 300), (3, "unmeasured", "b", None), (4, "", "b", 0), (5, None, "b", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {name: sorted({r[0] for r in derived.relation(spark, str(tmp_path), name).select(key).collect()}) for name, key in (("revisions", "document_id"), ("docs", "id"), ("companies", "id"), ("changes", "document_id"))}
    assert got == {"revisions": ["1", "2", "3", "4"], "docs": ["1", "2", "3", "4"], "companies": ["a", "b"], "changes": ["1", "2", "3", "4"]}


def test_diff_beyond_the_limit_is_a_shortest_script():
    from revtrail.operators import diff

    old = [f"w{i % 997}" for i in range(20_000)]
    new = [f"new{i}" if i % 19 == 7 and i < 19 * 1001 else w for i, w in enumerate(old)]
    parts = diff.diff_parts(" ".join(old), " ".join(new))
    assert len(diff.hunks_of(parts)) == 1001
    assert sum(len(p["value"].split()) for p in parts if p["op"] == "delete") == 1001
    for op, text in (("insert", old), ("delete", new)):
        assert "".join(p["value"] for p in parts if p["op"] != op).split() == text


def test_halving_is_as_short_as_myers(monkeypatch):
    import random

    from revtrail.operators import diff

    rng = random.Random(4)
    monkeypatch.setattr(diff, "_BLOCK", 13)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(60))] for _ in range(2))
        got, want = diff._halving(a, b), diff._script(a, b)
        assert len(got) == len(want) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
