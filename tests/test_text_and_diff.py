"""Text functions, diff, hunks and verdicts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revtrail.functions import text as X
from revtrail.operators import diff


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("x")).first()[0]


@pytest.mark.parametrize(
    "f, given_, expected",
    [
        (X.punctuation_normalize, "our “Portal” – for free…", 'our "Portal" - for free...'),
        (X.punctuation_normalize, "a week’s pause", "a week's pause"),
        (X.punctuation_normalize, "x\u00a0\u2009y\u200bz", "x yz"),
        (X.punctuation_normalize, "plain Words stay", "plain Words stay"),
        (X.punctuation_normalize, "a , b ;c", "a, b;c"),
        (X.punctuation_normalize, " tab\tand  two `ticks` ", "tab and two 'ticks'"),
        (X.date_normalize, "kept for 90 days", "kept for 90 days"),
        *[(X.date_normalize, f"Effective {d}!", "Effective @date!") for d in ("2025-06-07", "07/06/2025", "7.6.25", "June 7, 2025", "7 June 2025", "June 2025", "7th jun. 2025")],
        (X.count_words, " un \t deux\n\ntrois ", 3),
        (X.count_words, " \n ", 0),
        (X.split_sentences, "Rule 7.3 says more on that. It ends here.", ["Rule 7.3 says more on that.", "It ends here."]),
        (X.split_sentences, "Ask Harbor Ltd. about it. They answer soon.", ["Ask Harbor Ltd. about it.", "They answer soon."]),
        (X.split_sentences, "Valid in 2026. Then no more;", ["Valid in 2026. Then no more;"]),
        (X.split_sentences, "  ", []),
        (X.utf16_length, "a😀", 3),
        (X.normalize_blocks, " The  Service\nis provided \u0000 ", "The Service is provided"),
        (X.content_hash, "Services", None),
    ],
)
def test_functions(spark, f, given_, expected):
    got = one(spark, f, given_)
    if f is X.content_hash:
        assert len(got) == 64 and got != one(spark, f, "portal")
    else:
        assert got == expected


@pytest.mark.parametrize("a, b, changed", [("it is not kept", "it is kept", True), ("they ask", "they never ask", True), ("one cannot leave", "one can't leave", False), ("does not end", "do not end", False), ("No.", "no", False)])
def test_negation(spark, a, b, changed):
    assert one(spark, X.negation_changed, a, b) is changed


def test_negation_counts(spark):
    assert one(spark, X.negation_counts, "No, we don't and cannot. Never!") == {"no": 1, "not": 2, "never": 1}


def long_document(clause):
    filler = " ".join(f"Clause {i} binds whoever visits the harbor, by day or by night, as long as a lamp is lit on the eastern pier." for i in range(40))
    return f"{filler} {clause} {filler}"


VERDICTS = [
    ("The 'Portal' is \"open\".", "The ‘Portal’ is “open”.", "punctuation-only", None),
    ("Effective 7 June 2025.", "Effective 19 August 2025.", "date-only", None),
    ("Reports reach auditors, insurers, couriers.", "Reports reach couriers, insurers, auditors.", "reordering-only", None),
    ("Records are never handed on.", "Records are handed on.", None, 1),
    ("Backups stay for 90 days.", "Backups stay for 45 days.", None, 1),
    ("Same.", "Same.", "punctuation-only", 0),
]


@pytest.mark.parametrize("a, b, reason, hunks", VERDICTS)
def test_verdict(spark, a, b, reason, hunks):
    df = spark.createDataFrame([(long_document(a), long_document(b))], "a string, b string")
    row = diff.with_diff(df, "a", "b").select("stats", "hunks", "cosmetic_reason", "cosmetic").first()
    assert row["stats"]["ratio"] < 0.005 and row["cosmetic_reason"] == reason and row["cosmetic"] is (reason is not None)
    assert hunks is None or len(row["hunks"]) == hunks


def test_above_threshold_and_context(spark):
    texts = [f"A lamp. A pier. A boat. It waits {n} hours. A rope. A sail. An oar." for n in (8, 20)]
    row = diff.with_diff(spark.createDataFrame([texts], "a string, b string"), "a", "b").first()
    assert not row["cosmetic"] and row["stats"]["ratio"] >= 0.005
    assert [h.asDict() for h in row["hunks"]] == [{"index": 0, "removed": "8", "added": "20", "contextBefore": "A boat. It waits", "contextAfter": "hours. A rope."}]


def test_hunk_column_equals_udf(spark):
    parts = diff.diff_parts("A b. C d. E f g. H", "A b. X d. E g. H i")
    df = spark.createDataFrame([(parts,)], "parts array<struct<op:string,value:string>>")
    assert [h.asDict() for h in df.select(diff.build_hunks(F.col("parts")).alias("h")).first()[0]] == diff.hunks_of(parts)


def test_full_replacement_ratio_is_two(spark):
    df = spark.createDataFrame([("a b c", "x y z"), (None, "x"), ("", "")], "a string, b string")
    rows = diff.with_diff(df, "a", "b").select("stats.ratio", "parts").collect()
    assert rows[0][0] == 2.0 and rows[1]["parts"] is None and rows[2][0] == 0.0


def segments(spark, parts, side):
    df = spark.createDataFrame([([{"op": o, "value": v} for o, v in parts],)], "parts array<struct<op:string,value:string>>")
    return [(s["kind"], s["value"]) for s in df.select(diff.view_segments(F.col("parts"), side).alias("s")).first()[0]]


def test_segments_fold_long_equal_parts(spark):
    got = segments(spark, [("equal", "w " * 500), ("delete", "x "), ("insert", "y "), ("equal", "v " * 500)], "before")
    assert got == [("gap", "370 unchanged words"), ("equal", "w " * 130), ("changed", "x "), ("equal", "v " * 130), ("gap", "370 unchanged words")]


def test_segments_count_parts_of_both_sides(spark):
    """A part hidden on one side is still a change next to which the edge stays."""
    long = "w " * 500
    assert segments(spark, [("delete", "x "), ("equal", long)], "after") == [("equal", "w " * 130), ("gap", "370 unchanged words")]
    assert segments(spark, [("equal", "w " * 350 + "end"), ("insert", "y")], "before") == [("gap", "222 unchanged words"), ("equal", ("w " * 350 + "end")[-260:])]
    assert segments(spark, [("equal", "w" * 699 + " v"), ("insert", "y")], "after")[0] == ("gap", "1 unchanged words")


def test_segments_cut_by_utf16_units(spark):
    got = segments(spark, [("insert", "y"), ("equal", "😀" * 400)], "after")
    assert got == [("changed", "y"), ("equal", "😀" * 130), ("gap", "1 unchanged words")]
    assert segments(spark, [("insert", "y"), ("equal", "a" + "😀" * 400)], "after")[1] == ("equal", "a" + "😀" * 129)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Inc.", "one", "2.", "b;", "No.", "x!", "\n", "end.", "A."]), max_size=30), st.integers(1, 3), st.integers(1, 12))
def test_sentences_at_the_ends(words, count, window):
    text = " ".join(words)
    assert diff._last_sentences(text, count, window) == " ".join(diff.split_sentences(text)[-count:])
    assert diff._first_sentences(text, count, window) == " ".join(diff.split_sentences(text)[:count])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a,", "(b", " ", "\n", "é"]), max_size=25), st.lists(st.sampled_from(["a", "b", "a,", "(b", " ", "\n", "é"]), max_size=25))
def test_common_ends_change_no_script(a, b):
    """As short as over all tokens, whatever the common head and tail."""
    a, b = " ".join(a), " ".join(b)
    x, y = diff._tokens(a)[0], diff._tokens(b)[0]
    kept = sum(len(diff._tokens(p["value"])[0]) for p in diff.diff_parts(a, b) if p["op"] == "equal")
    longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            longest[i + 1][j + 1] = longest[i][j] + 1 if u == v else max(longest[i][j + 1], longest[i + 1][j])
    assert kept == longest[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab., \n", max_size=40), st.text("ab., \n", max_size=40))
def test_parts_rebuild_both_texts(a, b):
    parts = diff.diff_parts(a, b)
    join = lambda *ops: "".join(p["value"] for p in parts if p["op"] in ops)
    assert "".join(join("equal", "delete").split()) == "".join(a.split())
    assert "".join(join("equal", "insert").split()) == "".join(b.split())
