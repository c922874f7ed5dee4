"""Golden cases and brute force for operators that SQL does not express."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import merges as M
from folioforge.operators import windows as W
from folioforge.operators.search import matches, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_excerpt_is_clipped_on_both_sides(spark):
    assert one(spark, X.excerpt(F.lit("alpha beta gamma"), F.lit(6), F.lit(10), 2)) == "…a beta g…"


def test_search_offsets_and_case(spark):
    rows = spark.createDataFrame([(1, 0, "n0", "paragraph", "The systems of all other Systems. A system.")], "book_id long, block_index long, node string, kind string, text string")
    assert [(r.start, r.end) for r in search(rows, " SYSTEMS ").collect()] == [(4, 11), (25, 32)]
    assert matches(rows, "  ").count() == 0
    assert search(rows, "a.", 10).count() == 0


def test_greedy_groups_by_brute_force(spark):
    def brute(lengths, most, rows=None, after=False):
        groups, group, total, n, opened = [], -1, 0, 0, True
        for x in lengths:
            if opened or (n and total + x > most) or (rows and n >= rows):
                group, total, n = group + 1, 0, 0
            total, n = total + x, n + 1
            groups.append(group)
            opened = bool(after and rows and (total >= most or n >= rows))
        return groups

    cases = [[], [5], [3, 3, 3, 3], [10, 1, 1, 20, 1], [1] * 12, [7, 3, 10, 0, 4]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<long>")
    for most, rows, after in ((7, None, False), (10, 4, True)):
        got = df.select("i", W.greedy_groups(F.col("l"), most, rows, after).alias("g")).orderBy("i").collect()
        assert [r.g for r in got] == [brute(c, most, rows, after) for c in cases]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abc"), st.integers(0, 3)), st.dictionaries(st.sampled_from("abc"), st.integers(0, 3)))
def test_clock_order(spark, left, right):
    less, more = any(left.get(d, 0) < right.get(d, 0) for d in "abc"), any(left.get(d, 0) > right.get(d, 0) for d in "abc")
    want = "concurrent" if less and more else "before" if less else "after" if more else "equal"
    df = spark.createDataFrame([(left, right)], "a map<string,long>, b map<string,long>")
    assert df.select(M.clock_order(F.col("a"), F.col("b"))).first()[0] == want


def test_annotation_merge_keeps_a_copy_of_the_loser(spark):
    rows = [
        ("x", 1, {"a": 1}, 10, 0, "a", False, None, "first"),
        ("x", 2, {"b": 1}, 20, 0, "b", False, None, "second"),
        ("x", 3, {"a": 1}, 5, 0, "a", False, None, "old"),
        ("y", 1, {"a": 1}, 1, 0, "a", False, None, "one"),
        ("y", 2, {"a": 2}, 2, 0, "a", True, None, "gone"),
    ]
    df = spark.createDataFrame(rows, "id string, seq long, clock map<string,long>, wall long, counter long, device string, deleted boolean, conflict_of string, note string")
    got = {r.id: (r.note, r.conflict_of, r.deleted) for r in M.merge_annotations(df).collect()}
    assert got == {"x": ("second", None, False), "x~conflict~a~10-0": ("first", "x", False), "x~conflict~a~5-0": ("old", "x", False), "y": ("gone", None, True)}


def test_last_writer_is_newest_not_furthest(spark):
    df = spark.createDataFrame([("b", 0.9, 1, 0, "x"), ("b", 0.2, 2, 0, "x")], "book string, p double, wall long, counter long, device string")
    assert M.last_writer(df, "book", F.col("p")).first()["value"] == 0.2


def test_toc_depths(spark):
    entries = [(2, 1, False), (0, 1, False), (0, 1, True), (3, 2, False), (5, 2, False)]
    df = spark.createDataFrame([(entries,)], "l array<struct<depth:int,page:long,numbered:boolean>>")
    assert df.select(W.toc_depths(F.col("l"))).first()[0] == [0, 0, 1, 2, 3]


def test_normal_path(spark):
    cases = {"a/./b": "a/b", "a/../b": "b", "../a": None, "/a": None, "a\\b": None, "http://x/y": None, "a//b": "a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", X.normal_path(F.col("p")).alias("n")).collect()} == cases


def test_list_markers(spark):
    cases = {"• x": "•", "- x": "-", "-x": None, "1. x": "1.", "iv) x": "iv)", "toolong1. x": None, "plain": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.m for r in df.select("p", X.list_marker(F.col("p")).alias("m")).collect()} == cases


def test_sentence_atoms_lose_nothing_and_keep_pairs():
    from folioforge.functions.sentences import atoms

    cases = {
        "One. Two! Three": ["One. ", "Two! ", "Three"],
        "He said “Go. Now.” and left. Yes": ["He said “Go. Now.” and left. ", "Yes"],
        "End. (A note.) Next.": ["End. (A note.) ", "Next."],
        "第一。第二？第三": ["第一。", "第二？", "第三"],
        "Open ( never. Closed. X": ["Open ( never. ", "Closed. ", "X"],
        "v1.2 is out": ["v1.2 is out"],
        "": [],
    }
    for text, want in cases.items():
        got = [text[a:b] for a, b in atoms(text)]
        assert got == want and "".join(got) == text


def test_joined_pages(spark):
    from folioforge.operators.pages import joined_pages

    pages = ["Head\n\nThe long para-", "graph ends here.", "next sentence\n\nIt ends", "# Title", "Half", "way. Done"]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(pages)], "book_id long, page long, markdown string")
    got = [r.markdown for r in joined_pages(df).orderBy("page").collect()]
    assert got == ["Head\n\nThe long paragraph ends here.", "", "next sentence\n\nIt ends", "# Title", "Half way. Done", ""]
