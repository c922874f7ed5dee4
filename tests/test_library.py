"""Versioned tables, library writes, merges of synced copies, page seams and paragraphs, Markdown and inline rules."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import markdown as K
from folioforge.functions.carets import selected
from folioforge.operators import library as L
from folioforge.operators import merges as M
from folioforge.operators import pages as P
from folioforge.operators import tree as N
from folioforge.operators import windows as W
from folioforge.sources import books, css, inlines, writers
from folioforge.storage import VersionConflict, Versions


def test_versions(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    assert t.current() is None and t.number() == 0
    assert t.write(spark.range(3)) == 1
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.path}/v=2")
    assert t.number() == 1 and t.current().count() == 3
    with pytest.raises(VersionConflict):
        t.write(spark.range(1), expected=0)
    assert t.write(t.current().union(spark.range(1)), expected=1) == 2 and t.current().count() == 4
    t.trim()
    assert t.numbers() == [2]


def test_imports_are_idempotent(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    files = spark.createDataFrame([("a/x.txt", b"1"), ("a/y.txt", b"1"), ("a/z.txt", b"2")], "path string, content binary")
    assert L.import_files(t, files) == (2, 1) and L.import_files(t, files) == (0, 3)
    assert sorted(r.title for r in t.current().collect()) == ["x", "z"] and t.number() == 1


def test_synced_copies_take_their_place(spark):
    """A copy that came in as a version of its own is not made a second time."""
    schema = "id string, seq long, clock map<string,long>, wall long, counter long, device string, deleted boolean, conflict_of string, note string"
    rows = [
        ("x~conflict~a~10-0", 1, {"a": 1}, 10, 0, "a", False, "x", "copy"), ("x", 2, {"a": 1}, 10, 0, "a", False, None, "one"), ("x", 3, {"b": 1}, 20, 0, "b", False, None, "two"),
        ("x", 4, {"a": 1}, 10, 0, "a", True, None, "late"), ("y", 5, {"a": 1}, 1, 0, "a", False, None, "y"),
    ]
    got = sorted((r.id, r.note) for r in M.merge_annotations(spark.createDataFrame(rows, schema)).collect())
    assert got == [("x", "two"), ("x~conflict~a~10-0", "copy"), ("y", "y")]


def seams(pages):
    """Page by page, as a reader would: give away what goes on, then look at the next pair."""
    parts = [list(p) for p in pages]
    for a, b in zip(parts, parts[1:]):
        if a and b and a[-1][-1] != "!":  # all begin with small letters, so a full stop ends nothing
            a[-1] += (" " if a[-1][-1].isalnum() else "") + b.pop(0)
    return ["\n\n".join(p) for p in parts]


def test_page_seams(spark):
    r = random.Random(1)
    books_ = [[[r.choice(["go on", "end.", "stop!", "more"]) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] for _ in range(12)] for _ in range(40)]
    rows = [(b, p, "\n\n".join(parts), None) for b, pages in enumerate(books_) for p, parts in enumerate(pages)]
    got = {(x.book_id, x.page): x.markdown for x in P.joined_pages(spark.createDataFrame(rows, "book_id long, page long, markdown string, role string")).collect()}
    for b, pages in enumerate(books_):
        assert [got[b, p] for p in range(12)] == seams(pages)


@pytest.mark.parametrize(
    ("tail", "head", "goes"),
    [("a word", "goes on", True), ("inter-", "Next", True), ("the end.", "Then", False), ("e.g.", "then", True), ("He said “no.”", "then", True), ("Really?", "yes", False), ("# Title", "text", False), ("text", "- item", False),
     ("see ![x](y)", "text", False), ("a <b>b</b>", "text", False), ("a `<b>` c", "text", True), ("| a |\n|---|---|", "text", False), ("a $$x$$", "b", False), ("<http://x.y> is", "text", True)],
)
def test_seam_rule(spark, tail, head, goes):
    assert spark.range(1).select(P.goes_on(F.lit(tail), F.lit(head)).alias("x")).first().x == goes


def test_line_groups(spark):
    schema = "page long, line long, x double, y double, w double, h double, text string"
    lines = [(1, 0, 50, 0, 300, 10, "1.2 A heading"), (1, 1, 50, 12, 300, 10, "first"), (1, 2, 50, 24, 300, 10, "second"), (1, 3, 80, 36, 270, 10, "indented far"), (1, 4, 50, 60, 300, 10, "after a gap"), (1, 5, 50, 72, 300, 20, "taller")]
    got = [r.group for r in P.line_groups(spark.createDataFrame([(a, b, *map(float, c), t) for a, b, *c, t in lines], schema)).orderBy("line").collect()]
    assert got == [0, 1, 1, 2, 3, 4]


def _groups_of(lines):
    """Group numbers of one page's lines ``x, y, w, h, text``, line by line."""
    groups, first, size, before = [], None, 0, None
    for x, y, w, h, text in lines:
        starts = first is None or first[2]
        if not starts:
            px, py, pw, ph, ptext = before
            tall = max(ph, h, 1.0)
            overlap = (min(px + pw, x + w) - max(px, x)) / max(min(pw, w), 1.0)
            starts = y - py <= tall * 0.25 or y - (py + ph) > tall * 0.45 or min(ph, h) / tall < 0.68 or (len(text) < 20 and w < pw * 0.35 and len(ptext) > 40) or (overlap < 0.35 and abs(x - px) > tall * 2.5)
            starts = starts or x > first[0] + tall * 2.5 or (x + tall * 4.0 < first[0] and w > first[1] * 1.25) or (size > 1 and w > first[1] * 1.35 and pw < w * 0.8)
        if starts:
            number = (text.split() or [""])[0]
            first, size = (x, w, len(text) < 80 and "." in number and not number.strip("0123456789.")), 0
        groups.append((groups[-1] if groups else -1) + starts)
        size, before = size + 1, (x, y, w, h, text)
    return groups


@pytest.mark.parametrize("batch", [7, 10000])
def test_line_groups_over_batches(spark, batch):
    rng = random.Random(3)
    pages = {}
    for page in range(400):
        y, lines = 0.0, []
        for _ in range(3000 if page == 5 else rng.randint(1, 20)):
            y += rng.choice([12.0] * 12 + [1.0, 40.0])
            x, w = rng.choice([50.0] * 6 + [15.0, 60.0, 79.0, 400.0]), rng.choice([100.0, 120.0, 150.0, 300.0, 30.0])
            lines.append((x, y, w, rng.choice([10.0] * 9 + [11.0, 20.0]), rng.choice(["words " * 9, "words", "1.2 Part", " 3.", "1.a", "5", "", "."])))
        pages[page] = lines
    rows = [(page, i, *line) for page, lines in pages.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    found = P.line_groups(spark.createDataFrame(rows, "page long, line long, x double, y double, w double, h double, text string"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.page, r.line): r.group for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {(page, i): g for page, lines in pages.items() for i, g in enumerate(_groups_of(lines))}
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no call a page: 147,236 pages took 147 s


def test_trees_deeper_than_any_loop(spark):
    chain = spark.range(150).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit("x").alias("label"))
    got = {r.id: r for r in N.flattened(chain).collect()}
    assert len(got) == 150 and got["149"].depth == 149 and got["149"].path == "/".join("0" * 150) and len(got["3"].ancestors) == 3
    with pytest.raises(ValueError, match="circle"):
        N.flattened(spark.createDataFrame([("a", "b", 0, ""), ("b", "a", 0, "")], "id string, parent string, ord long, label string"))


def test_ranked(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = W.ranked(rows, [F.desc("v")], "ranks")
    assert got.where("place <> 1000 - v").count() == 0 and got.count() == 1000


def test_markdown_rules():
    assert [b["kind"] for b in K.layout_blocks("# A\n```\n# b\n~~~\n```\n|a|b|\n|---|---|\n|c|d|\ntext")] == ["heading", "markdown", "table", "markdown"]
    assert K.table_cells(r"| a \| b | `x|y` |") == [r"a \| b", "`x|y`"] and K.table_cells("no table") == []
    assert K.styled_runs("<em>a</strong></em>") is None and K.styled_runs("<em>a") is None and K.styled_runs("a") is None
    assert K.table_markdown([]) == "" and K.tight_strong("** a**") == " **a**"
    assert K.with_citations({"href": "book://section/1#n2", "x": [{"hrefs": ["y"]}]}, K.citation_marker) == {"citation": "[[1:n2]]", "x": [{"citations": []}]}


def test_inline_rules():
    assert inlines.figure("<figure><p>x</p></figure>") is None
    assert inlines.quote("<blockquote><cite>a</cite></blockquote>") == {"body": [], "attribution": "a"}
    assert inlines.quote("<blockquote><p style='text-align:right'>a</p></blockquote>") == {"body": ["a"], "attribution": None}
    assert inlines.sanitised('<script>x</script><td colspan="0">a</td>') == ' x <td>a</td>'
    assert inlines.sanitised('<img src="../OcrResources/../x.png">') == ""
    assert css.cascaded(css.parse("a.b{c:1} a{c:2} .b{c:3;d:4 !important}"), "a", {"class": "b x"}) == {"c": "1", "d": "4"}
    assert selected("one  two", 4, "word") == (0, 3) and selected("", 0, "word") is None and selected("A b. C d.", 6, "sentence") == (5, 9)


def test_recovered_archives():
    whole = writers.epub("T", "A", [("One", ["x", "y & z"]), ("Two", ["<w>"])])
    cut = whole[: whole.find(b"PK\x01\x02")]
    assert books.read_epub(cut) == books.read_epub(whole)
    stored = writers.epub("T", "A", [("One", ["xyzzy"])], stored=True)
    bad = stored.replace(b"xyzzy", b"xyzzz")
    for data in (bad, bad[: bad.find(b"PK\x01\x02")]):
        with pytest.raises(Exception, match="(?i)crc|checksum"):
            books.read_epub(data)
    with pytest.raises(ValueError, match="archive"):
        books.recovered_entries(b"nothing")


def test_palmdoc_round_trip():
    r = random.Random(4)
    for n in (0, 1, 7, 4096):
        data = bytes(r.choice(b"ab c\x01\xc3\xa9A ") for _ in range(n))
        assert books.palmdoc(writers.packed(data)) == data
    book = books.read_mobi(writers.mobi("Tïtle", "Ann", [("One", ["x"]), ("Two", ["y"])]))
    assert (book["title"], book["authors"], len(book["sections"])) == ("Tïtle", ["Ann"], 2)
