"""Readers on small files made here."""

import io
import struct
import zipfile

from folioforge.sources import books, html


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


EPUB = {
    "META-INF/container.xml": '<?xml version="1.0"?><container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
    "OPS/p.opf": '<package xmlns:dc="x"><metadata><dc:title>A & B</dc:title><dc:creator>Ann</dc:creator></metadata><manifest><item id="a" href="a.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="a"/></spine></package>',
    "OPS/a.xhtml": "<html><body><h1 id='top'>One</h1><p>Two</p></body></html>",
    "OPS/nav.xhtml": '<html xmlns:epub="e"><body><nav epub:type="toc"><ol><li><a href="a.xhtml#top">One</a><ol><li><span>Sub</span></li></ol></li></ol></nav></body></html>',
}


def test_epub():
    book = books.read_epub(zipped(EPUB))
    assert (book["title"], book["authors"]) == ("A & B", ["Ann"])
    assert [h for h, _ in book["sections"]] == ["OPS/a.xhtml"]
    assert book["toc"] == [{"label": "One", "href": "OPS/a.xhtml#top", "depth": 0}, {"label": "Sub", "href": None, "depth": 1}]


def test_fb2_preface_and_authors():
    fb2 = b"<FictionBook><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T</book-title></title-info></description><body><title><p>Pre</p></title><section><p>x</p></section><section><p>y</p></section></body></FictionBook>"
    book = books.read_fb2(fb2)
    assert (book["title"], book["authors"], len(book["sections"])) == ("T", ["A B"], 3)
    assert books.read_fbz(zipped({"b.fb2": fb2}))["title"] == "T"


def test_cbz_order():
    assert [h for h, _ in books.read_cbz(zipped({"B.png": "x", "a.jpg": "y", "note.txt": "z"}))["sections"]] == ["a.jpg", "B.png"]


def test_palmdoc_and_mobi():
    assert books.palmdoc(b"abc" + bytes([0x80 | (3 << 3) >> 8, (3 << 3) & 0xFF | 0])) == b"abcabc"
    text = b"<p>one</p><mbp:pagebreak/><p>two</p>"
    head = struct.pack(">HHIHH", 1, 0, len(text), 1, 4096)
    first = 78 + 16 + 2
    data = b"My_Book".ljust(32, b"\0") + bytes(44) + struct.pack(">H", 2) + struct.pack(">IIII", first, 0, first + len(head), 0) + bytes(2) + head + text
    book = books.read_mobi(data)
    assert book["title"] == "My Book" and [c for _, c in book["sections"]] == ["<p>one</p>", "<p>two</p>"]


def test_open_books(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(zipped(EPUB))
    (tmp_path / "b.md").write_text("# Head\n\ntext\nmore\n\n```\ncode\n```\n")
    (tmp_path / "c.epub").write_bytes(b"no zip")
    (tmp_path / "d.xyz").write_bytes(b"?")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in books.open_books(spark, str(tmp_path)).collect()}
    assert rows["a.epub"].title == "A & B" and rows["a.epub"].error is None
    assert rows["b.md"].content == "<h1>Head</h1>\n<p>text more</p>\n<pre>code</pre>"
    assert rows["c.epub"].error.startswith("BadZipFile") and rows["d.xyz"].error == "format None is not supported"
    assert len({r.book_id for r in rows.values()}) == 4


def kinds(text):
    return [(b["kind"], b["text"]) for b in html.parse_html(text)]


def test_html_blocks():
    text = "<head><title>t</title></head><h2>A <b>b</b>\n c</h2>x<p>y<br>z<ul><li>1<ol><li>2</ol></ul><script>var a='</p>'</script><pre> a\n b</pre><hr><img src=i alt=pic><blockquote>q</blockquote><p hidden>no</p><nav epub:type=landmarks>no</nav>"
    assert kinds(text) == [("heading", "A b c"), ("paragraph", "x"), ("paragraph", "y\nz"), ("list-item", "1"), ("list-item", "2"), ("preformatted", " a\n b"), ("separator", ""), ("image", "pic"), ("blockquote", "q")]
    rows = html.parse_html(text)
    assert rows[0]["level"] == 2 and [(r["depth"], r["ordered"], r["ordinal"]) for r in rows[3:5]] == [(0, False, 1), (1, True, 1)]
    assert html.parse_html(None) == []


def test_html_tables_anchors_links():
    rows = html.parse_html("<p id=a>see <a href='#b'>1</a></p><p id=b><a href='#a'>1</a> note</p><table><tr><th colspan=2>h<td>d</tr><tr><td>e</table>")
    assert [r["anchors"] for r in rows[:2]] == [["a"], ["b"]] and rows[0]["links"][0]["href"] == "#b"
    assert [(c["row"], c["col"], c["header"], c["colspan"], c["text"]) for c in rows[2]["cells"]] == [(0, 0, True, 2, "h"), (0, 1, False, 1, "d"), (1, 0, False, 1, "e")]


def test_footnotes(spark):
    pages = spark.createDataFrame([(1, "<p id=a>see <a href='#b'>1</a></p><p id=b><a href='#a'>1</a> note</p><p id=c><a href='#a'>2</a></p>")], "page_id long, html string")
    got = html.footnote_pairs(html.html_blocks(pages)).collect()
    assert [(r.seq, r.to_seq, r.marker) for r in got] == [(0, 1, "1")]


def test_footnotes_of_every_block(spark, tmp_path):
    from folioforge.plans.source_queries import t18

    spark.createDataFrame([(1, "one\n\ntwo <b> & c\nthree"), (2, "four"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(map(tuple, t18(spark, str(tmp_path)).collect()))
    assert [r[:2] for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0)] and {r[2:] for r in rows} == {(0, 1, "1")}


def test_selection_takes_whole_texts(spark, tmp_path):
    from folioforge.plans.more_queries import g27

    long = "word " * 20 + "end"
    rows = [(1, 2, "9."), (1, 0, long), (1, 1, ""), (1, 3, "a\n"), (1, 4, "b"), (2, 0, long), (2, 1, "é"), (3, 0, ""), (4, 0, None), (4, 1, "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert dict(map(tuple, g27(spark, str(tmp_path)).collect())) == {1: f"{long} 9.a\nb", 2: f"{long} é", 3: "", 4: None}
