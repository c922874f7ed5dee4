"""Book files to sections and their blocks: EPUB, FB2, CBZ, MOBI text, HTML, Markdown and plain text.

Files come through Spark's ``binaryFile`` source, so any store will do; each file is one row,
decoded where it is read. A file that cannot be read gives one row with its error.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.shipping import ship

#: Budgets against harmful archives: entries, bytes of one entry, of all, and unpacked for packed (fixed values).
MOST_ENTRIES, MOST_ENTRY, MOST_TOTAL, MOST_RATIO = 10_000, 64 << 20, 1 << 30, 200
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "bmp")
SCHEMA = "book_id string, path string, format string, title string, authors array<string>, section_index int, href string, content string, toc array<struct<label:string,href:string,depth:int>>, error string"
_COLUMNS = [x.split()[0] for x in ("book_id", "path", "format", "title", "authors", "section_index", "href", "content", "toc", "error")]


def format_of(path: Column) -> Column:
    """The format by file name, null if none is known."""
    name = F.lower(path)
    ext = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    known = {"epub": "epub", "fb2": "fb2", "fbz": "fbz", "cbz": "cbz", "mobi": "mobi", "azw": "mobi", "azw3": "azw3", "chm": "chm", "pdf": "pdf", "html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "txt": "text"}
    out = F.when(F.endswith(name, F.lit(".fb2.zip")), "fbz")
    for k, v in known.items():
        out = out.when(ext == k, v)
    return out


def decoded(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def clean_xml(text: str) -> str:
    """XML without document type, stray ampersands escaped."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text, flags=re.IGNORECASE)
    text = text.replace("&nbsp;", "&#160;")
    return re.sub(r"&(?!(#[0-9]+|#[xX][0-9A-Fa-f]+|amp|lt|gt|quot|apos);)", "&amp;", text)


def _xml(data: bytes) -> ET.Element:
    return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", clean_xml(decoded(data))))


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _name(e) == name]


def _text(element: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip() if element is not None else ""


def _inflated(method: int, data: bytes, most: int) -> bytes:
    """The bytes of a stored or deflated entry, as far as a budget goes."""
    if method == 0:
        return data
    if method != 8:
        raise ValueError(f"packing {method} of an entry is not supported")
    unpacker = zlib.decompressobj(-15)
    out = unpacker.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError("an entry is over its budget")
    return out


def recovered_entries(data: bytes) -> dict[str, tuple[int, int, bytes]]:
    """``name: (method, crc, packed bytes)`` by the headers before the entries, for archives without a readable directory.

    Names that a readable directory lacks are left out, its sizes count where they are larger, the methods must
    agree, and of entries with one name the last stays.
    """
    listed: dict[str, tuple[int, int]] = {}
    at = data.find(b"PK\x01\x02")
    while at >= 0 and at + 46 <= len(data):
        method, packed = struct.unpack_from("<H8xI", data, at + 10)
        n, extra, note = struct.unpack_from("<HHH", data, at + 28)
        listed[data[at + 46 : at + 46 + n].decode("utf-8", "replace")] = (method, packed)
        at = data.find(b"PK\x01\x02", at + 46 + n + extra + note)
    out: dict[str, tuple[int, int, bytes]] = {}
    at = data.find(b"PK\x03\x04")
    while at >= 0 and at + 30 <= len(data):
        _, method, _, _, crc, size, _, n, extra = struct.unpack_from("<HHHHIIIHH", data, at + 6)
        name, begin = data[at + 30 : at + 30 + n].decode("utf-8", "replace"), at + 30 + n + extra
        known = listed.get(name)
        if known is not None:
            if known[0] != method:
                raise ValueError(f"{name} has two packings")
            size = max(size, known[1])
        after = data.find(b"PK\x03\x04", begin + size)
        if (known is not None or not listed) and not name.endswith("/"):
            if len(out) >= MOST_ENTRIES:
                raise ValueError("the archive is over its budget")
            out[name] = (method, crc, data[begin : begin + size])
        at = after
    if not out:
        raise ValueError("not an archive")
    return out


class Archive:
    """A zip's entries within the budgets, by canonical path; without a directory by the entries' own headers."""

    def __init__(self, data: bytes) -> None:
        self._zip, self._found = None, {}
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            if b"PK\x03\x04" not in data:
                raise
            self._found = recovered_entries(data)
            self.names = list(self._found)
            return
        entries = [x for x in self._zip.infolist() if not x.is_dir()]
        if len(entries) > MOST_ENTRIES or sum(x.file_size for x in entries) > MOST_TOTAL:
            raise ValueError("the archive is over its budget")
        self.names = [x.filename for x in entries]

    def read(self, name: str) -> bytes:
        """One entry with its checksum tested; ``KeyError`` if there is none."""
        if self._zip is None:
            method, crc, packed = self._found[name]
            out = _inflated(method, packed, MOST_ENTRY)
            if zlib.crc32(out) != crc:
                raise ValueError(f"{name} has a wrong checksum")
            return out
        info = self._zip.getinfo(name)
        if info.file_size > MOST_ENTRY or info.file_size > MOST_RATIO * max(info.compress_size, 1 << 10):
            raise ValueError(f"{name} is over its budget")
        return self._zip.read(name)


def _resolved(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), urllib.parse.unquote(href.split("#")[0]))) if href.split("#")[0] else base


def _with_fragment(base: str, href: str) -> str:
    return _resolved(base, href) + ("#" + href.split("#", 1)[1] if "#" in href else "")


def _nav_entries(root: ET.Element, base: str) -> list[dict]:
    def walk(ol: ET.Element, depth: int) -> Iterator[dict]:
        for li in (x for x in ol if _name(x) == "li"):
            label = next((x for x in li if _name(x) in ("a", "span")), None)
            href = label.get("href") if label is not None else None
            yield {"label": _text(label) or "Untitled section", "href": _with_fragment(base, href) if href and ":" not in href.split("/")[0] else None, "depth": depth}
            for inner in (x for x in li if _name(x) == "ol"):
                yield from walk(inner, depth + 1)

    for nav in _all(root, "nav"):
        if any(k.rsplit("}", 1)[-1] == "type" and "toc" in v.split() for k, v in nav.attrib.items()):
            return [e for ol in nav if _name(ol) == "ol" for e in walk(ol, 0)]
    return []


def _ncx_entries(root: ET.Element, base: str) -> list[dict]:
    def walk(points: list[ET.Element], depth: int) -> Iterator[dict]:
        for p in points:
            label = next((x for x in p if _name(x) == "navLabel"), None)
            content = next((x for x in p if _name(x) == "content"), None)
            src = content.get("src") if content is not None else None
            yield {"label": _text(label) or "Untitled section", "href": _with_fragment(base, src) if src else None, "depth": depth}
            yield from walk([x for x in p if _name(x) == "navPoint"], depth + 1)

    maps = _all(root, "navMap")
    return list(walk([x for x in maps[0] if _name(x) == "navPoint"], 0)) if maps else []


def read_epub(data: bytes) -> dict:
    """Package, spine and contents of an EPUB."""
    archive = Archive(data)
    opf = next(e.get("full-path") for e in _all(_xml(archive.read("META-INF/container.xml")), "rootfile"))
    package = _xml(archive.read(opf))
    manifest = {e.get("id"): e for e in _all(package, "item")}
    sections, toc, ncx = [], [], None
    for ref in _all(package, "itemref"):
        item = manifest.get(ref.get("idref"))
        if item is None:
            raise ValueError(f"the spine names {ref.get('idref')}, which the manifest lacks")
        href = _resolved(opf, item.get("href"))
        sections.append((href, decoded(archive.read(href))))
    for item in manifest.values():
        path = _resolved(opf, item.get("href") or "")
        if "nav" in (item.get("properties") or "").split():
            toc = _nav_entries(_xml(archive.read(path)), path)
        elif item.get("media-type") == "application/x-dtbncx+xml":
            ncx = path
    if not toc and ncx:
        toc = _ncx_entries(_xml(archive.read(ncx)), ncx)
    return {"title": _text(next(iter(_all(package, "title")), None)), "authors": [t for t in map(_text, _all(package, "creator")) if t], "sections": sections, "toc": toc}


def read_fb2(data: bytes) -> dict:
    """Title, authors and top sections of a FictionBook, a preface first if it has text."""
    root = _xml(data)
    info = next(iter(_all(root, "title-info")), root)
    names = []
    for a in _all(info, "author"):
        parts = {_name(x): _text(x) for x in a}
        names.append(parts.get("nickname") or " ".join(filter(None, (parts.get(k) for k in ("first-name", "middle-name", "last-name")))))
    sections = []
    tags = {"title": "h1", "subtitle": "h2", "p": "p", "empty-line": "br", "emphasis": "i", "strong": "b", "v": "p", "cite": "blockquote", "epigraph": "blockquote", "text-author": "cite"}

    def markup(e: ET.Element) -> str:
        tag = tags.get(_name(e), "div")
        if tag in ("h1", "h2"):  # a title's paragraphs are one heading
            return f"<{tag}>{_escaped(' '.join(filter(None, map(_text, e))) or _text(e))}</{tag}>"
        inside = "".join([_escaped(e.text), *(markup(c) + _escaped(c.tail) for c in e)])
        return f"<{tag}>{inside}</{tag}>"

    for body in _all(root, "body"):
        own = [x for x in body if _name(x) == "section"]
        preface = "".join(markup(x) for x in body if _name(x) != "section")
        if re.sub(r"<[^>]*>|\s", "", preface):
            sections.append(f"<body>{preface}</body>")
        sections += [f"<body>{markup(s)}</body>" for s in own]
    return {"title": _text(next(iter(_all(info, "book-title")), None)), "authors": [n for n in names if n], "sections": [(f"section-{k}", s) for k, s in enumerate(sections)], "toc": []}


def _escaped(text: str | None) -> str:
    return (text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def read_fbz(data: bytes) -> dict:
    """The first FictionBook in an archive."""
    archive = Archive(data)
    return read_fb2(archive.read(next(n for n in archive.names if n.lower().endswith(".fb2"))))


def read_cbz(data: bytes) -> dict:
    """Image pages in the order of their names, with the title that the archive gives."""
    archive = Archive(data)
    pages = sorted((n for n in archive.names if n.lower().rsplit(".", 1)[-1] in IMAGES and not n.startswith("__MACOSX")), key=lambda n: (n.lower(), n))
    info = next((_xml(archive.read(n)) for n in archive.names if n.lower().endswith("comicinfo.xml")), None)
    title = _text(next(iter(_all(info, "Title")), None)) if info is not None else ""
    writers = _text(next(iter(_all(info, "Writer")), None)) if info is not None else ""
    return {"title": title, "authors": [w.strip() for w in writers.split(",") if w.strip()], "sections": [(n, f'<img src="{_escaped(n)}"/>') for n in pages], "toc": []}


def palmdoc(data: bytes) -> bytes:
    """Unpack one PalmDOC record."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0 or 9 <= c <= 0x7F:
            out.append(c)
        elif c <= 8:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            if back == 0 or back > len(out):
                raise ValueError("a PalmDOC record refers to before its start")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def exth(head: bytes) -> dict[int, list[str]]:
    """The metadata records of a Mobipocket header by kind, none if it has no such block."""
    if len(head) < 132 or not struct.unpack_from(">I", head, 128)[0] & 0x40:
        return {}
    at = 16 + struct.unpack_from(">I", head, 20)[0]
    if head[at : at + 4] != b"EXTH":
        return {}
    out: dict[int, list[str]] = {}
    count, at = struct.unpack_from(">I", head, at + 8)[0], at + 12
    for _ in range(count):
        kind, size = struct.unpack_from(">II", head, at)
        out.setdefault(kind, []).append(head[at + 8 : at + size].decode("utf-8", "replace").strip())
        at += max(size, 8)
    return out


def read_mobi(data: bytes) -> dict:
    """Text sections of a Mobipocket book that is plain or PalmDOC-packed; title and authors by its metadata."""
    count = struct.unpack_from(">H", data, 76)[0]
    offsets = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(count)] + [len(data)]
    record = lambda k: data[offsets[k] : offsets[k + 1]]
    head = record(0)
    packing, _, length, records = struct.unpack_from(">HHIH", head, 0)
    if packing not in (1, 2):
        raise ValueError(f"packing {packing} is not supported")
    known = exth(head)
    raw = b"".join((palmdoc if packing == 2 else bytes)(record(k)) for k in range(1, records + 1))[:length]
    text = raw.decode("utf-8" if len(head) >= 32 and struct.unpack_from(">I", head, 28)[0] == 65001 else "cp1252", "replace")
    parts = [p for p in re.split(r"(?i)<(?:mbp:)?pagebreak[^>]*/?>(?:</(?:mbp:)?pagebreak>)?", text) if re.sub(r"<[^>]*>|\s", "", p)]
    title = next(filter(None, known.get(503, [])), "") or data[:32].split(b"\0")[0].decode("latin-1").replace("_", " ")
    return {"title": title, "authors": [a for a in known.get(100, []) if a], "sections": [(f"chapter-{k + 1}", p) for k, p in enumerate(parts)], "toc": [{"label": f"Chapter {k + 1}", "href": f"chapter-{k + 1}", "depth": 0} for k in range(len(parts))]}


def markdown_to_html(text: str) -> str:
    """A plain rendering: fences, headings, quotes, list items and paragraphs."""
    out, paragraph, fence = [], [], None

    def end() -> None:
        if paragraph:
            out.append(f"<p>{_escaped(' '.join(paragraph))}</p>")
            paragraph.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence is not None:
            if mark and mark.group(1)[0] == fence[0][0] and len(mark.group(1)) >= len(fence[0]):
                out.append(f"<pre>{_escaped(chr(10).join(fence[1]))}</pre>")
                fence = None
            else:
                fence[1].append(line)
        elif mark:
            end()
            fence = (mark.group(1), [])
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            end()
            out.append(f"<h{len(m.group(1))}>{_escaped(m.group(2))}</h{len(m.group(1))}>")
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            end()
            out.append(f"<ul><li>{_escaped(m.group(1))}</li></ul>")
        elif line.startswith(">"):
            end()
            out.append(f"<blockquote>{_escaped(line[1:].strip())}</blockquote>")
        elif line.strip():
            paragraph.append(line.strip())
        else:
            end()
    end()
    if fence is not None:
        out.append(f"<pre>{_escaped(chr(10).join(fence[1]))}</pre>")
    return "\n".join(out)


def _single(html: str, title: str = "") -> dict:
    return {"title": title, "authors": [], "sections": [("section-0", html)], "toc": []}


READERS = {
    "epub": read_epub, "fb2": read_fb2, "fbz": read_fbz, "cbz": read_cbz, "mobi": read_mobi,
    "html": lambda d: _single(decoded(d), _text_of_title(decoded(d))), "markdown": lambda d: _single(markdown_to_html(decoded(d))),
    "text": lambda d: _single("".join(f"<p>{_escaped(x)}</p>" for x in decoded(d).split("\n") if x.strip())),
}


def _text_of_title(html: str) -> str:
    found = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    return re.sub(r"\s+", " ", found.group(1)).strip() if found else ""


def read_sections(files: DataFrame) -> DataFrame:
    """One row for each section of each file of a ``binaryFile`` table."""

    def rows(path: str, kind: str | None, data: bytes) -> Iterator[tuple]:
        book_id = hashlib.sha256(data).hexdigest()
        if kind not in READERS:
            yield book_id, path, kind, None, [], None, None, None, [], f"format {kind} is not supported"
            return
        try:
            book = READERS[kind](data)
        except Exception as error:  # noqa: BLE001  a bad file is a row, not the end of the job
            yield book_id, path, kind, None, [], None, None, None, [], f"{type(error).__name__}: {error}"
            return
        name = posixpath.basename(path)
        title = book["title"] or name.rsplit(".", 1)[0].strip() or "untitled"
        toc = book["toc"] or [{"label": f"Section {k + 1}", "href": href, "depth": 0} for k, (href, _) in enumerate(book["sections"])]
        for k, (href, content) in enumerate(book["sections"]):
            yield book_id, path, kind, title, book["authors"], k, href, content, toc if k == 0 else [], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, kind, data in zip(frame["path"], frame["format"], frame["content"], strict=True):
                made = list(rows(path, kind, bytes(data)))
                yield pd.DataFrame(made, columns=_COLUMNS).astype({"section_index": "Int32"})

    return files.select("path", format_of(F.col("path")).alias("format"), "content").mapInPandas(run, SCHEMA)


def open_books(spark: SparkSession, path: str) -> DataFrame:
    """The sections of all book files below a path, on any store that Spark reads."""
    return read_sections(book_table(spark, path))


def book_table(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path as bytes."""
    ship(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def catalog_of(files: DataFrame) -> DataFrame:
    """``book_id, path, format, title, authors`` of each file: opened for its description, no section kept."""
    return read_sections(files).where("section_index = 0 OR error IS NOT NULL").select("book_id", "path", "format", "title", "authors", "error")


def contents_of(sections: DataFrame) -> DataFrame:
    """``book_id, path, ord, label, href, depth`` of the books' contents."""
    return sections.where("section_index = 0").select("book_id", "path", F.posexplode("toc").alias("ord", "t")).select("book_id", "path", "ord", "t.*")
