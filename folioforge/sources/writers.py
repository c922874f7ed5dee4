"""Book files made from a table of sections: the export half of the readers in ``books``.

A file is built where its rows are; the result has the columns of Spark's ``binaryFile`` source that the
readers need, so it may be read at once or be written by any sink.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

FILES = "id long, path string, content binary"
_STAMP = (1980, 1, 1, 0, 0, 0)


def escaped(text: str | None) -> str:
    """Text for XML; signs that XML does not have go."""
    kept = "".join(c for c in text or "" if c >= " " or c in "\t\n")
    return kept.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def zipped(entries: list[tuple[str, bytes]], stored: bool = False) -> bytes:
    """A zip archive of entries in order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in entries:
            archive.writestr(zipfile.ZipInfo(name, _STAMP), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _page(title: str, paragraphs: list[str]) -> bytes:
    body = "".join(f"<p>{escaped(p)}</p>" for p in paragraphs)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escaped(title)}</title></head><body><h1 id="top">{escaped(title)}</h1>{body}</body></html>'.encode()


def epub(title: str, author: str, sections: list[tuple[str, list[str]]], stored: bool = False) -> bytes:
    """An EPUB with a page for each section and a contents document."""
    names = [f"text/s{k}.xhtml" for k in range(len(sections))]
    items = "".join(f'<item id="s{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    refs = "".join(f'<itemref idref="s{k}"/>' for k in range(len(names)))
    links = "".join(f'<li><a href="{n}#top">{escaped(t)}</a></li>' for n, (t, _) in zip(names, sections, strict=True))
    package = (
        f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="3.0"><metadata><dc:title>{escaped(title)}</dc:title><dc:creator>{escaped(author)}</dc:creator></metadata>'
        f'<manifest>{items}<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/></manifest><spine>{refs}</spine></package>'
    )
    nav = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    container = '<container version="1.0"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
    pages = [(f"OPS/{n}", _page(t, ps)) for n, (t, ps) in zip(names, sections, strict=True)]
    return zipped([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container.encode()), ("OPS/book.opf", package.encode()), ("OPS/nav.xhtml", nav.encode()), *pages], stored)


def fb2(title: str, author: str, sections: list[tuple[str, list[str]]], stored: bool = False) -> bytes:
    """A FictionBook with a section for each section."""
    body = "".join(f"<section><title><p>{escaped(t)}</p></title>{''.join(f'<p>{escaped(p)}</p>' for p in ps)}</section>" for t, ps in sections)
    info = f"<title-info><author><nickname>{escaped(author)}</nickname></author><book-title>{escaped(title)}</book-title></title-info>"
    return f'<?xml version="1.0" encoding="utf-8"?><FictionBook><description>{info}</description><body>{body}</body></FictionBook>'.encode()


def fbz(title: str, author: str, sections: list[tuple[str, list[str]]], stored: bool = False) -> bytes:
    """A FictionBook in an archive."""
    return zipped([("readme.txt", b"-"), ("book.fb2", fb2(title, author, sections))], stored)


def cbz(title: str, author: str, sections: list[tuple[str, list[str]]], stored: bool = False) -> bytes:
    """An archive with an image for each section, last first and in mixed case, and its description."""
    info = f"<ComicInfo><Title>{escaped(title)}</Title><Writer>{escaped(author)}, {escaped(author)} II</Writer></ComicInfo>"
    pages = [(f"{'Page' if k % 2 else 'pAGE'}{k:05d}.PNG", t.encode()) for k, (t, _) in enumerate(sections)]
    return zipped([*reversed(pages), ("notes.txt", b"-"), ("ComicInfo.xml", info.encode())], stored)


def packed(data: bytes) -> bytes:
    """One PalmDOC record: back references, a space with the letter after it, runs of other bytes."""
    out, run, i = bytearray(), bytearray(), 0
    last: dict[bytes, int] = {}

    def flush() -> None:
        for k in range(0, len(run), 8):
            out.append(len(run[k : k + 8]))
            out.extend(run[k : k + 8])
        run.clear()

    while i < len(data):
        at = last.get(data[i : i + 4])
        if len(data) - i >= 4:
            last[data[i : i + 4]] = i
        if at is not None and i - at < 2048:
            n = 4
            while n < 10 and i + n < len(data) and data[at + n] == data[i + n]:
                n += 1
            flush()
            out += struct.pack(">H", 0x8000 | (i - at) << 3 | (n - 3))
            i += n
            continue
        c = data[i]
        if c == 0x20 and i + 1 < len(data) and 0x40 <= data[i + 1] <= 0x7F:
            flush()
            out.append(data[i + 1] ^ 0x80)
            i += 2
        elif c == 0 or 9 <= c <= 0x7F:
            flush()
            out.append(c)
            i += 1
        else:
            run.append(c)
            i += 1
    flush()
    return bytes(out)


def mobi(title: str, author: str, sections: list[tuple[str, list[str]]], stored: bool = False) -> bytes:
    """A Mobipocket book of PalmDOC records, page breaks between sections, author and title in its header."""
    parts = ["".join([f"<h1>{escaped(t)}</h1>", *(f"<p>{escaped(p)}</p>" for p in ps)]) for t, ps in sections]
    text = "<mbp:pagebreak/>".join(parts).encode()
    chunks = [text[k : k + 4096] for k in range(0, len(text), 4096)]
    records = chunks if stored else [packed(c) for c in chunks]
    exth = b"".join(struct.pack(">II", kind, 8 + len(v)) + v for kind, v in ((100, author.encode()), (503, title.encode())))
    exth = b"EXTH" + struct.pack(">II", 12 + len(exth), 2) + exth
    head = struct.pack(">HHIHHI", 1 if stored else 2, 0, len(text), len(records), 4096, 0)
    # The header proper: its length, kind, encoding, and the flag that an EXTH block follows.
    own = b"MOBI" + struct.pack(">IIII", 232, 2, 65001, 0) + bytes(128 - 36) + struct.pack(">I", 0x40) + bytes(116)
    rows = [head + own + exth, *records]
    at, table = 78 + 8 * len(rows) + 2, b""
    for k, row in enumerate(rows):
        table += struct.pack(">II", at, 2 * k)
        at += len(row)
    name = title.encode("ascii", "replace")[:31].replace(b" ", b"_").ljust(32, b"\0")
    return name + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(rows)) + table + bytes(2) + b"".join(rows)


WRITERS: dict[str, Callable[..., bytes]] = {"epub": epub, "fb2": fb2, "fbz": fbz, "cbz": cbz, "mobi": mobi}


def book_files(books: DataFrame, kind: str, stored: bool = False, damage: Callable[[int, bytes], bytes] | None = None) -> DataFrame:
    """A file for each row ``id, title, author, sections array<struct<title,paragraphs>>``; ``damage`` may change its bytes."""
    write = WRITERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = [write(t, a, [(s["title"], list(s["paragraphs"])) for s in ss], stored) for t, a, ss in zip(frame["title"], frame["author"], frame["sections"], strict=True)]
            if damage:
                data = [damage(i, d) for i, d in zip(frame["id"], data, strict=True)]
            yield pd.DataFrame({"id": frame["id"], "path": [f"shelf/book{i}.{kind}" for i in frame["id"]], "content": data})

    return books.select("id", "title", "author", "sections").mapInPandas(run, FILES)
