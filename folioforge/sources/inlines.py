"""Inline content: runs with style, links, formulas and footnotes; quotes with attributions; a sanitiser for recognised pages."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

from folioforge.functions.markdown import trimmed_math
from folioforge.sources import css

#: What a tag does to the style of its text (fixed values).
STYLES = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "sup": "superscript", "sub": "subscript", "small": "small", "big": "big"}
_SKIPPED = ("img", "script", "style")
_VOID = {"br", "img", "hr", "input", "wbr"}
RUNS = "array<struct<kind:string,text:string,styles:array<string>,href:string>>"


class InlineParser(HTMLParser):
    """Runs ``kind, text, styles, href`` of an element's inline content; white space collapses as in a paragraph."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[dict] = []
        self._stack: list[tuple[str, str | None, str | None]] = []  # tag, what it means, its value
        self._blank = True  # whether a blank would be the first sign or follow another

    def _of(self, what: str) -> list[str]:
        return [v for _, k, v in self._stack if k == what]

    def handle_starttag(self, tag: str, attrs) -> None:
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        if tag == "br":
            self._trim()
            self.runs.append({"kind": "break", "text": "\n", "styles": [], "href": None})
            self._blank = True
            return
        if tag in _VOID:
            return
        what, value = None, None
        if tag in _SKIPPED:
            what = "skip"
        elif tag in STYLES:
            what, value = "style", STYLES[tag]
        elif tag == "a" and own.get("href"):
            what, value = "href", own["href"]
        elif tag == "span" and "math" in classes:
            what, value = "math", "math"
        elif tag == "span" and {"footnote", "footnote1"} & set(classes):
            what, value = "style", "footnote"
        self._stack.append((tag, what, value))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self._stack):
            while self._stack and self._stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._of("skip") or any(k == "skip" for _, k, _ in self._stack):
            return
        if self._of("math"):
            self._put("math", data.strip())
            self._blank = False
            return
        text = re.sub(r"\s+", " ", data)
        if self._blank:
            text = text.removeprefix(" ")
        if text:
            self._blank = text.endswith(" ")
            self._put("text", text)

    def _put(self, kind: str, text: str) -> None:
        styles, href = list(dict.fromkeys(self._of("style"))), next(reversed(self._of("href")), None)
        last = self.runs[-1] if self.runs else None
        if last and last["kind"] == kind == "text" and last["styles"] == styles and last["href"] == href:
            last["text"] += text
        elif text:
            self.runs.append({"kind": kind, "text": text, "styles": styles, "href": href})

    def _trim(self) -> None:
        while self.runs and self.runs[-1]["kind"] == "text":
            self.runs[-1]["text"] = self.runs[-1]["text"].rstrip(" ")
            if self.runs[-1]["text"]:
                return
            self.runs.pop()


def inline_runs(html: str) -> list[dict]:
    """The runs of one paragraph's markup."""
    parser = InlineParser()
    parser.feed(html)
    parser.close()
    parser._trim()
    return parser.runs


def runs_text(runs: list[dict]) -> str:
    """Plain text of runs: formulas as their source, breaks as new lines."""
    return "".join(r["text"] for r in runs)


class _Children(HTMLParser):
    """The children of the outermost element: ``tag, attributes, inner markup``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.children: list[dict] = []
        self._depth = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self._depth == 1:
            self.children.append({"tag": tag, "attributes": dict(attrs), "html": ""})
        elif self._depth > 1:
            self.children[-1]["html"] += self.get_starttag_text()
        if tag not in _VOID:
            self._depth += 1

    def handle_endtag(self, tag: str) -> None:
        self._depth -= 1
        if self._depth > 1:
            self.children[-1]["html"] += f"</{tag}>"

    def _data(self, data: str) -> None:
        if self._depth > 1:
            self.children[-1]["html"] += data

    def handle_data(self, data: str) -> None:
        self._data(data)

    def handle_entityref(self, name: str) -> None:
        self._data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._data(f"&#{name};")


def children_of(html: str) -> list[dict]:
    """The child elements of a markup's one outer element."""
    parser = _Children()
    parser.feed(html)
    parser.close()
    return parser.children


def quote(html: str, sheet: str = "") -> dict:
    """``body`` paragraphs and ``attribution`` of a block quote: its last child if that is a ``cite`` or a ``footer``, or is set to the end of the line beside others."""
    rules, children = css.parse(sheet), children_of(html)
    last = children[-1] if children else None
    attribution = None
    if last and (last["tag"] in ("cite", "footer") or (len(children) > 1 and css.is_end_aligned(css.cascaded(rules, last["tag"], last["attributes"])))):
        attribution = runs_text(inline_runs(last["html"]))
        children = children[:-1]
    return {"body": [t for t in (runs_text(inline_runs(c["html"])) for c in children) if t.strip()], "attribution": attribution}


def figure(html: str) -> dict | None:
    """Images and caption of a figure, and whether the caption comes first; None where it is just a container."""
    children = children_of(html)
    captions = [k for k, c in enumerate(children) if c["tag"] in ("figcaption", "caption")]
    images = [(k, c) for k, c in enumerate(children) if c["tag"] == "img"]
    if not images or any(re.search(r"(?i)<(?:figure|img|table)\b", children[k]["html"]) for k in captions):
        return None
    caption = " ".join(filter(None, (runs_text(inline_runs(children[k]["html"])) for k in captions)))
    return {
        "images": [{"src": c["attributes"].get("src"), "alt": c["attributes"].get("alt") or ""} for _, c in images], "caption": caption or None,
        "caption_first": bool(captions) and captions[0] < images[0][0],
    }


#: Tags that recognised pages may keep, and the alignments of their text (fixed values).
KEPT_TAGS = ("div", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "br")
ALIGNMENTS = ("left", "start", "center", "right", "end")
RESOURCES = "OcrResources/"


class _Sanitiser(HTMLParser):
    """Writes kept tags anew with the attributes that are safe; every other tag is one blank."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "img":
            self.out.append(self._image(own))
        elif tag == "br":
            self.out.append("<br />")
        elif tag in KEPT_TAGS:
            self.out.append(f"<{tag}{self._spans(tag, own)}{self._aligned(tag, own)}>")
        else:
            self.out.append(" ")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        self.out.append(f"</{tag}>" if tag in KEPT_TAGS and tag != "br" else " ")

    def handle_data(self, data: str) -> None:
        parts = re.split(r"((?<!\\)\$\$[^$]+?(?<!\\)\$\$|(?<![\\$])\$(?!\$)[^$]+?(?<!\\)\$(?!\$))", trimmed_math(data))
        for k, part in enumerate(parts):
            if k % 2 == 0:
                self.out.append(escape(part, quote=False))
            else:
                wide = part.startswith("$$")
                self.out.append(f'<span class="math math-{"display" if wide else "inline"}">{escape(part.strip("$").strip(), quote=False)}</span>')

    @staticmethod
    def _spans(tag: str, own: dict) -> str:
        good = [(k, own[k].strip()) for k in ("rowspan", "colspan") if k in own] if tag in ("td", "th") else []
        return "".join(f' {k}="{int(v)}"' for k, v in good if v.isascii() and v.isdigit() and 1 <= int(v) <= 64)

    @staticmethod
    def _aligned(tag: str, own: dict) -> str:
        if tag not in ("div", "td", "th"):
            return ""
        align = (dict(css.declarations(own.get("style", ""))).get("text-align") or own.get("align", "")).strip().lower()
        return f' style="text-align:{align}"' if align in ALIGNMENTS else ""

    @staticmethod
    def _image(own: dict) -> str:
        name = re.fullmatch(rf"(?:\.\.?/)?{RESOURCES}([A-Za-z0-9._-]+)", own.get("src", "").strip().replace("\\", "/"))
        if not name or name.group(1) in (".", ".."):
            return ""
        size = "".join(f' {k}="{own[k].strip()}"' for k in ("width", "height") if re.fullmatch(r"\s*\d{1,5}(?:\.\d+)?(?:px|%)?\s*", own.get(k, "")))
        alt = f' alt="{escape(own["alt"])}"' if "alt" in own else ""
        return f'<img src="../{RESOURCES}{name.group(1)}"{alt}{size} />'


def sanitised(html: str) -> str:
    """Markup of a recognised page with nothing but listed tags, safe attributes and formulas."""
    parser = _Sanitiser()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


_EMPTY = re.compile(r"(?i)<(area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b([^<>]*?)\s*/?>")


def as_xhtml(html: str) -> str:
    """HTML with its empty elements closed and no-break spaces as numbers, so that an XML parser takes it."""
    return _EMPTY.sub(lambda m: f"<{m.group(1)}{m.group(2)}/>", html).replace("&nbsp;", "&#160;")


_MARKER = re.compile(r"^\s*(?:[•·●○▪‣◦∙*–-]|\(?[0-9]{1,3}[.)]|[A-Za-z][.)])\s*")


def paragraph_items(html: str) -> list[dict]:
    """``text, depth`` of paragraphs that are list items by their ``span.enumerator``; depths by a stack of indents, equal within 4."""
    out, indents = [], []
    for child in children_of(html):
        found = re.search(r"""<span\b[^>]*class\s*=\s*["'][^"']*\benumerator\b[^"']*["'][^>]*>(.*?)</span>""", child["html"], re.DOTALL)
        if child["tag"] != "p" or not found:
            indents = []
            continue
        style = css.cascaded([], "p", child["attributes"])
        at = float((re.match(r"-?[0-9.]+", style.get("margin-left", "0")) or ["0"])[0])
        while indents and at < indents[-1] - 4:
            indents.pop()
        if not indents or at > indents[-1] + 4:
            indents.append(at)
        text = runs_text(inline_runs(child["html"].replace(found.group(), "", 1)))
        out.append({"text": _MARKER.sub("", text) if not found.group(1).strip() else text, "depth": len(indents) - 1})
    return out
