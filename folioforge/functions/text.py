"""Column functions on text: headings, clipping, markers, markup, versions, offsets.

All are compositions of Spark's own functions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that end a sentence (fixed values).
TERMINALS = ".!?。！？…‥"
#: Symbols that stand for a list item by themselves (fixed values).
BULLETS = "•·●○▪‣◦∙"
#: Languages written in Latin letters, and in others (fixed values).
LATIN_LANGUAGES = (
    "af", "ca", "cs", "cy", "da", "de", "en", "es", "et", "eu", "fi", "fr", "ga", "gd", "gl", "hr", "hu", "id", "is", "it",
    "lt", "lv", "ms", "mt", "nl", "no", "pl", "pt", "ro", "sk", "sl", "sq", "sv", "sw", "tr", "vi",
)
OTHER_LANGUAGES = ("ar", "be", "bg", "el", "fa", "he", "hi", "mk", "ru", "sr", "th", "uk", "ur")
#: Code point ranges of CJK scripts, as a regular expression class (fixed values).
CJK = "\\x{1100}-\\x{11ff}\\x{2e80}-\\x{2fff}\\x{3040}-\\x{30ff}\\x{3130}-\\x{318f}\\x{31a0}-\\x{31ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{f900}-\\x{faff}\\x{20000}-\\x{2fa1f}"


def heading_key(text: Column) -> Column:
    """Lower case, letters and digits only; leading digits go if anything else remains."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    rest = F.regexp_replace(plain, r"^[0-9０-９]+", "")
    return F.when(rest != "", rest).otherwise(plain)


def headings_match(a: Column, b: Column) -> Column:
    """Equal keys, or one inside the other if both have four signs or more."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a)))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped(text: Column, most: int, mark: str = "...") -> Column:
    """At most ``most`` signs, with a mark if any are left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit(mark)))


def list_marker(text: Column) -> Column:
    """The list marker that a text begins with, else null."""
    found = F.regexp_extract(text, rf"^\s*([{BULLETS}]|[-*+](?=\s)|[0-9A-Za-z]{{1,6}}[.、)）](?=\s|$))", 1)
    return F.nullif(found, F.lit(""))


def kept_list_marker(source: Column, translation: Column) -> Column:
    """A translation with the list marker of its source, or with none if the source has none."""
    ours, theirs = list_marker(source), list_marker(translation)
    rest = F.ltrim(F.regexp_replace(translation, rf"^\s*([{BULLETS}]|[-*+](?=\s)|[0-9A-Za-z]{{1,6}}[.、)）](?=\s|$))", ""))
    return F.when(ours.isNull() & theirs.isNotNull(), rest).when(ours != theirs, F.concat(ours, F.lit(" "), rest)).otherwise(translation)


def entities_decoded(text: Column) -> Column:
    """The named entities of XML and the no-break space, decoded once; the ampersand last."""
    for entity, sign in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def xml_escaped(text: Column) -> Column:
    """Text for XML: ampersand first, then angle brackets."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def without_markup(html: Column) -> Column:
    """Text without tags, a space for each, entities decoded."""
    return entities_decoded(F.regexp_replace(html, r"<[^>]*>", " "))


def title_of_file(name: Column, blank: str = "untitled") -> Column:
    """The file's name without folders and last extension."""
    base = F.element_at(F.split(name, "/"), -1)
    stem = F.trim(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))
    return F.when(stem == "", F.lit(blank)).otherwise(stem)


def version(text: Column) -> Column:
    """A version of three numbers as a comparable struct, null for anything else."""
    part = lambda k: F.split_part(text, F.lit("."), F.lit(k)).cast("long")
    return F.when(F.regexp_like(text, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+$")), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def scaled_offset(offset: Column, of: Column, to: Column, up: bool) -> Column:
    """An offset in a text of length ``of``, carried to length ``to``; 0 for an empty text."""
    product = offset.cast("decimal(38,0)") * to.cast("decimal(38,0)")
    amount = product + (of - 1 if up else F.lit(0)) if up else product
    return F.when(of == 0, F.lit(0).cast("long")).otherwise(((amount - F.pmod(amount, of)) / of).cast("long"))


def byte_offset(text: Column, chars: Column) -> Column:
    """The UTF-8 byte offset of a code point offset."""
    return F.octet_length(F.left(text, chars)).cast("long")


def safe_name(name: Column) -> Column:
    """Whether a name in an archive stays below its root."""
    plain = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.split(plain, "/")
    return (plain != "") & ~F.startswith(plain, F.lit("/")) & ~F.contains(plain, F.lit(":")) & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def writing_system(language: Column, title: Column) -> Column:
    """``cjk``, ``latin``, ``other`` or ``unknown``, by the language's tag, else by most of the title's letters."""
    tag = F.lower(F.replace(F.trim(language), F.lit("_"), F.lit("-")))
    subtags = F.split(tag, "-")
    rest = F.slice(subtags, 2, 99)
    first = F.element_at(subtags, 1)
    by_tag = (
        F.when(first.isin("", "und"), F.lit(None))
        .when(F.exists(rest, lambda s: s.isin("hans", "hant", "jpan", "kore")), "cjk")
        .when(F.array_contains(rest, "latn"), "latin")
        .when(first.isin("zh", "ja", "ko"), "cjk")
        .when(first.isin(*LATIN_LANGUAGES), "latin")
        .when(first.isin(*OTHER_LANGUAGES), "other")
    )
    count = lambda p: F.length(F.regexp_replace(title, f"[^{p}]", ""))
    c, n = count(CJK), count(r"\p{IsLatin}")
    by_title = F.when(c + n < 2, "unknown").when(c * 100 >= (c + n) * 60, "cjk").when(n * 100 >= (c + n) * 60, "latin").otherwise("unknown")
    return F.coalesce(by_tag, by_title)


def resource_path(url: Column) -> Column:
    """A URL's path, without scheme, host, query and fragment."""
    plain = F.regexp_replace(F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(plain, r"^/+", "")


def url_fragment(url: Column) -> Column:
    """What follows the first ``#``, null if there is none."""
    return F.when(F.contains(url, F.lit("#")), F.regexp_extract(url, r"#(.*)$", 1))


def normal_path(path: Column) -> Column:
    """A path with ``.`` and ``..`` resolved; null if it leaves its root, or is absolute or external."""

    def step(stack: Column, part: Column) -> Column:
        up = F.when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        return F.when(part.isin("", "."), stack).when(part == "..", up).otherwise(F.concat(stack, F.array(part)))

    stack = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    bad = F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")) | F.regexp_like(path, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:"))
    return F.when(~bad & (F.size(stack) > 0), F.array_join(stack, "/"))


def let(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``, which is so computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(numbers: Column) -> Column:
    """For each member of an array of integers the sum of those before it.

    The array is summed in blocks of about its square root, so that no array grows member by member: the work
    is n to the power 1.5 in the worst case and needs no shuffle.
    """

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        firsts = F.sequence(F.lit(0), F.size(a) - 1, width)
        within = lambda block: F.transform(block, lambda _, i: total(F.slice(block, F.lit(1), i)))
        blocks = lambda: F.transform(firsts, lambda f: F.slice(a, f + 1, width))
        return let(blocks(), lambda b: let(F.transform(b, total), lambda sums: F.flatten(F.transform(b, lambda block, k: let(total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(within(block), lambda x: x + base))))))

    return let(numbers, lambda a: F.when(F.size(a) == 0, a).otherwise(of(a)))


def match_spans(text: Column, pattern: str) -> Column:
    """An array of ``start, end, matched`` (code points, end exclusive) of leftmost non-overlapping matches.

    A match starts after all pieces and matches before it, so sums of their lengths give positions.
    """
    empty = F.array().cast("array<struct<start:int,end:int,matched:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x: F.length(x))
        steps = lambda g: F.zip_with(g, m, lambda n, x: n + F.length(x))
        begins = lambda g: F.zip_with(sums_before(steps(g)), g, lambda s, n: s + n)
        return let(gaps, lambda g: F.zip_with(begins(g), m, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("matched"))))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(found, placed)).otherwise(empty)


def excerpt(text: Column, start: Column, end: Column, context: int = 72) -> Column:
    """The match with its surroundings, trimmed, with an ellipsis on each side that is cut."""
    a, b = F.greatest(start - context, F.lit(0)), F.least(end + context, F.length(text))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.trim(F.substring(text, a + 1, b - a)), F.when(b < F.length(text), "…").otherwise(""))
