"""Secret scan by corpus-wide ownership frequency, from Spark's own expressions only.

Three base patterns give spans that always stay. Beside them, long runs of letters and
digits, values behind the prefixes of known issuers, and quoted values are candidates if they
have the look of a credential: letters, three digits, and eight different signs. The values of all
candidates, base ones too, are hashed and counted over the whole corpus: in how many distinct
repositories and owners does a value occur? A value of many owners, or of many repositories
whoever owns them, is an example that people copy; any other is taken for live. Live candidates that
no base span touches are added as spans of the kind ``owned``; the verdict on base spans is
given as counts.

Positions come from cutting the text at the pattern: a match starts after all pieces and
matches before it. They count code points; ends are exclusive.

Defined cases: null text counts as empty; a very long text is scanned as a whole; a null owner or
repository is one like any other; rows that repeat are one owner's; null ids keep their row; extra
columns play no part, whatever their names; a value with just as many owners or repositories as an
example needs is one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import column, cut, text_or_empty
from folioforge.llm.quality_rules import let

#: The base kinds in their order: pattern, group of the value, and its least length (fixed values).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Cheap tests that hold for every text with a match that counts.
_MAY_HAVE = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"(?<![0-9a-f])[0-9a-f]{24}"}
ADDED = "owned"
#: Prefixes that issuers put before their keys (fixed values).
PREFIXES = ("sk", "pk", "rk", "ghp", "gho", "ghu", "ghs", "ghr", "glpat", "xoxa", "xoxb", "xoxp", "xoxr", "xoxs", "npm", "pypi", "hf")
#: A prefixed value, a maximal run of the signs of credentials, or a quoted value.
CANDIDATE = rf"""(?<![A-Za-z0-9+/_=-])(?:(?:{"|".join(PREFIXES)})[_-][A-Za-z0-9_-]{{12,}}|[A-Za-z0-9+/_=-]{{16,}})|(?<=["'])[^"'\s]{{12,}}(?=["'])"""
LEAST = 12


def sums_before(lengths: Column) -> Column:
    """For an array of integers, the sum of all members before each one.

    The array is cut into about as many chunks as a chunk has members, so the work is
    n to the power 1.5 where a plain running sum of growing arrays takes n squared.
    """

    def of(a: Column) -> Column:
        chunk = F.ceil(F.sqrt(F.size(a))).cast("int")
        at = F.sequence(F.lit(0), F.size(a) - 1, chunk)
        total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
        running = lambda x, first: F.slice(F.aggregate(x, F.array(first), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v))), F.lit(1), F.size(x))
        chunks = F.transform(at, lambda i: F.slice(a, i + 1, chunk))
        bound = lambda c: let(running(F.transform(c, total), F.lit(0)), lambda firsts: F.flatten(F.zip_with(c, firsts, running)))
        return F.when(F.size(a) == 0, a).otherwise(let(chunks, bound))

    return let(lengths, of)


def spans(text: Column, pattern: str, group: int, least: int, rank: int, may_have: str | None) -> Column:
    """An array of ``start, rank, end, value`` of the leftmost non-overlapping matches that count."""
    p = F.lit(pattern)

    def made(found: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        gaps = lambda cuts: F.transform(found, lambda m, i: F.struct((F.get(cuts, i) + F.length(m["m"])).alias("step"), F.get(cuts, i).alias("gap")))
        put = lambda g: F.zip_with(found, F.zip_with(sums_before(F.transform(g, lambda x: x["step"])), g, lambda b, x: b + x["gap"]), lambda m, s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m["m"])).alias("end"), m["v"].alias("value")))
        return F.filter(let(let(pieces, gaps), put), lambda x: F.length(x["value"]) >= least)

    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    matches = F.zip_with(whole, value, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(may_have or pattern)), let(matches, made)).otherwise(none)


def _looks_secret(value: Column) -> Column:
    """Letters, three digits and eight different signs; where there is a slash, as in paths, letters of both cases."""
    has = lambda p: F.regexp_like(value, F.lit(p))
    return has("[A-Za-z]") & has("(?:[0-9][^0-9]*){3}") & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & (~has("/") | (has("[A-Z]") & has("[a-z]")))


def _joined(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(ADDED))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, repository: list[str], owner: str, id_col: str = "doc_id", text_col: str = "text", example_owners: int = 3, example_repositories: int = 6) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and counts of live and example values.

    ``repository`` and ``owner`` name columns; a value of at least ``example_owners`` owners, or of at least
    ``example_repositories`` repositories, is an example; any other is its owners' own.
    """
    text = text_or_empty(text_col)
    base = F.sort_array(F.concat(*[spans(text, pattern, group, least, rank, _MAY_HAVE.get(kind)) for rank, (kind, pattern, group, least) in enumerate(BASE)]))
    other = F.filter(spans(text, CANDIDATE, 0, LEAST, len(BASE), None), lambda x: _looks_secret(x["value"]))
    scanned = docs.select(
        column(id_col).cast("long").alias("doc_id"), column(owner).cast("string").alias("owner"), F.to_json(F.struct(*[column(c) for c in repository])).alias("repository"),
        let(F.struct(base.alias("base"), other.alias("other")), lambda s: F.struct(
            s["base"].alias("base"),
            F.filter(s["other"], lambda c: ~F.exists(s["base"], lambda b: (c["start"] < b["end"]) & (c["end"] > b["start"]))).alias("other"),
        )).alias("found"),
    )
    hashed = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.md5(x["value"].cast("binary")).alias("hash")))
    rows = cut(scanned.select("doc_id", "owner", "repository", hashed(F.col("found.base")).alias("base"), hashed(F.col("found.other")).alias("other")).withColumn("rid", F.monotonically_increasing_id()), "secrets")

    candidates = rows.select("rid", "owner", "repository", F.explode(F.concat("base", "other")).alias("c")).select("rid", "owner", "repository", "c.*")
    by_repository = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    frequency = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = candidates.select("rid", "start", "rank", "end", "hash").join(frequency, "hash")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    verdicts = judged.groupBy("rid").agg(
        F.collect_list(F.when((F.col("rank") == len(BASE)) & ~example, F.struct("start", "rank", "end"))).alias("added"),
        F.count_if(~example).alias("n_live"), F.count_if(example).alias("n_example"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    no_spans = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return rows.join(verdicts, "rid", "left").select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)],
        F.sha2(_joined(plain), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat(plain, F.coalesce("added", no_spans)))).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories")],
    )
