"""Quality rules: counted base rules and a hashed n-gram log-likelihood ratio.

Texts are cut into runs of letters and digits and runs of other signs. Unigrams
and bigrams of these are hashed into a fixed number of buckets. Two multinomials
over the buckets, one of trusted documents and one of the whole corpus, give a
weight for each bucket, log p_trusted - log p_corpus. A document's score is the
mean weight of its n-grams, so length cancels; at or above a fixed threshold it
is kept. Everything on this path is built from Spark's own expressions.

Defined cases: null text has no words; a text without n-grams scores 0; a null id is
never trusted, and its row is judged like any other; a very long text is one row and is
judged as a whole; extra columns play no part, whatever their names, and rows that repeat
are judged alike; a score equal to the threshold is kept; an empty corpus gives an empty
result, and an empty trusted set gives weights of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import column, free_name, text_or_empty, words_of

#: Runs of letters, digits and underscores; runs of anything else but white space.
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SYMBOLS = "#*$%&|<>"
#: Trusted ids are counted first and sent to all executors up to this number (some 100 bytes each, so 10 MB),
#: else they meet the documents in a join that sorts and may spill.
BROADCAST_IDS = 100_000


def let(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``, which is so computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words in ``width``-word windows that occur twice or more in the array, first ones included.

    Window hashes are sorted with their positions; equal neighbours mark repeats, and the
    length of the union of the marked windows follows from the gaps between their starts.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda s, i: F.coalesce(F.least(F.lit(width), F.get(starts, i + 1) - s), F.lit(width))), F.lit(0), lambda a, x: a + x)

    def marked(pairs: Column) -> Column:
        same = lambda p, i: F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, same), lambda p: p["i"]))

    def of(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, lambda p: let(marked(p), covered)))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))

    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), of))).cast("long")


def base_measures(text: Column) -> Column:
    """A struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def ngram_buckets(text: Column, buckets: int) -> Column:
    """The buckets of a text's unigrams and bigrams."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t))
    put = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    pairs = lambda h: F.transform(F.filter(h, lambda x, i: i > 0), lambda x, i: put(F.xxhash64(F.get(h, i), x)))
    return let(hashes, lambda h: F.concat(F.transform(h, put), pairs(h)))


def _flag_trusted(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``text`` of all documents, and whether their ids are ``trusted``."""
    ids = trusted.select(F.col(id_col).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids.hint("merge")
    own = docs.select(column(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return own.join(ids, own["id"] == ids["trusted_id"], "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, prior: float) -> list[float]:
    """Log-likelihood ratios by bucket, from counts over all documents.

    ``prior`` is the number of n-grams that each bucket is taken to have in common,
    which pulls rare buckets to 0. The result has ``buckets`` numbers at any corpus size.
    """
    flagged = _flag_trusted(docs, trusted, id_col, text_col)
    grams = flagged.select("trusted", F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("good")).collect()
    all_raw, all_good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    weights = [0.0] * buckets
    if all_good:
        for r in counts:
            weights[r["bucket"]] = math.log((r["good"] + prior) / (r["raw"] * all_good / all_raw + prior))
    return weights


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = 16384, prior: float = 8.0, threshold: float = -0.1, min_words: int = 20, max_repeat_percent: int = 30,
) -> DataFrame:
    """All columns of ``docs``, then a struct ``_quality`` (with underscores before it if that is taken) of measures,
    ``base_failed``, ``llr`` and ``kept``.

    ``trusted`` holds the ids of the trusted documents; the target multinomial is counted over all of them.
    """
    weights = bucket_weights(docs, trusted, id_col, text_col, buckets, prior)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    text = text_or_empty(text_col)
    score = let(ngram_buckets(text, buckets), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(g)))
    measured = let(
        F.struct(base_measures(text).alias("m"), score.alias("llr")),
        lambda s: F.struct(
            s["m"]["n_words"].alias("n_words"), s["m"]["word_chars"].alias("word_chars"), s["m"]["n_symbols"].alias("n_symbols"),
            s["m"]["n_dup_lines"].alias("n_dup_lines"), s["m"]["n_repeat_words"].alias("n_repeat_words"), s["llr"].alias("llr"),
            ((s["m"]["n_words"] < min_words) | (100 * s["m"]["n_repeat_words"] > max_repeat_percent * s["m"]["n_words"])).alias("base_failed"),
        ),
    )
    inner = free_name(docs, "_judged")
    flat = [F.col(inner)["s"][x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr")]
    judged = let(measured, lambda s: F.struct(s.alias("s"), (~s["base_failed"] & (s["llr"] >= threshold)).alias("kept")))
    return docs.select("*", judged.alias(inner)).select(*[column(c) for c in docs.columns], F.struct(*flat, F.col(inner)["kept"].alias("kept")).alias(free_name(docs, "_quality")))
