"""Hashed n-gram log-likelihood ratio between trusted text and the raw corpus, beside plain rules. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import WORD_BREAKS, bind, free_name, keyed_text, pieces_of, written

#: cells that words and pairs of words are hashed to
CELLS = 1 << 16  # a power of two
#: added to every cell's trusted count, and to the count that trusted text would have if it were like all text: what the trusted
#: rows happen not to hold says little, what they should hold often and don't says much
PRIOR = 10.0
#: trusted rows that the target model is fitted on, at most; the raw model counts every document
TRUSTED_ROWS = 50_000
#: documents below this mean log ratio go
LEAST_RATIO = -0.1
#: fixed values of the base rules
LEAST_WORDS, MOST_REPEATED = 50, 50
#: windows of a text below which a window's hash and place are packed into one number
PACKED = 4096
SYMBOLS = "#*$%&|<>"


def _shifted(x: Column, places: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, places)


def _neighbours(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Array of `combine` for each element and the one after it."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), combine)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text has twice or more, the first included.

    A window is a mix of its words' 64-bit hashes. Sorted with their places, equal windows are neighbours. In a text of less than PACKED
    windows each becomes its hash with its place in the lowest bits, told apart by the 52 or more bits left; in longer ones whole hashes
    are compared.
    Every intermediate array is bound to a lambda's variable, so that no rewriting of the plan can put its making inside a loop.
    """

    # two words' places, together in one number
    both = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32))

    def exact(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p"))))
        met = lambda a, b: F.when(a["h"] == b["h"], a["p"] * both + b["p"])
        return bind(marked, lambda m: F.filter(_neighbours(m, met), lambda x: x.isNotNull()))

    def packed(windows: Column) -> Column:
        bits = F.ceil(F.log2(F.size(windows) + F.lit(2))).cast("int")
        marked = F.sort_array(F.transform(windows, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        met = lambda a, b: F.when(_shifted(a.bitwiseXOR(b), bits) == 0, a.bitwiseAND(mask) * both + b.bitwiseAND(mask))
        return bind(marked, lambda m: F.filter(_neighbours(m, met), lambda x: x.isNotNull()))

    def places(windows: Column) -> Column:
        return bind(
            F.when(F.size(windows) < PACKED, packed(windows)).otherwise(exact(windows)),
            lambda p: F.sort_array(
                F.array_distinct(F.concat(F.transform(p, lambda x: _shifted(x, F.lit(32))), F.transform(p, lambda x: x.bitwiseAND(both - 1))))
            ),
        )

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["upto"])).alias("n"), (p + 3).alias("upto"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    mixed = lambda by: lambda a, b: _shifted(a, F.lit(by)).bitwiseXOR(b)  # noqa: E731  other shifts, so that no word falls out
    windows = bind(hashes, lambda h: bind(_neighbours(h, mixed(7)), lambda two: _neighbours(two, mixed(11))))
    none = F.lit(0).cast("long")
    return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(covered(places(w))))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WORD_BREAKS)) != "")
    return bind(
        pieces_of(text),  # one more than blanks
        lambda pieces: bind(
            F.array_remove(pieces, ""),
            lambda words: F.struct(
                F.size(words).cast("long").alias("n_words"),
                (F.length(text) - F.size(pieces) + 1).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
                bind(lines, lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("long")).alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
            ),
        ),
    )


def cells(text: Column) -> Column:
    """Where the text's words and pairs of words fall. Runs of symbols are words of their own; case counts."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
    cell = lambda h: h.bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int")
    return bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.concat(
            F.transform(hashes, cell),
            _neighbours(hashes, lambda a, b: cell(_shifted(a, F.lit(7)).bitwiseXOR(b))),
        ),
    )


def ratio_table(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, one array `ratios`: for each cell, log of its share in trusted text over its share in all text."""
    counted = []
    for kind, rows in (("raw", texts), ("good", trusted)):
        fallen = rows.select(F.explode_outer(cells(F.coalesce(F.col("text"), F.lit("")))).alias("cell"))
        n = {kind: F.col("n"), ("good" if kind == "raw" else "raw"): F.lit(0).cast("long")}
        counted.append(fallen.groupBy("cell").agg(F.count("cell").alias("n")).select("cell", *(n[k].alias(k) for k in ("raw", "good"))))
    spark = texts.sparkSession
    every = spark.range(CELLS).select(F.col("id").cast("int").alias("cell"), *(F.lit(0).cast("long").alias(c) for c in ("raw", "good")))
    sums = counted[0].unionByName(counted[1]).filter("cell IS NOT NULL").unionByName(every)
    sums = sums.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    # CELLS entries, whatever the corpus
    held = sums.agg(
        F.sort_array(F.collect_list(F.struct("cell", "raw", "good"))).alias("cells"), F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good")
    )
    return held.select(
        F.transform(
            "cells",
            lambda c: F.when(
                F.col("all_good") > 0,
                F.log(c["good"] + PRIOR) - F.log(c["raw"] * F.col("all_good") / F.col("all_raw") + PRIOR),
            ).otherwise(0.0),
        ).alias("ratios")
    )


def trusted_texts(texts: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TRUSTED_ROWS) -> DataFrame:
    """Texts of the labelled good rows of smallest hash, `rows` at most: so few that every executor may hold their keys."""
    good = labels.filter(F.col(label) == 1).select(F.col(key).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    chosen = good.orderBy(F.xxhash64(F.lit("trusted"), "doc_id"), "doc_id").limit(rows)
    return texts.join(F.broadcast(chosen), "doc_id", "left_semi")


def quality_rules(
    docs: DataFrame, trusted: DataFrame, least_ratio: float = LEAST_RATIO, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept: a row per document.

    `ratio` is the mean over the text's words and pairs of words of log(share in trusted text / share in all text); a document is
    kept if the base rules pass and the ratio is at least `least_ratio`. `trusted`: a table with a column `text`.

    Null, empty and wordless texts: no words, so base_failed. Null and repeated keys: each row is judged. Without trusted
    text every ratio is 0. Empty table: no rows. Nothing is shuffled but counts of cells.
    """
    texts = keyed_text(docs, key, text)
    rows = texts.withColumn("ratios", _ratios(texts, trusted)).select("doc_id", _verdict(F.col("text"), F.col("ratios"), least_ratio).alias("verdict"))
    return rows.select("doc_id", "verdict.*")


def keep_good(docs: DataFrame, trusted: DataFrame, least_ratio: float = LEAST_RATIO, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `quality_rules` keeps. Null, empty and wordless texts go; each of repeated rows and of
    rows with a null key is judged by its text. Empty table: no rows. Columns may have any name."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ratios = free_name(docs, "ratios")
    rows = docs.withColumn(ratios, _ratios(texts, trusted))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.filter(_verdict(whole, F.col(ratios), least_ratio)["kept"]).drop(ratios)


def _ratios(texts: DataFrame, trusted: DataFrame) -> Column:
    return written(ratio_table(texts, trusted), "ratios").scalar()


def _verdict(text: Column, ratios: Column, least_ratio: float) -> Column:
    """Struct of the counts, base_failed, ratio and kept."""
    ratio = bind(
        cells(text), lambda own: F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, c: a + ratios[c]) / F.size(own)).otherwise(0.0)
    )

    def verdict(base: Column) -> Column:
        failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
        counts = [base[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return bind(
            ratio,
            lambda r: F.struct(*counts, failed.alias("base_failed"), r.alias("ratio"), (~failed & (r >= least_ratio)).alias("kept")),
        )

    return bind(base_counts(text), verdict)
