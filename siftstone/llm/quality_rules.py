"""Quality rules: word statistics and a hashed n-gram log-likelihood ratio, by built-in functions only.

Statistics of each whole text: words, code points in words, symbols, repeated lines, words in
5-word windows that come twice or more.

Ratio. The n-grams of a text are its words and its pairs of neighbouring words, at every place; each
kind is hashed into a fixed number of bins. Counts over the trusted texts and over the whole corpus
give two multinomials (add-SMOOTHING), and a text's score is the mean over all its n-grams of the log
of trusted over raw. A text is kept if it passes the base rules and its score is at least
THRESHOLD; the same text always gets the same verdict.

Rows: null text is empty, has no words, fails and is not kept. Labels that are missing or null trust
nothing; rows that share an id are trusted together. Without trusted texts (an empty table) all
ratios are 0. Repeated rows get equal results, extra columns are not looked at, and texts are
read whole however long they are. Windows are told apart by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native

WORD_BINS = 8192
PAIR_BINS = 16384
SMOOTHING = 1.0
#: See the README for how it was chosen.
THRESHOLD = -0.1
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _bins(words: str) -> Column:
    """The bins of the words' hashes, then of the pairs' (from WORD_BINS on)."""
    one = F.transform(words, lambda h: F.pmod(h, F.lit(WORD_BINS)).cast("int"))
    two = native.rolling(words, 2, lambda at: F.pmod(F.xxhash64(at(0), at(1)), F.lit(PAIR_BINS)) + WORD_BINS)
    return F.concat(one, two.cast("array<int>"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The log ratio of every bin, words' first, from all documents; trusted holds distinct ids (id)."""
    rows = native.marked(docs.select(F.col(id_col).alias("doc"), native.whole(text_col).alias("text")), "doc", trusted, "is_trusted")
    hashed = rows.select("is_trusted", native.words(F.col("text")).alias("w")).select("is_trusted", native.hashes("w").alias("h"))
    found = hashed.select("is_trusted", F.explode(_bins("h")).alias("bin")).groupBy("bin").agg(F.count("*").alias("raw"), F.count_if("is_trusted").alias("good")).collect()
    out = []
    for low, high in ((0, WORD_BINS), (WORD_BINS, WORD_BINS + PAIR_BINS)):
        raw, good = [SMOOTHING] * (high - low), [SMOOTHING] * (high - low)
        for r in found:
            if low <= r["bin"] < high:
                raw[r["bin"] - low] += r["raw"]
                good[r["bin"] - low] += r["good"]
        all_raw, all_good = sum(raw), sum(good)
        any_good = all_good > (high - low) * SMOOTHING
        out += [round(math.log(g / all_good) - math.log(r / all_raw), 6) if any_good else 0.0 for g, r in zip(good, raw, strict=True)]
    return out


def statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the hashes of the words (`_h`)."""
    keep = rows.columns
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = rows.withColumn("_words", native.words(t)).withColumn("_lines", lines)
    df = df.withColumn("_h", native.hashes("_words"))
    df = df.withColumn("_g", native.rolling("_h", WINDOW, lambda at: F.xxhash64(*(at(k) for k in range(WINDOW)))))
    df = df.withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    # windows sorted by hash, each with its place in the low bits
    bits = F.ceil(F.log2(F.size("_g") + 1)).cast("int")
    df = df.withColumn("_bits", bits)
    none = F.array().cast("array<bigint>")
    packed = F.transform("_g", lambda x, i: F.call_function("shiftleft", x, F.col("_bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(packed)).otherwise(none))
    place = F.transform("_sorted", lambda v: v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int"))
    df = df.withColumn("_place", place)

    def same(i: Column, k: Column) -> Column:
        return F.coalesce(F.get(F.col("_g"), i) == F.get(F.col("_g"), F.get(F.col("_place"), k)), F.lit(False))

    df = df.withColumn("_twice", F.sort_array(F.filter("_place", lambda i, k: same(i, k - 1) | same(i, k + 1))))
    covered = F.aggregate("_twice", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda acc: acc["n"].cast("long"))
    return df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        "_h",
    )


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of each row."""
    ratios = native.constants(log_ratios(docs, trusted, id_col, text_col))
    rows = statistics(docs.select(F.col(id_col).alias("doc_id"), native.whole(text_col).alias("text")))
    total = F.aggregate(_bins("_h"), F.lit(0.0), lambda acc, k: acc + F.get(ratios, k))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.withColumn("base_failed", failed).withColumn("score", F.when(F.col("n_words") > 0, F.round(total / (2 * F.col("n_words") - 1), 6)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*names, (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
