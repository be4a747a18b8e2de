"""Quality rules: counts of a document, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Words and pairs of words are hashed into ``buckets``. Two multinomials over the buckets, one from the trusted
documents and one from the whole raw corpus, give each n-gram a log ratio; a document's verdict is the mean ratio of
its n-grams against a fixed threshold. Built from DataFrame functions alone.

Scale: the text is read twice. All trusted documents are counted: their ids meet the documents in a sort-merge join,
which shuffles the text once, at every size alike. The corpus counts are one aggregation with at most ``buckets`` keys;
the model is ``buckets`` numbers, which enter the second pass as a constant. Both passes explode a document into its
n-grams inside generated code and add up before anything is shuffled: a document is one row of sums.

Defined results: a null or empty text has no words, a ratio of 0, and fails the base rules; a text of any length is read
whole; a mean ratio of exactly the threshold passes; without any trusted document every ratio is 0 and the base rules
alone decide; of repeated labels for one id any that trusts it counts; a null id is trusted by none; repeated rows are
judged each by itself; an empty table gives an empty result; other columns are ignored, whatever their names. Ratios
are whole millionths, so that sums do not depend on their order.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import WORD, letters

SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 1 << 14
#: Chosen on labelled rows: trusted text scores above -0.03, junk that passes the base rules below -0.05.
THRESHOLD = -0.04


def repeat_words(words: str) -> str:
    """SQL for how many words lie in a 3-word window that occurs at least twice; ``words`` names an array column."""
    windows = f"sort_array(transform(sequence(0, size({words}) - 3), i -> named_struct('h', xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), 'i', i)))"
    pairs = f"transform(array({windows}), s -> zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2) END))[0]"
    return f"CASE WHEN size({words}) < 4 THEN 0 ELSE size(array_distinct(flatten(filter({pairs}, p -> p IS NOT NULL)))) END"


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __words and the base columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = letters(F.col(text_col))
    df = docs.withColumn("__text", text).withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "*",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat_words("__words")).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("__text", "__lines")


def bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def grams(df: DataFrame, words: str, keep: list[str], buckets: int) -> DataFrame:
    """keep and ``g``: one row per word and per pair of words; a row without words has one with null ``g``."""
    pairs = F.arrays_zip(F.col(words).alias("a"), F.expr(f"slice({words}, 2, size({words}))").alias("b"))
    said = df.select(*keep, F.explode_outer(pairs).alias("p")).select(*keep, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    one = F.when(F.col("a").isNotNull(), bucket(F.col("a"), buckets=buckets))
    both = F.when(F.col("b").isNotNull(), bucket(F.col("a"), F.col("b"), buckets=buckets))
    return said.select(*keep, one.alias("g"), both.alias("h"))


def ngram_counts(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str, buckets: int) -> dict[int, tuple[int, int]]:
    """bucket -> (in trusted documents, in all documents)."""
    trusted = trusted_ids.select(F.col("id").alias("__id"), F.lit(1).alias("t")).hint("merge")
    flagged = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(trusted, "__id", "left")
    flagged = flagged.select(F.regexp_extract_all(letters(F.col("__text")), F.lit(WORD), F.lit(0)).alias("w"), F.coalesce("t", F.lit(0)).alias("t"))
    each = grams(flagged, "w", ["t"], buckets)
    hashed = each.select("t", F.explode(F.array("g", "h")).alias("g")).where("g IS NOT NULL")
    return {r["g"]: (r["t"], r["n"]) for r in hashed.groupBy("g").agg(F.sum("t").alias("t"), F.count("*").alias("n")).collect()}


def log_ratios(counts: dict[int, tuple[int, int]], buckets: int, smooth: float = 1.0) -> list[int]:
    """In millionths."""
    trusted, raw = sum(t for t, _ in counts.values()), sum(n for _, n in counts.values())
    if not trusted:
        return [0] * buckets
    p = lambda c, total: log((c + smooth) / (total + smooth * buckets))
    return [round(1e6 * (p(counts.get(g, (0, 0))[0], trusted) - p(counts.get(g, (0, 0))[1], raw))) for g in range(buckets)]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct()
    ratios = log_ratios(ngram_counts(docs, trusted, id_col, text_col, buckets), buckets)
    model = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    df = counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__raw")), "__raw").withColumn("__row", F.monotonically_increasing_id())
    base = ["__row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    of = lambda c: F.coalesce(F.get(model, F.col(c)), F.lit(0))
    each = grams(df, "__words", base, buckets).withColumn("__r", of("g") + of("h"))
    summed = each.groupBy(*base).agg(F.sum("__r").alias("__sum"))
    mean = F.when(F.col("n_words") > 0, F.col("__sum") / 1e6 / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0))
    df = summed.withColumn("llr", mean)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
