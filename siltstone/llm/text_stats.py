"""Statistics of whole texts as native columns, the inputs of the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The statistics that the quality models may use; ratios are 0 for a text without words.
STATS = ("n_words", "mean_word", "symbol_share", "bang_share", "upper_share", "digit_share", "stop_share", "distinct_share", "dup_line_share", "words_per_line", "top_line_words")
WINDOW_WORDS = 8


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds __text (null: empty) and __words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn("__text", text).withColumn("__words", C.words(F.col("__text")))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def word_chars() -> Column:
    return (F.length("__text") - C.count_chars(F.col("__text"), C.SPACES)).cast("long")


def lines_with_word() -> Column:
    """The lines that hold a word: those that are not empty without white space. Trimming leaves that test to a byte scan."""
    return F.filter(F.split("__text", "\n"), lambda line: F.length(F.btrim(line, F.lit("".join(C.SPACES)))) > 0)


def with_lines(df: DataFrame) -> DataFrame:
    """Adds __chars and __lines, and the number of distinct lines, to what with_words gave."""
    return df.withColumn("__chars", word_chars()).withColumn("__lines", lines_with_word()).withColumn("__own_lines", F.size(F.array_distinct("__lines")))


def with_stats(df: DataFrame) -> DataFrame:
    """Adds the columns STATS to what with_words, or with_lines after it, gave."""
    text, chars = F.col("__text"), F.col("__chars")
    ready = df if "__lines" in df.columns else with_lines(df)
    return (
        ready.withColumn("n_words", F.size("__words").cast("double"))
        .withColumn("mean_word", _ratio(chars, F.col("n_words")))
        .withColumn("symbol_share", _ratio(C.count_chars(text, C.SYMBOLS), chars))
        .withColumn("bang_share", _ratio(C.count_chars(text, ("!", "?")), chars))
        .withColumn("upper_share", _ratio(F.length(F.regexp_replace(text, "[^A-Z]+", "")), chars))
        .withColumn("digit_share", _ratio(F.length(F.regexp_replace(text, "[^0-9]+", "")), chars))
        .withColumn("stop_share", _ratio(C.count_chars(text, (".", ",")), F.col("n_words")))
        .withColumn("distinct_share", _ratio(F.size(F.array_distinct("__words")), F.col("n_words")))
        .withColumn("dup_line_share", _ratio(F.size("__lines") - F.col("__own_lines"), F.size("__lines")))
        .withColumn("words_per_line", _ratio(F.col("n_words"), F.size("__lines")))
        .withColumn("top_line_words", _ratio(F.octet_length(F.element_at(F.concat("__lines", F.array(F.lit(""))), 1)), F.lit(1)))
        .drop("__chars", "__lines", "__own_lines")
    )


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of eight words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Only texts in which a hash recurs are sorted: equal windows then
    are neighbours, and one pass over the sorted starts adds up the words that they cover.
    """
    k = WINDOW_WORDS
    n = F.size("__words")
    windows = F.when(n > k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice("__words", i, k))))
    recurs = F.size(F.array_distinct("__windows")) < F.size("__windows")
    paired = F.when(recurs, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda at, h: F.coalesce(F.get(F.col("__sorted"), at)["h"] == h, F.lit(False))
    starts = F.array_sort(F.transform(F.filter("__sorted", lambda x, j: same(j - 1, x["h"]) | same(j + 1, x["h"])), lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    add = lambda acc, i: F.struct((acc["n"] + k - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + k).alias("end"))
    covered = F.aggregate("__starts", zero, add, lambda acc: acc["n"])
    return (
        df.withColumn("__windows", windows)
        .withColumn("__sorted", paired)
        .withColumn("__starts", starts)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("__windows", "__sorted", "__starts")
    )
