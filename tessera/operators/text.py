"""Text features (TXT1-7): native string expressions, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import c

# fixed values: the sentiment lexicon (must equal the reference's lists)
POSITIVE_WORDS = ["good", "great", "excellent", "positive", "happy", "best", "perfect",
                  "love", "awesome", "fantastic", "nice", "amazing", "wonderful", "enjoy"]
NEGATIVE_WORDS = ["bad", "poor", "negative", "terrible", "worst", "horrible", "hate",
                  "awful", "disappointing", "dislike", "sad", "unhappy", "problem", "fail"]

WORD = r"[\p{L}\p{N}_]+"  # a Unicode word: letters, digits, underscore


def text_length(df: DataFrame, col: str, out: str) -> DataFrame:
    """Length in Unicode code points."""
    return df.withColumn(out, F.char_length(c(col)))


def word_count_expr(col: Column) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.coalesce(F.regexp_count(col, F.lit(r"\S+")), F.lit(0))


def word_count(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, word_count_expr(c(col)))


def alpha_count(df: DataFrame, col: str, out: str) -> DataFrame:
    """Alphabetic characters (Unicode letters)."""
    return df.withColumn(out, F.char_length(F.regexp_replace(c(col), r"[^\p{L}]", "")))


def contains_text(df: DataFrame, col: str, text: str, case: bool = True, out: str | None = None) -> DataFrame:
    e = F.contains(c(col), F.lit(text)) if case else F.contains(F.lower(c(col)), F.lit(text.lower()))
    return df.withColumn(out or f"{col}_contains", e)


def extract_pattern(df: DataFrame, col: str, pattern: str, out: str) -> DataFrame:
    """First regex match or null."""
    return df.withColumn(out, F.regexp_substr(c(col), F.lit(pattern)))


def count_pattern(df: DataFrame, col: str, pattern: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.regexp_count(c(col), F.lit(pattern)), F.lit(0)))


def sentiment_expr(col: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), 0)
    pos = F.array(*[F.lit(w) for w in POSITIVE_WORDS])
    neg = F.array(*[F.lit(w) for w in NEGATIVE_WORDS])
    npos = F.size(F.filter(words, lambda w: F.array_contains(pos, w)))
    nneg = F.size(F.filter(words, lambda w: F.array_contains(neg, w)))
    return F.when(npos > nneg, "positive").when(nneg > npos, "negative").otherwise("neutral")


def sentiment(df: DataFrame, col: str, out: str) -> DataFrame:
    """Lexicon sentiment: more positive words -> positive, more negative -> negative, else neutral."""
    return df.withColumn(out, sentiment_expr(c(col)))
