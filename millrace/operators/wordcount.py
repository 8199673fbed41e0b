"""Word counts. Counting combines on the map side, so a frequent word costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = "[ \\t\\n\\r\\f]+"


def tokens(text: Column | str) -> Column:
    """Pieces between runs of whitespace; blank only at the ends of a text."""
    return F.split(text, WHITESPACE)


def pieces(text: Column | str) -> Column:
    """Pieces between single spaces; blank where two spaces meet."""
    return F.split(text, " ")


def words(lines: DataFrame, text: str, how: str = "tokens", keep_blank: bool = False) -> DataFrame:
    """One row ``word`` per word of a text column, batch or stream."""
    found = lines.select(F.explode({"tokens": tokens, "pieces": pieces}[how](text)).alias("word"))
    return found if keep_blank else found.where(F.col("word") != "")


def count_words(lines: DataFrame, text: str, how: str = "tokens", keep_blank: bool = False) -> DataFrame:
    """Rows ``(word, count)`` over a text column, split by ``tokens`` or by ``pieces``."""
    return words(lines, text, how, keep_blank).groupBy("word").agg(F.count("*").alias("count"))


def word_documents(counts: DataFrame) -> DataFrame:
    """One JSON document ``{"word": …, "count": …}`` per word."""
    return counts.select("word", F.to_json(F.struct("word", "count")).alias("doc"))
