"""Building and profiling JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters written as escapes when JSON must also be safe inside HTML.
HTML_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "=": "\\u003d", "'": "\\u0027"}
LINE_ESCAPES = {"\u2028": "\\u2028", "\u2029": "\\u2029"}


def kv_to_json(*pairs: str | Column, html_safe: bool = True) -> Column:
    """A JSON object from ``key1, value1, key2, value2, …``; keys are literal strings.

    Keys keep the place of their first mention and the value of their last. Numbers stay
    numbers, null stays null. ``html_safe`` writes ``< > & = '`` as escapes, which reads
    back the same.
    """
    if len(pairs) % 2:
        raise ValueError(f"kv_to_json takes an even number of arguments, got {len(pairs)}")
    fields: dict[str, Column] = {}
    for key, value in zip(pairs[::2], pairs[1::2], strict=True):
        fields[str(key)] = F.col(value) if isinstance(value, str) else value
    text = F.to_json(
        F.struct(*(column.alias(key) for key, column in fields.items())), {"ignoreNullFields": "false"}
    )
    for char, escape in (HTML_ESCAPES | LINE_ESCAPES if html_safe else {}).items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def row_to_json(df: DataFrame, pattern: str = "yyyy-MM-dd HH:mm:ss SSS", pretty: bool = False) -> Column:
    """The whole row as a JSON object: timestamps by ``pattern``, null columns left out; ``pretty`` for reading."""
    return F.to_json(
        F.struct(*(F.col(f"`{name}`") for name in df.columns)),
        {"timestampFormat": pattern, "timestampNTZFormat": pattern, "ignoreNullFields": "true", "pretty": str(pretty).lower()},
    )


def value_kinds(df: DataFrame, column: str) -> DataFrame:
    """Profile of a JSON column: rows ``(key, kind, n)`` over the top-level keys.

    ``kind`` is one of object, array, string, integer, decimal, boolean, null.
    """
    entries = df.select(F.explode(F.from_json(column, "map<string,variant>")).alias("key", "value"))
    shape = F.schema_of_variant("value")
    kind = (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BIGINT", "integer")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.isNull() | (shape == "VOID"), "null")
        .otherwise("decimal")
    )
    return entries.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))
