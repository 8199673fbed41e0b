"""Text, CSV, JSON and delimited exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.reshape import as_text

# The text form of a null and the field separators of exported tables.
NULL_TEXT = "\\N"
TAB = "\t"
CTRL_A = "\x01"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path)


# What writer and reader of CSV agree on: quotes doubled inside quotes, line breaks inside them kept, and the
# empty text written as "" so that it is no null.
_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV = {"escape": '"', "emptyValue": '""', "nullValue": ""} | _BLANKS
CSV_READ = {"escape": '"', "emptyValue": "\0", "multiLine": "true"} | _BLANKS


def read_csv(
    spark: SparkSession, path: str, schema: str, sep: str = ",", timestamps: str = "yyyy-MM-dd HH:mm:ss"
) -> DataFrame:
    """CSV with a header line, as ``write_csv`` writes it."""
    options = CSV_READ | {"timestampFormat": timestamps, "timestampNTZFormat": timestamps}
    rows = spark.read.schema(schema).options(**options).csv(path, header=True, sep=sep)
    # The reader takes an empty value for a null, quoted or not; a mark for the quoted one tells them apart.
    texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    mark = F.lit(CSV_READ["emptyValue"])
    return rows.withColumns({n: F.when(F.col(f"`{n}`") == mark, "").otherwise(F.col(f"`{n}`")) for n in texts})


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or with ``multi_line`` one JSON array per file."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_csv(df: DataFrame, path: str, sep: str = ",", timestamps: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """CSV with a header line per file; an existing path is replaced."""
    options = CSV | {"timestampFormat": timestamps, "timestampNTZFormat": timestamps}
    df.write.mode("overwrite").options(**options).csv(path, header=True, sep=sep)


def write_sorted_pairs(df: DataFrame, path: str, key: str, value: str) -> None:
    """Lines ``key<TAB>value`` in key order over all files; a key with very many rows spans several ranges."""
    line = F.concat_ws(TAB, key, F.col(value).cast("string"))
    df.orderBy(key, value).select(line.alias("value")).write.mode("overwrite").text(path)


def scrubbed(column: Column, sep: str) -> Column:
    """Field text on one line: line breaks and tabs become blanks, the separator goes."""
    plain = F.regexp_replace(column, "[\\n\\r\\t]", " ")
    return plain if sep == TAB else F.replace(plain, F.lit(sep), F.lit(""))


def export_lines(df: DataFrame, sep: str = TAB) -> DataFrame:
    """Every row as one delimited line, all columns as text, null as ``\\N``, a text ``\\N`` with one more backslash."""

    def field(name: str) -> Column:
        text = scrubbed(as_text(df, name), sep)
        kept = F.when(text.rlike(r"^\\+N\z"), F.concat(F.lit("\\"), text)).otherwise(text)
        return F.coalesce(kept, F.lit(NULL_TEXT))

    fields = map(field, df.columns)
    return df.select(F.concat_ws(sep, *fields).alias("value"))


def export_text(df: DataFrame, path: str, sep: str = TAB) -> None:
    """Write ``export_lines``; a map-only job, an existing path is replaced."""
    export_lines(df, sep).write.mode("overwrite").text(path)


def read_export(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = TAB) -> DataFrame:
    """Exported text by a declared schema; ``\\N`` and unreadable values are null, '' is ''."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    parts = spark.read.text(path).select(F.split("value", f"\\Q{sep}\\E", -1).alias("parts"))

    def field(i: int, declared: T.StructField) -> Column:
        text = F.nullif(F.get("parts", F.lit(i)), F.lit(NULL_TEXT))
        text = F.when(text.rlike(r"^\\{2,}N\z"), F.substring(text, 2, 1 << 30)).otherwise(text)
        same = isinstance(declared.dataType, T.StringType)
        return (text if same else text.try_cast(declared.dataType)).alias(declared.name)

    return parts.select(*(field(i, declared) for i, declared in enumerate(fields)))
