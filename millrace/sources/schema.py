"""Declared schemas, and the column types a sink can take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names of a declared schema. A bare ``decimal`` is a double.
TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "tinyint": T.ByteType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "decimal": T.DoubleType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}

# Column types of an OLAP table and field types of a search index.
OLAP_TYPES = {
    "boolean": "boolean",
    "tinyint": "int",
    "smallint": "int",
    "int": "int",
    "bigint": "bigint",
    "float": "float",
    "double": "double",
    "string": "String",
    "timestamp": "timestamp",
    "date": "date",
}
SEARCH_TYPES = {
    "smallint": "pint",
    "int": "pint",
    "bigint": "plong",
    "float": "pfloat",
    "double": "pdouble",
    "decimal": "pdouble",
    "string": "text_general",
    "date": "pdate",
    "timestamp": "pdate",
    "boolean": "boolean",
}
OTHER_OLAP_TYPE = "String"
OTHER_SEARCH_TYPE = "text_general"

COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


@dataclass(frozen=True)
class CellColumn:
    family: str
    qualifier: str
    type: T.DataType

    @property
    def is_key(self) -> bool:
        return self.family == "rowkey"

    @property
    def name(self) -> str:
        return f"{self.family}_{self.qualifier}"


def named_type(name: str) -> T.DataType:
    """The Spark type of a declared type name; unknown names are strings."""
    name = name.strip().lower()
    if name.startswith("decimal("):
        precision, scale = name[len("decimal(") :].rstrip(")").split(",")
        return T.DecimalType(int(precision), int(scale))
    return TYPES.get(name, T.StringType())


def parse_cell_schema(declared: str) -> list[CellColumn]:
    """``"rowkey:id:string; family:qualifier:type; …"`` as columns, in declared order."""
    columns = []
    for part in filter(None, (p.strip() for p in declared.split(";"))):
        family, qualifier, kind = (x.strip() for x in part.split(":", 2))
        columns.append(CellColumn(family, qualifier, named_type(kind)))
    if sum(c.is_key for c in columns) != 1:
        raise ValueError("a declared schema names the row key exactly once")
    return columns


def base_name(kind: T.DataType) -> str:
    """The type name without parameters; character types are ``string``, both timestamps one."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return kind.simpleString().split("(")[0].removesuffix("_ntz")


def olap_columns(df: DataFrame) -> dict[str, str]:
    """Target column types of an OLAP table.

    The first column is its sort key and never null, all others may be. Nested and binary
    columns become strings.
    """
    columns = {}
    for i, field in enumerate(df.schema.fields):
        kind = field.dataType
        name = base_name(kind)
        if isinstance(kind, T.DecimalType):
            target = kind.simpleString()
        else:
            target = OLAP_TYPES.get(name, OTHER_OLAP_TYPE)
        columns[field.name] = target if i == 0 else f"Nullable({target})"
    return columns


def olap_ddl(df: DataFrame, table: str, engine: str = "MergeTree()") -> str:
    """The CREATE TABLE text for ``olap_columns``, ordered by the first column; comments of columns are carried over."""

    def commented(name: str) -> str:
        text = df.schema[name].metadata.get("comment", "").replace("\\", "\\\\").replace("'", "\\'")
        return f" COMMENT '{text}'" if text else ""

    columns = ", ".join(f"`{name}` {kind}{commented(name)}" for name, kind in olap_columns(df).items())
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns}) ENGINE = {engine} ORDER BY `{df.columns[0]}`"


def search_fields(df: DataFrame, unique_key: str = "id") -> list[dict]:
    """Field definitions of a search index for every column but the key."""
    fields = []
    for field in df.schema.fields:
        if field.name == unique_key:
            continue
        kind = SEARCH_TYPES.get(base_name(field.dataType), OTHER_SEARCH_TYPE)
        fields.append({"name": field.name, "type": kind, "multiValued": False})
    return fields


def flat_for_sink(df: DataFrame, decimals_as_double: bool = False) -> DataFrame:
    """Nested columns as JSON text, binary as base64 text, and on request decimals as doubles."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, COMPLEX):
            column = F.to_json(column)
        elif isinstance(field.dataType, T.BinaryType):
            column = F.regexp_replace(F.base64(column), "[\\r\\n]", "")
        elif decimals_as_double and isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def with_document_columns(df: DataFrame) -> DataFrame:
    """Add ``id`` (a UUID per row) and ``dt`` (the time of the run) where they are missing."""
    if "id" not in df.columns:
        df = df.withColumn("id", F.uuid())
    if "dt" not in df.columns:
        df = df.withColumn("dt", F.current_timestamp())
    return df
