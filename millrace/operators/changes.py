"""Change records (binlog JSON): to rows, to SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a change record. ``table_pk`` is a string or a list of strings.
RECORD = (
    "log_file string, log_pos long, log_time string, log_timestamp long, schema string, `table` string,"
    " table_pk string, action string, data array<map<string,map<string,variant>>>"
)


def parsed(records: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Change records as columns; ``pk`` is the array of key names and ``rows`` the row maps.

    An update carries its new row as ``after_values``, the other actions as ``values``. The
    maps keep the order of the document and the type of every value. An entry that can't be
    acted on is null among the rows, and ``faults`` says why at its place.
    """
    # inline() keeps the parsed record as one step: it is not parsed again for every field.
    record = records.select(*(keep or ()), F.inline(F.array(F.from_json(column, RECORD))))
    listed = F.from_json("table_pk", "array<string>")
    pk = F.when(F.col("table_pk").startswith("["), listed).otherwise(F.array("table_pk"))
    new_row = F.when(F.col("action") == "update", F.lit("after_values")).otherwise(F.lit("values"))
    # Each inline() keeps what it makes as a step of its own, worked out once.
    found = F.transform("data", lambda entry: F.try_element_at(entry, new_row))
    read = record.select(
        *(keep or ()),
        "log_file",
        "log_pos",
        "log_time",
        F.when(F.col("table").isNotNull(), F.concat_ws(".", "schema", "table")).alias("table"),
        "action",
        F.inline(F.array(F.struct(pk.alias("pk"), found.alias("found")))),
    )
    faults = read.select("*", F.inline(F.array(F.struct(F.transform("found", _fault).alias("faults")))))
    rows = F.zip_with("found", "faults", lambda row, fault: F.when(fault.isNull(), row))
    return faults.select(*(c for c in read.columns if c != "found"), F.inline(F.array(F.struct(rows.alias("rows")))), "faults")


def _fault(row: Column) -> Column:
    """Why an entry can't be acted on: an insert needs values, a delete its whole key, an update also something to set."""
    keyed = F.col("action").isin("update", "delete")
    no_key = F.coalesce((F.size("pk") < 1) | (F.size(F.array_compact("pk")) < F.size("pk")), F.lit(True))
    lacks_key = F.size(F.array_except("pk", F.map_keys(row))) > 0
    return (
        F.when(row.isNull() | (F.size(row) < 1), "no values")
        .when(keyed & no_key, "no key named")
        .when(keyed & lacks_key, "key without a value")
        .when((F.col("action") == "update") & (F.size(F.array_except(F.map_keys(row), "pk")) < 1), "nothing to set")
    )


ACTIONS = ("insert", "update", "delete")


def rejects(records: DataFrame, column: str = "value") -> DataFrame:
    """What no other function here takes up, as ``(value, ordinal, reason)``: whole records (ordinal null) that can't be
    read as a change record, have an action other than ``ACTIONS`` or no entries, and single entries of others, by their
    place. Together with ``change_rows`` no entry is lost, and together with ``change_sql`` no record."""
    raw = records.select(F.col(column).alias("value"))
    read = parsed(raw.withColumn("_raw", F.col("value")), "value", ["_raw"])
    whole = (
        F.when(F.col("table").isNull() | F.col("action").isNull() | F.col("rows").isNull(), "unreadable")
        .when(~F.col("action").isin(*ACTIONS), "unknown action")
        .when(F.size("rows") < 1, "no entries")
    )
    single = F.filter(F.transform("faults", lambda fault, i: F.struct(i.alias("ordinal"), fault.alias("reason"))), lambda f: f["reason"].isNotNull())
    record = F.array(F.struct(F.lit(None).cast("int").alias("ordinal"), whole.alias("reason")))
    return read.select(F.col("_raw").alias("value"), F.inline(F.when(_sound(), single).otherwise(record)))


def _sound() -> Column:
    known = F.col("table").isNotNull() & (F.size("rows") > 0) & F.col("action").isin(*ACTIONS)
    return F.coalesce(known, F.lit(False))


def _text(value: Column) -> Column:
    """A value as text; numbers written with a fraction in the form of a double, as 5.0, whole ones with all digits.

    Whole numbers are decimals only where they don't fit a long, with 19 digits or more.
    """
    fraction = F.schema_of_variant(value).rlike(r"^DECIMAL(?!\((19|[2-9][0-9]),0\))")
    return F.when(fraction, value.try_cast("double").cast("string")).otherwise(value.cast("string"))


def change_rows(records: DataFrame, column: str = "value") -> DataFrame:
    """One row per changed row: table, pk, action, log_pos, place in the record, values as text.

    Records without a readable table or known action are not among them, nor entries that can't be acted on; these are
    in ``rejects``.
    """
    # The outer form adds no filter on the size of ``rows``, which would work them out twice.
    exploded = parsed(records, column).where(_sound()).select(
        "table", "pk", "action", "log_pos", F.posexplode_outer("rows").alias("ordinal", "row")
    ).where(F.col("row").isNotNull())
    text = F.transform_values("row", lambda _, value: _text(value))
    return exploded.select("table", "pk", "action", "log_pos", "ordinal", text.alias("values"))


def value_lists(records: DataFrame, column: str = "value") -> DataFrame:
    """The values of every changed row as a list of texts, null written as ``null``."""
    rows = change_rows(records, column)
    texts = F.transform(F.map_values("values"), lambda v: F.coalesce(v, F.lit("null")))
    return rows.select("table", "log_pos", "ordinal", texts.alias("value_list"))


def _literal(value: Column) -> Column:
    """A SQL literal: strings quoted (inner quotes doubled), anything else as it is."""
    text = _text(value)
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return (
        F.when(text.isNull(), F.lit("null"))
        .when(F.schema_of_variant(value) == "STRING", quoted)
        .otherwise(text)
    )


def _assign(entry: Column) -> Column:
    return F.concat(entry["key"], F.lit("="), _literal(entry["value"]))


def _match(entry: Column) -> Column:
    missing = entry["value"].cast("string").isNull()
    return F.when(missing, F.concat(entry["key"], F.lit(" is null"))).otherwise(_assign(entry))


def change_sql(records: DataFrame, column: str = "value") -> DataFrame:
    """The SQL text of every change record.

    Insert: one statement with all rows. Update: one statement per row, joined by ``;`` and a
    line break. Delete: one statement with a predicate per row. Other records, and entries that can't be acted on, are
    in ``rejects``; a record of such entries only has no statement.
    """
    change = parsed(records, column).where(_sound()).withColumn("rows", F.filter("rows", lambda row: row.isNotNull())).where(F.size("rows") > 0)

    def is_pk(entry: Column) -> Column:
        return F.array_contains("pk", entry["key"])

    def where(row: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.map_entries(row), is_pk), _match), " and ")

    def settings(row: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.map_entries(row), lambda e: ~is_pk(e)), _assign), ", ")

    def tuple_of(row: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(F.map_values(row), _literal), ", "), F.lit(")"))

    def update_of(row: Column) -> Column:
        return F.concat(
            F.lit("update "), F.col("table"), F.lit(" set "), settings(row), F.lit(" where "), where(row)
        )

    inserts = F.concat(
        F.lit("insert into "), "table", F.lit(" values "), F.array_join(F.transform("rows", tuple_of), ", ")
    )
    updates = F.array_join(F.transform("rows", update_of), ";\n")
    predicates = F.array_distinct(F.transform("rows", lambda row: F.concat(F.lit("("), where(row), F.lit(")"))))
    deletes = F.concat(F.lit("delete from "), "table", F.lit(" where "), F.array_join(predicates, " or "))
    sql = (
        F.when(F.col("action") == "insert", inserts)
        .when(F.col("action") == "update", updates)
        .when(F.col("action") == "delete", deletes)
    )
    return change.select("log_pos", "table", "action", sql.alias("sql"))


def typed_changes(rows: DataFrame, target: str, columns: dict[str, str]) -> DataFrame:
    """The changed rows of one table with its columns typed, ready to be applied to it.

    ``present`` lists the columns that the record carries: what it leaves out keeps its value.
    """
    return rows.where(F.col("table") == target).select(
        *(F.try_element_at("values", F.lit(name)).try_cast(kind).alias(name) for name, kind in columns.items()),
        "action",
        "log_pos",
        "ordinal",
        F.map_keys("values").alias("present"),
    )
