"""Cells, upserts, change records, logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import changes, log_scan, logs, ranking, reshape, upsert
from millrace.operators.keyed_store import KeyedStore
from millrace.plans.registry import Tables, query
from millrace.session import written

# Wide rows and cells.

_CUSTOMER_CELLS = """
SELECT c_custkey::VARCHAR AS rowkey, 'cf' AS family, 'c_name' AS qualifier, c_name AS value FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'cf', 'c_nationkey', c_nationkey::VARCHAR FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'cf', 'c_acctbal', c_acctbal::VARCHAR FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey::VARCHAR, 'cf', 'c_mktsegment', c_mktsegment FROM customer"""


def sparse_customers(t: Tables) -> DataFrame:
    """Customers; a negative balance is taken as unknown."""
    return t.customer.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))


@query("wide_to_cells", _CUSTOMER_CELLS)
def wide_to_cells(t: Tables) -> DataFrame:
    return reshape.wide_to_cells(sparse_customers(t))


@query(
    "sorted_cells",
    """SELECT s_nationkey || '#' || s_suppkey AS rowkey, 'f1' AS family, 's_name' AS qualifier, s_name AS value FROM supplier
    UNION ALL SELECT s_nationkey || '#' || s_suppkey, 'f1', 's_acctbal', s_acctbal::VARCHAR FROM supplier""",
)
def sorted_cells(t: Tables) -> DataFrame:
    suppliers = t.supplier.select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    return reshape.sorted_cells(reshape.wide_to_cells(suppliers, ["s_nationkey", "s_suppkey"], "f1", sep="#"))


@query("cell_copy", _CUSTOMER_CELLS)
def cell_copy(t: Tables) -> DataFrame:
    path = t.scratch("cells")
    reshape.wide_to_cells(sparse_customers(t)).write.parquet(path)
    return t.spark.read.parquet(path)


@query("cell_columns", f"SELECT DISTINCT family, qualifier FROM ({_CUSTOMER_CELLS})")
def cell_columns(t: Tables) -> DataFrame:
    return reshape.cell_columns(reshape.wide_to_cells(sparse_customers(t)))


@query(
    "cells_to_wide",
    """SELECT c_custkey AS rowkey_id, c_name AS cf_c_name, CASE WHEN c_acctbal >= 0
      THEN CAST(c_acctbal AS DECIMAL(38,3)) ELSE 0 END AS cf_c_acctbal, CAST(NULL AS INTEGER) AS cf_c_mktsegment,
      CAST(NULL AS DOUBLE) AS other_missing FROM customer""",
)
def cells_to_wide(t: Tables) -> DataFrame:
    # An older version of every balance, which only shows where there is no newer one; a
    # column that is no number; a column nobody wrote.
    now = reshape.wide_to_cells(sparse_customers(t)).withColumn("ts", F.lit(2))
    before = reshape.wide_to_cells(t.customer.select("c_custkey", F.lit(0).alias("c_acctbal"))).withColumn("ts", F.lit(1))
    declared = "rowkey:id:bigint; cf:c_name:string; cf:c_acctbal:decimal(38,3); cf:c_mktsegment:int; other:missing:double"
    return reshape.cells_to_wide(now.unionByName(before), declared)


# Upsert.


@query(
    "upsert_latest",
    """WITH batch AS (SELECT CASE WHEN l_returnflag = 'R' THEN -l_orderkey - 1 ELSE l_orderkey END AS id, l_extendedprice AS price,
        l_shipdate AS changed, l_linenumber AS line FROM lineitem),
    newest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY changed DESC, line DESC, price DESC) AS rn FROM batch) WHERE rn = 1)
    SELECT id, price, changed, line FROM newest
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderdate, 0 FROM orders WHERE o_orderkey NOT IN (SELECT id FROM newest)""",
)
def upsert_latest(t: Tables) -> DataFrame:
    base = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("changed"),
        F.lit(0).alias("line"),
    )
    fresh = F.when(F.col("l_returnflag") == "R", -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    batch = t.lineitem.select(
        fresh.alias("id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("changed"),
        F.col("l_linenumber").alias("line"),
    )
    return upsert.upsert(base, batch, ["id"], ["changed", "line", "price"])


# Change records: two rows per order, made from its status; the key is one column or two.


def change_records(t: Tables) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "F", "update").when(F.col("o_orderstatus") == "O", "insert").otherwise("delete")

    def row(key: Column) -> Column:
        return F.struct(
            key.alias("id"),
            F.col("o_custkey").alias("cust"),
            F.col("o_totalprice").alias("price"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("it's "), "o_orderpriority")).alias("note"),
        )

    shifted = F.col("o_orderkey") - F.pmod(F.col("o_orderkey"), F.lit(3))
    rows = F.array(row(F.col("o_orderkey")), row(shifted))
    data = F.when(action == "update", F.to_json(F.transform(rows, lambda r: F.struct(r.alias("after_values"))), _NULLS))
    plain = F.to_json(F.transform(rows, lambda r: F.struct(r.alias("values"))), _NULLS)
    keys = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit('["id","cust"]')).otherwise(F.lit('"id"'))
    head = F.concat(
        F.lit('{"log_file":"bin.1","log_pos":'),
        F.col("o_orderkey").cast("string"),
        F.lit(',"log_time":"2024-01-01 00:00:00","log_timestamp":1704067200,"schema":"shop","table":"orders","table_pk":'),
        keys,
        F.lit(',"action":"'),
        action,
        F.lit('","data":'),
    )
    # Every seventh record has an entry without the values its action needs.
    entries = F.coalesce(data, plain)
    odd = F.concat(F.expr("left(entries, length(entries) - 1)"), F.lit(',{"before_values":{"id":1}}]'))
    body = F.when(F.col("o_orderkey") % 7 == 0, odd).otherwise(F.col("entries"))
    return t.orders.withColumn("entries", entries).select(F.concat(head, body, F.lit("}")).alias("value"))


_NULLS = {"ignoreNullFields": "false"}

_CHANGES = """
changes AS (SELECT o_orderkey AS log_pos, o AS ordinal, CASE WHEN o = 0 THEN o_orderkey ELSE o_orderkey - o_orderkey % 3 END AS id,
    o_custkey AS cust, o_totalprice AS price, CASE WHEN o_orderpriority <> '5-LOW' THEN 'it''s ' || o_orderpriority END AS note,
    CASE o_orderstatus WHEN 'F' THEN 'update' WHEN 'O' THEN 'insert' ELSE 'delete' END AS action,
    o_orderpriority = '1-URGENT' AS two_keys
  FROM orders, (SELECT unnest([0, 1]) AS o))"""


@query(
    "cdc_flatten",
    f"""WITH {_CHANGES} SELECT 'shop.orders' AS "table", CASE WHEN two_keys THEN 'id,cust' ELSE 'id' END AS pk, action, log_pos,
      ordinal::INTEGER AS ordinal, id::VARCHAR AS id, cust::VARCHAR AS cust, price::VARCHAR AS price, note FROM changes""",
)
def cdc_flatten(t: Tables) -> DataFrame:
    rows = changes.change_rows(change_records(t))
    return rows.select(
        "table", F.array_join("pk", ",").alias("pk"), "action", "log_pos", "ordinal",
        *(F.try_element_at("values", F.lit(c)).alias(c) for c in ("id", "cust", "price", "note")),
    )


@query(
    "cdc_values",
    f"""WITH {_CHANGES} SELECT 'shop.orders' AS "table", log_pos, ordinal::INTEGER AS ordinal,
      id || '|' || cust || '|' || price::VARCHAR || '|' || coalesce(note, 'null') AS value_list FROM changes""",
)
def cdc_values(t: Tables) -> DataFrame:
    return changes.value_lists(change_records(t)).withColumn("value_list", F.array_join("value_list", "|"))


CHANGE_SQL = f"""WITH {_CHANGES}, parts AS (SELECT *, coalesce('''' || replace(note, '''', '''''') || '''', 'null') AS q,
      CASE WHEN two_keys THEN 'id=' || id || ' and cust=' || cust ELSE 'id=' || id END AS w FROM changes),
    texts AS (SELECT log_pos, action,
      'insert into shop.orders values ' || string_agg('(' || id || ', ' || cust || ', ' || price::VARCHAR || ', ' || q || ')', ', ' ORDER BY ordinal) AS ins,
      string_agg('update shop.orders set ' || CASE WHEN two_keys THEN '' ELSE 'cust=' || cust || ', ' END || 'price='
        || price::VARCHAR || ', note=' || q || ' where ' || w, ';' || chr(10) ORDER BY ordinal) AS upd,
      'delete from shop.orders where ' || CASE WHEN min(w) = max(w) THEN '(' || min(w) || ')'
        ELSE string_agg('(' || w || ')', ' or ' ORDER BY ordinal) END AS del
    FROM parts GROUP BY log_pos, action)
    SELECT log_pos, 'shop.orders' AS "table", action, CASE action WHEN 'insert' THEN ins WHEN 'update' THEN upd ELSE del END AS sql FROM texts"""


@query("cdc_sql", CHANGE_SQL)
def cdc_sql(t: Tables) -> DataFrame:
    return changes.change_sql(change_records(t))


@query("cdc_rejects", "SELECT o_orderkey AS log_pos, 2 AS ordinal, 'no values' AS reason FROM orders WHERE o_orderkey % 7 = 0")
def cdc_rejects(t: Tables) -> DataFrame:
    return changes.rejects(change_records(t)).select(F.get_json_object("value", "$.log_pos").cast("long").alias("log_pos"), "ordinal", "reason")


ORDER_COLUMNS = {"id": "long", "cust": "long", "price": "double", "note": "string"}

APPLIED = f"""WITH {_CHANGES}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY log_pos DESC, ordinal DESC) AS rn FROM changes) WHERE rn = 1)
    SELECT id, cust, price, note FROM last WHERE action <> 'delete'
    UNION ALL SELECT c_custkey * 7, c_custkey, c_acctbal, c_name FROM customer WHERE c_custkey * 7 NOT IN (SELECT id FROM last)"""


def change_target(t: Tables) -> DataFrame:
    """The table before the changes; some of its keys are changed, some are not."""
    return t.customer.select(
        (F.col("c_custkey") * 7).alias("id"),
        F.col("c_custkey").alias("cust"),
        F.col("c_acctbal").alias("price"),
        F.col("c_name").alias("note"),
    )


@query("cdc_apply", APPLIED)
def cdc_apply(t: Tables) -> DataFrame:
    rows = changes.typed_changes(changes.change_rows(change_records(t)), "shop.orders", ORDER_COLUMNS)
    return upsert.apply_changes(change_target(t), rows, ["id"], ["log_pos", "ordinal"])


@query("cdc_keyed_store", APPLIED)
def cdc_keyed_store(t: Tables) -> DataFrame:
    """The same changes in batches along the log, to a table in buckets; the second batch is handed in twice."""
    rows = changes.typed_changes(changes.change_rows(change_records(t)), "shop.orders", ORDER_COLUMNS)
    rows = written(rows, "changes")
    store = KeyedStore.create(change_target(t), t.scratch("keyed"), ["id"], buckets=16)
    ends = rows.agg(F.expr("percentile_approx(log_pos, array(0.3, 0.6, 1.0))")).head()[0] or []
    for number, end in enumerate(ends):
        begin = F.lit(True) if number == 0 else F.col("log_pos") > ends[number - 1]
        for _ in range(2 if number == 1 else 1):
            store.apply(rows.where(begin & (F.col("log_pos") <= end)), ["log_pos", "ordinal"], batch_id=number)
    return store.read()


# A query log made from conversations: what a user says is a query, compiled when it is
# answered; system lines are noise, and so is what a long answer goes on with.

_LINES = r"""
lines AS (SELECT (conv_id % 4)::VARCHAR AS source, conv_id, turn, pos - 1 AS pos, CASE
    WHEN pos > 1 THEN parts[pos]
    WHEN role = 'user' THEN '2024-01-01T10:00:' || lpad(turn::VARCHAR, 2, '0') || ',123 INFO  Compiling command(queryId=u' || conv_id
      || '_2024010' || turn || '): ' || parts[pos]
    WHEN role = 'assistant' THEN '2024-01-01T11:00:' || lpad(turn::VARCHAR, 2, '0') || ',456 INFO  Completed compiling command(queryId=u'
      || conv_id || '_2024010' || (turn - 1) || '); Time taken: ' || length(text) || '.5 seconds'
    ELSE '2024-01-01T09:00:00,000 WARN  ' || parts[pos] END AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT *, string_split(text, chr(10)) AS parts FROM conversations)))"""

_SESSIONS = f"""WITH {_LINES},
kinds AS (SELECT *, regexp_matches(line, 'INFO|WARN|ERROR') AS starts, contains(line, 'Compiling command') AS compiling FROM lines),
grouped AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY source ORDER BY conv_id, turn, pos) AS id FROM kinds),
queries AS (SELECT source, id, max(CASE WHEN compiling THEN regexp_extract(line, 'queryId=(.*)\\):', 1) END) AS query_id,
    max(CASE WHEN compiling THEN substr(line, 1, 23) END) AS start_time,
    max(CASE WHEN compiling THEN regexp_extract(line, 'queryId=(.*)_20', 1) END) AS "user",
    string_agg(trim(CASE WHEN compiling THEN substr(line, strpos(line, '): ') + 3) ELSE line END, ' '), ' ' ORDER BY conv_id, turn, pos) AS query_str
  FROM grouped GROUP BY source, id HAVING NOT bool_or(starts AND NOT compiling)),
done AS (SELECT regexp_extract(line, 'queryId=(.*)\\);', 1) AS query_id, substr(line, 1, 23) AS end_time,
    regexp_extract(line, 'Time taken: (.*) seconds', 1) AS duration FROM lines WHERE contains(line, 'Completed compiling command'))
SELECT source, id::BIGINT AS id, q.query_id, start_time, end_time, duration, "user", query_str FROM queries q LEFT JOIN done d ON d.query_id = q.query_id""".replace("\\\\", "\\")


def log_lines(t: Tables) -> DataFrame:
    """The log: lines with source, block and order; blocks are ranges along the sources."""
    return ranking.stored_ranges(made_lines(t), ["source", "seq"], "block")


def log_files(t: Tables) -> str:
    """The same log as text files, a folder per source, cut and named in the order of its lines."""
    path = t.scratch("log")
    ranged = made_lines(t).repartitionByRange("source", "seq").sortWithinPartitions("source", "seq")
    ranged.select("source", "line").write.partitionBy("source").option("lineSep", "\n").text(path)
    return path


def made_lines(t: Tables) -> DataFrame:
    said = t.conversations.select(
        "conv_id", "turn", "role", "text", F.posexplode(F.split("text", "\n")).alias("pos", "part")
    )
    second = F.lpad(F.col("turn").cast("string"), 2, "0")
    compiling = F.concat(
        F.lit("2024-01-01T10:00:"), second, F.lit(",123 INFO  Compiling command(queryId=u"), "conv_id",
        F.lit("_2024010"), "turn", F.lit("): "), "part",
    )
    completed = F.concat(
        F.lit("2024-01-01T11:00:"), second, F.lit(",456 INFO  Completed compiling command(queryId=u"), "conv_id",
        F.lit("_2024010"), F.col("turn") - 1, F.lit("); Time taken: "), F.length("text"), F.lit(".5 seconds"),
    )
    line = (
        F.when(F.col("pos") > 0, F.col("part"))
        .when(F.col("role") == "user", compiling)
        .when(F.col("role") == "assistant", completed)
        .otherwise(F.concat(F.lit("2024-01-01T09:00:00,000 WARN  "), "part"))
    )
    return said.select(
        F.pmod("conv_id", F.lit(4)).cast("string").alias("source"),
        F.struct("conv_id", "turn", "pos").alias("seq"),
        line.alias("line"),
    )


@query("log_sessions", _SESSIONS)
def log_sessions(t: Tables) -> DataFrame:
    return logs.sessions(log_lines(t))


@query("log_sessions_scan", _SESSIONS)
def log_sessions_scan(t: Tables) -> DataFrame:
    return log_scan.sessions(log_scan.read_blocks(t.spark, log_files(t)))


@query(
    "log_classify",
    f"""WITH {_LINES} SELECT source, CASE WHEN contains(line, 'Compiling command') THEN 'compiling' WHEN contains(line, 'Executing command') THEN 'executing'
      WHEN contains(line, 'INFO') THEN 'info' WHEN regexp_matches(line, 'WARN|ERROR') THEN 'problem' ELSE 'continued' END AS kind, count(*) AS n
    FROM lines GROUP BY ALL""",
)
def log_classify(t: Tables) -> DataFrame:
    return logs.classify(log_lines(t)).groupBy("source", "kind").agg(F.count("*").alias("n"))
