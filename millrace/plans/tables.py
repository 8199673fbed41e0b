"""Sources and sinks: what is written is read back and compared with what went in."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import aggregates
from millrace.plans.registry import Tables, query
from millrace.sources import connectors, files, schema, sync, tables

ORDER_DETAIL = {"id": "bigint", "order_id": "bigint", "charge_time": "timestamp_ntz", "amount": "double"}

ARRAY_ROWS = 10_000


def table_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


@query("table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def table_scan(t: Tables) -> DataFrame:
    tables.publish_view(t.customer, "customer_scan")
    found = tables.scan(t.spark, "customer_scan")
    return found.where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")


@query("scan_column", "SELECT p_name AS items FROM part")
def scan_column(t: Tables) -> DataFrame:
    tables.publish_view(t.part, "part_scan")
    return tables.scan_column(t.spark, "part_scan", "p_name")


@query(
    "param_query",
    """SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    WHERE year(o_orderdate) = 1997 AND o_orderstatus = 'F'""",
)
def param_query(t: Tables) -> DataFrame:
    text = """SELECT o_orderkey, o_totalprice, date_format(o_orderdate, 'yyyy-MM-dd') AS day FROM {orders}
    WHERE o_orderdate >= make_date(:year, 1, 1) AND o_orderdate < make_date(:year + 1, 1, 1) AND o_orderstatus = :status"""
    return tables.query(t.spark, text, {"year": 1997, "status": "F"}, orders=t.orders)


@query(
    "literal_rows",
    """SELECT name, count(*) AS n FROM orders
    JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partly')) AS s(code, name) ON code = o_orderstatus GROUP BY name""",
)
def literal_rows(t: Tables) -> DataFrame:
    given = tables.literal_rows(t.spark, "code string, name string", ("F", "finished"), ("O", "open"))
    values = t.spark.sql("SELECT 'P' AS code, 'partly' AS name UNION ALL SELECT 'X', 'unknown'")
    names = given.unionByName(values)
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return counts.join(names, "code").select("name", "n")


@query(
    "text_lines",
    """SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value""",
)
def text_lines(t: Tables) -> DataFrame:
    path = t.scratch("text")
    t.documents.select("text").write.text(path)
    return files.read_lines(t.spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(
    "csv_json_scan",
    """SELECT kind, c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM customer, (VALUES ('csv'), ('json'), ('json_array')) k(kind) GROUP BY kind, c_nationkey""",
)
def csv_json_scan(t: Tables) -> DataFrame:
    csv, lines, array = t.scratch("csv"), t.scratch("json"), t.scratch("json-array")
    files.write_csv(t.customer, csv)
    t.customer.write.json(lines)
    # JSON array files: one array of a bounded number of rows in each, whatever is in the rows.
    number = F.floor(F.monotonically_increasing_id() / ARRAY_ROWS)
    ranges = t.customer.groupBy(number.alias("n")).agg(
        F.to_json(F.collect_list(F.struct(*t.customer.columns))).alias("value")
    )
    ranges.select("value").write.option("maxRecordsPerFile", 1).text(array)
    columns = t.customer.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    read = {
        "csv": files.read_csv(t.spark, csv, columns),
        "json": files.read_json(t.spark, lines, columns),
        "json_array": files.read_json(t.spark, array, columns, multi_line=True),
    }
    together = None
    for kind, rows in read.items():
        part = rows.select(F.lit(kind).alias("kind"), "c_nationkey", "c_acctbal")
        together = part if together is None else together.unionByName(part)
    return together.groupBy("kind", "c_nationkey").agg(
        F.count("*").alias("n"), F.sum(aggregates.exact("c_acctbal", 2)).cast("double").alias("balance")
    )


@query(
    "text_export",
    """SELECT doc_id, regexp_replace(text, '[\n\r\t]', ' ', 'g') AS text, CASE WHEN lang <> 'en' THEN lang END AS lang, n_chars
    FROM documents""",
)
def text_export(t: Tables) -> DataFrame:
    path = t.scratch("export")
    lang = F.when(F.col("lang") != "en", F.col("lang")).alias("lang")
    files.export_text(t.documents.select("doc_id", "text", lang, "n_chars"), path, files.CTRL_A)
    return files.read_export(t.spark, path, "doc_id long, text string, lang string, n_chars long", files.CTRL_A)


@query(
    "text_export_tab",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, o_totalprice,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders""",
)
def text_export_tab(t: Tables) -> DataFrame:
    path = t.scratch("export-tab")
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", priority.alias("priority"), "o_totalprice", "o_orderdate")
    files.export_text(rows, path)
    return files.read_export(t.spark, path, "o_orderkey long, priority string, o_totalprice double, day string")


@query(
    "csv_write",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, props, value FROM events
    UNION ALL SELECT -doc_id - 1, NULL, text, NULL FROM documents""",
)
def csv_write(t: Tables) -> DataFrame:
    """Events, and texts with quotes, separators and line breaks, through the library's own writer and reader."""
    path = t.scratch("csv")
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "props", "value")
    texts = t.documents.select((-F.col("doc_id") - 1).alias("event_id"), F.lit(None).cast("string").alias("ts"), "text", F.lit(None).cast("double"))
    files.write_csv(rows.union(texts), path, sep=";")
    return files.read_csv(t.spark, path, "event_id long, ts string, props string, value double", sep=";")


_DETAIL_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_shipdate AS charge_time,
  l_extendedprice AS amount FROM lineitem"""


def order_detail(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_shipdate").alias("charge_time"),
        F.col("l_extendedprice").alias("amount"),
    )


@query("table_write", _DETAIL_SQL)
def table_write(t: Tables) -> DataFrame:
    name = table_name("order_detail")
    tables.create_table(t.spark, name, ORDER_DETAIL, comment="order lines", path=t.scratch(name))
    tables.replace_rows(order_detail(t), name)
    tables.replace_rows(order_detail(t), name)
    return tables.scan(t.spark, name)


@query(
    "table_append",
    """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def table_append(t: Tables) -> DataFrame:
    name = table_name("people")
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    tables.save_table(customers, name, path=t.scratch(name))
    tables.save_table(t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"), name, mode="append")
    return tables.scan(t.spark, name)


@query("load_file", _DETAIL_SQL)
def load_file(t: Tables) -> DataFrame:
    name, path = table_name("order_detail"), t.scratch("load")
    files.export_text(order_detail(t), path)
    tables.create_table(t.spark, name, ORDER_DETAIL, path=t.scratch(name))
    tables.load_file(t.spark, path, name)
    return tables.scan(t.spark, name)


@query("orc_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus AS dt FROM orders")
def orc_partitioned(t: Tables) -> DataFrame:
    name = table_name("orders_orc")
    rows = t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("dt"))
    tables.save_table(rows, name, fmt="orc", partition_by=["dt"], path=t.scratch(name))
    return tables.scan(t.spark, name)


@query(
    "ctas_support",
    """SELECT p_brand, count(*) AS num, (SELECT count(*) FROM part) AS row_num,
      count(*) / (SELECT count(*) FROM part)::DOUBLE AS support, count(*) * 100 AS scaled FROM part GROUP BY p_brand""",
)
def ctas_support(t: Tables) -> DataFrame:
    name = table_name("brand_support")
    counts = t.part.groupBy("p_brand").agg(F.count("*").alias("num"))
    shared = aggregates.with_share(counts, "num", t.part)
    tables.save_with_columns(shared, name, t.scratch(name), scaled="num * 100", etl_time="now()")
    return tables.scan(t.spark, name).drop("etl_time")


@query("temp_view_agg", "SELECT l_shipdate::DATE AS dt, count(*) AS n FROM lineitem GROUP BY 1")
def temp_view_agg(t: Tables) -> DataFrame:
    name = tables.publish_view(t.lineitem, "lineitem_everywhere", across_sessions=True)
    return tables.query(t.spark, f"SELECT to_date(l_shipdate) AS dt, count(*) AS n FROM {name} GROUP BY 1")


@query(
    "sink_cast",
    """SELECT event_id, '{"k":' || json_extract(props, '$.k')::VARCHAR || '}' AS props, '["' || event_type || '","' || user_id || '"]' AS tags,
      '{"value":' || value::VARCHAR || '}' AS nested, base64(encode(event_type)) AS bytes, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount,
      36 AS id_length, true AS dated FROM events""",
)
def sink_cast(t: Tables) -> DataFrame:
    rich = t.events.select(
        "event_id",
        F.from_json("props", "map<string,int>").alias("props"),
        F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
        F.struct("value").alias("nested"),
        F.col("event_type").cast("binary").alias("bytes"),
        aggregates.exact("value", 2, 18).alias("amount"),
    )
    flat = schema.with_document_columns(schema.flat_for_sink(rich, decimals_as_double=True))
    flat = flat.withColumn("id_length", F.length("id")).withColumn("dated", F.col("dt").isNotNull())
    return flat.drop("id", "dt")


@query(
    "batch_docs",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, true AS small_enough FROM customer",
)
def batch_docs(t: Tables) -> DataFrame:
    path = t.scratch("batches")
    docs = connectors.documents(t.customer, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})
    connectors.write_batches(docs, path, batch_size=200)
    found = t.spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    sizes = found.groupBy("file").agg((F.count("*") <= 200).alias("small_enough"))
    doc = F.from_json("value", "id long, name string, balance double").alias("doc")
    return found.join(sizes, "file").select(doc, "small_enough").select("doc.*", "small_enough")


@query(
    "doc_envelope",
    """SELECT '{"add":{"overwrite":true,"doc":{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey
      || ',"s_acctbal":' || s_acctbal::VARCHAR || '}}}' AS doc FROM supplier""",
)
def doc_envelope(t: Tables) -> DataFrame:
    return connectors.add_envelopes(t.supplier)


@query(
    "messages",
    """SELECT n_nationkey::VARCHAR AS key, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value
    FROM nation""",
)
def messages(t: Tables) -> DataFrame:
    return connectors.as_messages(t.nation, "n_nationkey")


@query("sync_tables", "SELECT s_suppkey AS id, upper(s_name) AS name, (SELECT count(*) FROM supplier) AS handed FROM supplier")
def sync_tables(t: Tables) -> DataFrame:
    path = t.scratch("sync")
    handed = sync.sync(
        t.supplier,
        lambda rows: rows.write.parquet(path),
        lambda rows: rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        lambda rows: rows.withColumn("name", F.upper("name")),
    )
    return connectors.read(t.spark, "parquet", path).withColumn("handed", F.lit(handed).cast("long"))
