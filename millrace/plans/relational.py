"""Counts, aggregates, joins, ranking, set operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import map_of, max_length_value, sort_array_desc, sum_value
from millrace.functions.sql_aggregates import register_aggregates, slices
from millrace.operators import aggregates, joins, ranking, wordcount
from millrace.plans.registry import Tables, query
from millrace.sources import files

DETAIL = """(SELECT l_orderkey, l_partkey, l_shipdate,
  CAST(CASE WHEN l_quantity <> 1 THEN l_extendedprice * l_discount * l_tax END AS DECIMAL(28,6)) AS amount FROM lineitem)"""

_TOKENS = r"unnest(regexp_split_to_array(text, '[ \t\n\r\f]+'))"
_COUNT_TOKENS = f"""
SELECT word, count(*) AS count FROM (SELECT {_TOKENS} AS word FROM documents) WHERE word <> '' GROUP BY word"""


def detail(t: Tables) -> DataFrame:
    """Order lines with an amount of six decimals that is sometimes null."""
    amount = F.when(F.col("l_quantity") != 1, F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_shipdate", aggregates.exact(amount, 6).alias("amount"))


@query("wordcount_tok", _COUNT_TOKENS)
def wordcount_tok(t: Tables) -> DataFrame:
    return wordcount.count_words(t.documents, "text")


@query(
    "wordcount_split",
    """SELECT word, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
    WHERE word <> '' GROUP BY word""",
)
def wordcount_split(t: Tables) -> DataFrame:
    return wordcount.count_words(t.documents, "text", how="pieces")


@query("wordcount_sorted", _COUNT_TOKENS)
def wordcount_sorted(t: Tables) -> DataFrame:
    path = t.scratch("wordcount")
    files.write_sorted_pairs(wordcount.count_words(t.documents, "text"), path, "word", "count")
    return files.read_export(t.spark, path, "word string, count long")


@query(
    "wordcount_docs",
    f"""SELECT word, '{{"word":' || to_json(word)::VARCHAR || ',"count":' || count || '}}' AS doc
    FROM ({_COUNT_TOKENS})""",
)
def wordcount_docs(t: Tables) -> DataFrame:
    return wordcount.word_documents(wordcount.count_words(t.documents, "text"))


@query("global_sum", "SELECT sum(l_linenumber)::BIGINT AS total FROM lineitem")
def global_sum(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.sum("l_linenumber").alias("total"))


@query(
    "daily_agg",
    f"""SELECT CAST(l_shipdate AS DATE) AS dt, count(DISTINCT l_partkey) AS items,
      CAST(sum(amount) AS DOUBLE) AS sum_amount,
      CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_amount,
      CAST(sum(amount) AS DOUBLE) / count(*) AS avg_all_rows,
      CAST(max(amount) AS DOUBLE) AS max_amount, CAST(min(amount) AS DOUBLE) AS min_amount
    FROM {DETAIL} GROUP BY 1""",
)
def daily_agg(t: Tables) -> DataFrame:
    days = aggregates.daily(detail(t), "l_shipdate", "l_partkey", "amount")
    return days.withColumns({c: F.col(c).cast("double") for c in ("sum_amount", "max_amount", "min_amount")})


@query(
    "multi_key_having",
    f"""SELECT CAST(l_shipdate AS DATE) AS dt, p_brand, p_type,
      CAST(sum(amount) AS DOUBLE) AS sum_amount, count(*) AS cnt
    FROM {DETAIL} JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3 HAVING count(*) > 3""",
)
def multi_key_having(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    joined = detail(t).join(parts, "l_partkey")
    found = aggregates.grouped_having(joined, [F.to_date("l_shipdate").alias("dt"), "p_brand", "p_type"], "amount", 3)
    return found.withColumn("sum_amount", F.col("sum_amount").cast("double"))


@query(
    "typed_sum",
    """SELECT l_returnflag, sum(l_linenumber)::BIGINT AS sum_int,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_decimal,
      round(sum(l_tax), 4) AS sum_double, round(sum(CAST(l_discount AS DOUBLE)), 4) AS sum_text,
      sum(epoch(l_shipdate)) AS sum_time
    FROM lineitem GROUP BY l_returnflag""",
)
def typed_sum(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_returnflag",
        "l_linenumber",
        aggregates.exact("l_extendedprice", 2, 18).alias("price"),
        "l_tax",
        F.col("l_discount").cast("string").alias("discount"),
        "l_shipdate",
    )
    return lines.groupBy("l_returnflag").agg(
        sum_value(lines, "l_linenumber").alias("sum_int"),
        sum_value(lines, "price").alias("sum_decimal"),
        F.round(sum_value(lines, "l_tax"), 4).alias("sum_double"),
        F.round(sum_value(lines, "discount"), 4).alias("sum_text"),
        sum_value(lines, "l_shipdate").alias("sum_time"),
    )


@query(
    "max_length_value",
    """SELECT lang, min(text) AS longest, max(length(text))::INTEGER AS len
    FROM documents d WHERE length(text) = (SELECT max(length(text)) FROM documents e WHERE e.lang = d.lang)
    GROUP BY lang""",
)
def longest_text(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(
        max_length_value("text").alias("longest"), F.max(F.length("text")).alias("len")
    )


@query(
    "kv_map_pivot",
    """SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F' AND rn = 1) AS f,
      max(o_totalprice) FILTER (o_orderstatus = 'O' AND rn = 1) AS o,
      max(o_totalprice) FILTER (o_orderstatus = 'P' AND rn = 1) AS p
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus
            ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) GROUP BY o_custkey""",
)
def kv_map_pivot(t: Tables) -> DataFrame:
    kv = map_of(t.orders, ["o_custkey"], "o_orderstatus", "o_totalprice", ["o_orderdate", "o_orderkey"])
    return kv.select("o_custkey", *(F.try_element_at("kv", F.lit(s)).alias(s.lower()) for s in "FOP"))


# The same aggregates by name in SQL.


@query(
    "sql_typed_sum",
    """SELECT l_returnflag, sum(l_linenumber)::BIGINT AS sum_int, round(sum(l_tax), 4) AS sum_double,
      round(sum(CAST(l_discount AS DOUBLE)), 4) AS sum_text FROM lineitem GROUP BY l_returnflag""",
)
def sql_typed_sum(t: Tables) -> DataFrame:
    """There are few flags, so lines of a flag are summed in slices, then the sums; a double's text reads as itself."""
    register_aggregates(t.spark)
    sums = t.spark.sql(
        """SELECT l_returnflag, sum_value_long(l_linenumber) AS l_linenumber, sum_value(l_tax) AS l_tax,
          sum_value(CAST(l_discount AS STRING)) AS l_discount FROM {lines} GROUP BY l_returnflag, slice""",
        lines=slices(t.lineitem.select("l_returnflag", "l_linenumber", "l_tax", "l_discount", "l_orderkey"), "l_orderkey", "l_linenumber"),
    )
    return t.spark.sql(
        """SELECT l_returnflag, sum_value_long(l_linenumber) AS sum_int, round(sum_value(l_tax), 4) AS sum_double,
          round(sum_value(CAST(l_discount AS STRING)), 4) AS sum_text FROM {lines} GROUP BY l_returnflag""",
        lines=sums,
    )


@query(
    "sql_max_length_value",
    "SELECT o_custkey, min(o_comment) AS longest FROM (SELECT o_custkey, o_orderpriority AS o_comment FROM orders) o"
    " WHERE length(o_comment) = (SELECT max(length(o_orderpriority)) FROM orders e WHERE e.o_custkey = o.o_custkey) GROUP BY o_custkey",
)
def sql_max_length_value(t: Tables) -> DataFrame:
    register_aggregates(t.spark)
    return t.spark.sql("SELECT o_custkey, max_length_value(o_orderpriority) AS longest FROM {orders} GROUP BY o_custkey", orders=t.orders)


@query(
    "sql_map_of",
    """SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F' AND rn = 1) AS f, max(o_totalprice) FILTER (o_orderstatus = 'O' AND rn = 1) AS o
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn FROM orders) GROUP BY o_custkey""",
)
def sql_map_of(t: Tables) -> DataFrame:
    register_aggregates(t.spark)
    return t.spark.sql(
        """SELECT o_custkey, CAST(try_element_at(kv, 'F') AS DOUBLE) AS f, CAST(try_element_at(kv, 'O') AS DOUBLE) AS o
        FROM (SELECT o_custkey, map_of(o_orderstatus, CAST(o_totalprice AS STRING), o_orderkey) AS kv FROM {orders} GROUP BY o_custkey)""",
        orders=t.orders,
    )


@query(
    "left_join",
    """SELECT o_orderkey, o_custkey, c_name FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey""",
)
def left_join(t: Tables) -> DataFrame:
    building = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.select("o_orderkey", "o_custkey").join(building, "o_custkey", "left")


@query(
    "anti_join",
    """SELECT l_orderkey, count(*) AS n_lines FROM lineitem
    WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    GROUP BY l_orderkey""",
)
def anti_join(t: Tables) -> DataFrame:
    lines = t.lineitem
    kept = joins.without_groups(lines.select("l_orderkey"), lines.where("l_returnflag = 'R'"), ["l_orderkey"])
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query(
    "broadcast_join",
    """SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name""",
)
def broadcast_join(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    places = t.nation.join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    joined = joins.lookup_join(counts, places.select("n_nationkey", "n_name", "r_name"), ["n_nationkey"])
    return joined.groupBy("r_name", "n_name").agg(F.sum("customers").alias("customers"))


@query(
    "shuffle_join",
    """SELECT o_orderpriority, count(*) AS n_lines,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
)
def shuffle_join(t: Tables) -> DataFrame:
    # One row per order goes into the join, however many lines an order has.
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.sum(aggregates.exact("l_extendedprice", 2, 18)).alias("price")
    )
    joined = joins.shuffled_join(per_order, t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return joined.groupBy("o_orderpriority").agg(
        F.sum("n").alias("n_lines"), F.sum("price").cast("double").alias("revenue")
    )


@query(
    "reduced_join",
    """SELECT l_orderkey AS o_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""",
)
def reduced_join(t: Tables) -> DataFrame:
    """Few orders, too many for a broadcast in earnest: lines of other orders go before the shuffle."""
    urgent = t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderpriority")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.reduced_join(lines, urgent, ["o_orderkey"])


@query(
    "semi_join",
    """SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def semi_join(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@query(
    "topn_global",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def topn_global(t: Tables) -> DataFrame:
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return ranking.top(t.orders.select("o_orderkey", "o_totalprice"), order, 20)


@query(
    "topn_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, rn::INTEGER AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    WHERE rn <= 3""",
)
def topn_group(t: Tables) -> DataFrame:
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return ranking.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], order, 3)


@query(
    "secondary_sort",
    """SELECT event_type, event_id, value,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events""",
)
def secondary_sort(t: Tables) -> DataFrame:
    numbered = ranking.row_numbers(t.events, ["event_type"], ["ts", "event_id"])
    return numbered.select("event_type", "event_id", "value", F.col("rn").cast("long").alias("rn"))


@query("distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query(
    "union_rows",
    """SELECT name, acctbal FROM (SELECT c_name AS name, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT s_name, s_acctbal FROM supplier)""",
)
def union_rows(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    return customers.unionByName(t.supplier.select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name")))


@query(
    "sort_array_desc",
    """SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority DESC) AS priorities
    FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY o_custkey""",
)
def priorities_desc(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return per_customer.select("o_custkey", F.array_join(sort_array_desc("p"), ",").alias("priorities"))


_SETS = """(SELECT doc_id, list_distinct(string_split(text, ' ')) AS a,
  list_distinct(string_split(lower(text), ' ')) AS b FROM documents)"""


@query(
    "array_setops",
    f"""SELECT doc_id, len(list_filter(a, lambda x: list_contains(b, x)))::INTEGER AS n_both,
      len(list_filter(a, lambda x: NOT list_contains(b, x)))::INTEGER AS n_only_a,
      len(list_distinct(list_concat(a, b)))::INTEGER AS n_either,
      len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS a_holds_b FROM {_SETS}""",
)
def array_setops(t: Tables) -> DataFrame:
    sets = t.documents.select(
        "doc_id",
        F.array_distinct(F.split("text", " ")).alias("a"),
        F.array_distinct(F.split(F.lower("text"), " ")).alias("b"),
    )
    return sets.select(
        "doc_id",
        F.size(F.array_intersect("a", "b")).alias("n_both"),
        F.size(F.array_except("a", "b")).alias("n_only_a"),
        F.size(F.array_union("a", "b")).alias("n_either"),
        joins.contains_all("a", "b").alias("a_holds_b"),
    )


@query("array_size", "SELECT doc_id, len(string_split(text, ' '))::INTEGER AS n_pieces FROM documents")
def array_size(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(wordcount.pieces(F.col("text"))).alias("n_pieces"))


@query(
    "col_arith",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber + 1 AS plus, l_linenumber - 1 AS minus,
      l_linenumber * 10 AS times, l_linenumber / 5 AS ratio, l_linenumber % 3 AS rest,
      (l_partkey // 7)::BIGINT AS whole, '#' AS mark, CAST(NULL AS VARCHAR) AS nothing,
      CAST(l_linenumber AS VARCHAR) AS text, l_linenumber + 1 - l_linenumber * 10 / 5.0::DOUBLE AS calc FROM lineitem""",
)
def col_arith(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    derived = (
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
        .withColumn("plus", number + 1)
        .withColumn("minus", number - 1)
        .withColumn("times", number * 10)
        .withColumn("ratio", number / 5)
        .withColumn("rest", number % 3)
        .withColumn("whole", F.expr("l_partkey div 7"))
        .withColumn("mark", F.lit("#"))
        .withColumn("nothing", F.lit(None).cast("string"))
    )
    return derived.selectExpr(
        "*", "cast(l_linenumber as string) AS text", "plus - times / cast(5 as double) AS calc"
    )
