"""The SQL-visible functions on whole columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators.wordcount import tokens
from millrace.plans.registry import Tables, query


@query("base64_encode", "SELECT doc_id, CASE WHEN trim(text) <> '' THEN base64(encode(text)) END AS encoded FROM documents")
def base64_encode(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.encode_base64("text").alias("encoded"))


@query(
    "base64_decode",
    """SELECT doc_id, plain AS decoded, plain AS decoded_unpadded, CASE WHEN plain IS NOT NULL THEN 'Base64解密失败' END AS broken,
      CAST(NULL AS VARCHAR) AS blank FROM (SELECT doc_id, CASE WHEN trim(text) <> '' THEN text END AS plain FROM documents)""",
)
def base64_decode(t: Tables) -> DataFrame:
    coded = t.documents.select("doc_id", fn.encode_base64("text").alias("s"))
    return coded.select(
        "doc_id",
        fn.decode_base64("s").alias("decoded"),
        fn.decode_base64(F.rtrim("s", F.lit("="))).alias("decoded_unpadded"),
        fn.decode_base64(F.concat(F.lit("@"), "s")).alias("broken"),
        fn.decode_base64(F.repeat(F.lit(" "), F.length("s"))).alias("blank"),
    )


@query("md5_hex", "SELECT doc_id, CASE WHEN trim(text) <> '' THEN md5(text) END AS digest FROM documents")
def md5_hex(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.encode_md5("text").alias("digest"))


@query(
    "uuid_shape",
    """SELECT lang, count(*) AS n, count(*) AS different, 32 AS shortest, 32 AS longest, true AS all_hex
    FROM documents GROUP BY lang""",
)
def uuid_shape(t: Tables) -> DataFrame:
    named = t.documents.select("lang", fn.uuid32().alias("u"))
    return named.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.countDistinct("u").alias("different"),
        F.min(F.length("u")).alias("shortest"),
        F.max(F.length("u")).alias("longest"),
        F.bool_and(F.col("u").rlike(r"^[0-9a-f]{32}\z")).alias("all_hex"),
    )


# Offsets from the lengths of the pieces between matches, as running totals.
@query(
    "all_in_str",
    """SELECT doc_id, coalesce(string_agg((upto + (i - 1) * 2)::VARCHAR, ',' ORDER BY i)
        FILTER (i < n), '') AS places FROM (
      SELECT doc_id, i, n, sum(length(parts[i])) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
        SELECT doc_id, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS i FROM (
          SELECT doc_id, string_split(text, 'en') AS parts FROM documents)))
    GROUP BY doc_id""",
)
def all_in_str(t: Tables) -> DataFrame:
    places = t.documents.select("doc_id", fn.all_in_str(F.col("text"), F.lit("en")).alias("p"))
    return places.select("doc_id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("places"))


_CARD = """lpad(((c_custkey * 7) % 95)::VARCHAR, 2, '1') || lpad((c_custkey % 9973)::VARCHAR, 4, '0')
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '19' END || lpad((c_custkey % 90 + 10)::VARCHAR, 2, '0')
  || lpad((c_custkey % 14)::VARCHAR, 2, '0') || lpad((c_custkey % 33)::VARCHAR, 2, '0')
  || lpad((c_custkey % 997)::VARCHAR, 3, '0')
  || CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'xx' ELSE substr('0123456789X', (c_custkey % 11 + 1)::INTEGER, 1) END"""
_WEIGHTED = " + ".join(
    f"try_cast(substr(s, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate("7 9 10 5 8 4 2 1 6 3 7 9 10 5 8 4 2".split())
)


@query(
    "id_card_check",
    f"""SELECT c_custkey, s, CASE WHEN length(s) NOT IN (15, 18) THEN -1
      WHEN NOT regexp_full_match(CASE WHEN length(s) = 15 THEN '19' || substr(s, 7, 6) ELSE substr(s, 7, 8) END,
        '[0-9]{{4}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])') THEN -2
      WHEN NOT list_contains(string_split('11 12 13 14 15 21 22 23 31 32 33 34 35 36 37 41 42 43 44 45 46 50 51 52 53 54 61 62 63 64 65 71 81 82 91', ' '), substr(s, 1, 2)) THEN -3
      WHEN length(s) = 15 THEN 0
      WHEN NOT regexp_full_match(substr(s, 1, 17), '[0-9]+') THEN -4
      WHEN substr('10X98765432', ({_WEIGHTED}) % 11 + 1, 1) <> substr(s, 18, 1) THEN -4 ELSE 0 END AS result
    FROM (SELECT c_custkey, {_CARD} AS s FROM customer)""",
)
def id_card_check(t: Tables) -> DataFrame:
    key = F.col("c_custkey")

    def digits(number: Column, width: int, fill: str = "0") -> Column:
        return F.lpad(number.cast("string"), width, fill)

    short = key % 5 == 0
    check = F.substr(F.lit("0123456789X"), (key % 11 + 1).cast("int"), F.lit(1))
    card = F.concat(
        digits(key * 7 % 95, 2, "1"),
        digits(key % 9973, 4),
        F.when(short, "").otherwise("19"),
        digits(key % 90 + 10, 2),
        digits(key % 14, 2),
        digits(key % 33, 2),
        digits(key % 997, 3),
        F.when(short, "").when(key % 17 == 0, "xx").otherwise(check),
    )
    cards = t.customer.select("c_custkey", card.alias("s"))
    return cards.select("c_custkey", "s", fn.check_id_card("s").alias("result"))


@query(
    "distinct_array_size",
    "SELECT doc_id, len(list_distinct(string_split(text, ' ')))::INTEGER AS n FROM documents",
)
def distinct_array_size(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.count_distinct_array(F.split("text", " ")).alias("n"))


@query(
    "explode_str",
    r"""WITH pieces AS (SELECT doc_id, regexp_split_to_array(text, '[,.\n]') AS p FROM documents),
    ends AS (SELECT doc_id, p, CASE WHEN len(p) = 1 THEN 1
      ELSE coalesce(list_max(list_filter(range(1, len(p) + 1), lambda i: p[i] <> '')), 0) END AS n FROM pieces)
    SELECT col, count(*) AS n FROM (SELECT unnest(p[1:n]) AS col FROM ends) GROUP BY col""",
)
def explode_str(t: Tables) -> DataFrame:
    fn.register(t.spark)
    return t.spark.sql(
        r"SELECT e.col, count(*) AS n FROM {docs} d, LATERAL explode_str(d.text, '[,.\n]') e GROUP BY e.col",
        docs=t.documents,
    )


@query(
    "kv_to_json",
    r"""SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","price":'
      || o_totalprice::VARCHAR || ',"note":' || CASE WHEN o_orderpriority = '5-LOW' THEN 'null'
      ELSE '"a\u003cb\u0026c\u003d\u0027' || o_orderpriority || '\u0027"' END || '}' AS j FROM orders""",
)
def kv_to_json(t: Tables) -> DataFrame:
    priority = F.concat(F.lit("a<b&c='"), "o_orderpriority", F.lit("'"))
    note = F.when(F.col("o_orderpriority") != "5-LOW", priority)
    j = fn.kv_to_json(
        "id", "o_orderkey", "status", "o_orderkey", "price", "o_totalprice", "note", note, "status", "o_orderstatus"
    )
    return t.orders.select("o_orderkey", j.alias("j"))


@query(
    "row_to_json",
    """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_totalprice":'
      || o_totalprice::VARCHAR || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' 000"'
      || CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE ',"priority":"' || o_orderpriority || '"' END
      || '}' AS j FROM orders""",
)
def row_to_json(t: Tables) -> DataFrame:
    low = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", low)
    return rows.select("o_orderkey", fn.row_to_json(rows).alias("j"))


@query(
    "json_key_profile",
    """SELECT key, kind, count(*) AS n FROM (
      SELECT unnest(['event_id', 'event_type', 'price', 'props', 'tags', 'extra', 'k']) AS key,
        unnest(['integer', 'string', 'decimal', 'object', 'array',
          CASE WHEN event_type = 'error' THEN 'null' ELSE 'boolean' END, 'integer']) AS kind FROM events)
    GROUP BY key, kind""",
)
def json_key_profile(t: Tables) -> DataFrame:
    extra = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value") > 1)
    whole = F.to_json(
        F.struct(
            "event_id",
            "event_type",
            F.from_json("props", "map<string,int>").alias("props"),
            F.array("user_id").alias("tags"),
            (F.floor("value") + 0.5).alias("price"),
            extra.alias("extra"),
        ),
        {"ignoreNullFields": "false"},
    )
    docs = t.events.select(F.explode(F.array(whole, "props")).alias("j"))
    return fn.value_kinds(docs, "j")


@query(
    "string_fns",
    r"""SELECT doc_id, regexp_replace(text, ' +', ' ', 'g') AS collapsed,
      array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> ''), chr(9)) AS joined,
      trim(upper(source)) AS label, lpad(doc_id::VARCHAR, 8, '0') AS padded, printf('%.2f', n_chars / 4.0) AS quarter,
      regexp_full_match(replace(source, 'src', ''), '[0-9]+') AS numeric FROM documents""",
)
def string_fns(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        F.regexp_replace("text", " +", " ").alias("collapsed"),
        F.array_join(F.filter(tokens("text"), lambda x: x != ""), "\t").alias("joined"),
        F.trim(F.upper("source")).alias("label"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"),
        F.format_string("%.2f", F.col("n_chars") / F.lit(4.0)).alias("quarter"),
        F.replace("source", F.lit("src"), F.lit("")).rlike(r"^[0-9]+\z").alias("numeric"),
    )


@query(
    "regex_fns",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
      array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers, strpos(url, 'example') - 1 AS place,
      contains(html, '<title>') AS titled, regexp_full_match(url, 'https.*') AS secure,
      regexp_extract(html, '(?s)<title>(.*)</title>', 1) AS title,
      len(regexp_extract_all(html, '<a href='))::INTEGER AS links FROM pages""",
)
def regex_fns(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id",
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.array_join(F.regexp_extract_all("url", F.lit("[0-9]+"), 0), ",").alias("numbers"),
        (F.instr("url", "example") - 1).cast("long").alias("place"),
        F.contains("html", F.lit("<title>")).alias("titled"),
        F.col("url").rlike(r"^https.*\z").alias("secure"),
        F.regexp_extract("html", "(?s)<title>(.*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit("<a href="), 0)).alias("links"),
    )


@query(
    "date_fns",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(ts AS DATE) + 7 AS next_week,
      strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS earlier, epoch_us(ts) // 1000000 AS seconds,
      epoch_us(ts) // 1000 AS millis, strftime(make_timestamp(epoch_us(ts)) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at_plus_8
    FROM events""",
)
def date_fns(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    millis = F.unix_millis(ts)
    plus_8 = F.convert_timezone(F.lit("UTC"), F.lit("+08:00"), F.timestamp_millis(millis).cast("timestamp_ntz"))
    return t.events.select(
        "event_id",
        F.substring(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), 1, 10).alias("day"),
        F.date_add(F.to_date("ts"), 7).alias("next_week"),
        F.date_format(F.col("ts") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("earlier"),
        F.unix_seconds(ts).alias("seconds"),
        millis.alias("millis"),
        F.date_format(plus_8, "yyyy-MM-dd HH:mm:ss").alias("at_plus_8"),
    )
