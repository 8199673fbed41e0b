"""Sources and sinks on small fixtures."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import connectors, files, jdbc, schema, sync, tables

TYPES = (
    "flag boolean, t tinyint, s smallint, i int, l bigint, f float, d double, m decimal(38,4), txt string,"
    " raw binary, ts timestamp, day date, arr array<int>, map map<string,int>, st struct<a:int,b:string>"
)


@pytest.fixture
def matrix(spark):
    row = (
        True, 1, 2, 3, 4, 0.5, 0.25, Decimal("1.2345"), "x", bytearray(b"abc"),
        datetime(2020, 1, 2, 3, 4, 5), date(2020, 1, 2), [1, 2], {"k": 1}, (1, "b"),
    )
    return spark.createDataFrame([row], T.StructType.fromDDL(TYPES))


def test_olap_types(matrix):
    columns = schema.olap_columns(matrix)
    assert columns["flag"] == "boolean"
    assert columns["s"] == columns["i"] == "Nullable(int)" and columns["l"] == "Nullable(bigint)"
    assert columns["m"] == "Nullable(decimal(38,4))" and columns["ts"] == "Nullable(timestamp)"
    assert {columns[c] for c in ("txt", "raw", "arr", "map", "st")} == {"Nullable(String)"}
    ddl = schema.olap_ddl(matrix.select("i", "d"), "db.t")
    assert ddl == "CREATE TABLE IF NOT EXISTS db.t (`i` int, `d` Nullable(double)) ENGINE = MergeTree() ORDER BY `i`"


def test_search_fields(matrix):
    fields = {f["name"]: f["type"] for f in schema.search_fields(matrix.withColumnRenamed("l", "id"))}
    assert "id" not in fields
    assert (fields["i"], fields["m"], fields["day"], fields["txt"], fields["arr"]) == (
        "pint", "pdouble", "pdate", "text_general", "text_general",
    )


def test_flat_for_sink(matrix):
    flat = schema.flat_for_sink(matrix, decimals_as_double=True)
    row = flat.head()
    assert (row.arr, row.map, row.st, row.raw, row.m) == ("[1,2]", '{"k":1}', '{"a":1,"b":"b"}', "YWJj", 1.2345)
    assert flat.schema["m"].dataType == T.DoubleType()
    many = schema.with_document_columns(matrix.sparkSession.range(50).withColumnRenamed("id", "n"))
    assert many.select("id").distinct().count() == 50 and many.where("dt IS NULL").count() == 0
    assert schema.with_document_columns(many).columns == many.columns


def test_declared_schema():
    declared = "rowkey:id:string; f1:name:string; f2:english:int; f2:chinese:decimal(38,3); f2:plain:decimal"
    columns = schema.parse_cell_schema(declared)
    assert [c.name for c in columns] == ["rowkey_id", "f1_name", "f2_english", "f2_chinese", "f2_plain"]
    assert columns[3].type == T.DecimalType(38, 3) and columns[4].type == T.DoubleType()
    with pytest.raises(ValueError, match="row key"):
        schema.parse_cell_schema("f1:a:int")


def test_export_text(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a\tb\nc\rd", None, 1.5), (2, "q\x01r", "", None), (3, '"x"', "\\", -2.0)], "id int, txt string, e string, d double"
    )
    lines = [r.value for r in files.export_lines(rows).collect()]
    assert lines[0] == "1\ta b c d\t\\N\t1.5" and lines[2] == '3\t"x"\t\\\t-2.0'
    assert [r.value for r in files.export_lines(rows, files.CTRL_A).collect()][1] == "2\x01qr\x01\x01\\N"
    for sep in (files.TAB, files.CTRL_A):
        path = str(tmp_path / f"out{ord(sep)}")
        files.export_text(rows, path, sep)
        files.export_text(rows, path, sep)
        back = files.read_export(spark, path, "id int, txt string, e string, d double", sep).orderBy("id").collect()
        assert [tuple(r)[2:] for r in back] == [(None, 1.5), ("", None), ("\\", -2.0)]
        assert back[0].txt == "a b c d" and back[2].txt == '"x"'


def test_null_text_is_no_null(spark, tmp_path):
    rows = [(1, "\\N"), (2, None), (3, "\\\\N"), (4, ""), (5, "x\\N")]
    files.export_text(spark.createDataFrame(rows, "id int, txt string"), str(tmp_path / "n"))
    assert sorted(map(tuple, files.read_export(spark, str(tmp_path / "n"), "id int, txt string").collect())) == rows


def test_csv_and_json(spark, tmp_path):
    rows = spark.createDataFrame(
        [(datetime(2020, 1, 2, 3, 4, 5), 'say "hi", ok', 1.5), (None, None, None)], "ts timestamp, txt string, d double"
    )
    files.write_csv(rows, str(tmp_path / "csv"), timestamps="yyyy/MM/dd HH:mm")
    text = "".join(sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect()))
    assert "2020/01/02 03:04" in text and "ts,txt,d" in text
    back = files.read_csv(spark, str(tmp_path / "csv"), "ts string, txt string, d double")
    assert {tuple(r) for r in back.collect()} == {("2020/01/02 03:04", 'say "hi", ok', 1.5), (None, None, None)}
    odd = [(1, 'say "hi", you'), (2, "two\nlines"), (3, ""), (4, None), (5, '"'), (6, "\\"), (7, ',",\n"'), (8, " blanks ")]
    files.write_csv(spark.createDataFrame(odd, "id int, txt string"), str(tmp_path / "odd"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "odd"), "id int, txt string").collect())) == odd

    sample = [{"dt": "2021-01-01", "name": "张三", "amount": "40.5", "qty": "7"}, {"dt": "2021-01-02", "name": "mark", "amount": "1", "qty": "2"}]
    (tmp_path / "t.json").write_text(json.dumps(sample, indent=2, ensure_ascii=False), encoding="utf-8")
    found = files.read_json(spark, str(tmp_path / "t.json"), "dt string, name string, amount string, qty string", multi_line=True)
    assert sorted(r.name for r in found.collect()) == ["mark", "张三"]


def test_sorted_pairs_are_in_order_over_all_files(spark, tmp_path):
    rows = spark.range(1000).select(F.hex("id").alias("k"), F.col("id").alias("v"))
    files.write_sorted_pairs(rows, str(tmp_path / "pairs"), "k", "v")
    parts = sorted((tmp_path / "pairs").glob("part-*"))
    keys = [line.split("\t")[0] for part in parts for line in part.read_text().splitlines()]
    assert keys == sorted(keys) and len(keys) == 1000


def test_table_writes(spark, tmp_path):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    tables.create_table(spark, "t_people", {"id": "int", "name": "string"}, comment="who's who", path=str(tmp_path / "p"))
    tables.replace_rows(people.select("name", "id"), "t_people")
    tables.replace_rows(people.select("name", "id"), "t_people")
    assert sorted(map(tuple, tables.scan(spark, "t_people").collect())) == [(1, "a"), (2, "b")]
    assert tables.column_listing(spark.table("t_people")) == [("id", "int", ""), ("name", "string", "")]
    assert "t_people" in tables.table_names(spark)

    tables.save_with_columns(people, "t_more", str(tmp_path / "m"), twice="id * 2", etl_time="now()")
    tables.save_with_columns(people, "t_more", str(tmp_path / "m"), twice="id * 2")
    assert sorted(r.twice for r in spark.table("t_more").collect()) == [2, 4]
    own = spark.table("t_more").select("id", "name")
    tables.save_with_columns(own, "t_more", str(tmp_path / "m"), twice="id * 2")
    assert sorted(r.twice for r in spark.table("t_more").collect()) == [2, 4]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        tables.save_with_columns(own, "t_more", str(tmp_path / "m"), twice="id / 0")
    assert spark.table("t_more").count() == 2
    tables.save_table(people.selectExpr("id", "name", "id * 2 AS twice"), "t_more", mode="append")
    assert spark.table("t_more").count() == 4

    (tmp_path / "rows.txt").write_text("7\tx\n8\t\\N\n")
    tables.load_file(spark, str(tmp_path / "rows.txt"), "t_people")
    assert sorted(map(tuple, spark.table("t_people").collect())) == [(7, "x"), (8, None)]
    for name in ("t_people", "t_more"):
        spark.sql(f"DROP TABLE {name}")


def test_database_tables_and_partitions(spark, tmp_path):
    tables.create_table(spark, "side_db.t", {"id": "int", "dt": "string"}, partitioned_by=["dt"], path=str(tmp_path / "t"))
    spark.sql("INSERT INTO side_db.t VALUES (1, 'x'), (2, 'y')")
    assert tables.scan(spark, "side_db.t", "id").where("dt = 'y'").head().id == 2
    spark.sql("DROP TABLE side_db.t")
    spark.sql("DROP DATABASE side_db")


def test_views_and_parameters(spark):
    rows = spark.createDataFrame([(1, "it's"), (2, "b")], "id int, name string")
    assert spark.table(tables.publish_view(rows, "v_local")).count() == 2
    assert spark.newSession().table(tables.publish_view(rows, "v_all", across_sessions=True)).count() == 2
    found = tables.query(spark, "SELECT id FROM {rows} WHERE name = :name", {"name": "it's"}, rows=rows)
    assert [r.id for r in found.collect()] == [1]
    assert tables.scan_column(spark, "v_local", "name").columns == ["items"]


def test_documents_and_envelopes(spark):
    rows = spark.createDataFrame([(1, "x", None)], "id int, name string, gone string")
    assert connectors.documents(rows, {"id": "key", "name": "label"}).head().doc == '{"key":1,"label":"x"}'
    assert connectors.add_envelopes(rows).head().doc == '{"add":{"overwrite":true,"doc":{"id":1,"name":"x"}}}'
    assert tuple(connectors.as_messages(rows, "id").head()) == ("1", '{"id":1,"name":"x"}')


def test_batches(spark, tmp_path):
    docs = spark.range(105).select(F.to_json(F.struct("id")).alias("doc"))
    connectors.write_batches(docs, str(tmp_path / "out"), batch_size=10, writers=2)
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("part-*")]
    assert sum(sizes) == 105 and max(sizes) == 10

    folder = str(tmp_path / "sent")
    (tmp_path / "sent").mkdir()

    def send(batch):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as out:
            out.write("\n".join(batch))

    connectors.push_batches(docs, send, batch_size=20, writers=2)
    sent = [p.read_text().splitlines() for p in (tmp_path / "sent").iterdir()]
    assert sum(map(len, sent)) == 105 and max(map(len, sent)) == 20
    assert len({d for batch in sent for d in batch}) == 105


def test_connector_options():
    assert connectors.kafka_options("h:9092", ["a", "b"]) == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "a,b", "startingOffsets": "latest",
    }
    assert json.loads(connectors.kafka_options("h", ["a"], {"a": {0: 5, 1: 7}})["startingOffsets"]) == {"a": {"0": 5, "1": 7}}
    assert connectors.search_options("h", "c")["query"] == "*:*"


def test_jdbc_options():
    options = jdbc.table_options("jdbc:x", "t", user="u", split_by=("id", "1", "100", 4))
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id" and "password" not in options
    split = jdbc.query_options("jdbc:x", "select 1", split_by=("id", "1", "9", 3))
    assert split["dbtable"] == "(select 1) t" and split["partitionColumn"] == "id" and "query" not in split
    query = jdbc.query_options("jdbc:x", "select 1", user="u")
    assert query["query"] == "select 1" and "dbtable" not in query


def test_append_counts_what_it_writes(spark, tmp_path):
    path = tmp_path / "t"
    for expected in (40, 80):
        assert jdbc.append(spark.range(40), {"path": str(path)}, writers=3, fmt="parquet") == 40
        assert spark.read.parquet(str(path)).count() == expected
    assert len(list(path.glob("part-*"))) == 6


def test_generic_connector_and_sync(spark, tmp_path):
    path = str(tmp_path / "t")
    n = sync.sync(spark.range(10), lambda rows: connectors.write(rows, "parquet", path), lambda rows: rows.where("id > 3"))
    assert n == 6 and connectors.read(spark, "parquet", path).count() == 6


def test_ddl_carries_comments_and_databases_are_listed(spark):
    df = spark.createDataFrame([(1, "a")], "k long COMMENT 'it''s the key', plain string")
    assert schema.olap_ddl(df, "db.t").startswith("CREATE TABLE IF NOT EXISTS db.t (`k` bigint COMMENT 'it\\'s the key', `plain` Nullable(String))")
    assert "default" in tables.database_names(spark)
