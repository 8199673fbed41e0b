"""Queries on tables where one key, or copies of one row, make up a third of the rows."""

import duckdb
import pytest

from oracle import TABLES, connect, differences

SOURCE = "/root/testdata/sf0.001"

# What a third of the rows gets instead; every column keeps its type.
HOT = {
    "lineitem": "l_orderkey = CASE WHEN n % 3 = 0 THEN 7 ELSE l_orderkey END, l_partkey = CASE WHEN n % 5 = 0 THEN 11 ELSE l_partkey END",
    "orders": "o_custkey = CASE WHEN n % 3 = 0 THEN 5 ELSE o_custkey END",
    "part": "p_type = CASE WHEN n % 3 = 0 THEN 'LARGE' ELSE p_type END",
    "documents": f"text = CASE WHEN n % 3 = 0 THEN (SELECT text FROM '{SOURCE}/documents.parquet' WHERE doc_id = 5) ELSE text END",
    "events": "event_type = CASE WHEN n % 3 = 0 THEN 'click' ELSE event_type END, ts = CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-05 10:00:00' ELSE ts END",
    "embeddings": f"embedding = CASE WHEN n % 3 = 0 THEN (SELECT embedding FROM '{SOURCE}/embeddings.parquet' WHERE vec_id = 3) ELSE embedding END",
    "conversations": "conv_id = CASE WHEN n % 3 = 0 THEN 3 ELSE conv_id END, turn = CASE WHEN n % 3 = 0 THEN 1000 + n ELSE turn END",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder, db = str(tmp_path_factory.mktemp("skewed")), duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE TABLE t AS SELECT row_number() OVER () AS n, * FROM '{SOURCE}/{name}.parquet'")
        if name in HOT:
            db.execute(f"UPDATE t SET {HOT[name]}")
        db.execute(f"COPY (SELECT * EXCLUDE n FROM t) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        db.execute("DROP TABLE t")
    return folder, connect(folder)


@pytest.mark.parametrize(
    "name",
    "daily_agg multi_key_having wordcount_tok shuffle_join anti_join topn_group secondary_sort kv_map_pivot upsert_latest"
    " apriori_k rule_predict maximal_sets top_baskets knn_topk log_sessions cdc_apply stream_per_arrival"
    " stream_window_top5".split(),
)
def test_query_on_skewed_tables(spark, skewed, name):
    folder, db = skewed
    assert differences(spark, db, name, folder) is None
