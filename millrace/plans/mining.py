"""Baskets, itemsets, rules; clusters and neighbours."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import combinations, subset_rows
from millrace.mining import baskets, itemsets, rules
from millrace.operators import clusters, neighbours, pivots
from millrace.plans.registry import Tables, query
from millrace.session import written

# p_type has few values in many baskets, p_brand more values in fewer.
TYPE_SUPPORT = 0.1
BRAND_SUPPORT = 0.02

_TYPE_PAIRS = "SELECT DISTINCT l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON p_partkey = l_partkey"
_BRAND_PAIRS = _TYPE_PAIRS.replace("p_type", "p_brand")

# Every basket as a bit mask over the item types; a set is held where its bits all are.
_MASKS = f"""
pairs AS ({_TYPE_PAIRS}),
codes AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS bit FROM (SELECT DISTINCT item FROM pairs)),
masks AS (SELECT tid, bit_or((1 << bit)::BIGINT) AS mask FROM pairs JOIN codes USING (item) GROUP BY tid),
total AS (SELECT count(*) AS n FROM masks),
sets AS (SELECT s, string_agg(item, ',' ORDER BY item) AS frequent_set, count(*) AS k
  FROM (SELECT unnest(range(1, (1 << (SELECT count(*) FROM codes))::BIGINT)) AS s), codes
  WHERE s & (1 << bit)::BIGINT <> 0 GROUP BY s),
weights AS (SELECT mask, count(*) AS w FROM masks GROUP BY mask),
counts AS (SELECT s, frequent_set, k, sum(w)::BIGINT AS num FROM sets JOIN weights ON mask & s = s GROUP BY ALL),
frequent AS (SELECT *, (SELECT n FROM total) AS row_num FROM counts
  WHERE num >= ceil({TYPE_SUPPORT} * (SELECT n FROM total) - 1e-9))"""


def type_baskets(t: Tables) -> DataFrame:
    """Per order, the different part types in it."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return baskets.baskets_of(t.lineitem.select("l_orderkey", "l_partkey").join(parts, "l_partkey"), "l_orderkey", "p_type")


def brand_baskets(t: Tables) -> DataFrame:
    """Per order, the different brands in it."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return baskets.baskets_of(t.lineitem.select("l_orderkey", "l_partkey").join(parts, "l_partkey"), "l_orderkey", "p_brand")


def type_itemsets(t: Tables) -> DataFrame:
    return itemsets.frequent_itemsets(type_baskets(t), TYPE_SUPPORT, min_size=1)


@query(
    "basket_clean",
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(s, ','), lambda x:
      NOT regexp_full_match(x, '[\x00-\x20]*') AND lower(x) <> 'null'))), '|') AS items
    FROM (SELECT doc_id, text || ',,null, NULL , ,' || source || ',' || lang || ',' || source AS s FROM documents)""",
)
def basket_clean(t: Tables) -> DataFrame:
    dirty = F.concat("text", F.lit(",,null, NULL , ,"), "source", F.lit(","), "lang", F.lit(","), "source")
    rows = t.documents.select("doc_id", dirty.alias("s"))
    return rows.select("doc_id", F.array_join(baskets.split_items("s"), "|").alias("items"))


@query(
    "baskets",
    f"SELECT tid AS l_orderkey, string_agg(item, ',' ORDER BY item) AS items FROM ({_BRAND_PAIRS}) GROUP BY tid",
)
def brand_lists(t: Tables) -> DataFrame:
    return brand_baskets(t).select("l_orderkey", F.array_join("items", ",").alias("items"))


@query(
    "top_baskets",
    f"""SELECT items, n_items FROM (SELECT string_agg(item, ',' ORDER BY item) AS items, list(item ORDER BY item) AS l,
      count(*)::INTEGER AS n_items FROM ({_BRAND_PAIRS}) GROUP BY tid) ORDER BY n_items DESC, l LIMIT 5""",
)
def top_baskets(t: Tables) -> DataFrame:
    return baskets.longest(brand_baskets(t)).select(F.array_join("items", ",").alias("items"), "n_items")


@query(
    "itemset_l1",
    f"""WITH pairs AS ({_BRAND_PAIRS}), total AS (SELECT count(DISTINCT tid) AS n FROM pairs)
    SELECT item, count(*) AS num FROM pairs GROUP BY item
    HAVING count(*) >= ceil({BRAND_SUPPORT} * (SELECT n FROM total) - 1e-9)""",
)
def itemset_l1(t: Tables) -> DataFrame:
    found = written(brand_baskets(t), "brand-baskets")
    return itemsets.single_items(found, itemsets.needed(BRAND_SUPPORT, found.count()))


@query(
    "prune_items",
    f"""WITH pairs AS ({_BRAND_PAIRS}), kept AS (SELECT item FROM pairs GROUP BY item HAVING count(*) >= 1800 * (SELECT count(*) FROM part) / 2000)
    SELECT tid AS l_orderkey, string_agg(item, ',' ORDER BY item) AS items FROM pairs JOIN kept USING (item)
    GROUP BY tid HAVING count(*) >= 3""",
)
def prune_items(t: Tables) -> DataFrame:
    found = written(brand_baskets(t), "brand-baskets")
    often = itemsets.single_items(found, -(-1800 * t.part.count() // 2000))
    pruned = baskets.only_items(found, often, "l_orderkey", at_least=3)
    return pruned.select("l_orderkey", F.array_join("items", ",").alias("items"))


@query("apriori_k", f"WITH {_MASKS} SELECT frequent_set, k::INTEGER AS k, num, row_num, num / row_num AS support FROM frequent WHERE k >= 2")
def apriori_k(t: Tables) -> DataFrame:
    found = itemsets.frequent_itemsets(type_baskets(t), TYPE_SUPPORT)
    return itemsets.as_report(found).drop("etl_time")


@query(
    "apriori_strict",
    f"""WITH {_MASKS} SELECT frequent_set, k::INTEGER AS k, num FROM counts
    WHERE num > {TYPE_SUPPORT} * (SELECT n FROM total)""",
)
def apriori_strict(t: Tables) -> DataFrame:
    found = itemsets.frequent_itemsets(type_baskets(t), TYPE_SUPPORT, min_size=1, strict=True)
    return found.select(F.array_join("items", ",").alias("frequent_set"), "k", "num")


@query(
    "apriori_pairs",
    f"""WITH pairs AS ({_BRAND_PAIRS}), total AS (SELECT ceil({BRAND_SUPPORT} * count(DISTINCT tid) - 1e-9) AS n FROM pairs),
    two AS (SELECT a.item AS a, b.item AS b, count(*) AS num FROM pairs a JOIN pairs b ON a.tid = b.tid AND a.item < b.item
      GROUP BY 1, 2 HAVING count(*) >= (SELECT n FROM total)),
    held AS (SELECT x.tid, a, b FROM two JOIN pairs x ON x.item = a JOIN pairs y ON y.item = b AND y.tid = x.tid),
    three AS (SELECT a, b, c.item AS c, count(*) AS num FROM held JOIN pairs c ON c.tid = held.tid AND c.item > b
      GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT n FROM total)),
    four AS (SELECT t.a, t.b, t.c, d.item AS d, count(*) AS num FROM three t JOIN held h ON h.a = t.a AND h.b = t.b
      JOIN pairs c ON c.tid = h.tid AND c.item = t.c JOIN pairs d ON d.tid = h.tid AND d.item > t.c
      GROUP BY 1, 2, 3, 4 HAVING count(*) >= (SELECT n FROM total))
    SELECT a || ',' || b AS frequent_set, num FROM two UNION ALL SELECT a || ',' || b || ',' || c, num FROM three
    UNION ALL SELECT a || ',' || b || ',' || c || ',' || d, num FROM four""",
)
def apriori_pairs(t: Tables) -> DataFrame:
    """All frequent brand sets; the SQL goes to sets of four, and a fifth would show as a difference."""
    found = itemsets.frequent_itemsets(brand_baskets(t), BRAND_SUPPORT)
    return found.select(F.array_join("items", ",").alias("frequent_set"), "num")


@query("fp_growth", f"WITH {_MASKS} SELECT frequent_set, k::INTEGER AS k, num FROM frequent WHERE k >= 2")
def fp_growth(t: Tables) -> DataFrame:
    found, _ = itemsets.fp_growth(type_baskets(t), TYPE_SUPPORT)
    return found.select(F.array_join("items", ",").alias("frequent_set"), "k", "num")


_RULES = f"""{_MASKS},
rules AS (SELECT a.s AS left_bits, c.item AS consequent, a.frequent_set AS antecedent, b.num / a.num AS confidence, b.num
  FROM frequent b JOIN codes c ON b.s & (1 << c.bit)::BIGINT <> 0
  JOIN frequent a ON a.s = b.s - (1 << c.bit)::BIGINT WHERE b.num / a.num >= 0.4)"""


@query(
    "assoc_rules",
    f"""WITH {_RULES} SELECT antecedent, consequent, round(confidence, 9) AS confidence, r.num AS num,
      round(confidence * row_num / f.num, 9) AS lift FROM rules r JOIN frequent f ON f.frequent_set = r.consequent""",
)
def assoc_rules(t: Tables) -> DataFrame:
    found = type_itemsets(t)
    listed = rules.with_lift(rules.association_rules(found, 0.4), found)
    return listed.select(
        F.array_join("antecedent", ",").alias("antecedent"),
        "consequent",
        F.round("confidence", 9).alias("confidence"),
        "num",
        F.round("lift", 9).alias("lift"),
    )


@query(
    "rule_predict",
    f"""WITH {_RULES}, hits AS (SELECT DISTINCT m.mask, r.consequent FROM weights m JOIN rules r ON m.mask & r.left_bits = r.left_bits
      JOIN codes c ON c.item = r.consequent WHERE m.mask & (1 << c.bit)::BIGINT = 0),
    told AS (SELECT mask, string_agg(consequent, ',' ORDER BY consequent) AS prediction FROM hits GROUP BY mask)
    SELECT tid AS l_orderkey, coalesce(prediction, '') AS prediction FROM masks LEFT JOIN told USING (mask)""",
)
def rule_predict(t: Tables) -> DataFrame:
    stored = written(type_baskets(t), "type-baskets")
    found = itemsets.frequent_itemsets(stored, TYPE_SUPPORT, min_size=1)
    told = rules.predict(stored, rules.association_rules(found, 0.4))
    return told.select("l_orderkey", F.array_join("prediction", ",").alias("prediction"))


@query(
    "maximal_sets",
    f"""WITH {_MASKS} SELECT frequent_set, k::INTEGER AS k, num FROM frequent f
    WHERE NOT EXISTS (SELECT 1 FROM frequent g WHERE g.s & f.s = f.s AND g.s <> f.s)""",
)
def maximal_sets(t: Tables) -> DataFrame:
    found = itemsets.maximal(type_itemsets(t))
    return found.select(F.array_join("items", ",").alias("frequent_set"), "k", "num")


@query(
    "contain_join",
    f"""WITH {_MASKS} SELECT c.frequent_set AS candidate, c.num AS n FROM counts c JOIN weights w ON w.mask = c.s WHERE c.k = 3""",
)
def contain_join(t: Tables) -> DataFrame:
    found = type_baskets(t)
    candidates = found.where(F.size("items") == 3).select(F.col("items").alias("candidate")).distinct()
    counted = baskets.containing(found, candidates)
    return counted.select(F.array_join("candidate", ",").alias("candidate"), "n")


@query(
    "array_combos",
    f"""WITH {_MASKS} SELECT frequent_set AS combo, num AS n FROM counts WHERE k = 3""",
)
def array_combos(t: Tables) -> DataFrame:
    combos = type_baskets(t).select(F.explode(combinations("items", 3)).alias("combo"))
    return combos.groupBy(F.array_join("combo", ",").alias("combo")).agg(F.count("*").alias("n"))


@query("array_subsets", f"WITH {_MASKS} SELECT frequent_set AS subset, num AS n FROM counts")
def array_subsets(t: Tables) -> DataFrame:
    parts = subset_rows(type_baskets(t), "items")
    return parts.groupBy(F.array_join("subset", ",").alias("subset")).agg(F.count("*").alias("n"))


@query(
    "kmeans",
    """WITH dims AS (SELECT vec_id, label, unnest(range(1, 65)) AS d, unnest(embedding) AS x FROM embeddings),
    means AS (SELECT label, list(m ORDER BY d) AS center FROM (SELECT label, d, avg(x::DOUBLE) AS m FROM dims GROUP BY label, d) GROUP BY label),
    near AS (SELECT vec_id, m.label AS centre, sqrt(list_sum(list_transform(list_zip(center, embedding::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2))) AS distance
      FROM means m, embeddings e),
    own AS (SELECT vec_id, centre FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, centre) AS rn FROM near) WHERE rn = 1),
    moved AS (SELECT centre, d, avg(x::DOUBLE) AS m FROM own JOIN dims USING (vec_id) GROUP BY centre, d)
    SELECT centre::BIGINT AS cluster, (SELECT count(*) FROM own o WHERE o.centre = c.centre) AS n, round(sum(m), 6) AS total, round(sum(m * m), 6) AS squares
    FROM moved c GROUP BY centre""",
)
def kmeans(t: Tables) -> DataFrame:
    """One step from the label means: points go to the nearest mean, and each cluster has a new one."""
    centres = neighbours.centroids(t.embeddings, "embedding", "label").withColumnRenamed("label", "centre_id")
    centres = centres.withColumn("centre_id", F.col("centre_id").cast("long"))
    own = written(neighbours.assigned(t.embeddings, centres, "embedding", "vec_id", "label"), "assigned")
    moved = neighbours.centroids(t.embeddings.join(own.select("vec_id", "centre_id"), "vec_id"), "embedding", "centre_id")
    sizes = own.groupBy("centre_id").agg(F.count("*").alias("n"))
    total = lambda f: F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + f(x)), 6)
    return moved.join(sizes, "centre_id").select(
        F.col("centre_id").alias("cluster"), "n", total(lambda x: x).alias("total"), total(lambda x: x * x).alias("squares")
    )


LLOYD_STEPS = 4


def _lloyd_sql(steps: int) -> str:
    """Lloyd steps as a chain of tables, from the six vectors of smallest id."""
    apart = "list_sum(list_transform(list_zip(v, x), lambda z: (z[1] - z[2]) ** 2))"
    chain = [
        "p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)",
        "c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, x AS v FROM p ORDER BY vec_id LIMIT 6)",
    ]
    for step in range(steps + 1):
        chain.append(f"""a{step} AS MATERIALIZED (SELECT vec_id, x, c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rn
            FROM (SELECT vec_id, x, c, {apart} AS d FROM p, c{step})) WHERE rn = 1)""")
        chain.append(f"""m{step} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, avg(x[i]) AS m FROM a{step}, (SELECT unnest(range(1, 65)) AS i)
            GROUP BY c, i) GROUP BY c)""")
        chain.append(f"c{step + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{step} o LEFT JOIN m{step} m USING (c))")
    return f"WITH {', '.join(chain)} SELECT vec_id, c::INTEGER AS cluster FROM a{steps}"


@query("kmeans_lloyd", _lloyd_sql(LLOYD_STEPS))
def kmeans_lloyd(t: Tables) -> DataFrame:
    first = t.embeddings.orderBy("vec_id").limit(6).select("embedding").collect()
    found = clusters.fit(t.embeddings, "embedding", np.array([r[0] for r in first], dtype=np.float64), most_steps=LLOYD_STEPS)
    return clusters.assign(t.embeddings, "embedding", "vec_id", found.centres).select("vec_id", "cluster")


@query("kmeans_fit")
def kmeans_fit(t: Tables) -> DataFrame:
    """Spark ML's k-means to the end; its seeding has no SQL."""
    return neighbours.kmeans(t.embeddings, "embedding", k=10).groupBy("cluster").agg(
        F.count("*").alias("n"), F.countDistinct("label").alias("labels")
    )


_NEAREST = """WITH dims AS (SELECT label, unnest(range(1, 65)) AS d, unnest(embedding) AS x FROM embeddings),
    means AS (SELECT label AS query_id, list(m ORDER BY d) AS center
      FROM (SELECT label, d, avg(x::DOUBLE) AS m FROM dims GROUP BY label, d) GROUP BY label),
    near AS (SELECT query_id, vec_id, label,
        sqrt(list_sum(list_transform(list_zip(center, embedding::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2))) AS distance
      FROM means, embeddings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM near)"""


@query(
    "knn_topk",
    f"""{_NEAREST} SELECT query_id, vec_id, label, round(distance, 6) AS distance, rn::INTEGER AS rn FROM ranked WHERE rn <= 10""",
)
def knn_topk(t: Tables) -> DataFrame:
    centers = neighbours.centroids(t.embeddings, "embedding", "label").withColumnRenamed("label", "query_id")
    found = neighbours.nearest(t.embeddings, centers, 10, "embedding", "vec_id", "label")
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "knn_pivots",
    f"""{_NEAREST} SELECT query_id, vec_id, label, round(distance, 6) AS distance, rn::INTEGER AS rn FROM ranked WHERE rn <= 10""",
)
def knn_pivots(t: Tables) -> DataFrame:
    """The same neighbours through blocks around pivots."""
    centers = neighbours.centroids(t.embeddings, "embedding", "label").withColumnRenamed("label", "query_id")
    found = pivots.nearest(t.embeddings, centers, 10, "embedding", "vec_id", "label")
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "knn_vote",
    f"""{_NEAREST}, votes AS (SELECT query_id, label, count(*) AS votes FROM ranked WHERE rn <= 10 GROUP BY query_id, label)
    SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS place FROM votes)
    WHERE place = 1""",
)
def knn_vote(t: Tables) -> DataFrame:
    centers = neighbours.centroids(t.embeddings, "embedding", "label").withColumnRenamed("label", "query_id")
    return neighbours.vote(neighbours.nearest(t.embeddings, centers, 10, "embedding", "vec_id", "label"), "label")
