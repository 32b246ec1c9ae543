"""op7: the 20 nearest by integer inner product of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.sources.tables import table

from . import vector_search


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    # floor() on doubles gives a long; components that are null or not finite stay so and take their row out
    v = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x.cast("double")).otherwise(F.floor(x.cast("double") * 64.0).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("embedding"))
    got = vector_search.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)
    return got.withColumn("score", F.col("score").cast("long"))


QUERIES = {"op7_vector_search": op7_vector_search}
ORACLES = {
    "op7_vector_search": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
