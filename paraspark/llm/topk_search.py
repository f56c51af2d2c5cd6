"""Exact top-k inner product search by multi-resolution segment statistics.

A vector is summarised, coarse to fine, by the mean and deviation of its
segments; the summaries bound the inner product from above (so they bound the
distance from below) and a pair whose bound is under the query's threshold,
its k-th best score so far, drops out at the first level that shows it. Exact
products are computed for the survivors only. Queries are dealt into blocks of
bounded size, candidates into slices; see ``segments`` for both.

Defined results: vectors that are NULL or empty or hold a NULL or non-finite
component, and rows with a NULL id, take no part; of rows that share an id the
smallest vector stays; a query meets vectors of its own length only, never its
own id; ties go to the smaller id; fewer than k candidates are all returned; an
empty table gives an empty result; other columns are ignored. Scores are
64-bit integers, exact while the sum of products stays below 2^63.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm import segments as SG
from paraspark.llm.common import checkpointed, key_table, table
from paraspark.plans.registry import register

K = 20
SCALE = 64
QUERY_EVERY = 20


def top_k(rows: DataFrame, query_filter, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows ``query_filter(vec_id)``
    selects as queries, against all rows."""
    spark = rows.sparkSession
    vecs = SG.vectors(rows, id_col, vec_col, F.lit(1), scale)
    vecs = checkpointed(vecs.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.lit(1).cast("long").alias("label"), F.size("v").alias("dim"), "v"))
    queries = vecs.filter(query_filter(F.col("vec_id")))
    dims, _ = key_table(queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SG.ANCHOR_BLOCK).cast("int").alias("n_blocks")))
    block = F.pmod(F.xxhash64("vec_id"), "n_blocks").cast("int")
    # any other row may be a result: queries and candidates differ in the label
    queries = queries.join(dims, "dim").select("vec_id", F.lit(0).cast("long").alias("label"), "dim", "v", block.alias("block"),
                                               F.array(F.lit(-SG.FAR), F.lit(SG.FAR)).alias("bounds"))
    every = vecs.join(dims, "dim").select("vec_id", "label", "dim", "v", F.sequence(F.lit(0), F.col("n_blocks") - 1).alias("blocks"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = SG.dealt(queries, every, k, False, SG.slices_of(vecs.count(), tasks), tasks)
    return SG.best(found, k).select(F.col("anchor_id").alias("query_id"), "rank", "vec_id", "score")


@register("op1_segment_statistics_topk", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}""")
def op1_segment_statistics_topk(spark, d):
    """The 20 best inner products of every twentieth vector."""
    return top_k(table(spark, d, "embeddings"), lambda i: i % QUERY_EVERY == 0)
